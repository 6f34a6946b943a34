"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import components, exact_dedup, language_id, line_dedup, minhash_dedup, mixing, quality_classifier, quality_rules, sentencepiece_codec, sharding

SCHEMA = "doc_id long, text string, lang string, source string, score double, n int, keep_id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = ["alpha", "beta", "Gamma", "delta", "É", "zeta", "eta", "theta", "iota", "kappa", "la", "le", "der", "die", "und", "###", "x!"]


def texts() -> list:
    rng = random.Random(5)
    line = "A line that is quite long and found in many of the documents here"
    base = [rng.choice(VOCABULARY) for _ in range(60)]
    out = [None, "", "   ", "\n\n", "one", "one two", "ONE two", "one two", "É two", "é two", "x" * 5000, " ".join(base * 40)]
    for k in range(12):
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(60)] = rng.choice(VOCABULARY) + str(rng.randrange(9))
        out.append(" ".join(words))
    out += [f"start {k}\n  {line if k % 2 else line.upper()}\t\nend {k}\n{line}" for k in range(7)]
    out += [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(3, 80))) for _ in range(40)]
    return out


@pytest.fixture(scope="module")
def rows():
    langs, sources = ["en", "fr", None], ["b", None, "a", "ünï", "a"]
    return [(i, t, langs[i % 3], sources[i % 5], 0.5, 1, "k") for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(spark, rows, docs, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_groups(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, "b")], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_groups(twice).collect())
    assert out == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_cuckoo_filter_inserts_deletes_and_grows():
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    index = exact_dedup.CuckooFilter(4)
    numbers = {k: index.insert(k) for k in keys}
    assert index.size > 4 and all(index.find(k) == n for k, n in numbers.items())
    for k in keys[::2]:
        assert index.delete(k) >= 0 and index.find(k) == -1 and index.delete(k) == -1
    assert all(index.find(k) >= 0 for k in keys[1::2])
    live = [(s, n) for s, n in enumerate(index.slots) if n >= 0]
    again = exact_dedup.CuckooFilter.restored([index.keys[n] for _, n in live], [s for s, _ in live], index.size)
    assert all(again.find(k) >= 0 for k in keys[1::2]) and all(again.find(k) == -1 for k in keys[::2])


def test_cuckoo_index_over_batches(spark):
    digest = lambda x: hashlib.sha256(x.encode()).digest()
    table = lambda pairs: spark.createDataFrame([(i, digest(x)) for i, x in pairs], "doc_id long, digest binary")
    index = exact_dedup.CuckooIndex(spark, 4)
    index.insert(table([(1, "a"), (2, "b"), (3, "a")]))
    index.insert(table([(9, "b"), (4, "c")]))
    index.delete(table([(0, "a"), (0, "unknown")]))
    got = {r.doc_id: (r.keep_id, r.n) for r in index.lookup(table([(1, "a"), (2, "b"), (3, "c")])).collect()}
    assert got == {1: (None, None), 2: (9, 2), 3: (4, 1)}


def test_line_dedup(rows, docs, empty):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    frequent = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    assert frequent
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if frequent.get(key(x), i) == i]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_repeated_ids(spark):
    line = "a line of more than forty characters that is repeated"
    table = lambda ids: spark.createDataFrame([(i, f"{k}\n{line}") for k, i in enumerate(ids)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(table([1, 1, 1, 1, 2, None])).collect()} == {0}
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(table([1, 1, 2, 3, 4, 5, 5])).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (5, 0)]


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark)
    batch = lambda pairs: spark.createDataFrame(pairs, "h1 long, h2 long, doc_id long")
    held = lambda names: sorted(r.h1 for x in names for r in spark.table(x).collect())
    assert runs.add(batch([(1, 1, 5), (1, 1, 7), (2, 2, 5)])).count() == 2
    first = runs.runs()[0]
    assert [tuple(r) for r in runs.add(batch([(1, 1, 6), (3, 3, 6)])).collect()] == [(3, 3)]
    assert [held([r]) for r in runs.runs()] == [[1, 2], [3]] and held(runs.deltas[first]) == [1]  # the known line is in no other run
    assert runs.add(batch([(2, 2, 9), (3, 3, 9)])).count() == 0
    assert [len(x) for x in runs.levels] == [1, 1] and first not in runs.runs() and held(runs.runs()) == [1, 2, 3]
    assert [held(runs.deltas[r]) for r in runs.runs()] == [[], [2, 3]]
    assert sorted((r.h1, r.n, r.top) for r in runs.totals().collect()) == [(1, 3, 7), (2, 2, 9), (3, 2, 9)]
    runs.drop()
    assert not runs.paths and not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_runs_hold_each_line_once(spark):
    rng = random.Random(3)
    rows = [(k % 5, rng.randrange(40), k) for k in range(600)]
    runs, seen = line_dedup.LineRuns(spark, 2), set()
    for b in range(5):
        own = [(h, h, i) for x, h, i in rows if x == b]
        fresh = {r.h1 for r in runs.add(spark.createDataFrame(own, "h1 long, h2 long, doc_id long")).collect()}
        assert fresh == {h for h, _, _ in own} - seen
        seen |= fresh
        live = [r.h1 for name in runs.runs() for r in spark.table(name).collect()]
        assert sorted(live) == sorted(seen)
    want = {h: (len({i for _, x, i in rows if x == h}), max(i for _, x, i in rows if x == h)) for h in seen}
    assert {r.h1: (r.n, r.top) for r in runs.totals().collect()} == want
    runs.drop()


def test_runs_go_after_a_failure(spark, monkeypatch):
    def fails(self):
        raise RuntimeError("lost")

    monkeypatch.setattr(line_dedup.LineRuns, "totals", fails)
    with pytest.raises(RuntimeError):
        line_dedup.dedup_lines(spark.createDataFrame([(1, "x" * 50)], "doc_id long, text string"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_mixing_targets(spark):
    sizes = [("a", 1000), ("b", 10), (None, 50), ("B", 300), ("c", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    order = ["B", "a", "b", "c", None]
    weight, size, fixed = dict(zip(order, [5, 2, 1, 5, 2])), dict(sizes), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = (1360 - sum(fixed.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * share > 3 * size[s] + 1e-9]
        if not over:
            break
        fixed |= {s: 3 * size[s] for s in over}
    for s in order:
        assert abs(got[s] - fixed.get(s, weight[s] * share)) < 1e-6


def test_mixing(rows, docs, empty):
    mix = {r.doc_id: r for r in mixing.curriculum_mix(docs).collect()}
    assert len(mix) == len(rows)
    taken, target = Counter(), {}
    for r in mix.values():
        assert r.size == len(WORD.findall(rows[r.doc_id][1] or "")) and r.taken == r.size * len(r.positions) <= 3 * r.size
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] += r.taken
        target[r.source] = r.target
    longest = max(r.size for r in mix.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in target)
    order = mixing.training_order(mixing.curriculum_mix(docs)).collect()
    assert len(order) == sum(len(r.positions) for r in mix.values()) and [r.position for r in order] == sorted(r.position for r in order)
    assert mixing.curriculum_mix(empty).count() == 0


def test_mixing_reruns_agree(spark):
    own = [(1 + k % 2, "w " * (k + 1), "a") for k in range(12)] + [(5, "v " * (k + 1), "b") for k in range(12)]
    runs = []
    for k in range(2):
        random.Random(k).shuffle(own)
        mix = mixing.curriculum_mix(spark.createDataFrame(own, "doc_id long, text string, source string").repartition(k + 1))
        runs.append(sorted((r.doc_id, r.size, r.taken) for r in mix.collect()))
    assert runs[0] == runs[1]


def test_schedule_inversion(spark):
    for schedule in (((0.0, 6.0), (1.0, 4.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 0.0), (1.0, 2.0))):
        whole = mixing.integral(schedule)
        for r in spark.createDataFrame([(k / 10,) for k in range(1, 11)], "q double").select("q", mixing.inverted(F.col("q"), schedule).alias("t")).collect():
            xs = np.linspace(0, r.t, 20001)
            ys = np.interp(xs, [t for t, _ in schedule], [w for _, w in schedule])
            assert abs(float(((ys[1:] + ys[:-1]) / 2 * np.diff(xs)).sum()) / whole - r.q) < 1e-6


def test_sharding(spark, rows, docs, empty):
    got = sharding.pack_shards(docs, 4).collect()
    by = defaultdict(list)
    for r in got:
        t = rows[r.doc_id][1] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    homes = defaultdict(set)
    for r in got:
        homes[rows[r.doc_id][1] or ""].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())
    assert sharding.pack_shards(empty, 4).count() == 0
    hot = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string")
    sizes = Counter()
    for r in sharding.pack_shards(hot, 5).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_write_shards(docs, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), 3)
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_rule_measures(rows, docs, empty):
    got = {r.doc_id: r for r in quality_rules.measured(docs).collect()}
    for i, t, *_ in rows:
        words, lines, seen, dups = WORD.findall(t or ""), (t or "").split("\n"), set(), 0
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeated = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        for x in lines:
            if WORD.search(x):
                dups += x in seen
                seen.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dups, len(repeated)), i
    assert quality_rules.measured(empty).count() == 0


def test_rule_cutoffs(spark, docs, empty):
    assert abs(quality_rules.at_most(2, 10, 0.3) - 0.3827827864) < 1e-9
    assert quality_rules.safe_cutoff(2000, [0, 1, 500], (3.0, 2.0, 1.0), 0.02, 0.01) == 2.0
    assert quality_rules.safe_cutoff(20, [0, 0], (3.0, 2.0), 0.02, 0.01) is None
    words = "a calm and plain text of some twelve quite different words in all"
    many = [(i, words + f" n{i}" if i % 4 else " ".join(w + "###" for w in words.split()) + f" n{i}", "en") for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, *_ in many], "doc_id long, quality int")
    out = quality_rules.judged(spark.createDataFrame(many, "doc_id long, text string, lang string"), labels).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in out)
    none = labels.filter("doc_id < 0")
    assert quality_rules.judged(docs, none).filter("kept = base_failed").count() == 0
    assert quality_rules.judged(empty, none).count() == 0


def test_binomial_of_many():
    for n, p, k in ((40, 0.3, 0), (40, 0.3, 9), (40, 0.3, 25), (40, 0.3, 39), (5000, 0.9, 4600)):
        assert quality_rules.at_most(k, n, p) == pytest.approx(math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)), rel=1e-9)
    n, p = 10**9, 0.01
    sd = math.sqrt(n * p * (1 - p))
    for z in (0, -1, -3):
        assert quality_rules.at_most(int(n * p + z * sd), n, p) == pytest.approx(math.erfc(-z / math.sqrt(2)) / 2, rel=5e-3)


def test_language(spark, docs, empty):
    rng = random.Random(2)
    words = {"en": ["the", "and", "this", "house", "water"], "de": ["der", "und", "dieses", "straße", "wasser"]}
    own = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i in range(80) for x in (("en", "de")[i % 2],)]
    df = spark.createDataFrame(own, "doc_id long, text string, lang string")
    trained = language_id.train(df.filter("doc_id < 60"))
    got = {r.doc_id: r for r in language_id.identify(df, trained).collect()}
    assert all(got[i].lang_pred == x for i, _, x in own) and all(0 <= r.score <= 1 for r in got.values())
    model = language_id.LanguageModel(trained)
    text = "the straße ü\U0001f600".encode()
    codes, _ = language_id.grams([text])
    slow = [sum(slow_bits(trained[x], text, k) for k in range(len(text))) for x in model.languages]
    assert np.allclose(model.lengths([text])[:, 0], slow)
    assert np.allclose(model.lengths([b"", text * 3, text])[:, 2], slow)
    odd = {r.doc_id: r for r in language_id.identify(docs, trained).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 3))
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"} and language_id.identify(empty, trained).count() == 0


def slow_bits(trained, text, k):
    """The code length of a byte, straight from the definition."""
    padded = b"\0" * language_id.ORDER + text
    k += language_id.ORDER
    bits = 0.0
    for order in range(language_id.ORDER, -1, -1):
        after = Counter()
        for g, n in zip(*trained):
            b = int(g).to_bytes(language_id.ORDER + 1, "big")
            if b[language_id.ORDER - order : -1] == padded[k - order : k]:
                after[b[-1]] += n
        whole = sum(after.values()) + len(after)
        if after and padded[k] in after:
            return bits + np.log2(whole / after[padded[k]])
        if after:
            bits += np.log2(whole / len(after))
    return bits + 8


def test_quality_classifier(spark, docs, empty):
    rng = random.Random(4)
    good = [" ".join(rng.choice(VOCABULARY[:10]) for _ in range(40)) for _ in range(200)]
    bad = [" ".join(rng.choice(VOCABULARY[:10]).upper() + "!!" for _ in range(40)) for _ in range(100)]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300) if i % 5], "doc_id long, quality int")
    data = quality_classifier.train(own, labels)
    got = quality_classifier.scored(own, data).collect()
    held = [r for r in got if r.doc_id % 5 == 0]
    assert sum(r.predicted == int(r.doc_id < 200) for r in held) >= 0.95 * len(held)
    odd = quality_classifier.scored(docs, data)
    assert odd.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in odd.collect())
    assert quality_classifier.scored(empty, data).count() == 0
    assert quality_classifier.train(own, labels.filter("quality = 1")) is None
    assert quality_classifier.scored(own, None).filter("predicted = 0").count() == 0


def brute_components(rows, width, percent=80):
    sets = {}
    for i, t, *_ in rows:
        words = WORD.findall((t or "").translate(LOWER))
        w = min(width, len(words))
        sets[i] = {tuple(words[k : k + w]) for k in range(len(words) - w + 1)} if words else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return sets, root


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(rows, docs, width):
    sets, root = brute_components(rows, width)
    got = {r.doc_id: r for r in minhash_dedup.near_groups(docs, width=width).collect()}
    assert {i: r.component_id for i, r in got.items()} == root
    assert all(r.n_shingles == len(sets[i]) and r.kept == (root[i] == i) for i, r in got.items())


def test_near_groups_odd(spark, empty):
    assert minhash_dedup.near_groups(empty).count() == 0
    twice = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "A B C")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash_dedup.near_groups(twice, width=2).collect()) == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False)]


def test_block_pairs_with_equal_lower_halves(spark):
    text = " ".join(VOCABULARY)
    assert len(minhash_dedup.packed(spark.createDataFrame([(1, text)], "doc_id long, text string"), 2).first().hashes) == 8 * len(minhash_dedup.shingle_set(text.encode(), 2))
    shared, low = np.arange(1, 81, dtype=np.uint64) << np.uint64(32), np.uint64(7)
    own = [np.sort(np.concatenate([shared + low, (np.arange(a, a + 10, dtype=np.uint64) << np.uint64(32)) + np.arange(a, a + 10, dtype=np.uint64)])) for a in (100, 200)]
    left, right = ([{"rep": i, "root": i, "hashes": s.tobytes()}] for i, s in enumerate(own))
    assert minhash_dedup.block_pairs(left, right, 80) == [(0, 1)] and minhash_dedup.block_pairs(left, right, 81) == []


def test_short_texts_that_share_a_shingle(spark):
    many = [(i, f"the end {i}") for i in range(4000)] + [(5000 + i, f"all of it ends here {i % 3} {i}") for i in range(300)]
    out = minhash_dedup.near_groups(spark.createDataFrame(many, "doc_id long, text string"), width=2).collect()
    assert len(out) == 4300 and all(r.kept for r in out)


def test_block_pairs_against_sets():
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(30, 55))), np.uint64) for _ in range(60)]
    rows = [{"rep": i, "root": i % 50, "hashes": s.tobytes()} for i, s in enumerate(sets)]
    slow = {(i, j) for i in range(30) for j in range(60) if i % 50 != j % 50 and 100 * len(set(sets[i]) & set(sets[j])) >= 60 * len(set(sets[i]) | set(sets[j]))}
    assert slow and set(minhash_dedup.block_pairs(rows[:30], rows, 60)) == slow


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components.roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e for e in edges if e[0] != e[1])}


def test_sentencepiece(spark, docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    v = sentencepiece_codec.Vocabulary.load(sentencepiece_codec.MODEL)
    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    odd = ["     x", "      x  y", "x     ", "\t\tx", "   \n   x", "ﬁ é Ａ", "\xa0x", "  ", "x" * 200, "=-" * 300, "日本語テキスト", "Straße 1234 ².", "\U0001f44d\U0001f3fd", "हिन्दी"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    given = {r.doc_id: r.text for r in table.collect()}
    coded = sentencepiece_codec.encode(table, v)
    got = sentencepiece_codec.decode(coded, v).collect()
    assert len(got) == len(given)
    for r in got:
        assert list(r.ids) == own.encode(given[r.doc_id] or "") and r.text == (given[r.doc_id] or "") and r.n_tokens == len(r.ids)
    assert sentencepiece_codec.encode(empty, v).count() == 0


def test_viterbi(spark):
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab"]
    v = sentencepiece_codec.Vocabulary(pieces, [0, -2.0, -3.0, -3.1, -3.25, -4.0, -4.2, -3.5, -7.6, -5.9], [2] + [1] * 9, sentencepiece_codec.UNIGRAM)
    given = ["abc abcab", "a b c", "xabx", "abcabcabc bca"]
    for r in sentencepiece_codec.encode(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), v).collect():
        words = [u for w in re.findall(v.words, v.normalized(given[r.doc_id])) for u in re.findall(v.cuts, w)]
        assert list(r.ids) == [i for u in words for i in v.best(u)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    plain = [" ".join(rng.choice(VOCABULARY[:10]) for _ in range(50)) for _ in range(120)]
    junk = [" ".join(rng.choice(VOCABULARY[:10]).upper() + "!!" for _ in range(50)) for _ in range(60)]
    all_ = plain + junk + plain[:10] + [t + " tail" for t in plain[10:20]]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(all_)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and len(ids & set(range(120))) >= 118 and len(ids & set(range(120, 180))) <= 2
    unique = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    assert unique == set(range(200)) - set(range(10))
    near = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs.filter("doc_id < 120 or doc_id >= 190"), "").collect()}
    assert near == set(range(120))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.n_tokens == len(r.ids) > 0 for r in out)


def test_pipeline_repeated_and_null_ids(spark):
    import corpus_pipeline as P

    table = lambda rows: spark.createDataFrame([(i, t, "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, k int")
    copies = [(7, "x"), (9, "X"), (7, "y"), (7, "Y"), (None, "z"), (None, "x"), (None, "w"), (None, "w"), (3, "v"), (3, "v")]
    out = P.drop_copies(spark, table(copies), "").collect()
    assert sorted(((r.doc_id or 0), r.text.lower()) for r in out) == [(0, "w"), (0, "z"), (3, "v"), (7, "y"), (9, "x")]

    rng = random.Random(4)
    a, b, c = (" ".join(rng.choice(VOCABULARY) + str(rng.randrange(99)) for _ in range(60)) for _ in range(3))
    near = [(3, a), (5, a + " tail"), (5, b), (None, b + " tail"), (None, c), (None, c + " tail"), (8, c + " other tail"), (8, ""), (8, None)]
    out = P.drop_near_copies(spark, table(near), "")
    assert out.columns == ["doc_id", "text", "source", "k"] and sorted(r.k for r in out.collect()) == [0, 2, 6, 7, 8]

    docs = table([(1, f"a b {k}") for k in range(12)] + [(None, f"c d {k}") for k in range(12)] + [(9, "")])
    out = P.mix_sources(spark, docs, "").collect()
    assert sum(len(r.text.split()) for r in out) == 72 and Counter(r.k for r in out) == dict.fromkeys(range(24), 1)


def test_pipeline_clashing_names(spark):
    import corpus_pipeline as P

    names = ["row_", "tie_", "of", "position_", "kept", "group_of", "number", "score"]
    for ids in ([1, 2, 3], [1, 1, None]):
        docs = spark.createDataFrame([(i, "a b c d e f", "s", *range(8)) for i in ids], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
        for stage in (P.drop_copies, P.drop_near_copies):
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and [tuple(r)[3:] for r in out.collect()] == [tuple(range(8))]
        out = P.mix_sources(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 3


def test_pipeline_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == P.STAGES[-1][0] or out.columns == docs.columns)
    assert P.run(spark, str(tmp_path)).count() == 0


def test_two_pipelines_at_once(spark, tmp_path):
    """A stage's result can be read after the next stages have begun."""
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, "other words", "s")], "doc_id long, text string, source string")
    first = P.drop_copies(spark, docs, "")
    second = P.drop_near_copies(spark, docs, "")
    assert first.count() == second.count() == 2 and P.drop_near_copies(spark, first, "").count() == 2


def test_pipeline_decodes(spark):
    import corpus_pipeline

    given = ["one two", "Zwei  Wörter", "👍", ""]
    out = corpus_pipeline.encode_texts(spark, spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), "").collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(given)}


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert json.dumps(sorted(__spark_entry__.oracle_sql()))
