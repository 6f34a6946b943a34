"""Registered queries and operators against plain versions, on tables with repeated rows, ties and odd texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import language_id, minhash_dedup, quality_classifier, quality_rules, sharding, token_packing
from trackweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = ["alpha", "beta", "Gamma", "delta", "É", "zeta", "eta", "straße", "iota", "###", "x!", "12", "a-b"]


def texts(seed: int, n: int) -> list:
    rng = random.Random(seed)
    return [None, "", " \n ", "x" * 3000, *(" ".join(rng.choice(PLAIN) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "!", "\nend", " ..."]) for _ in range(n))]


# ---- quality classifier -----------------------------------------------------------------------------------------


def plain_score(data: dict, text: str) -> float:
    """One text through vectors and network, token by token."""
    words_known, shapes_known, word_vectors, shape_vectors = data["vectors"]
    raw = text.encode()
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = "".join(chr(b) if chr(b).isalnum() and b < 128 or b >= 128 else " " for b in lowered).split(" ")
    words = [bytes(map(ord, w)) for w in words if w]
    kinds = "".join("a" if 97 <= b < 123 or b >= 128 else "A" if 65 <= b < 91 else "0" if 48 <= b < 58 else " " if b <= 32 else chr(b) for b in raw)
    shapes = [w.encode() for w in re.sub(r"(.)\1+", r"\1", kinds, flags=re.S).split(" ") if w]
    shapes += [quality_classifier.REPEATED] * sum(a == b for a, b in zip(words, words[1:]))
    x = []
    for tokens, known, vectors in ((words, words_known, word_vectors), (shapes, shapes_known, shape_vectors)):
        place = {t: i for i, t in enumerate(known)}
        rows = [vectors[place.get(t, len(known))].astype(float) for t in tokens]
        x += (np.sum(rows, axis=0) / len(rows)).tolist() if rows else [0.0] * vectors.shape[1]
    x.append(math.log1p(len(words)) / 10)
    n = data["network"]
    w1, b1, w2, b2 = n["weights"]
    hidden = [max(0.0, sum((x[i] - n["mean"][i]) / n["scale"][i] * w1[i][j] for i in range(len(x))) + b1[j]) for j in range(len(b1))]
    return 1 / (1 + math.exp(-max(-30, min(30, (sum(h * w for h, w in zip(hidden, w2)) + b2[0]) / n["temperature"]))))


def test_scores_equal_a_plain_pass(spark):
    own = texts(3, 150)
    rows = [(i, t) for i, t in enumerate(own)] + [(20, own[20]), (20, own[20]), (None, own[21])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("!" in (t or ""))) for i, t in enumerate(own)], "doc_id long, quality int")
    data = quality_classifier.train(docs, labels)
    got = [(r.doc_id, r.text, r.score, r.predicted) for r in quality_classifier.scored(docs, data).collect()]
    assert len(got) == len(rows)
    for _, t, score, predicted in got:
        assert score == pytest.approx(plain_score(data, t or ""), abs=2e-4) and predicted == int(score >= quality_classifier.THRESHOLD)


def test_repeated_ids_stay_within_the_sample(spark, monkeypatch):
    """Rows that repeat a sampled id add no text to the sample, nor texts that are too long."""
    rows = [(i % 7, f"text {i}") for i in range(300)] + [(3, "y" * (quality_classifier.TRAIN_BYTES + 1))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    sample = quality_classifier.sampled(spark.createDataFrame(rows, "doc_id long, text string"), labels, "doc_id", "text", "quality").collect()
    assert len(sample) == 7 and all(len(r.text) < 100 and int(r.text.split()[1]) % 7 % 2 == r.label for r in sample)


# ---- language ---------------------------------------------------------------------------------------------------


def test_languages_of_repeated_ids(spark):
    rows = [(1, f"the house {k}", "en") for k in range(40)] + [(1, f"das haus {k}", "de") for k in range(40)] + [(2, "the house", "en"), (2, "the house", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trained = language_id.train(docs)
    bytes_of = {x: int(n.sum()) for x, (_, n) in trained.items()}
    assert set(bytes_of) == {"en", "de"} and bytes_of["de"] <= len("das haus 39") and bytes_of["en"] <= len("the house 39") + len("the house")
    got = language_id.identify(docs, trained).collect()
    assert len(got) == len(rows) and len({(r.lang_pred, r.score) for r in got if r.doc_id == 2}) == 1
    tie = language_id.identify(spark.createDataFrame([(1, "zz")], "doc_id long, text string"), {"b": trained["en"], "a": trained["en"]}).first()
    assert tie.lang_pred == "a" and tie.score == pytest.approx(0.5)  # equal models: the first by name


# ---- quality rules ----------------------------------------------------------------------------------------------


def exact_tail(k: int, n: int, p: float) -> float:
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def plain_measures(t: str) -> dict:
    words = WORD.findall(t)
    lines, seen, dups = [x for x in t.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dups += x in seen
        seen.add(x)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    n, upper, lower = max(len(words), 1), sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    return {
        "n": len(words), "repeat": len(repeated), "symbols_per_word": len(re.findall(r"[#*$%&|<>]", t)) / n, "upper_share": upper / max(upper + lower, 1), "exclamations_per_word": t.count("!") / n,
        "repeat_share": len(repeated) / n, "dup_line_share": dups / max(len(lines), 1),
    }


def test_kept_equals_plain_cutoffs(spark):
    rng = random.Random(12)
    rows = []
    for i in range(2400):
        noise = rng.choice([0, 0, 0, 0.02, 0.4, 0.9, 1.6])
        words = [rng.choice(PLAIN[:9]) + str(rng.randrange(40)) + ("#" * rng.randrange(1, 4) if rng.random() < noise else "") + ("!" if rng.random() < noise / 2 else "") for _ in range(rng.randrange(5, 40))]
        rows.append((i, " ".join(w.upper() if rng.random() < noise / 3 else w for w in words), rng.choice(["en", "de", None])))
    rows += [rows[5], rows[5], (None, "a few words without any id here at all now", "en"), (9_001, None, None), (9_002, "", "en")]
    measured = {k: plain_measures(t or "") for k, (_, t, _) in enumerate(rows)}
    good = {i: int(measured[k]["symbols_per_word"] < 0.6 or rng.random() < 0.02) for k, (i, _, _) in enumerate(rows) if i is not None and i < 2400 and i % 3}
    failed = {k: m["n"] < 10 or 100 * m["repeat"] > 20 * m["n"] for k, m in measured.items()}
    strata = defaultdict(list)
    for k, (i, _, lang) in enumerate(rows):
        if good.get(i) == 1 and not failed[k]:
            strata[lang or "und"].append(k)
    level = quality_rules.LEVEL / (len(strata) * len(quality_rules.RULES))
    risk = quality_rules.RISK / len(quality_rules.RULES)
    cutoff: dict = {}
    for s, members in strata.items():
        for rule, grid in quality_rules.RULES.items():
            values = sorted((measured[k][rule] for k in members), reverse=True)
            for c in grid:
                rejected = next((j for j, v in enumerate(values) if v <= c), len(values))
                if rejected > risk * len(values) or exact_tail(rejected, len(values), risk) > level:
                    break
                cutoff[s, rule] = c
    want = [not failed[k] and all(measured[k][r] <= cutoff.get((lang or "und", r), math.inf) for r in quality_rules.RULES) for k, (_, _, lang) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    got = quality_rules.judged(docs, labels).collect()
    by_text = defaultdict(set)
    for k, (i, t, lang) in enumerate(rows):
        by_text[i, len(WORD.findall(t or "")), lang or "und"].add(want[k])
    assert len(got) == len(rows) and Counter(r.kept for r in got) == Counter(want)
    assert all(r.kept in by_text[r.doc_id, r.n_words, r.stratum] for r in got)
    assert any(not want[k] and not failed[k] for k in measured) and len({c for c in cutoff.values()}) > 3  # the rules reject, at cutoffs of their own


# ---- packing and sharding ---------------------------------------------------------------------------------------


def test_packing_of_repeated_rows(spark):
    ranks = token_packing.load_ranks(token_packing.RANKS)
    rows = [(1, "one two"), (1, "one two"), (1, "other"), (None, "no id"), (None, "no id")]
    out = token_packing.pack_rows(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), ranks, length=16).collect()
    pieces = Counter(i for r in out for i in r.doc_ids)
    assert pieces == Counter(i for i, _ in rows)


def plain_pack(vectors: list, n_bins: int) -> list:
    """Each item, the largest weighted sum of shares first, to the bin of the highest weighted dot product with what is left of it."""
    sums = [max(sum(v[d] for v in vectors), 1) for d in range(3)]
    share = [[v[d] / sums[d] * n_bins for d in range(3)] for v in vectors]
    weights, left, out = sharding.WEIGHTS, [[1.0] * 3 for _ in range(n_bins)], [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-sum(w * s for w, s in zip(weights, share[i])), i)):
        out[i] = b = max(range(n_bins), key=lambda b: (sum(left[b][d] * share[i][d] * weights[d] for d in range(3)), -b))
        left[b] = [x - s for x, s in zip(left[b], share[i])]
    return out


def test_pack_equals_a_plain_packer():
    rng = random.Random(5)
    for n_bins in (1, 3, 8):
        vectors = [[rng.randrange(16, 900), rng.randrange(0, 90), 1] for _ in range(120)] + [[50, 5, 1]] * 20  # ties too
        got = sharding.pack(np.array(vectors, np.int64), n_bins).tolist()
        want = plain_pack(vectors, n_bins)
        sums = lambda bins: sorted(tuple(sum(v[d] for v, b in zip(vectors, bins) if b == k) for d in range(3)) for k in range(n_bins))
        assert got == want or sums(got) == sums(want)


def test_shards_of_a_table_equal_a_plain_packer(spark):
    """All groups of a small table have cells of their own, so shards are those of the groups, packed one by one."""
    own = texts(8, 90)
    rows = [(i, t) for i, t in enumerate(own)] + [(4, own[4]), (4, own[4]), (None, own[5]), (7, "same id, other text")] + [(200 + k, own[9]) for k in range(12)]
    got = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows) and sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len((t or "").encode()) + 16) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    room = sum(sizes) / 4
    largest = max(Counter({t: 0 for _, t in rows} | {}).keys() and [sum(len((t or "").encode()) + 16 for _, t in rows if (t or "") == x) for x in {(t or "") for _, t in rows}])
    assert max(sizes) - min(sizes) <= max(largest, room / 8)
    again = sharding.pack_shards(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), 4).collect()
    assert sorted((r.doc_id or -1, r.text_crc32, r.shard) for r in got) == sorted((r.doc_id or -1, r.text_crc32, r.shard) for r in again)


def test_query_of_shards_on_a_table(spark):
    """Whole groups, gapless slots, sizes near equal, on the given table."""
    out = QUERIES["op9_sharding"](spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(out) == len(docs) and {r.law for r in out} == {"bytes"}
    by, group = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.size == len(docs[r.doc_id].encode()) + 16
        by[r.shard].append(r)
        group[docs[r.doc_id]].append(r)
    assert set(by) == set(range(40)) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r.size for r in x) for x in by.values()]
    room = sum(sizes) / 40
    assert max(sizes) < 1.1 * min(sizes)
    assert all(len({r.shard for r in g}) == 1 for g in group.values() if sum(r.size for r in g) <= room)


# ---- near duplicates --------------------------------------------------------------------------------------------


def test_query_of_near_duplicates_on_a_table(spark):
    """Every link of the given table is found: components equal those of all pairs that share a shingle."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sets, holders = {}, defaultdict(list)
    for i, t in rows:
        words = WORD.findall(t.translate(LOWER))
        w = min(2, len(words))
        sets[i] = {tuple(words[k : k + w]) for k in range(len(words) - w + 1)} if words else set()
        for s in sets[i]:
            holders[s].append(i)
    common = Counter()
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                common[ids[a], ids[b]] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in QUERIES["op10_minhash_dedup"](spark, SF).collect()}
    assert links and {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(2)
    words = [rng.choice(PLAIN) + str(rng.randrange(9999)) for _ in range(60_000)]
    near = list(words)
    for _ in range(900):
        near[rng.randrange(len(near))] = "changed"
    far = [w if rng.random() < 0.8 else "other" + str(rng.randrange(99)) for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (2, " ".join(near))]
    out = minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 1), (2, 1), (3, 3)]


def test_queries_keep_every_row(spark):
    """Queries that return a row per document return all of the given table."""
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name in ("op2_language_id", "op3_line_dedup", "op4_quality_classifier", "op5_quality_rules", "op7_exact_dedup", "op8_mixing", "op9_sharding", "op10_minhash_dedup", "op12_bpe"):
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert out.select(F.count_distinct("doc_id")).first()[0] == n == out.count(), name


def test_links_that_connect():
    """Of all links of a group as many are passed on as connect it, and they connect as much."""
    roots = {k: k - k % 2 for k in range(200)}
    pairs = [(a, b) for a in range(200) for b in range(200) if a % 10 // 2 == b % 10 // 2 and roots[a] != roots[b]]
    kept = minhash_dedup.joining(pairs, roots)
    assert len(pairs) > 7000 and len(kept) == 100 - 5 and set(kept) <= {(min(p), max(p)) for p in pairs}
    of = dict(roots)
    for a, b in kept:
        x, y = of[a], of[b]
        of = {k: x if v == y else v for k, v in of.items()}
    assert len(set(of.values())) == 5 and all(of[a] == of[b] for a, b in pairs)


def test_packing_cuts_alike():
    """The quicker pattern cuts pre-tokens as the plain one does."""
    import tiktoken

    ranks, rng = token_packing.load_ranks(token_packing.RANKS), random.Random(3)
    plain, quick = (tiktoken.Encoding("t", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (token_packing.PATTERN, token_packing.SAME_CUTS))
    for _ in range(20_000):
        text = "".join(rng.choice(" \n\t\r  'sdmtlvrea1²٣é中!?#\u0085 \x1c") for _ in range(rng.randint(0, 14)))
        assert plain.encode_ordinary(text) == quick.encode_to_numpy(text, disallowed_special=()).tolist()
