"""SentencePiece encoding and decoding with a relational lattice.

Texts are cut into words and these into units, neither of which a piece of the vocabulary crosses. Blocks of documents name their distinct units; each
unit of the corpus is then encoded once: its substrings up to the longest piece's length are exploded and equi-joined
to the piece table, the edges found are grouped by unit, and a higher-order aggregate folds them into ids. For a
unigram vocabulary the fold is Viterbi, for the best sum of scores. A BPE vocabulary is not segmented by its best sum
but by its merges, so for it the fold applies, of the lattice's edges that join two neighbouring symbols, the one of the
highest score (ties: the leftmost) until there is none. Characters without a piece become bytes.

An edge is packed into a number: rank of its score, start, end, id, and whether it is early. Edges of one character need no
join: they are looked up by the character's code. Ids go back to the blocks by block and number of the unit, packed, and
meet the block's texts, which travel compressed.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, thrifty

#: The vocabulary of the queries.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: UTF-8 bytes of the texts of a block and of a chunk of it, and what a row counts besides its text.
BLOCK_BYTES, CHUNK_BYTES, ROW_BYTES = 20 << 20, 1 << 20, 16
#: Units longer than this (runs of one kind of character) are encoded in their block. Places of units that a task gathers before it sends them.
LONG, GATHERED = 48, 1 << 19
#: Words whose ids are put together at once (or one text).
AT_ONCE = 1 << 17
SPACE = "▁"
#: A bit beyond those of a unit's symbols.
MARK = 1 << 62
#: First bits of an edge's fields (early is bit 0), the id of a character without a piece, and codes below which a character's id is found in a table.
ID, END, START, RANK = 1, 21, 27, 33
NONE, NEAR = (1 << 31) - 1, 768
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
#: Added to the score of an unknown character in a unigram lattice, below the least score.
PENALTY = -10.0


@dataclass
class Vocabulary:
    """Pieces in the order of their ids with their scores and kinds."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int = BPE
    prefix: bool = True

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.words, self.cuts, self.simple = self._cuts()

    def _cuts(self) -> tuple[str, str, bool]:
        """Patterns whose matches are the words of a text, and the units of a word. No piece may lie in two of them. Last: whether letters are one unit and the signs after them another."""
        odd = ""
        for p in self.ids:  # letters that some piece joins with other characters count as those
            for a, b in zip(p, p[1:]):
                if re.match(r"[^\W\d_]", a) and re.match(rf"(?![^\W\d_]|{SPACE}).", b, re.S):
                    odd += a
                if re.match(r"[^\W\d_]", b) and re.match(rf"(?![^\W\d_]|{SPACE}).", a, re.S):
                    odd += b
        letters = any(map(str.isalpha, odd))
        odd = "".join(map(re.escape, dict.fromkeys(odd)))
        kinds = rf"{SPACE}*[^\W\d_{odd}]+|{SPACE}*(?:[^\w{SPACE}]|[_{odd}])+|{SPACE}+|\d"
        words, whole = rf"{SPACE}*[^{SPACE}]+|{SPACE}+", r"[\s\S]+"
        fits = lambda pattern: all(re.findall(pattern, p) == [p] for p in self.ids)
        if fits(words) and fits(kinds):
            return words, kinds, self.prefix and not letters
        return (words, words, False) if fits(words) else (whole, whole, False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a .model file, whose normalization must be the identity."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError(f"{path} normalizes texts")
        return cls([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type, m.normalizer_spec.add_dummy_prefix)

    def normalized(self, text: str) -> str:
        return (SPACE * self.prefix + text.replace(" ", SPACE)) if text else ""

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece has."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def merged(self, unit: str) -> list[int]:
        """Ids of one unit by BPE merges, with a heap: for units of any length."""
        left, right = list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1]
        parts: list[str | None] = list(unit)
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (p := parts[i] + parts[right[i]]) in self.ids:
                heapq.heappush(queue, (-self.scores[self.ids[p]], i, p))

        for i in range(len(unit)):
            offer(i)
        while queue:
            _, i, p = heapq.heappop(queue)
            if parts[i] is None or right[i] < 0 or parts[i] + parts[right[i]] != p:
                continue
            gone = right[i]
            parts[i], parts[gone], right[i] = p, None, right[gone]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [x for p in parts if p is not None for x in ([self.ids[p]] if p in self.ids else self.fallback(p))]

    def best(self, unit: str) -> list[int]:
        """Ids of one unit by Viterbi over all pieces: for units of any length."""
        low = min((self.scores[i] for i in self.ids.values()), default=0.0) + PENALTY
        score, back = [0.0] + [-np.inf] * len(unit), [(0, -1)] * (len(unit) + 1)
        for e in range(1, len(unit) + 1):
            for s in range(max(0, e - self.longest), e):
                i = self.ids.get(unit[s:e], -1)
                x = score[s] + (self.scores[i] if i >= 0 else low if e - s == 1 else -np.inf)
                if x >= score[e]:  # ties: the shortest last piece, as in the fold
                    score[e], back[e] = x, (s, i)
        out, e = [], len(unit)
        while e:
            s, i = back[e]
            out.append([i] if i >= 0 else self.fallback(unit[s:e]))
            e = s
        return [i for x in reversed(out) for i in x]

    def surfaces(self) -> list[bytes]:
        """What each id adds to a text."""
        return [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, k in zip(self.pieces, self.kinds)]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of runs that start at ``starts`` and are ``lengths`` long."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """The texts of a block as numbers of words, and these as numbers of units.

    Texts whose words are parted by single spaces are cut at once by Arrow, and so are words of letters with signs
    after them; other texts and words are cut by the vocabulary's patterns. Units are numbered as they first appear.
    """

    def __init__(self, texts: pa.Array, vocabulary: Vocabulary):
        split, cut = re.compile(vocabulary.words).findall, re.compile(vocabulary.cuts).findall
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = odd.to_numpy(zero_copy_only=False) if vocabulary.simple else np.ones(len(texts), bool)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        self.plain, self.odd = np.flatnonzero(~odd & ~empty), np.flatnonzero(odd | empty)

        lists = pc.split_pattern(texts.take(pa.array(self.plain)), " ")
        words = lists.flatten().dictionary_encode()
        self.plain_words, self.plain_counts = words.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
        words = words.dictionary
        letters = pc.utf8_rtrim(words, characters=punctuation)
        whole = pc.utf8_is_alpha(letters).to_numpy(zero_copy_only=False)
        tailed = whole & (pc.binary_length(letters).to_numpy() < pc.binary_length(words).to_numpy())
        at = np.flatnonzero(tailed)
        tails = pc.struct_field(pc.extract_regex(words.take(pa.array(at)), rf"(?P<tail>[{re.escape(punctuation)}]+)$"), "tail")
        fronts = pc.binary_join_element_wise(SPACE, letters.take(pa.array(np.flatnonzero(whole))), "")

        known: dict[str, int] = {}
        rare: list[str] = []
        of: list[int] = []
        for k, w in zip(np.flatnonzero(~whole).tolist(), words.take(pa.array(np.flatnonzero(~whole))).to_pylist()):
            units = cut(SPACE + w)
            rare += units
            of += [k] * len(units)
        odd_words, self.odd_counts = [], []
        for t in texts.take(pa.array(self.odd)).to_pylist():
            found = split(vocabulary.normalized(t))
            self.odd_counts.append(len(found))
            odd_words += [known.setdefault(w, len(known)) for w in found]
        self.odd_words = np.array(odd_words, np.int64) + len(words)
        for k, w in enumerate(known, len(words)):
            units = cut(w)
            rare += units
            of += [k] * len(units)

        coded = pa.concat_arrays([fronts, tails, pa.array(rare, pa.string())]).dictionary_encode()
        self.units = coded.dictionary
        self.n_words = len(words) + len(known)
        word = np.concatenate([np.flatnonzero(whole), at, np.array(of, np.int64)])
        rank = np.concatenate([np.zeros(int(whole.sum()), np.int8), np.ones(len(at), np.int8), np.zeros(len(of), np.int8)])  # a tail comes after its letters
        order = np.lexsort((rank, word))
        self.word_of, self.units_of = word[order], coded.indices.to_numpy()[order]

    def short(self) -> tuple[np.ndarray, pa.Array]:
        """Numbers and texts of the units of at most LONG characters."""
        at = np.flatnonzero(pc.utf8_length(self.units).to_numpy() <= LONG)
        return at, self.units.take(pa.array(at))

    def encoded(self, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of all texts, some at once: numbers of the texts, counts of their ids, ids. ``flat`` has the ids of unit k from ``starts[k]`` on."""
        own = lengths[self.units_of]
        flat = flat[spread(starts[self.units_of], own)]
        sizes = np.bincount(self.word_of, own, self.n_words).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        for texts, words, counts in ((self.plain, self.plain_words, self.plain_counts), (self.odd, self.odd_words, np.array(self.odd_counts, np.int64))):
            ends = np.cumsum(counts, dtype=np.int64)
            a = 0
            while a < len(texts):
                done = int(ends[a] - counts[a])
                b = max(a + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
                part = words[done : int(ends[b - 1])]
                cumulative = np.concatenate([[0], np.cumsum(sizes[part])])
                at = np.concatenate([[0], ends[a:b] - done])
                yield texts[a:b], np.diff(cumulative[at]), flat[spread(starts[part], sizes[part])]
                a = b


def state(vocabulary: Vocabulary) -> tuple:
    """What a broadcast carries of a vocabulary."""
    return vocabulary.pieces, vocabulary.scores, vocabulary.kinds, vocabulary.model, vocabulary.prefix


def held(shared: dict) -> Vocabulary:
    """The vocabulary of a broadcast value; it is made once in each Python worker."""
    if "made" not in shared:
        shared["made"] = Vocabulary(*shared["state"])
    return shared["made"]


def blocked(docs: DataFrame, vocabulary: Vocabulary, payload: bool) -> DataFrame:
    """Documents (doc_id, text) in blocks: either (block, number, payload), a block's texts in compressed chunks, or (block, number, unit), its distinct short units.

    A block is named by the hash of its ids and texts, and units are numbered in the order they first appear, so two
    passes over the same input agree.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"state": state(vocabulary)})

    def named(ids: pa.Array, texts: pa.Array) -> int:
        name = xxhash.xxh3_64()
        for part in (pc.fill_null(ids, 0), pc.is_null(ids), pc.fill_null(texts, ""), pc.is_null(texts)):
            for buffer in pa.concat_arrays([part]).buffers()[1:]:
                name.update(buffer or b"")
        return name.intdigest() - (1 << 63)

    def chunks(ids: pa.Array, texts: pa.Array) -> Iterator[bytes]:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + ROW_BYTES)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK_BYTES, "right")))
            sink = pa.BufferOutputStream()
            table = pa.table({"doc_id": ids.slice(a, b - a), "text": texts.slice(a, b - a)})
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as out:
                out.write_table(table)
            yield sink.getvalue().to_pybytes()
            a = b

    def ended(held_rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = (pa.concat_arrays([b.column(k) for b in held_rows]) for k in (0, 1))
        block = named(ids, texts)
        if payload:
            for k, c in enumerate(chunks(ids, texts)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([k], pa.int32()), pa.array([c], pa.binary())], ["block", "number", "payload"])
            return
        numbers, units = Block(texts, held(shared.value)).short()
        for k in range(0, len(numbers), 1 << 16):
            part = numbers[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part.astype(np.int32)), units.slice(k, 1 << 16)], ["block", "number", "unit"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64) + ROW_BYTES)
            a = 0
            while a < len(b):
                done = int(ends[a - 1]) if a else 0
                fit = int(np.searchsorted(ends, done + BLOCK_BYTES - size, "right"))
                fit = max(fit, a if size else a + 1)  # a text that is larger than a block is one of its own
                if fit > a:
                    held_rows.append(b.slice(a, fit - a))
                    size += int(ends[fit - 1]) - done
                if fit < len(b):
                    yield from ended(held_rows)
                    held_rows, size = [], 0
                a = fit
        if held_rows:
            yield from ended(held_rows)

    return docs.mapInArrow(thrifty(each), f"block long NOT NULL, number int NOT NULL, {'payload binary' if payload else 'unit string'} NOT NULL")


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """Pieces of two characters and more with the code of their edges at 0; early: a piece that contains this one has as high a score."""
    ids, scores = vocabulary.ids, vocabulary.scores
    early = {q for p, i in ids.items() for s in range(len(p)) for e in range(s + 1, len(p) + 1) if (q := p[s:e]) != p and q in ids and scores[i] >= scores[ids[q]]}
    rank = {x: k for k, x in enumerate(sorted({-scores[i] for i in ids.values()}))}
    return spark.createDataFrame([(p, (rank[-scores[i]] << RANK) + (i << ID) + (p in early)) for p, i in ids.items() if len(p) > 1], "piece string, code long")


def lattices(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """Distinct units, each with its edges of two characters and more (packed): its substrings that are pieces.

    ``units`` should be partitioned by unit already: then nothing is shuffled here. The piece table has a fixed size
    and is broadcast.
    """
    spread = units.select("unit", F.explode(F.sequence(F.lit(0), F.greatest(F.length("unit") - 2, F.lit(0)))).alias("s"))
    spread = spread.select("unit", "s", F.substring("unit", F.col("s") + 1, F.lit(longest)).alias("rest"))
    spread = spread.select("unit", "s", "rest", F.explode(F.sequence(F.lit(2), F.greatest(F.length("rest"), F.lit(2)))).alias("k"))
    spread = spread.select("unit", "s", "k", F.substring("rest", F.lit(1), F.col("k")).alias("part"))
    first = (F.col("s") == 0) & (F.col("k") == 2)  # a unit stays, with or without edges
    edges = spread.join(F.broadcast(pieces), F.col("part") == F.col("piece"), "left").filter(first | F.col("code").isNotNull())
    edge = F.col("code") + F.shiftleft(F.col("s").cast("long"), START) + F.shiftleft((F.col("s") + F.col("k")).cast("long"), END)
    return edges.select("unit", edge.alias("edge")).groupBy("unit").agg(F.collect_list("edge").alias("edges"))


def field(edge: Column, bit: int, width: int) -> Column:
    """A field of a packed edge."""
    return F.shiftright(edge, bit).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def start_of(edge: Column) -> Column:
    return field(edge, START, RANK - START).cast("int")


def end_of(edge: Column) -> Column:
    return field(edge, END, START - END).cast("int")


def id_of(edge: Column) -> Column:
    return field(edge, ID, END - ID).cast("int")


def single(vocabulary: Vocabulary, char: Column) -> Column:
    """Id of the piece of one character, NONE if it has none."""
    ids = {p: i for p, i in vocabulary.ids.items() if len(p) == 1}
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>")
    far = [p for p in ids if ord(p) >= NEAR]
    found = F.get(numbers([ids.get(chr(k), NONE) for k in range(NEAR)]), F.ascii(char))
    if far:
        found = F.when(F.ascii(char) < NEAR, found).otherwise(F.get(numbers([ids[p] for p in far]), F.instr(F.lit("".join(far)), char) - 1))
    return F.coalesce(found, F.lit(NONE))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bytes(vocabulary: Vocabulary, char: Column) -> Column:
    """Ids of a character without a piece."""
    if not vocabulary.bytes:
        return F.array(F.lit(vocabulary.unknown))
    names = F.array(*[F.lit(vocabulary.bytes[b]) for b in range(256)])
    code = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.octet_length(char)), lambda k: F.element_at(names, F.conv(F.substring(code, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + 1))


def folded_merges(vocabulary: Vocabulary) -> Column:
    """Ids of ``unit`` from ``edges`` by merging neighbours, highest score first, leftmost first.

    The ends of the symbols are the bits of a number. An edge joins two neighbours if its ends are set and one bit
    between them is; to merge them is to clear that bit. Edges are sorted once, so that the first that can merge is
    the best. A merge lets only edges merge that contain it. While none of these is before it in this order, one sweep over
    the edges does all merges. Only the merge of an ``early`` edge can break that; then an edge before it that can merge
    now sets MARK, and the unit is folded step by step instead.
    """
    n, one = F.length("unit"), F.lit(1).cast("long")
    mark = F.lit(MARK).cast("long")
    left = lambda x, by: F.call_function("shiftleft", x, by)

    def masked(x: Column) -> Column:
        s, e = start_of(x), end_of(x)
        return F.struct(left(one, s).bitwiseOR(left(one, e)).alias("ends"), (left(one, e) - left(one, s + 1)).alias("inner"), x.alias("edge"))

    def mergeable(bits: Column, x: Column) -> Column:
        return (bits.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(bits.bitwiseAND(x["inner"])) == 1)

    def fold(edges: Column) -> Column:
        def step(bits: Column, _: Column) -> Column:
            inner = F.get(F.filter(edges, lambda x: mergeable(bits, x)), F.lit(0))["inner"]
            return F.when(bits >= mark, bits).otherwise(F.coalesce(bits.bitwiseAND(F.bitwise_not(inner)), bits.bitwiseOR(mark)))  # marked: nothing is left to merge

        def sweep(bits: Column, x: Column) -> Column:
            merged = bits.bitwiseAND(F.bitwise_not(x["inner"]))
            passed = (field(x["edge"], 0, 1) == 1) & F.exists(edges, lambda y: (y["edge"] <= x["edge"]) & mergeable(merged, y))
            return F.when(bits >= mark, bits).when(mergeable(bits, x), F.when(passed, mark).otherwise(merged)).otherwise(bits)

        every = left(one, n + 1) - 1
        by_steps = F.aggregate(F.sequence(F.lit(1), n), every, step).bitwiseAND(F.bitwise_not(mark))
        return let(let(F.aggregate(edges, every, sweep), lambda bits: F.when(bits < mark, bits).otherwise(by_steps)), lambda bits: ids(edges, bits))

    def ids(edges: Column, bits: Column) -> Column:
        """Symbols of several characters from the edges and those of one from the characters, in order: the start's number in the upper half, the id in the lower."""
        symbols = F.filter(edges, lambda x: (bits.bitwiseAND(x["ends"]) == x["ends"]) & (bits.bitwiseAND(x["inner"]) == 0))
        several = F.transform(symbols, lambda x: F.shiftleft(start_of(x["edge"]).cast("long"), 32) + id_of(x["edge"]))
        both = bits.bitwiseAND(F.shiftright(bits, 1))
        alone = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.call_function("getbit", both, k) == 1)
        alone = F.transform(alone, lambda k: F.shiftleft(k.cast("long"), 32) + single(vocabulary, F.substring("unit", k + 1, F.lit(1))))
        low = lambda x: field(x, 0, 32).cast("int")
        spelled = lambda x: F.when(low(x) == NONE, _bytes(vocabulary, F.substring("unit", F.shiftright(x, 32).cast("int") + 1, F.lit(1)))).otherwise(F.array(low(x)))
        return let(F.sort_array(F.concat(several, alone)), lambda all_: F.when(F.exists(all_, lambda x: low(x) == NONE), F.flatten(F.transform(all_, spelled))).otherwise(F.transform(all_, low)))

    return let(F.transform(F.sort_array("edges"), masked), fold)


def folded_viterbi(vocabulary: Vocabulary) -> Column:
    """Ids of ``unit`` from ``edges`` by the best sum of scores."""
    n, edges = F.length("unit"), F.col("edges")
    low = min((vocabulary.scores[i] for i in vocabulary.ids.values()), default=0.0) + PENALTY
    scores = F.split(F.lit(",".join(map(repr, map(float, vocabulary.scores)))), ",").cast("array<double>")
    node = lambda score, back, id_: F.struct(score.alias("score"), back.alias("back"), id_.alias("id"))

    def reach(nodes: Column, e: Column) -> Column:
        known = F.transform(F.filter(edges, lambda x: end_of(x) == e), lambda x: node(F.get(nodes, start_of(x))["score"] + F.get(scores, id_of(x)), start_of(x), id_of(x)))
        char = lambda i: node(F.get(nodes, e - 1)["score"] + F.coalesce(F.get(scores, i), F.lit(low)), e - 1, i)
        return F.concat(nodes, F.array(F.array_max(F.concat(known, F.array(let(single(vocabulary, F.substring("unit", e, F.lit(1))), char))))))

    nodes = F.aggregate(F.sequence(F.lit(1), n), F.array(node(F.lit(0.0), F.lit(0), F.lit(NONE))), reach)

    def ids(nodes: Column) -> Column:
        def back(path: Column, _: Column) -> Column:
            e = path["at"]
            x = F.get(nodes, e)
            own = F.when(x["id"] < NONE, F.array(x["id"])).otherwise(_bytes(vocabulary, F.substring("unit", e, F.lit(1))))
            return F.when(e == 0, path).otherwise(F.struct(x["back"].alias("at"), F.concat(own, path["ids"]).alias("ids")))

        return F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids")), back, lambda path: path["ids"])

    return let(nodes, ids)


def encoded_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Distinct short units (not empty) with their ids."""
    pieces = piece_table(units.sparkSession, vocabulary)
    fold = folded_viterbi(vocabulary) if vocabulary.model == UNIGRAM else folded_merges(vocabulary)
    return lattices(units, pieces, min(vocabulary.longest, LONG)).select("unit", fold.alias("ids"))


def gathered(coded: DataFrame, code: str) -> DataFrame:
    """Rows (block, number, ids) as rows (block, number, payload) of all that a task has for a block; number is -1.

    A payload has the count, the units' numbers in order as differences, the lengths of their ids in bytes, and the ids
    as numbers of the kind ``code``.
    """

    def rows(blocks: np.ndarray, numbers: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        order = np.lexsort((numbers, blocks))
        blocks, numbers, ids = blocks[order], numbers[order], ids.take(pa.array(order))
        starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        width = np.dtype(code).itemsize
        lengths = (pc.list_value_length(ids).to_numpy() * width).astype("<u2")
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        raw = ids.flatten().to_numpy().astype(code).tobytes()
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(blocks)]):
            head = np.diff(numbers[a:b], prepend=0).astype("<i4")
            out.append(zlib.compress(b"".join([(b - a).to_bytes(4, "little"), head.tobytes(), lengths[a:b].tobytes(), raw[ends[a] : ends[b]]]), 1))
        return pa.RecordBatch.from_arrays([pa.array(blocks[starts], pa.int64()), pa.array([-1] * len(out), pa.int32()), pa.array(out, pa.binary())], ["block", "number", "payload"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[pa.RecordBatch] = []
        n = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held_rows).combine_chunks()
            return rows(table["block"].to_numpy(), table["number"].to_numpy(), table["ids"].combine_chunks())

        for b in batches:
            held_rows.append(b)
            n += b.num_rows
            if n >= GATHERED:
                yield out()
                held_rows, n = [], 0
        if n:
            yield out()

    return coded.select("block", "number", "ids").mapInArrow(thrifty(each), "block long, number int, payload binary")


def encode(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, n_tokens.

    Null and empty texts have no ids. Rows that repeat are encoded alike; empty tables give no rows; other columns
    may have any name.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    places = blocked(own, vocabulary, False).repartition("unit")
    # the filter is always true; with it block and number are in use here too, so both sides of the join below read one shuffle of the places
    units = places.groupBy("unit").agg(F.max("block").alias("last_block"), F.max("number").alias("last_number")).filter("last_block IS NOT NULL AND last_number IS NOT NULL")
    coded = encoded_units(units.select("unit"), vocabulary)
    code = ">u2" if len(vocabulary.pieces) <= 1 << 16 else ">i4"
    both = blocked(own, vocabulary, True).unionByName(gathered(places.join(coded.hint("shuffle_hash"), "unit"), code))
    shared = docs.sparkSession.sparkContext.broadcast({"state": state(vocabulary)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come one after the other, each with its units' ids before its chunks."""
        v = held(shared.value)
        long = v.best if v.model == UNIGRAM else v.merged
        width = np.dtype(code).itemsize

        def ended(found: list[tuple], tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(tables).combine_chunks()
            ids = table["doc_id"].combine_chunks()
            own = Block(table["text"].combine_chunks(), v)
            n = len(own.units)
            starts, lengths, done = np.full(n, -1), np.zeros(n, np.int64), 0
            for numbers, sizes, raw in found:
                starts[numbers] = done + np.cumsum(sizes) - sizes
                lengths[numbers] = sizes
                done += len(raw)
            flat = [raw for _, _, raw in found]
            rest = np.flatnonzero(starts < 0)
            for k, u in zip(rest.tolist(), own.units.take(pa.array(rest)).to_pylist()):
                if len(u) <= LONG:
                    raise RuntimeError("a block does not hold the units that it named in the first pass")
                flat.append(np.array(long(u), np.int32))
                starts[k], lengths[k] = done, len(flat[-1])
                done += len(flat[-1])
            for rows, counts, values in own.encoded(starts, lengths, np.concatenate([np.zeros(0, np.int32), *flat]).astype(np.int32)):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), lists, pa.array(counts.astype(np.int64))], ["doc_id", "ids", "n_tokens"])

        block, found, tables = None, [], []
        for batch in batches:
            for name, number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if name != block:
                    if tables:
                        yield from ended(found, tables)
                    block, found, tables = name, [], []
                if number >= 0:
                    tables.append(pa.ipc.open_stream(payload.as_buffer()).read_all())
                    continue
                raw = zlib.decompress(payload.as_buffer())
                n = int.from_bytes(raw[:4], "little")
                sizes = np.frombuffer(raw, "<u2", n, 4 + 4 * n).astype(np.int64) // width
                found.append((np.cumsum(np.frombuffer(raw, "<i4", n, 4)), sizes, np.frombuffer(raw, code, -1, 4 + 6 * n)))
        if tables:
            yield from ended(found, tables)

    return both.repartition("block").sortWithinPartitions("block", "number").mapInArrow(thrifty(each), "doc_id long, ids array<int>, n_tokens long")


def decoded_text(vocabulary: Vocabulary, ids: Column) -> Column:
    """The text of an array of ids, in built-in functions. Null ids give ''.

    Pieces are joined as texts. Where one of them is a byte that is no character of its own, which has NUL for its text, the
    bytes of all pieces are joined as hexadecimal digits instead and read as UTF-8.
    """
    surfaces = vocabulary.surfaces()
    digits = F.split(F.lit(",".join(x.hex() for x in surfaces)), ",")

    def own(x: bytes, kind: int) -> str:
        text = "\0" if kind == BYTE and x[0] > 0x7F else x.decode()
        return "\0" if "\1" in text else text.replace(SPACE, " ")

    pieces = F.split(F.lit("\1".join(map(own, surfaces, vocabulary.kinds))), "\1")
    joined = lambda table: F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    spelled = F.replace(F.call_function("make_valid_utf8", F.unhex(joined(digits)).cast("string")), F.lit(SPACE), F.lit(" "))
    text = let(joined(pieces), lambda t: F.when(F.contains(t, F.lit("\0")), spelled).otherwise(t))
    if vocabulary.prefix:
        text = let(text, lambda t: F.when(F.startswith(t, F.lit(" ")), F.substring(t, F.lit(2), F.length(t))).otherwise(t))
    return F.coalesce(text, F.lit(""))


def decode(coded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """``coded`` with a column of the texts that its ids stand for. Ids outside the vocabulary add nothing; a column of that name is replaced."""
    return coded.withColumn(text, decoded_text(vocabulary, F.col(ids)))


def op1_sentencepiece(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Ids of every document, and the SHA-256 of the text that they decode to."""
    vocabulary = Vocabulary.load(model)
    out = decode(encode(documents(spark, sf_dir), vocabulary), vocabulary)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text"), 256).alias("decoded_sha256"))
