"""Near-duplicate documents by one-permutation MinHash.

A document is the set of its word shingles. One hash of each shingle gives its bin and its value; the least value
of a bin is the bin's MinHash, and empty bins borrow from bins that a fixed random order of each bin names (optimal
densification). Bins are banded; documents that agree in all rows of a band share a bucket. Documents with equal
sets are one class and are represented by their smallest id.

Candidates are stars: each member of a bucket is compared with the bucket's smallest id only, so their number grows
with the members and not with their pairs. Links are confirmed on full sets. Where a bucket is not in one connected
component after that, the members outside its largest component are matched with those of other components too, so
no link between members of a bucket is lost. That is done block by block: a task compares two blocks of sets at once
and only passes on the similar pairs that connect components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, documents, temporary_tables, thrifty, utf8, written
from .components import roots

#: Bands and rows of a band. Sets of similarity 0.8 share a bucket with a chance of 1 - (1 - 0.8**5)**25 = 0.99995.
BANDS, ROWS = 25, 5
#: Words of a shingle, and least similarity in percent.
WIDTH, PERCENT = 5, 80

#: Shingles and sets of a block that is compared with another at once (a larger set is a block of its own), and rows of a batch that are Python objects at once.
BLOCK, BLOCK_SETS, SLICE = 1 << 15, 512, 256

U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles of ``width`` words, A-Z lower-cased; with fewer words the whole sequence is one."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, U64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, U64)
    for k in range(width):
        out = out * U64(0x9DDFEA08EB382D69) + hashes[k : n + k]
    return np.unique(mixed(out))


class OnePermutation:
    """Signatures of sets of hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(1)
        self.donors = np.stack([rng.permutation(self.bins) for _ in range(self.bins)])
        self.salts = mixed(np.arange(1, bands + 1, dtype=U64))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The MinHash of each bin of a sorted set of hashes that is not empty."""
        bins = ((hashes >> U64(32)) * U64(self.bins) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        values, filled = np.zeros(self.bins, U64), np.zeros(self.bins, bool)
        values[bins[first]], filled[bins[first]] = hashes[first], True
        empty = np.flatnonzero(~filled)
        if len(empty):
            donors = self.donors[empty]
            values[empty] = values[donors[np.arange(len(empty)), filled[donors].argmax(1)]]
        return values

    def band_keys(self, values: np.ndarray) -> np.ndarray:
        keys = self.salts.copy()
        for column in values.reshape(self.bands, self.rows).T:
            keys = mixed(keys * U64(0x9DDFEA08EB382D69) + column)
        return keys.view(np.int64)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, as their texts become Python objects."""
    return (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands) of rows (doc_id, text); the last two are null for an empty set or a null id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = OnePermutation()
        for b in sliced(batches):
            n, digests, bands = [], [], []
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                s = shingle_set(t, width)
                n.append(len(s))
                real = len(s) > 0 and i is not None
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if real else None)
                bands.append(minhash.band_keys(minhash.signature(s)) if real else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "bands"])

    return docs.mapInArrow(thrifty(each), "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def packed(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, hashes): the hashes of each text's set, as 64-bit numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, width).tobytes() for t in utf8(b.column(1))], pa.binary())], ["doc_id", "hashes"])

    return texts.mapInArrow(thrifty(each), "doc_id long, hashes binary")


def block_pairs(left: list[dict], right: list[dict], percent: int) -> list[tuple[int, int]]:
    """Pairs of ids of two blocks of sets (rep, root, hashes), in different components, that are similar enough.

    The hashes of the right block are sorted with their owners; each left set finds its hashes among them and counts
    by owner. That takes memory for the right block only.
    """
    sets = [np.frombuffer(x["hashes"], U64) for x in right]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    hashes, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], owners[order]
    ids, roots_ = np.array([x["rep"] for x in right]), np.array([x["root"] for x in right])
    found = []
    for x in left:
        own = np.frombuffer(x["hashes"], U64)
        first, past = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        counts = past - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        both = np.bincount(owners[at], minlength=len(sets))
        near = (roots_ != x["root"]) & (100 * both >= percent * (len(own) + sizes - both))
        found += [(x["rep"], int(i)) for i in ids[near]]
    return found


def joining(pairs: list[tuple[int, int]], roots_: dict[int, int]) -> list[tuple[int, int]]:
    """Those pairs of ids that connect what the pairs before do not: of n components at most n - 1, which connect as much as all pairs do."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for a, b in pairs:
        x, y = top(roots_[a]), top(roots_[b])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((min(a, b), max(a, b)))
    return out


def level(n: Column, percent: int) -> Column:
    """Number of a size class: sets that are similar enough are in the same or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100.01 / percent)).cast("int")


def rest_pairs(rest: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect all that are similar: of each key's members (key, rep, root, n, main) outside its main component, with its members of other components.

    Members of a key and size class are dealt to blocks of about BLOCK shingles and BLOCK_SETS sets, and blocks meet if
    their sizes allow it. Of the similar pairs of two blocks only those are passed on that connect components, so their number grows with
    the members of the blocks and not with their pairs; no component is lost. Members that can meet no one outside the main component are left out before ``hashes`` (doc_id,
    hashes) are looked up. Each pair of blocks is a row of its own key, so that those of one bucket are spread over the tasks.
    """
    sized = rest.withColumn("level", level(F.col("n"), percent))
    met = sized.filter("root <> main").select("key", F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1)).alias("level")).distinct()
    sized = sized.join(met, ["key", "level"], "left_semi")
    n_blocks = F.ceil(F.greatest(F.sum("n") / BLOCK, F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("n_blocks")
    counts = written(sized.groupBy("key", "level").agg(n_blocks), "blocks")
    dealt = sized.join(counts, ["key", "level"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    member = F.struct("rep", "root", "hashes")
    every = dealt.join(hashes, F.col("rep") == F.col("doc_id")).groupBy("key", "level", "block").agg(F.collect_list(member).alias("right"), F.collect_list(F.when(F.col("root") != F.col("main"), member)).alias("left"))
    every = written(every, "blocks-of-sets")
    other = every.filter(F.size("left") > 0).select("key", F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1)).alias("level"), "left").join(counts, ["key", "level"])
    other = other.select("key", "level", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "left")
    both = other.join(every.select("key", "level", "block", "right"), ["key", "level", "block"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                left, right = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                found = joining(block_pairs(left, right, percent), {x["rep"]: x["root"] for x in (*left, *right)})
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    return both.select("left", "right").mapInArrow(thrifty(each), "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts' full sets are similar enough."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, U64)
        for b in sliced(batches):
            keep = []
            for i, s, t in zip(b.column(0).to_pylist(), utf8(b.column(2)), utf8(b.column(3))):
                if i != last:
                    last, own = i, shingle_set(s, width)
                other = shingle_set(t, width)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(thrifty(each), "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links), kept (own id is it).

    Two documents are linked if 100 * intersection >= percent * union of their sets. Null, empty and blank texts
    have empty sets and no links. A null id is never linked, has a null component and is kept. Rows that repeat an
    id are one document, linked through all its texts. Empty tables give no rows; other columns may have any name.
    The result is a written table; all others are removed.
    """
    with temporary_tables(docs.sparkSession):
        return _near_groups(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), width, percent)


def _near_groups(own: DataFrame, width: int, percent: int) -> DataFrame:
    signed = written(signatures(own, width), "signatures")
    classes = signed.filter("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    # sets so small that one shingle more or less is too much can only be linked with equal sets, which are one class already
    linkable = signed.filter(100 * F.col("n_shingles") >= percent * (F.col("n_shingles") + 1)).withColumnRenamed("set_hash", "of")
    reps = linkable.join(classes, (F.col("of") == F.col("set_hash")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["set_hash"])
    banded = written(reps.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n")), "banded")
    shared = banded.groupBy("key").agg(F.min("rep").alias("center"), F.min(F.struct("rep", "n"))["n"].alias("center_n"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    members = written(banded.join(written(shared, "buckets"), "key"), "members")
    texts = written(own.join(members.select(F.col("rep").alias("of")).distinct(), F.col("doc_id") == F.col("of"), "left_semi"), "texts")
    alike = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent

    stars = written(members.filter((F.col("rep") != F.col("center")) & alike(F.col("n"), F.col("center_n"))).select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = written(confirmed(stars, texts, width, percent), "links")
    found = written(roots(links.toDF("u", "v")), "roots")

    # the rest: members of a bucket in different components
    rooted = members.join(found, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    rooted = written(rooted, "rooted")
    counts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("rep")).alias("h"), F.sum(F.xxhash64(F.lit(1), "rep").cast("decimal(38,0)")).alias("g"))
    largest = counts.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts"), F.bit_xor("h").alias("h"), F.sum("g").alias("g"), F.sum("c").alias("c")).filter("parts > 1")
    largest = largest.groupBy("h", "g", "c").agg(F.min(F.struct("key", "main")).alias("one")).select("one.*")  # buckets of the same members are compared once
    rest = written(rooted.join(written(largest, "largest"), "key"), "rest")
    hashes = written(packed(texts.join(rest.select(F.col("rep").alias("of")).distinct(), F.col("doc_id") == F.col("of"), "left_semi").select("doc_id", "text"), width), "hashes")
    cross = rest_pairs(rest, hashes, percent)
    more = written(cross, "more-links")
    if not more.isEmpty():
        found = written(roots(links.union(more).toDF("u", "v")), "roots")

    groups = classes.join(found, F.col("rep") == F.col("id"), "left").select(F.col("set_hash").alias("of"), F.coalesce("root", "rep").alias("root"))
    groups = written(groups, "groups")
    component = F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    out = signed.join(groups, F.col("set_hash") == F.col("of"), "left").select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
    return written(out, "near-groups", keep=True)


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), width=2)
