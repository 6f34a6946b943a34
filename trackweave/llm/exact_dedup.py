"""Exact dedup with a cuckoo-filter index over live digests.

Digests are dealt to index buckets by their first bits. Each bucket has a cuckoo filter of 16-bit fingerprints
and the content behind it: the stored keys. A digest that misses the filter is new and is inserted; a hit is
verified against the stored key in the slot that matched; a digest that agrees in its fingerprint only goes on
as new. If an insertion finds no place after a bounded number of moves, the filter is doubled and refilled from
the stored keys. Deletion takes a digest out of its slot and out of the store.

The index is a table with one row per live digest, its filter slot included, so a bucket's filter is rebuilt by
placing fingerprints, without hashing or moves. Buckets are independent and are updated by a co-grouped job.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, documents, utf8, written

#: Slots of a filter bucket, moves before a filter is doubled, and the first number of filter buckets.
SLOTS, MOVES, FIRST = 4, 200, 64
#: Index buckets of a small index, and live digests that one more index bucket is made for.
LEAST_BUCKETS, KEYS_A_BUCKET = 512, 50_000
#: Digests that a task merges before it passes them on.
MERGED = 200_000

STATE = "bucket int, digest binary, keep_id long, n long, slot int, size int"


def lower_ascii(text: bytes | None) -> bytes:
    """The normal form: A-Z lower-cased, null as empty."""
    return (text or b"").translate(LOWER)


class CuckooFilter:
    """Fingerprints of stored keys in two candidate buckets each; ``slots`` has key numbers, -1 for free."""

    def __init__(self, size: int = FIRST):
        self.size, self.keys, self.slots, self.free = size, [], [-1] * (size * SLOTS), []
        self.prints = [0] * (size * SLOTS)
        self.random = random.Random(0)

    @staticmethod
    def fingerprint(key: bytes) -> int:
        return int.from_bytes(key[8:10], "big") or 1

    def first(self, key: bytes) -> int:
        return int.from_bytes(key[10:18], "big") & (self.size - 1)

    def other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & (self.size - 1))

    def hits(self, key: bytes) -> Iterator[int]:
        """Slots whose fingerprint agrees with the key's."""
        f = self.fingerprint(key)
        a = self.first(key)
        for b in dict.fromkeys((a, self.other(a, f))):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[s] == f and self.slots[s] >= 0:
                    yield s

    def find(self, key: bytes) -> int:
        """Number of the stored key that is equal to ``key``, else -1. Filter hits are verified against stored keys."""
        return next((self.slots[s] for s in self.hits(key) if self.keys[self.slots[s]] == key), -1)

    def insert(self, key: bytes) -> int:
        """Store a key that find() does not know; its number."""
        if self.free:
            number = self.free.pop()
            self.keys[number] = key
        else:
            number = len(self.keys)
            self.keys.append(key)
        while not self._place(number):
            self._resize()
        return number

    def _place(self, number: int) -> bool:
        f = self.fingerprint(self.keys[number])
        a = self.first(self.keys[number])
        b = self.other(a, f)
        for c in (a, b):
            for s in range(c * SLOTS, c * SLOTS + SLOTS):
                if self.slots[s] < 0:
                    self.slots[s], self.prints[s] = number, f
                    return True
        moved = []
        c = self.random.choice((a, b))
        for _ in range(MOVES):
            s = c * SLOTS + self.random.randrange(SLOTS)
            moved.append((s, self.slots[s], self.prints[s]))
            number, self.slots[s] = self.slots[s], number
            f, self.prints[s] = self.prints[s], f
            c = self.other(c, f)
            for t in range(c * SLOTS, c * SLOTS + SLOTS):
                if self.slots[t] < 0:
                    self.slots[t], self.prints[t] = number, f
                    return True
        for s, n, p in reversed(moved):
            self.slots[s], self.prints[s] = n, p
        return False

    def _resize(self) -> None:
        """Double the filter and refill it from the stored keys that are placed."""
        live = [n for n in self.slots if n >= 0]
        while True:
            self.size *= 2
            self.slots, self.prints = [-1] * (self.size * SLOTS), [0] * (self.size * SLOTS)
            if all(self._place(n) for n in live):
                return

    def delete(self, key: bytes) -> int:
        """Forget a key; the number it had, -1 if it was not stored."""
        for s in self.hits(key):
            number = self.slots[s]
            if self.keys[number] == key:
                self.slots[s], self.prints[s], self.keys[number] = -1, 0, b""
                self.free.append(number)
                return number
        return -1

    @classmethod
    def restored(cls, keys: list[bytes], slots: list[int], size: int) -> CuckooFilter:
        """A filter from its stored keys and their slots."""
        out = cls(size)
        out.keys = list(keys)
        for number, s in enumerate(slots):
            out.slots[s], out.prints[s] = number, cls.fingerprint(keys[number])
        return out


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest) of each row: SHA-256 of the text in normal form."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(lower_ascii(t)).digest() for t in utf8(b.column(1))], pa.binary())], ["doc_id", "digest"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(hashed, "doc_id long, digest binary")


def merged(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (doc_id, digest) merged inside each task, so that a hot digest reaches its bucket a few times only: bucket, digest, keep_id, n.

    A null id is smaller than any other.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            keys = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(k[:8], "big") % n_buckets for k in keys], pa.int32()), pa.array(keys, pa.binary()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())],
                ["bucket", "digest", "keep_id", "n"],
            )

        for b in batches:
            for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if v := found.get(k):
                    v[1] += 1
                    if v[0] is None or i is not None and i > v[0]:
                        v[0] = i
                else:
                    found[k] = [i, 1]
            if len(found) >= MERGED:
                yield out()
                found.clear()
        yield out()

    return rows.mapInArrow(merge, "bucket int, digest binary, keep_id long, n long")


def _updated(key: tuple, state: pd.DataFrame, batch: pd.DataFrame, delete: bool) -> pd.DataFrame:
    """One index bucket after a batch of merged rows."""
    bucket = int(key[0])
    index = CuckooFilter.restored(list(state.digest), list(state.slot), int(state["size"].iloc[0])) if len(state) else CuckooFilter()
    ids, counts = [None if pd.isna(x) else int(x) for x in state.keep_id], [int(x) for x in state.n]
    for digest, keep, n in zip(batch.digest, batch.keep_id, batch.n):
        if delete:
            index.delete(digest)
            continue
        keep = None if pd.isna(keep) else int(keep)
        at = index.find(digest)
        if at < 0:
            at = index.insert(digest)
            if at == len(ids):
                ids.append(keep)
                counts.append(int(n))
            else:
                ids[at], counts[at] = keep, int(n)
        else:
            counts[at] += int(n)
            if ids[at] is None or keep is not None and keep > ids[at]:
                ids[at] = keep
    live = [(s, n) for s, n in enumerate(index.slots) if n >= 0]
    return pd.DataFrame(
        {
            "bucket": pd.Series([bucket] * len(live), dtype="int32"), "digest": [index.keys[n] for _, n in live], "keep_id": pd.array([ids[n] for _, n in live], dtype="Int64"),
            "n": pd.Series([counts[n] for _, n in live], dtype="int64"), "slot": pd.Series([s for s, _ in live], dtype="int32"), "size": pd.Series([index.size] * len(live), dtype="int32"),
        }
    )


class CuckooIndex:
    """A persistent index of live digests. ``state`` has a row per digest: keep_id is the largest id inserted with it, n the number of rows."""

    def __init__(self, spark: SparkSession, n_buckets: int = LEAST_BUCKETS):
        self.spark, self.n_buckets = spark, n_buckets
        self.state = spark.createDataFrame([], STATE)

    def _apply(self, rows: DataFrame, delete: bool) -> None:
        batch = merged(rows, self.n_buckets)
        update = lambda key, state, new: _updated(key, state, new, delete)
        self.state = written(self.state.groupBy("bucket").cogroup(batch.groupBy("bucket")).applyInPandas(update, STATE), "cuckoo")

    def insert(self, rows: DataFrame) -> None:
        """Add rows (doc_id, digest)."""
        self._apply(rows, False)

    def delete(self, rows: DataFrame) -> None:
        """Forget the digests of rows (doc_id, digest); unknown ones are passed over."""
        self._apply(rows, True)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, digest) with keep_id and n of their digest, null where it is not live."""
        return rows.join(self.state.select("digest", "keep_id", "n"), "digest", "left")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. The largest id of
    a group stays. Rows that repeat both an id and a text are counted in group_size and all marked alike; null
    ids are never kept beside others. An empty table gives no rows; other columns may have any name.
    """
    rows = written(digests(docs, doc_id, text), "digests")
    index = CuckooIndex(docs.sparkSession, max(LEAST_BUCKETS, rows.count() // KEYS_A_BUCKET))
    index.insert(rows)
    copies = index.state.filter("n > 1").select(F.col("digest").alias("of"), F.col("keep_id").alias("keep"), "n")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return rows.join(copies, F.col("digest") == F.col("of"), "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP7_SQL = """
WITH hashed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM hashed
"""
