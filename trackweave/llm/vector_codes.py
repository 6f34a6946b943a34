"""Vector compression: each part of a vector becomes the number of the nearest entry of that part's codebook.

The nearest entry is found by a vector approximation of the codebook: entries' coordinates are quantised to cells,
each query's tables of cells give a lower and an upper bound of its distance to every entry, and only entries whose
lower bound is within the least upper bound are compared by their integers. Codebooks are trained by rounds of
assigning all vectors and averaging; each task sends sums only, so a round shuffles a bounded table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .vectors import Grid, integer_vectors, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Bits of a coordinate's cell, and queries that are bounded together.
BITS, CHUNK = 4, 2048
#: Sums of at most so many labels are broadcast; more are joined by shuffles.
LABELS = 100_000


def part_ends(dims: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part: equal ones if ``parts`` divides ``dims``."""
    return [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]


class PartBook:
    """One part's entries, with their approximation."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = np.asarray(entries, np.int64)
        self.grid = Grid(self.entries.min(0), self.entries.max(0), bits)
        self.cells = self.grid.cells(self.entries)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each point's nearest entry (ties: the lower number), and how many entries were compared by their integers."""
        points = points.astype(np.int64)
        number, distance, refined = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), 0
        for at in range(0, len(points), CHUNK):
            x = points[at : at + CHUNK]
            lower, upper = (np.zeros((len(x), len(self.entries)), np.int64) for _ in range(2))
            for k in range(x.shape[1]):
                least, most = self.grid.distance_tables(k, x[:, k])
                lower += least[:, self.cells[:, k]]
                upper += most[:, self.cells[:, k]]
            who, which = np.nonzero(lower <= upper.min(1)[:, None])  # by point, then by number; at least one each
            d = ((x[who] - self.entries[which]) ** 2).sum(1)
            best = np.minimum.reduceat(d, np.searchsorted(who, np.arange(len(x))))
            ties = np.nonzero(d == best[who])[0][::-1]
            number[at + who[ties]] = which[ties]  # of repeated places the last counts, which is the lowest number
            distance[at : at + CHUNK] = best
            refined += len(d)
        return number, distance, refined


@dataclass
class Codebooks:
    """Entries of all parts; ``books`` has an array (entries, components) for each part."""

    dims: int
    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()

    def assigned(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers (rows, parts) and squared distances, summed over parts."""
        numbers, error = np.zeros((len(m), len(self.books)), np.int64), np.zeros(len(m), np.int64)
        for p, (a, z) in enumerate(part_ends(self.dims, len(self.books))):
            numbers[:, p], d, _ = PartBook(self.books[p]).nearest(m[:, a:z])
            error += d
        return numbers, error


def improved(rows: DataFrame, old: Codebooks) -> Codebooks:
    """A round: all parts are assigned, and each entry becomes its parts' componentwise floor(sum / count); unused ones stay."""
    ends = part_ends(old.dims, len(old.books))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in old.books], [np.zeros(len(b), np.int64) for b in old.books]
        for batch in batches:
            m = matrix(batch.column(0), old.dims).astype(np.int64)
            numbers, _ = old.assigned(m)
            for p, (a, z) in enumerate(ends):
                np.add.at(sums[p], numbers[:, p], m[:, a:z])
                counts[p] += np.bincount(numbers[:, p], minlength=len(counts[p]))
        out = [(p, e, k, int(counts[p][e]), int(sums[p][e, k])) for p in range(len(ends)) for e in np.nonzero(counts[p])[0].tolist() for k in range(sums[p].shape[1])]
        names = ["part", "entry", "k", "n", "s"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int32()] * 3 + [pa.int64()] * 2)], names)

    totals = rows.select("q").mapInArrow(each, "part int, entry int, k int, n long, s long").groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    books = [b.copy() for b in old.books]
    for r in totals.collect():  # a number for each entry's component at most
        books[r.part][r.entry, r.k] = r.s // r.n
    return Codebooks(old.dims, books)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of integer vectors (see vectors.integer_vectors). They begin as the vectors of the smallest ids (ties: the smaller vector; null ids last)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    dims = len(first[0].q) if first else 0
    seed = np.array([r.q for r in first], np.int64).reshape(len(first), dims)
    books = Codebooks(dims, [seed[:, a:z].copy() for a, z in part_ends(dims, parts)])
    for _ in range(rounds if first else 0):
        books = improved(rows, books)
    return books


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part's entry (so at most 256 entries), and the squared distances summed over parts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, error = books.assigned(matrix(b.column(2), books.dims))
            codes = [r.tobytes().hex() for r in numbers.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "q").mapInArrow(each, "vec_id long, label int, code string, error long")


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` (a column code, and others) with ``q``, the integer vector that a code stands for; null for a null code."""
    tables = [F.array(*[F.array(*map(F.lit, e)) for e in b.tolist()]) for b in books.books]
    number = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("q", F.flatten(F.array(*[F.get(t, number(p)) for p, t in enumerate(tables)])))


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of the rows whose vector is not null and holds finite components only, and the codebooks.

    label_error is the error summed over equal labels, null labels together. Rows that repeat an id are rows of
    their own. Components are held within 65,536; vectors of another length than that of the smallest id are left out. If the length is
    no multiple of ``parts``, parts differ by one component. An empty table gives no rows and empty codebooks. Other columns may have any name.
    """
    rows = integer_vectors(vectors, vec_id, vec, label)
    books = train(rows, parts, entries, rounds)
    codes = written(encoded(rows, books), "vector-codes")
    sums = small(written(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors"), LABELS)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of"), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _assign_sql(books: str) -> str:
    return f"""SELECT vec_id, label, part, arg_min(entry, struct_pack(d := d, entry := entry)) AS entry, min(d) AS d, any_value(q) AS q
               FROM (SELECT p.vec_id, p.label, p.part, p.q, b.entry, (p.q[1] - b.q[1]) ** 2 + (p.q[2] - b.q[2]) ** 2 + (p.q[3] - b.q[3]) ** 2 + (p.q[4] - b.q[4]) ** 2 AS d
                     FROM parts p JOIN {books} b ON p.part = b.part) GROUP BY vec_id, label, part"""


def _improve_sql(books: str, used: str) -> str:
    means = ", ".join(f"CAST(floor(sum(q[{k}]) / count(*)) AS BIGINT)" for k in range(1, 5))
    return f"""SELECT b.part, b.entry, coalesce(n.q, b.q) AS q FROM {books} b LEFT JOIN (SELECT part, entry, [{means}] AS q FROM {used} GROUP BY part, entry) n ON b.part = n.part AND b.entry = n.entry"""


#: For vectors of 64 components.
OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (SELECT vec_id, label, part, q[4 * part + 1 : 4 * part + 4] AS q FROM v, range(16) r(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64),
b0 AS MATERIALIZED (SELECT part, entry, q FROM parts JOIN first USING (vec_id)),
a1 AS MATERIALIZED ({_assign_sql("b0")}), b1 AS MATERIALIZED ({_improve_sql("b0", "a1")}),
a2 AS MATERIALIZED ({_assign_sql("b1")}), b2 AS MATERIALIZED ({_improve_sql("b1", "a2")}),
a3 AS MATERIALIZED ({_assign_sql("b2")}),
codes AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256 FROM codes
"""
