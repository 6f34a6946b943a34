"""Integer vectors, and vector approximations: coordinates quantised to cells, whose tables bound distances and products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A component x becomes floor(SCALE * x), held within MOST, so that sums of products of 4096 components fit in 64 bits.
SCALE, MOST = 256, 1 << 24


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -MOST, MOST).astype(np.int32)


def kept(column: pa.ListArray) -> tuple[np.ndarray, pa.ListArray]:
    """Which vectors of a list column have finite components only, and the integers of those."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null lists have no values, null values become NaN
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
    whole = np.repeat(good, sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
    return good, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(integers(flat[whole]), pa.int32()))


def integer_vectors(df: DataFrame, vec_id: str, vec: str, label: Column | str) -> DataFrame:
    """(row_, vec_id, label, q) of the rows whose vector is not null and holds finite components only, written: q has its integers.

    row_ is a number of each row, as ids may repeat. Vectors of another length than that of the smallest id
    (ties: the shortest) cannot be compared with it and are left out.
    """
    own = df.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("int").alias("label"), F.col(vec).alias("vec"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, q = kept(b.column(2))
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask), q], ["vec_id", "label", "q"])

    clean = own.mapInArrow(each, "vec_id long, label int, q array<int>")
    rows = written(clean.select(F.monotonically_increasing_id().alias("row_"), "vec_id", "label", "q"), "vectors")
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size("q").alias("dims")))["dims"]).first()[0]
    return rows.filter(F.size("q") == (first or 0))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A column of integer vectors of one length as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


class Grid:
    """Cells of equal width, 2**bits for each dimension at most; cell c of dimension k holds the integers low[k] + c * width[k] to low[k] + (c + 1) * width[k] - 1."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.bits, self.low = bits, np.asarray(low, np.int64)
        span = np.asarray(high, np.int64) - self.low + 1
        self.width = np.maximum(1, -(-span >> bits))
        edges = self.low[:, None] + np.arange((1 << bits) + 1) * self.width[:, None]
        #: Least and largest integer of each cell, by dimension and cell.
        self.least, self.largest = edges[:, :-1], edges[:, 1:] - 1

    def cells(self, points: np.ndarray) -> np.ndarray:
        """Cell numbers of points that lie within the grid."""
        return ((points - self.low) // self.width).astype(np.uint8)

    def distance_tables(self, k: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query's coordinate k and each cell, bounds of the squared difference: (queries, cells) each."""
        below, above = self.least[k] - q[:, None], q[:, None] - self.largest[k]
        return np.maximum(np.maximum(below, above), 0) ** 2, np.maximum(-below, -above) ** 2

    def product_table(self, q: np.ndarray) -> tuple[np.ndarray, int]:
        """For one query, the least product with each dimension's cells (dimensions, cells), and by how much a sum over all dimensions can be larger."""
        q = q.astype(np.int64)[:, None]
        return np.minimum(q * self.least, q * self.largest), int((np.abs(q[:, 0]) * (self.width - 1)).sum())


def dimension_bounds(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer of each dimension over all vectors; each task sends one row a dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(0), dims)
                a, z = m.min(0), m.max(0)
                low, high = (a, z) if low is None else (np.minimum(low, a), np.maximum(high, z))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["k", "low", "high"])

    found = rows.select("q").mapInArrow(each, "k int, low long, high long").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for r in found.collect():  # as many rows as dimensions
        low[r.k], high[r.k] = r.low, r.high
    return low, high
