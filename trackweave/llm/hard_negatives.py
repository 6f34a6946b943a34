"""Hard negatives by a vector-approximation file.

Each dimension is quantised to cells; a vector's approximation is its cell numbers. For an anchor, a table of the least
product with each cell gives, summed over dimensions, a lower bound of every row's score, and the upper bound is a
constant above it, as all cells of a dimension are equally wide. Only rows whose bounds may reach the best, or
may lie in a window of scores, are scored by their integers. Rows are dealt to stripes and anchors to blocks, both of
bounded size; each task sees one stripe and one block and keeps its best few of each anchor, which are then merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .vectors import Grid, dimension_bounds, integer_vectors, matrix

POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Bits of a cell number; rows of a stripe, rows that are worth a stripe of their own, and anchors of a block.
BITS, STRIPE, LEAST, BLOCK = 6, 32_768, 2_048, 4_096


class Approximations:
    """Vectors of a stripe, in order of label, with their approximations: the cells of two dimensions are one number."""

    def __init__(self, rows: pa.Table, grid: Grid):
        label = rows["label"].to_numpy()
        order = np.argsort(label, kind="stable")
        self.grid, self.dims = grid, len(grid.low)
        self.label, self.row, self.vec_id = label[order], rows["row_"].to_numpy()[order], rows["vec_id"].to_numpy()[order]
        self.q = matrix(rows["q"], self.dims)[order].astype(np.int64)
        raw = rows["cells"].combine_chunks()
        cells = np.frombuffer(b"".join(x.as_py() for x in raw), np.uint8).reshape(len(order), self.dims)[order].astype(np.uint16)
        if self.dims % 2:
            cells = np.hstack([cells, np.zeros((len(order), 1), np.uint16)])
        self.codes = np.ascontiguousarray((cells[:, ::2] << grid.bits | cells[:, 1::2]).T)

    def same(self, label: int) -> tuple[int, int]:
        """Begin and end of the rows of a label."""
        return int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, "right"))

    def bounds(self, anchor: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, int]:
        """Lower bounds of the scores of rows ``begin`` to ``end``, and how far above it a score can be."""
        table, gap = self.grid.product_table(anchor)
        if self.dims % 2:
            table = np.vstack([table, np.zeros((1, table.shape[1]), np.int64)])
        pairs = (table[::2, :, None] + table[1::2, None, :]).reshape(len(table) // 2, -1)
        lower = np.zeros(end - begin, np.int64)
        for t, c in zip(pairs, self.codes):
            lower += t.take(c[begin:end])
        return lower, gap

    def best(self, which: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``most`` of scored rows: higher scores first, then smaller ids."""
        order = np.lexsort((self.vec_id[which], -score))[:most]
        return which[order], score[order]


def nearest_of_label(data: Approximations, row: int, label: int, anchor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, score) of the ``most`` best rows of the label but ``row`` itself."""
    begin, end = data.same(label)
    lower, gap = data.bounds(anchor, begin, end)
    other = data.row[begin:end] != row
    may = other
    if (n := int(other.sum())) > most:
        may = other & (lower + gap >= np.partition(lower[other], n - most)[n - most])
    which = begin + np.flatnonzero(may)
    return data.best(which, data.q[which] @ anchor, most)


def in_window(data: Approximations, label: int, anchor: np.ndarray, positives: list[int], most: int, low: int, high: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each positive's score, (place, score) of the ``most`` best rows of other labels with low * positive <= 100 * score <= high * positive."""
    wanted = {p: (-(-low * p // 100), high * p // 100) for p in positives}
    wanted = {p: w for p, w in wanted.items() if w[0] <= w[1]}
    if not wanted:
        return {}
    lower, gap = data.bounds(anchor, 0, len(data.label))
    other = data.label != label
    out = {}
    for p, (least, largest) in wanted.items():
        may = other & (lower + gap >= least) & (lower <= largest)
        sure = lower[other & (lower >= least) & (lower + gap <= largest)]
        if len(sure) > most:
            may &= lower + gap >= np.partition(sure, len(sure) - most)[len(sure) - most]
        which = np.flatnonzero(may)
        score = data.q[which] @ anchor
        fits = (score >= least) & (score <= largest)
        out[p] = data.best(which[fits], score[fits], most)
    return out


def with_cells(rows: DataFrame, grid: Grid) -> DataFrame:
    """``rows`` (row_, vec_id, label, q) with ``cells``, a byte for each dimension."""
    dims = len(grid.low)

    def each(batches):
        for b in batches:
            cells = [c.tobytes() for c in grid.cells(matrix(b.column(3), dims))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.binary())], [*b.schema.names, "cells"])

    return rows.mapInArrow(each, "row_ long, vec_id long, label int, q array<int>, cells binary")


def search(rows: DataFrame, anchors: DataFrame, stripes: int, blocks: int, one, schema: str, grid: Grid) -> DataFrame:
    """What ``one`` (approximations of a stripe, an anchor's row as a dict) yields for each stripe and each anchor, as rows of ``schema``.

    Each stripe meets each block of anchors in one task, so rows are shuffled once for each block, anchors once for each stripe.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32()}
    kinds = [arrow[part.split()[1]] for part in schema.split(", ")]
    deal = lambda n, to: F.pmod(F.xxhash64("row_"), F.lit(n)).alias(to)
    every = lambda n, to: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(to)

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            data = Approximations(left, grid)
            for a in right.to_pylist():
                for r in one(data, a):
                    for column, value in zip(out, r):
                        column.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    left = rows.select(deal(stripes, "stripe"), every(blocks, "block"), "row_", "vec_id", "label", "q", "cells")
    right = anchors.select(every(stripes, "stripe"), deal(blocks, "block"), *anchors.columns)
    return left.groupBy("stripe", "block").cogroup(right.groupBy("stripe", "block")).applyInArrow(meet, schema)


def mined(vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", vec: str = "embedding", label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows for which ``anchors`` (of vec_id) is true.

    A score is the inner product of integer vectors (floor of 256 times each component). An anchor's positives are the
    best ``positives`` other rows of its label; for each, the best ``negatives`` rows of other labels within
    low to high hundredths of the positive's score are returned. Ties go to the smaller id. Rows with a
    null id or label, or whose vector is null or holds a null or non-finite component take no part, nor do vectors of
    another length than that of the smallest id. Rows that repeat an id are rows of their own: such an anchor has rows for each. Positives of
    scores under 0 have an empty window. An empty table gives no rows; other columns may have any name.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, vec_id, vec, label).filter("vec_id IS NOT NULL AND label IS NOT NULL")
    n, n_anchors, dims = rows.agg(F.count(F.lit(1)), F.count_if(anchors), F.max(F.size("q"))).first()
    grid = Grid(*dimension_bounds(rows, dims or 0), BITS)
    rows = written(with_cells(rows, grid), "approximations")
    stripes, blocks = max(1, -(-n // STRIPE), min(shuffle_partitions(spark), n // LEAST)), max(1, -(-n_anchors // BLOCK))
    own = rows.filter(anchors).select("row_", "vec_id", "label", "q")

    def positive(data: Approximations, a: dict):
        which, score = nearest_of_label(data, a["row_"], a["label"], np.array(a["q"], np.int64), positives)
        return [(a["row_"], int(data.vec_id[i]), int(s)) for i, s in zip(which, score)]

    found = search(rows, own, stripes, blocks, positive, "anchor long, positive_id long, positive_score long", grid)
    at = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("k", at).filter(F.col("k") <= positives).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("positives"))
    asked = written(own.join(best, F.col("row_") == F.col("anchor")).drop("anchor"), "anchors")

    def negative(data: Approximations, a: dict):
        windows = in_window(data, a["label"], np.array(a["q"], np.int64), sorted({p["positive_score"] for p in a["positives"]}), negatives, low, high)
        for p in a["positives"]:
            for i, s in zip(*windows.get(p["positive_score"], ((), ()))):
                yield a["row_"], a["vec_id"], p["k"], p["positive_id"], p["positive_score"], int(data.vec_id[i]), int(s)

    found = search(rows, asked, stripes, blocks, negative, "anchor long, anchor_id long, k int, positive_id long, positive_score long, negative_id long, negative_score long", grid)
    rank = F.row_number().over(W.partitionBy("anchor", "k").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label)


OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
