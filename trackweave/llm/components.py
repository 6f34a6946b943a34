"""Connected components by alternating large and small stars, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _starred(arcs: DataFrame, least: DataFrame) -> DataFrame:
    """Arcs (u, v) with the smallest id around u. ``least`` is written first, so that both sides of the join are shuffled for it and a hub's arcs can be split."""
    return arcs.join(written(least, "least"), "u")


def roots(edges: DataFrame) -> DataFrame:
    """(id, root) for each id of ``edges`` (u, v): the smallest id that it is connected with. Self loops and repeated edges are harmless."""
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(_starred(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        arcs = _starred(large, large.groupBy("u").agg(F.min("v").alias("m")))
        small = arcs.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = written(small.filter("u <> v").distinct(), "edges")
        if (then := _state(now)) == state:
            break
        state = then
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
