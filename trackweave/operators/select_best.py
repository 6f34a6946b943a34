"""Picking rows: best per group, pools of preferred rows, bands, swaps, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group; ``order`` should be total."""
    return df.withColumn("rank_", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("rank_ = 1").drop("rank_")


def preferred_pool(df: DataFrame, query: str, collection: str, preferred: Column, score: str, pos: str) -> DataFrame:
    """Best row of each collection among preferred rows, else among the others; rows without a collection all stay.

    Adds ``pool`` (0 preferred, 1 other, 2 without collection) and ``pool_pos`` (first position of the collection in its pool).
    """
    marked = df.withColumn("pool", F.when(F.col(collection).isNull(), 2).when(preferred, 0).otherwise(1))
    alone = marked.filter("pool = 2").withColumn("pool_pos", F.col(pos))
    by = W.partitionBy(query, collection, "pool")
    best = marked.filter("pool < 2").withColumn("pool_pos", F.min(pos).over(by)).withColumn("rank_", F.row_number().over(by.orderBy(F.desc(score), pos))).filter("rank_ = 1").drop("rank_")
    wanted = best.filter("pool = 0")
    rest = best.filter("pool = 1").join(wanted.select(query, collection), [query, collection], "left_anti")
    return wanted.unionByName(rest).unionByName(alone)


def picked_of_pool(pool: DataFrame, query: str, score: str, live: Column, delta: Column) -> DataFrame:
    """``pool`` with a flag ``picked`` for one row per query: highest score, then not live, then nearest duration, then pool order."""
    order = W.partitionBy(query).orderBy(F.desc(score), live.cast("int"), delta, "pool", "pool_pos")
    return pool.withColumn("picked", F.row_number().over(order) == 1)


def duration_delta(asked: Column, found: Column) -> Column:
    """Distance of durations: 0 if none is asked, 999999 if none is known."""
    return F.when(asked.isNull(), 0).when(F.coalesce(found, F.lit(0)) == 0, 999_999).otherwise(F.abs(asked - found))


def near_best(df: DataFrame, query: str, score: str, band: float) -> DataFrame:
    """Rows within ``band`` of their query's best score."""
    return df.withColumn("best_", F.max(score).over(W.partitionBy(query))).filter(F.col(score) >= F.col("best_") - band).drop("best_")


def tolerant_best(df: DataFrame, query: str, pos: str, score: str, overlap: str, name: str, band: float = 0.05) -> DataFrame:
    """(query, pos) of the row that a scan in order of ``pos`` ends with.

    A later row wins if its score is higher by more than ``band``, or within the band with more overlap, or with equal
    overlap and a longer name. This depends on the order, so a query's rows are folded in one array; they are the
    albums of one search and few.
    """
    row = F.struct(F.col(pos).alias("pos"), F.col(score).cast("double").alias("score"), F.col(overlap).cast("int").alias("overlap"), F.length(name).alias("size"))
    lists = df.groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(best: Column, x: Column) -> Column:
        close = F.abs(x["score"] - best["score"]) <= band
        better = (x["score"] > best["score"] + band) | (close & (x["overlap"] > best["overlap"])) | (close & (x["overlap"] == best["overlap"]) & (x["size"] > best["size"]))
        return F.when(better, x).otherwise(best)

    return lists.select(query, F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), F.col("rows")[0], step)["pos"].alias(pos))


def side_numbers(df: DataFrame, release: str, number: str) -> DataFrame:
    """Track numbers of sided media: 'B2' is 2 and the tracks on earlier sides; plain numbers stay; others are null."""
    side = F.ascii(F.upper(F.regexp_extract(number, r"^([A-Za-z])(\d+)$", 1)))
    marked = df.withColumn("side_", F.when(F.col(number).rlike(r"^[A-Za-z]\d+$"), side)).withColumn("own_", F.regexp_extract(number, r"^[A-Za-z]?(\d+)$", 1))
    before = F.count("side_").over(W.partitionBy(release).orderBy("side_").rangeBetween(W.unboundedPreceding, -1))
    value = F.expr("try_cast(own_ as int)")
    return marked.withColumn("position", F.when(F.col("side_").isNotNull(), (before + value).cast("int")).when(F.col(number).rlike(r"^\d+$"), value)).drop("side_", "own_")


def collision_names(df: DataFrame, name: str, artist: str, order: Sequence[str], most: int = 10) -> DataFrame:
    """``df`` with a file name of its own: the name, then 'name - artist', then 'name - artist (1)' and so on to ``most``, beyond that null."""
    n = F.row_number().over(W.partitionBy(name).orderBy(*order))
    base = F.concat(F.col(name), F.lit(" - "), F.col(artist))
    m = F.row_number().over(W.partitionBy(name, artist, F.col("n_") == 1).orderBy(*order))
    numbered = df.withColumn("n_", n).withColumn("m_", m)
    out = F.when(F.col("n_") == 1, F.col(name)).when(F.col("m_") == 1, base).when(F.col("m_") <= most + 1, F.concat(base, F.lit(" ("), (F.col("m_") - 1).cast("string"), F.lit(")")))
    return numbered.withColumn("file_name", out).drop("n_", "m_")


def top_tag(tags: Column) -> Column:
    """Name of the most counted of an array of (name, count); ties to the first."""
    at = F.transform(tags, lambda t, i: F.struct(t["count"].alias("count"), (-i).alias("at"), t["name"].alias("name")))
    return F.array_max(at)["name"]
