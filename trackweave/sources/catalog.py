"""Sources: line files, JSON payloads and catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select_best import first_of


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): non-blank lines of text files, stripped; lines that begin with # are comments (an indented # is not)."""
    lines = spark.read.text(path)
    return lines.filter(~F.startswith("value", F.lit("#"))).select(F.trim("value").alias("line")).filter("line <> ''")


def entries(df: DataFrame, column: str) -> DataFrame:
    """One row per entry of an array column; rows without entries stay once, with null."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode_outer(column).alias("entry_pos", "entry"))


def json_list(df: DataFrame, column: str, element: str, keys: tuple[str, ...] = ("data", "results")) -> DataFrame:
    """Rows of a JSON list that lies under one of ``keys``, as structs of schema ``element``; texts that are no JSON give none."""
    parsed = F.from_json(F.col(column), "struct<" + ",".join(f"`{k}`:array<struct<{element}>>" for k in keys) + ">")
    rows = df.withColumn("parsed_", parsed)
    return rows.select(*df.columns, F.explode(F.coalesce(*[F.col(f"parsed_.{k}") for k in keys])).alias("item"))


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def by_ids(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows of some ids; no ids, no rows."""
    return df.filter(F.col(key).isin(values)) if values else df.limit(0)


def page(df: DataFrame, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in order of the key."""
    return df.orderBy(key).offset(offset).limit(limit)


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, fields: list[str], name: str) -> DataFrame:
    """``parents`` with an array of their children, ordered by ``fields``; empty for none."""
    lists = children.groupBy(F.col(child_key).alias("of_")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    joined = parents.join(lists, F.col(parent_key) == F.col("of_"), "left").drop("of_")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))


def tracks_of(tracks: DataFrame, key: str, value, albums: DataFrame | None = None) -> DataFrame:
    """Track rows of one album, each with its album's columns if ``albums`` is given (nulls where it is not known)."""
    own = by_id(tracks, key, value)
    return own if albums is None else own.join(by_id(albums, key, value), key, "left")


def read_through(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local rows, and remote rows of the keys that are not known locally."""
    return local.unionByName(remote.join(local.select(key).distinct(), key, "left_anti"))


def first_source(df: DataFrame, key: str, rank: Column, order: list[str]) -> DataFrame:
    """Rows of the first source (lowest rank) that has any for a key, as in fallbacks over countries or query forms."""
    ranked = df.withColumn("rank_", rank)
    best = ranked.groupBy(key).agg(F.min("rank_").alias("best_"))
    return ranked.join(best, key).filter("rank_ = best_").drop("rank_", "best_")


def keep_first(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key by position."""
    return first_of(df, [key], [F.col(pos)])
