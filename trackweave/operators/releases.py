"""Operators over releases: their tracks, the pick of one, and what leaves the engine of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .select_best import first_of

#: Rows of a list of artists that are broadcast.
LISTED = 10_000


def track_total(media: Column) -> Column:
    """Number of tracks of all media (an array of structs with ``tracks``); null media or tracks count as none."""
    sizes = F.transform(media, lambda m: F.coalesce(F.size(m["tracks"]), F.lit(0)))
    return F.coalesce(F.aggregate(F.filter(sizes, lambda n: n > 0), F.lit(0), lambda a, n: a + n), F.lit(0))


def contained(a: Column, b: Column) -> Column:
    """Whether one of two titles, neither empty, holds the other."""
    a, b = T.text_or_empty(a), T.text_or_empty(b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def release_track(rows: DataFrame, key: str, wanted: Column, title: Column, alternative: Column, order: list[str]) -> DataFrame:
    """One track row of each release, with ``rank``: the first whose title is contained and that is no alternative version (0), else the first contained (1), else the first (2).

    ``order`` should be total; rows that tie in it are picked from in any order.
    """
    fits = contained(wanted, title)
    rank = F.when(fits & ~F.coalesce(alternative, F.lit(False)), 0).when(fits, 1).otherwise(2)
    return first_of(rows.withColumn("rank", rank), [key], [F.col("rank"), *map(F.col, order)])


def not_listed(df: DataFrame, listed: DataFrame, artist: Column, title: Column) -> DataFrame:
    """``df`` without the rows whose artist is in ``listed`` (artist, word) with a word that the title holds.

    A list of up to LISTED rows is broadcast; a longer one is joined by artist as Spark sees fit.
    """
    listed = F.broadcast(listed) if listed.limit(LISTED + 1).count() <= LISTED else listed
    return df.join(listed, (artist == F.col("artist")) & F.contains(title, F.col("word")), "left_anti")


def exported(df: DataFrame, key: str) -> DataFrame:
    """``key`` and each row as JSON, nulls included, without the internal columns, whose names begin with an underscore."""
    shown = [F.col(c) for c in df.columns if not c.startswith("_")]
    return df.select(key, F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def trusted_isrc(*sources: Column) -> Column:
    """The first code, from the most to the least trusted source, that is neither null nor empty; else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in sources], F.lit(""))


def least_score(confidence: Column) -> Column:
    """The score that a catalog match needs, which is higher where the recording is of low confidence."""
    return F.when(confidence == "LOW", 0.70).otherwise(0.55)


def without_internals(df: DataFrame) -> DataFrame:
    """``df`` without its internal columns, whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def with_fields(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with fields set that it has, in their types; names that it lacks are passed over."""
    kinds = dict(df.dtypes)
    return df.withColumns({n: c.cast(kinds[n]) for n, c in values.items() if n in kinds})
