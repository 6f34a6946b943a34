"""Merging records: what fills, what overwrites, and what a guard allows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing(c: Column, kind: str) -> Column:
    """The value, or null where it is empty, 0 or false: such values never overwrite."""
    if kind == "string":
        return F.nullif(c, F.lit(""))
    if kind == "boolean":
        return F.when(c, c)
    return F.nullif(c, F.lit(0).cast(kind))


def merged(old: Column, new: Column, kind: str, overwrite: bool | Column = False) -> Column:
    """One field of a merge: the new value if it may overwrite and is there, else the old one, else the new."""
    a, b = missing(old, kind), missing(new, kind)
    if isinstance(overwrite, bool):
        return F.coalesce(b, a) if overwrite else F.coalesce(a, b)
    return F.when(overwrite, F.coalesce(b, a)).otherwise(F.coalesce(a, b))


def merge_records(base: DataFrame, update: DataFrame, key: str, overwrite: Iterable[str] = ()) -> DataFrame:
    """``base`` with the fields that it shares with ``update`` merged, by key. Keys of ``update`` are unique; its other rows are left out."""
    kinds = dict(base.dtypes)
    shared = [c for c in update.columns if c in kinds and c != key]
    new = update.select(F.col(key), *[F.col(c).alias(f"{c}__new") for c in shared])
    allowed = set(overwrite)
    fields = [merged(F.col(c), F.col(f"{c}__new"), kinds[c], c in allowed).alias(c) if c in shared else F.col(c) for c in base.columns]
    return base.join(new, key, "left").select(*fields)


def cascade(stages: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first stage that resolves a key: each stage only counts where no earlier one did. Rows of a null key all stay.

    All stages are shuffled once, by the key; the least number of a stage decides.
    """
    numbered = [stage.withColumn("stage_", F.lit(n)) for n, stage in enumerate(stages)]
    first = reduce(DataFrame.unionByName, numbered).withColumn("first_", F.min("stage_").over(W.partitionBy(key)))
    return first.filter(F.col(key).isNull() | (F.col("stage_") == F.col("first_"))).drop("stage_", "first_")


def valid_year(text: Column) -> Column:
    """The year that a date text begins with, if it is from 1900 to 2100, else null."""
    year = F.when(F.substring(text, 1, 4).rlike(r"^\d{4}$"), F.substring(text, 1, 4).cast("int"))
    return F.when(year.between(1900, 2100), year)


def repaired_year(current: Column, sources: list[Column], last: list[Column]) -> Column:
    """A year as text: the first source that is earlier than the current one; if that leaves none, the first valid of ``last``."""
    now = F.coalesce(valid_year(current), F.lit(9999))
    earlier = F.coalesce(*[F.when(valid_year(s) < now, valid_year(s)) for s in sources])
    return F.coalesce(earlier, valid_year(current), *[valid_year(s) for s in last]).cast("string")


def durations_agree(a: Column, b: Column, within: int = 5000) -> Column:
    """Whether durations are close; unknown ones agree."""
    return F.coalesce(F.abs(a - b) <= within, F.lit(True))


def tags_agree(source: Column, title: Column, album: Column) -> Column:
    """Whether a version tag of the source is found in the candidate's title or album; tags of the candidate alone are fine."""
    return ~source | title | album


def overwrite_fields(consistent: Column, promote_title: Column) -> dict[str, Column]:
    """For each guarded field, whether a candidate may overwrite it."""
    yes = F.lit(True)
    return {"cover_url": yes, "explicit": yes, "title": promote_title, "track_number": consistent, "disc_number": consistent}


def consistent_match(found: Column, tags: Column, confidence: Column, durations: Column, by_isrc: Column, matched_isrc: Column, names: Column, isrc_a: Column, isrc_b: Column, safe: Column) -> Column:
    """Whether a candidate is consistent with the recording: tags, durations if the recording is good, names if it was found by ISRC alone, and ISRCs that do not contradict."""
    empty = (F.coalesce(isrc_a, F.lit("")) == "") | (F.coalesce(isrc_b, F.lit("")) == "")
    return found & tags & ((confidence < 0.75) | durations) & (~by_isrc | matched_isrc | names) & (empty | safe)


def title_promotion(own: Column, candidate: Column, likeness: Column) -> Column:
    """Whether a candidate's longer spelling of the same title should replace it."""
    return (own != "") & (candidate != "") & (own != candidate) & (likeness >= 0.92) & (F.length(candidate) > F.length(own))


def is_compilation(various: Column, primary: Column, album_artist: Column, contained: Column) -> Column:
    return various | ((primary != "") & (album_artist != "") & ~contained)
