"""Enriching raw records: seed, local match, then provider records in order of trust, then finishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mappers import finished, seeds
from ..operators.merge import cascade, merge_records
from ..sources.catalog import keep_first
from .local_match import match_records


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint, where the session has a folder for one: later stages use it several times."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def enrich(raw: DataFrame, tracks: DataFrame, albums: DataFrame, providers: list[DataFrame]) -> DataFrame:
    """Finished records of raw ones (see schemas.RAW).

    Repeated video ids count once, the first. A local match overwrites what the seed has; otherwise the first of
    ``providers`` (records with input_pos) that knows the record fills what is missing.
    """
    seed = cut(seeds(keep_first(raw, "video_id", "input_pos")))
    asked = seed.select(F.col("input_pos").alias("query_id"), "title", "artist", F.col("album").alias("album_hint"), "duration_ms", "isrc")
    local = cut(match_records(asked, tracks, albums).withColumnRenamed("query_id", "input_pos").drop("score"))
    base = seed.withColumns({c: F.lit(None).cast(kind) for c, kind in local.dtypes if c not in seed.columns})
    hit = merge_records(base, local, "input_pos", overwrite=local.columns).join(local.select("input_pos"), "input_pos", "left_semi")
    rest = base.join(local.select("input_pos"), "input_pos", "left_anti")
    if providers:
        rest = merge_records(rest, cascade(providers, "input_pos"), "input_pos", overwrite=("cover_url", "explicit"))
    return finished(cut(hit.unionByName(rest)))
