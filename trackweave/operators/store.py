"""Changes of a keyed table as new tables: upsert, patch, backfill, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .mappers import album_of_track
from .select_best import first_of


def upsert(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """``base`` with the rows of ``updates`` put over those of the same key, all columns; of several updates the last by ``order`` counts.

    Only updated keys are sorted: the others are taken as they are by an anti join. A null key names no row: rows of
    ``base`` with one stay, and updates with one are left out.
    """
    updates = updates.filter(F.col(key).isNotNull())
    last = first_of(updates, [key], [F.desc(order)]).drop(order)
    return base.join(last.select(key), key, "left_anti").unionByName(last.select(*base.columns))


def backfill(base: DataFrame, values: DataFrame, key: str, column: str, change=lambda c: c) -> DataFrame:
    """``base`` with ``column`` set from ``values`` (unique keys) where it is null."""
    new = values.select(key, F.col(column).alias("new_"))
    fields = [F.coalesce(F.col(column), change(F.col("new_"))).alias(column) if c == column else F.col(c) for c in base.columns]
    return base.join(new, key, "left").select(*fields)


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with the non-null values of ``changes`` (unique keys); columns that base lacks are passed over."""
    shared = [c for c in changes.columns if c in base.columns and c != key]
    new = changes.select(key, *[F.col(c).alias(f"{c}__new") for c in shared])
    return base.join(new, key, "left").select(*[F.coalesce(F.col(f"{c}__new"), F.col(c)).alias(c) if c in shared else F.col(c) for c in base.columns])


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def deleted_count(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, n): rows of ``base`` that deleting each key removes."""
    return base.join(keys.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def persisted(albums: DataFrame, tracks: DataFrame, best: DataFrame, read_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The tables of albums and tracks after the best results are put into them: each result's album, then its track.

    ``best`` has the columns of ``tracks`` and wrapper_type; rows that are no track, or have no id, are left out. Albums are derived from their
    results. Of results of one id the smallest row counts, so a second run changes nothing. With ``read_only``
    nothing is changed.
    """
    if read_only:
        return albums, tracks
    found = best.filter((F.col("wrapper_type") == "track") & F.coalesce(F.col("track_id") != 0, F.lit(False))).select(*tracks.columns)
    rows = found.groupBy("track_id").agg(F.min(F.struct(*[F.col(c) for c in tracks.columns])).alias("r")).select("r.*")
    new = album_of_track(rows.withColumn("collection_id", F.nullif(F.col("collection_id"), F.lit(0))))
    kinds = dict(albums.dtypes)
    parents = new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in albums.columns])
    put = lambda base, rows, key: base.join(rows.select(key), key, "left_anti").unionByName(rows)
    return put(albums, parents, "collection_id"), put(tracks, rows, "track_id")


def save_best(spark: SparkSession, path: str, best: DataFrame, run: str, read_only: bool = False) -> None:
    """Put the best results into the catalog under ``path`` (folders albums and tracks of versions, named by ``run``), albums first.

    The results are written once and both tables computed from that copy. A version is finished when its folder has the marker that Spark
    writes last; a run that was lost after the albums writes the tracks only, one that is whole does nothing. Runs are numbered so that
    their names sort in order; each reads the last finished version before its own.
    """
    if read_only:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda table, name: files.exists(hadoop.Path(f"{path}/{table}/version={name}/_SUCCESS"))

    def before(table: str) -> DataFrame:
        names = sorted(s.getPath().getName().removeprefix("version=") for s in files.listStatus(hadoop.Path(f"{path}/{table}")))
        last = max(n for n in names if n < run and done(table, n))
        return spark.read.parquet(f"{path}/{table}/version={last}")

    if done("albums", run) and done("tracks", run):
        return
    albums, tracks = persisted(before("albums"), before("tracks"), written(best, "best-results"))
    for table, rows in (("albums", albums), ("tracks", tracks)):
        if not done(table, run):
            rows.write.mode("overwrite").parquet(f"{path}/{table}/version={run}")
