"""Streaming form of the upsert: an extension, the catalog's writers are batch jobs otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert


def latest_by_key(stream: DataFrame, key: str, time: str, fields: list[str], late: str = "1 hour") -> DataFrame:
    """The last values of each key within windows of a watermarked stream."""
    row = F.max(F.struct(time, *fields)).alias("last")
    return stream.withWatermark(time, late).groupBy(F.window(time, late), key).agg(row).select("window", key, *[f"last.{f}" for f in (time, *fields)])


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keep a table as versions under ``path``: each micro-batch writes the next from the last.

    A version is named by its batch, so a batch that is run again writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        updates = batch.withColumn("order_", F.col(order))
        base = spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}") if number else spark.createDataFrame([], batch.schema)
        upsert(base, updates, key, "order_").write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
