"""What the training-data operators share: the scratch folder, written tables and text conventions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, removed, temporary_tables, work_dir, written  # noqa: F401  also used by the operators

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows that it has at most ``max_rows`` rows, else leave the join to Spark.

    ``df`` should be a written table, as it is read for the count.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is held out from training: crc32 of its id as text, modulo ``folds``, is 0. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


#: Bytes of a batch of rows that Spark hands to Python, and the setting that has it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Have texts handed to Python in batches of BATCH_BYTES, which bounds a task's memory. It holds for the session; a value that the session has been given stays."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Lower-cases A-Z only, byte by byte, which is safe in UTF-8.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: ASCII white space, as bytes.strip() and bytes.split() without arguments see it too.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def utf8(column) -> list[bytes | None]:
    """The values of an Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def thrifty(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives the memory it no longer uses back to the system when it ends, as its Python worker lives on, idle or in other stages."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
            trim(0)

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
