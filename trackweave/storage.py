"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session has none and runs in this process, as in tests, a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="trackweave-")
        atexit.register(shutil.rmtree, path, True)
        path = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark)}/trackweave/{name}-{uuid.uuid4().hex}"


_open: ContextVar[list[str] | None] = ContextVar("open_tables", default=None)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage is cut and survives lost executors.

    Within temporary_tables() the copy is removed at its end, unless ``keep`` is set.
    """
    path = new_folder(df.sparkSession, name)
    if not keep and (paths := _open.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out over all cores (``by`` columns), for much work on each row: a compact file of millions of rows is otherwise read, and worked on, by one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *by)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it is stored."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove what written() writes inside, when the block ends, also by an error. What outlives the block must be written with ``keep``."""
    paths: list[str] = []
    token = _open.set(paths)
    try:
        yield
    finally:
        _open.reset(token)
        for path in paths:
            removed(spark, path)
