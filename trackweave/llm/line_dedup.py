"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed, sorted table of line hashes with the number of documents that hold the line and the largest
id among them. Documents come in batches. Each batch is merge-anti-joined with all runs, without a shuffle of the runs: only
lines that no run has enter the batch's own run. Counts of the others go to a delta of the run that has them. When a level has as
many runs as the fan-out, they are merged with their deltas into one run of the next level. The totals say which lines are
frequent; then all runs are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, documents, new_folder, removed, shuffle_partitions, utf8, written

#: Lines shorter than this (in code points, as keys) are never dropped; nor are those in fewer documents.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches that a table is taken in, and runs of a level that are merged.
BATCHES, FAN_OUT = 3, 2


def line_key(line: bytes) -> bytes:
    """A line stripped of ASCII white space, with A-Z lower-cased."""
    return line.translate(LOWER).strip(SPACE)


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _words(digest: int) -> tuple[int, int]:
    """A 128-bit number as two signed ones of 64 bits."""
    return tuple(x - (1 << 64) if x >> 63 else x for x in (digest >> 64, digest & (1 << 64) - 1))


def line_hashes(docs: DataFrame, batches: int = BATCHES, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(batch, h1, h2, doc_id): each long enough line of a document (doc_id, text) once, by the 128-bit hash of its key."""

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            batch, h1, h2, ids = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                if i is None or not t:
                    continue
                for key in {k for k in map(line_key, t.split(b"\n")) if long_enough(k, least_chars)}:
                    x, y = _words(xxhash.xxh3_128_intdigest(key))
                    batch.append(i % batches)
                    h1.append(x)
                    h2.append(y)
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64())], ["batch", "h1", "h2", "doc_id"])

    return docs.mapInArrow(split, "batch int, h1 long, h2 long, doc_id long")


class LineRuns:
    """Levelled runs of lines. A run is a table bucketed and sorted by (h1, h2) with n (documents) and top (largest id); no line is in two live runs.

    A batch is merge-joined with the live runs without shuffling them: lines that no run has become the batch's own run, and
    counts of lines that a run has go to a delta of that run, which is added to it when it is compacted or totalled. The tables lie in
    the shared folder.
    """

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.levels: list[list[str]] = []
        self.deltas: dict[str, list[str]] = {}
        self.paths: dict[str, str] = {}
        self.buckets = shuffle_partitions(spark)

    def _table(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_folder(self.spark, name)
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, self.paths.pop(name))

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch of (h1, h2, doc_id); returns the batch's lines that no earlier batch had, valid until the next one. All rows of an id belong to one batch."""
        self.compact()
        own = self._table(lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("top")))
        batch, fresh = self.spark.table(own), self.spark.table(own)
        for run in self.runs():
            held = self.spark.table(run).select("h1", "h2")
            fresh = fresh.join(held, ["h1", "h2"], "left_anti")
            self.deltas[run].append(self._table(batch.join(held, ["h1", "h2"], "left_semi")))
        if not self.levels:
            self.levels.append([])
        if self.runs():
            self.levels[0].append(self._table(fresh))
            self._drop(own)
        else:
            self.levels[0].append(own)  # the first batch knows nothing yet
        self.deltas[self.levels[0][-1]] = []
        return self.spark.table(self.levels[0][-1]).select("h1", "h2")

    def compact(self) -> None:
        """Merge each level that is full, with its deltas, into a run of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_out:
                old = self.levels[level]
                run = self._table(self.merged(old))
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(run)
                for name in [x for r in old for x in [*self.deltas.pop(r), r]]:
                    self._drop(name)
                self.deltas[run] = []
            level += 1

    def drop(self) -> None:
        """Drop all tables, also after a batch that failed."""
        for name in list(self.paths):
            self._drop(name)
        self.levels, self.deltas = [], {}

    def merged(self, names: list[str]) -> DataFrame:
        """Sorted runs and their deltas merged bucket by bucket: counts add up, the largest id stays."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("h1", "h2", F.col("n").alias("n2"), F.col("top").alias("top2"))
            zero = F.lit(0).cast("long")
            return a.join(b, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n", zero) + F.coalesce("n2", zero)).alias("n"), F.greatest("top", "top2").alias("top"))

        return reduce(two, [self.spark.table(x) for r in names for x in [r, *self.deltas[r]]])

    def totals(self) -> DataFrame:
        return self.merged(self.runs())


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without its dropped lines, n_lines (before), n_dropped.

    A line whose key has at least ``least_chars`` code points and is found in at least ``least_docs``
    documents loses all its occurrences but those in the largest id that holds it. Null or empty text is one
    empty line. Rows with a null id keep all lines and count nowhere; rows that repeat an id
    count as one document, and each of them keeps or loses the same lines. An empty table gives no rows; other columns may have any name.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines = written(line_hashes(own, batches, least_chars), "lines")
    runs = LineRuns(docs.sparkSession)
    try:
        for k in range(batches):
            runs.add(lines.filter(F.col("batch") == k))
        frequent = written(runs.totals().filter(F.col("n") >= least_docs).select("h1", "h2", "top"), "frequent-lines")
    finally:
        runs.drop()
    hash16 = F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))
    drops = lines.join(frequent, ["h1", "h2"]).filter("doc_id < top").select(F.col("doc_id").alias("of"), F.unhex(hash16).alias("h"))
    drops = drops.groupBy("of").agg(F.collect_set("h").alias("drop"))

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out, total, dropped = [], [], []
            for t, drop in zip(utf8(b.column(1)), b.column(2).to_pylist()):
                parts = (t or b"").split(b"\n")
                total.append(len(parts))
                if drop:
                    drop = set(drop)
                    keys = map(line_key, parts)
                    parts = [p for p, k in zip(parts, keys) if not (long_enough(k, least_chars) and xxhash.xxh3_128_digest(k) in drop)]
                dropped.append(total[-1] - len(parts))
                out.append(b"\n".join(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return own.join(drops, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "drop").mapInArrow(apply, "doc_id long, text string, n_lines long, n_dropped long")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM split)
), frequent AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, f.key IS NOT NULL AND l.doc_id < f.top AS dropped FROM lines l LEFT JOIN frequent f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
