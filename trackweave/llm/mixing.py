"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Each source has a schedule: its weight as a piecewise linear function of training time in [0, 1]. The
integral of the schedule is the source's weight in the whole mix and fixes its target in words. A document
copy's place in its source's demand (the words demanded before it) is then turned into a training position by
inverting the source's cumulative demand, and copies are range-sorted by that position.

Running sums over a source, which may hold a third of all rows, are built in two levels: a source's documents
are dealt to about sqrt(n) buckets by a hash, summed by bucket, and only bucket totals and the rows inside one
bucket are ever ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, word_count, written

Schedule = Sequence[tuple[float, float]]

#: Weight schedules that repeat over the sources in code point order: the first tapers off, the third ramps up; they integrate to 5, 2 and 1.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: A source gives each document at most this many times.
CAP = 3
#: Sources are looked up by broadcast up to this many of them.
BROADCAST_SOURCES = 10_000


def integral(schedule: Schedule) -> float:
    """The area under a piecewise linear schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, cap: int = CAP) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source, class, n_docs, source_size, target.

    Sources are numbered by code point, null last; number i has schedule i modulo the number of schedules.
    The targets share the sum of all sizes by the schedules' integrals, but none is above ``cap`` times its
    source's size: the excess goes to the others by weight. That is a water level, the largest of the levels
    found when the k sources with the lowest cap for their weight are full. No sources: no rows. Sources, one row each, are
    sorted in one task: meant for up to some millions of them.
    """
    weight = F.element_at(F.array(*[F.lit(float(integral(s))) for s in schedules]), F.col("class") + 1)
    by = W.orderBy("ratio", "rank")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    leveled = (
        totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("class", (F.col("rank") % len(schedules)).cast("int"))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", F.max((F.col("total") - F.col("full")) / F.col("open")).over(W.partitionBy()))
    )
    return leveled.select("source", "class", "n_docs", "source_size", F.least(F.col("weight") * F.col("level"), F.col("most").cast("double")).alias("target"))


def inverted(share: Column, schedule: Schedule) -> Column:
    """Training time at which a source with ``schedule`` has met ``share`` (0 to 1) of its whole demand."""
    whole, done, at = integral(schedule), 0.0, None
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        rest = share * F.lit(whole) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        here = F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2.0 * slope) * rest))
        done += area
        at = F.when(share * F.lit(whole) <= F.lit(done), here) if at is None else at.when(share * F.lit(whole) <= F.lit(done), here)
    return at.otherwise(F.lit(float(schedule[-1][0])))


def order_key(doc_id: Column) -> Column:
    """A fixed pseudo-random number below 2**32 from a document's id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def curriculum_mix(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, cap: int = CAP, doc_id: str = "doc_id", source: str = "source", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, positions, position; with ``carry`` also carried, a struct of all columns of ``docs``.

    Size is the number of words. A source's documents follow each other in a fixed pseudo-random order (ties
    by id, then size, then a hash of the text, so that reruns agree), again and again until the target is met; a copy is taken if its middle word is within the target,
    so a source misses its target by at most half a document. ``positions`` has the training position in
    [0, 1] of each copy taken, ``position`` the first (null: not taken), ``taken`` the words of all copies.

    Rows are carried through the running sums, not joined back, as ids may repeat or be null; rows of one id and source
    share a bucket. Null or empty texts have size 0 and are never taken; a null source is a source of its own; rows that
    repeat an id count as documents of their own; an empty table gives no rows. Other columns of ``docs``
    are not looked at and may have any name.
    """
    columns = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order_key(F.col(doc_id)).alias("key"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tie")]
    rows = written(docs.select(*columns), "mix-sizes")
    sources = small(written(targets(rows, schedules, cap), "mix-targets"), BROADCAST_SOURCES)

    def deal(rows: DataFrame) -> DataFrame:
        out = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.class", "s.n_docs", "s.source_size", "s.target")
        return out.withColumn("bucket", F.floor(F.col("key") * F.ceil(F.sqrt("n_docs")) / F.lit(float(1 << 32)))).withColumn("place", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))

    dealt = deal(rows)
    before = W.partitionBy("place").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("place", "bucket").agg(F.sum("size").alias("in_bucket")).select("place", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))
    more = []
    if carry:
        dealt = deal(docs.select(*columns, F.struct(*[F.col(c) for c in docs.columns]).alias("carried")))
        more = ["carried"]
    within = W.partitionBy("place", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["place", "bucket"]).withColumn("middle", F.col("start") + F.col("inner") + F.col("size") / 2)
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.ceil((F.col("target") - F.col("middle")) / F.col("source_size")))).otherwise(0).cast("int")
    share = lambda k: (F.col("middle") + k * F.col("source_size")) / F.col("target")

    def time(k: Column) -> Column:
        at = F.when(F.col("class") == 0, inverted(share(k), schedules[0]))
        for i, s in enumerate(schedules[1:], 1):
            at = at.when(F.col("class") == i, inverted(share(k), s))
        return at

    out = placed.withColumn("n", copies).withColumn("positions", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), time)).otherwise(F.array().cast("array<double>")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("n") * F.col("size")).cast("long").alias("taken"), "positions", F.get("positions", F.lit(0)).alias("position"), *more)


def training_order(mix: DataFrame) -> DataFrame:
    """One row per copy taken, range-sorted by training position (ties by id): all columns of ``mix`` but the list, with copy (from 0)."""
    rest = [c for c in mix.columns if c not in ("positions", "position")]
    copies = mix.select(*rest, F.posexplode("positions").alias("copy", "position"))
    return copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, in the order of their first training position; documents not taken come last."""
    from .common import documents

    mix = curriculum_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position")
    return mix.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) AS key, md5(coalesce(text, '')) AS tie
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM rows GROUP BY source
), weighted AS (
  SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 3 * source_size AS most FROM totals
), leveled AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_sum,
         sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_sum,
         sum(source_size) OVER () AS total
  FROM weighted
), water AS (
  SELECT max(CAST(total - full_sum AS DOUBLE) / open_sum) AS level FROM leveled
), targets AS (
  SELECT source, source_size, rank % 3 AS class, least(weight * level, CAST(most AS DOUBLE)) AS target FROM leveled, water
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.class,
         CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size, r.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + r.size / 2.0::DOUBLE AS middle
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(0, CAST(ceil((target - middle) / source_size) AS BIGINT)) ELSE 0 END AS n, middle / target AS share FROM placed
)
SELECT doc_id, size, source_size, target, n * size AS taken,
       CASE WHEN n = 0 THEN NULL
            WHEN class = 0 THEN 0.0::DOUBLE + 2.0::DOUBLE * (share * 5.0::DOUBLE) / (6.0::DOUBLE + sqrt(36.0::DOUBLE + -4.0::DOUBLE * (share * 5.0::DOUBLE)))
            WHEN class = 1 THEN 0.0::DOUBLE + 2.0::DOUBLE * (share * 2.0::DOUBLE) / (2.0::DOUBLE + sqrt(4.0::DOUBLE + 0.0::DOUBLE * (share * 2.0::DOUBLE)))
            WHEN share * 1.0::DOUBLE <= 0.375 THEN 0.0::DOUBLE + 2.0::DOUBLE * share / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * share))
            ELSE 0.5::DOUBLE + 2.0::DOUBLE * (share - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2.0::DOUBLE * (share - 0.375::DOUBLE))) END AS position
FROM taken
"""
