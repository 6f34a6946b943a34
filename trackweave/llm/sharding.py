"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts stay together, unless a group is larger than a shard: such a group is split into parts by a
hash of the id. The other groups are dealt to a fixed number of cells by their hash, so that the
number of things to pack depends on the number of shards only, whatever the input's size. They are packed, the
largest first, each into the shard where the dot product of its vector with the residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, word_count, written

SHARDS = 40
#: Cells for each shard; a group over 1/PARTS of a shard is counted and numbered in parts of that size.
CELLS, PARTS = 512, 16
#: Weights of bytes, tokens and rows in the dot product.
WEIGHTS = (16.0, 1.0, 1.0)
#: Bytes that each row takes beside its text.
OVERHEAD = 16


def pack(vectors: np.ndarray, n_bins: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Bin of each item: largest weighted sum first, into the bin with the highest weighted dot product with residual capacity (ties: lowest bin)."""
    share = vectors.astype(float) / np.maximum(vectors.sum(0), 1) * n_bins
    residual = np.ones((n_bins, vectors.shape[1]))
    bins = np.zeros(len(vectors), dtype=np.int64)
    scale = np.asarray(weights)
    for i in np.argsort(-(share @ scale), kind="stable"):
        bins[i] = b = int(np.argmax(residual @ (share[i] * scale)))
        residual[b] -= share[i]
    return bins


def pack_shards(docs: DataFrame, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (bytes with overhead), tokens (words), text_crc32, shard, slot.

    Null text counts as empty. Slots are gapless from 0 inside a shard. Rows that repeat an id are rows of their
    own; ties between them are broken by size and checksum. Empty tables give no rows, and other columns may
    have any name. The result depends on the rows only, not on their order or partitions.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), word_count(t).alias("tokens"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")),
        "shard-rows",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    room = max(1, total // n_shards)
    # at most PARTS * n_shards groups can be as large as this
    large = rows.groupBy("k1", "k2").agg(F.sum("size").alias("s")).filter(F.col("s") > room // PARTS).orderBy("k1", "k2").collect()
    cells, base, parts, unit_of = CELLS * n_shards, CELLS * n_shards, [], {}
    for g in large:
        n = -(-g.s * PARTS // room)
        parts.append((g.k1, g.k2, base, n))
        unit_of |= {base + i: base if g.s <= room else base + i for i in range(n)}
        base += n
    split = spark.createDataFrame(parts, "g1 long, g2 long, base long, n long")
    part = F.col("base") + F.pmod(F.xxhash64("doc_id"), F.col("n"))
    dealt = rows.join(F.broadcast(split), (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left").withColumn("item", F.coalesce(part, F.pmod(F.col("k1"), F.lit(cells))))
    items = dealt.groupBy("item").agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).orderBy("item").collect()  # CELLS + 2 * PARTS for each shard at most
    units: dict[int, np.ndarray] = {}
    for i in items:
        u = unit_of.get(i[0], i[0])
        units[u] = units.get(u, 0) + np.array(i[1:], dtype=np.int64)
    bins = dict(zip(units, pack(np.array(list(units.values()), dtype=np.int64).reshape(-1, 3), n_shards).tolist()))
    start, placed = [0] * n_shards, []
    for i in items:
        s = bins[unit_of.get(i[0], i[0])]
        placed.append((i[0], s, start[s]))
        start[s] += i[3]
    where = F.broadcast(spark.createDataFrame(placed, "item long, shard int, start long"))
    rank = F.row_number().over(W.partitionBy("item").orderBy("doc_id", "size", "text_crc32"))
    return dealt.withColumn("rank", rank).join(where, "item").select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` with shard and slot to ``path``, a folder per shard, in slot order. Ids must be distinct and not null."""
    at = pack_shards(docs, n_shards, doc_id, text).select(F.col("doc_id").alias(doc_id), "shard", "slot")
    docs.join(at, doc_id).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    out = pack_shards(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
