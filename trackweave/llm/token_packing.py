"""Token ids packed into rows of a fixed length, for training.

Each task takes documents in blocks of bounded size, splits those that are longer than a row into pieces without loss,
and packs the pieces by best fit, longest first: a piece goes into the open row with the least room that still holds
it. The row is found by a segment tree over the amounts of room, in as many steps as the row length has bits. Blocks
are independent, so nothing is shuffled, and what a block wastes is its last rows' room.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Ranks of the tokenizer of the queries, and the id that ends a document.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
#: Pattern of pre-tokens that the ranks were made for (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts by a pattern that does not go back (a fixed value).
SAME_CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Tokens of a row, and tokens that a task packs together.
ROW, BLOCK = 2048, 1 << 20


class RoomTree:
    """Open rows by their room; finds the least room that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.counts[k] += by
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least ``size``, taken out; None if there is none."""
        k = size + self.leaves
        if not self.counts[k]:
            while k > 1 and (k & 1 or not self.counts[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.counts[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._count(room, -1)
        return room, self.rows[room].pop()


def packed(sizes: list[int], length: int) -> list[list[int]]:
    """Numbers of the pieces in each row, by best fit, longest first (ties: first come). No size is over ``length``."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], row)
    return rows


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack_rows(docs: DataFrame, ranks: dict[bytes, int], end: int = END, length: int = ROW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows: ids (``length`` of them, filled with ``end``), cumulative (starts of the segments and the end of the last), doc_ids, starts (of a segment in its document), raw (the ids as little-endian 32-bit numbers).

    A document's ids are those of its text and ``end``; a null or empty text has ``end`` alone. Positions begin anew
    with each segment, see positions(). Rows that repeat an id are documents of their own; an empty table gives no
    rows; other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks})

    def block(ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
        pieces = [(i, s, t[s : s + length]) for i, t in zip(ids, tokens) for s in range(0, len(t), length)]
        rows = packed([len(p[2]) for p in pieces], length)
        grid = np.full((len(rows), length), end, "<i4")
        out: list[list] = [[], [], []]
        for line, row in zip(grid, rows):
            own = [pieces[k] for k in row]
            cumulative = np.concatenate([[0], np.cumsum([len(p[2]) for p in own])]).astype(np.int32)
            line[: cumulative[-1]] = np.concatenate([p[2] for p in own])
            out[0].append(cumulative)
            out[1].append([p[0] for p in own])
            out[2].append([p[1] for p in own])
        # all rows have one length, so the lists and the binary values are slices of the grid as it lies in memory
        bounds = np.arange(len(rows) + 1, dtype=np.int32) * length
        filled = pa.ListArray.from_arrays(pa.array(bounds), pa.array(grid.ravel()))
        raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds * 4), pa.py_buffer(grid)])
        kinds = (pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([filled, *[pa.array(c, pa.list_(k)) for c, k in zip(out, kinds)], raw], ["ids", "cumulative", "doc_ids", "starts", "raw"])

    def ended(ids: np.ndarray) -> np.ndarray:
        out = np.empty(len(ids) + 1, np.int32)
        out[:-1], out[-1] = ids, end
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        data = shared.value
        if "encoding" not in data:  # kept beside the broadcast data, so it is built once in each Python worker
            data["encoding"] = tiktoken.Encoding("own", pat_str=SAME_CUTS, mergeable_ranks=data["ranks"], special_tokens={})
        encode = data["encoding"].encode_to_numpy  # numbers in an array, not Python's; there are no special tokens to look for
        ids: list = []
        tokens: list[np.ndarray] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                tokens.append(ended(encode(t or "", disallowed_special=())))
                size += len(tokens[-1])
                if size >= BLOCK:
                    yield block(ids, tokens)
                    ids, tokens, size = [], [], 0
        if ids:
            yield block(ids, tokens)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(each, "ids array<int>, cumulative array<int>, doc_ids array<long>, starts array<int>, raw binary")


def positions(cumulative, length: int = ROW):
    """Positions of a row's tokens (a column): from 0 in each segment, and in what is filled after the last."""
    ends = F.concat(F.slice(cumulative, 2, F.size(cumulative)), F.array(F.lit(length)))
    return F.flatten(F.transform(F.arrays_zip(cumulative.alias("a"), ends.alias("b")), lambda x: F.when(x["b"] > x["a"], F.sequence(F.lit(0), x["b"] - x["a"] - 1)).otherwise(F.array().cast("array<int>"))))


def write_packed(rows: DataFrame, path: str) -> None:
    """Write rows with their ids as little-endian 32-bit numbers in a binary column, beside segments and positions."""
    rows.select(F.col("raw").alias("ids"), "cumulative", positions(F.col("cumulative")).alias("positions"), "doc_ids", "starts").write.parquet(path)


def op6_token_packing(spark, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """Packed rows of all documents with their positions, and their ids in binary too."""
    return pack_rows(documents(spark, sf_dir), load_ranks(ranks)).withColumn("positions", positions(F.col("cumulative")))
