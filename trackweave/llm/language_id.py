"""Language identification by prediction with partial matching.

Each language has a variable-order tree of byte contexts: how often each byte followed each context of up to
ORDER bytes in its training texts. A byte's code length is found by escape: in the longest known context the byte
has its share of the counts; if it never followed there, an escape (as likely as there are distinct bytes in the
context) leads to the next shorter context, at last to 8 bits. Statistics are frozen after training. A text's
language is the one that codes it in the fewest bits; the score is that language's posterior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, utf8, written

#: Longest context in bytes. Codes of a context with its next byte must fit into 64 bits.
ORDER = 4
#: Bounds of the training sample: documents per language, and bytes of a document to be sampled.
TRAIN_DOCS, TRAIN_BYTES = 512, 1 << 16
#: Bytes that are scored at once.
SLAB = 1 << 21


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code of each byte with the ORDER bytes before it (zeros before a text), and the start of each text in the codes."""
    pad = b"\0" * ORDER
    joined = np.frombuffer(pad + pad.join(texts) + pad, np.uint8).astype(np.uint64)
    codes = joined.copy()
    for k in range(1, ORDER + 1):
        codes[k:] |= joined[:-k] << np.uint64(8 * k)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes, np.cumsum(lengths + ORDER) - lengths


class ByteTree:
    """Frozen counts of one language: for each order, sorted contexts and sorted grams."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in range(ORDER, -1, -1):
            own, at = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(own))
            contexts, at = np.unique(own >> np.uint64(8), return_inverse=True)
            self.levels.append((k, own, n, contexts, np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after its context."""
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        for k, own, n, contexts, total, distinct in self.levels:
            if not len(own):
                continue
            g = codes & np.uint64((1 << 8 * (k + 1)) - 1)
            c = g >> np.uint64(8)
            ci = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            gi = np.minimum(np.searchsorted(own, g), len(own) - 1)
            known, coded = open_ & (contexts[ci] == c), open_ & (own[gi] == g)
            whole = total[ci] + distinct[ci]
            out += np.where(coded, np.log2(whole / n[gi]), np.where(known, np.log2(whole / distinct[ci]), 0.0))
            open_ &= ~coded
        return out + 8.0 * open_


class LanguageModel:
    """Trees of all languages, with the code lengths of all grams that some language knows in a hash table."""

    def __init__(self, trained: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(trained)
        self.trees = [ByteTree(*trained[x]) for x in self.languages]
        known = np.unique(np.concatenate([trained[x][0] for x in self.languages]))
        values = np.stack([t.bits(known) for t in self.trees])
        self.shift = np.uint64(64 - max(10, int(len(known) * 8).bit_length()))
        self.tables = []
        rest = np.arange(len(known))
        for factor in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            size = 1 << (64 - int(self.shift))
            keys, rows = np.full(size, np.uint64((1 << 64) - 1)), np.zeros(size, np.int32)
            at = (known[rest] * factor) >> self.shift
            keys[at], rows[at] = known[rest], rest
            self.tables.append((factor, keys, rows))
            rest = rest[keys[at] != known[rest]]
        self.values = values

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths (languages x codes)."""
        factor, keys, rows = self.tables[0]
        at = (codes * factor) >> self.shift
        row = rows[at]
        miss = np.flatnonzero(keys[at] != codes)
        out = self.values[:, row]
        if len(miss):
            factor, keys, rows = self.tables[1]
            at = (codes[miss] * factor) >> self.shift
            hit = keys[at] == codes[miss]
            out[:, miss[hit]] = self.values[:, rows[at[hit]]]
            miss = miss[~hit]
        if len(miss):
            own, back = np.unique(codes[miss], return_inverse=True)
            out[:, miss] = np.stack([t.bits(own) for t in self.trees])[:, back]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each language takes for each text (languages x texts)."""
        out = np.zeros((len(self.languages), len(texts)))
        k = 0
        while k < len(texts):
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) <= SLAB):
                size += len(texts[end])
                end += 1
            codes, starts = grams(texts[k:end])
            for at in range(0, len(codes), SLAB):  # a long text is coded piece by piece; its grams are whole
                part = self.bits(codes[at : at + SLAB])
                sums = np.concatenate([np.zeros((len(part), 1)), np.cumsum(part, axis=1)], axis=1)
                lo = np.clip(starts - at, 0, part.shape[1])
                hi = np.clip(starts + [len(t) for t in texts[k:end]] - at, 0, part.shape[1])
                out[:, k:end] += sums[:, hi] - sums[:, lo]
            k = end
        return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language, the grams of its tree with their counts, from the rows of ``docs`` that have a language and a text.

    Of each language at most ``per_language`` documents of at most TRAIN_BYTES bytes are taken, one for each
    value of a hash of the id (rows that repeat an id count once for a language), so the counts and the model are bounded whatever
    the input's size: to TRAIN_DOCS times TRAIN_BYTES grams a language, one for each byte.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(per_language)).alias("slot")
    chosen = written(own.groupBy(F.col("lang").alias("in"), slot).agg(F.max("doc_id").alias("of")), "lid-sample")
    # the sample has per_language ids for a language at most, so it is small; of the rows that repeat an id one stays, by a hash of its text
    picked = own.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("lang") == F.col("in")))
    chosen = written(picked.groupBy("lang", "slot").agg(F.max_by("text", F.xxhash64("text")).alias("text")).select("lang", "text"), "lid-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for x, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                by.setdefault(x, []).append(t)
            for x, texts in by.items():
                codes, starts = grams(texts)
                keep = np.zeros(len(codes), bool)
                for s, t in zip(starts, texts):
                    keep[s : s + len(t)] = True
                found, n = np.unique(codes[keep], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = chosen.mapInArrow(count, "lang string, gram long, n long")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return {x: (g.gram.to_numpy().astype(np.uint64), g.n.to_numpy().astype(float)) for x, g in rows.groupby("lang")}


def identify(docs: DataFrame, trained: dict[str, tuple[np.ndarray, np.ndarray]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (0 to 1), bits_per_byte.

    ``und`` with score 0 for null texts, texts without a letter, and where the model knows no language. Ties go to
    the first language by name. Rows that repeat are predicted alike; empty tables give no rows; other columns may
    have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"trained": trained})

    trained_any = bool(trained)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value
        if trained_any and "model" not in data:
            data["model"] = LanguageModel(data["trained"])  # kept beside the broadcast data, so it is built once in each Python worker
        m = data.get("model")
        for b in batches:
            texts = [t or b"" for t in utf8(b.column(1))]
            known = [trained_any and has_letter(t) for t in texts]
            bits = m.lengths(texts) if trained_any else np.zeros((1, len(texts)))
            best = bits.argmin(0)
            least = bits.min(0)
            score = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(0)
            rate = least / np.maximum([len(t) for t in texts], 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([m.languages[k] if ok else "und" for k, ok in zip(best, known)], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, rate, 0.0))],
                ["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, "doc_id long, lang_pred string, score double, bits_per_byte double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trained = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, trained).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
