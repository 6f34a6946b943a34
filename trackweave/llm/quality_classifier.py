"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Words and word shapes are counted over a sample of labelled documents; the frequent ones make the vocabulary. Each
has a sparse random index vector, fixed by a hash, and a context vector: the sum of the index vectors of its
neighbours in the sample. A document's features are its pooled word vectors and its pooled shape vectors. A
network with one hidden layer learns the label; its temperature is fitted on documents that it was not trained on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, documents, held_out, thrifty, utf8, written

#: Bounds of the training sample: labelled documents, and bytes of a document to be sampled.
TRAIN_ROWS, TRAIN_BYTES = 16384, 1 << 17
#: Vocabulary of words and of shapes, dimensions of a vector, non-zeros of an index vector, and neighbours on each side.
WORDS, SHAPES, DIMENSIONS, NON_ZEROS, REACH = 16384, 1024, 48, 4, 2
#: Partial sums of context vectors, and pairs of neighbours that are summed at once.
PARTS, PAIRS = 8, 1 << 15
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 30, 256, 3e-3, 1e-4, 7
#: Documents of a lower score are predicted to have label 0.
THRESHOLD = 0.3

#: Bytes of words: ASCII letters and digits, and all of other scripts; the rest separates words.
_IN_WORDS = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TO_WORDS = bytes(LOWER[b] if b in _IN_WORDS else 32 for b in range(256))
#: Bytes of shapes: a for small letters and other scripts, A for capitals, 0 for digits; punctuation stays.
_TO_SHAPES = bytes(97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else 32 if b <= 32 else b for b in range(256))
#: A shape that stands for a word which repeats the one before it.
REPEATED = b"\x01again"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def shapes_of(text: bytes, words: list[bytes]) -> list[bytes]:
    """Shapes of the blank-separated tokens, runs of a character as one, and a mark for each immediate repeat."""
    if not text:
        return []
    s = np.frombuffer(text.translate(_TO_SHAPES), np.uint8)
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    again = sum(map(bytes.__eq__, words, words[1:]))
    return s[keep].tobytes().split() + [REPEATED] * again


def index_vector(token: bytes) -> np.ndarray:
    """The fixed sparse ternary vector of a token."""
    rng = np.random.default_rng(zlib.crc32(token))
    out = np.zeros(DIMENSIONS, np.float32)
    out[rng.choice(DIMENSIONS, NON_ZEROS, replace=False)] = rng.choice((-1.0, 1.0), NON_ZEROS)
    return out


def contexts(ids: np.ndarray, size: int, vectors: np.ndarray) -> np.ndarray:
    """Sums of the vectors of the neighbours within REACH of each token (ids; -1: none)."""
    out = np.zeros((size, DIMENSIONS))
    for step in range(1, REACH + 1):
        for a, b in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
            pairs, n = np.unique((a * size + b)[(a >= 0) & (b >= 0)], return_counts=True)
            for k in range(0, len(pairs), PAIRS):  # each pair's vector is a row, so few at once
                part = pairs[k : k + PAIRS]
                np.add.at(out, part // size, vectors[part % size] * n[k : k + PAIRS, None])
    return out


class WordVectors:
    """Vocabularies with their vectors; unknown words and shapes share one vector each."""

    def __init__(self, words: list[bytes], shapes: list[bytes], word_vectors: np.ndarray, shape_vectors: np.ndarray):
        self.words, self.shapes = {w: i for i, w in enumerate(words)}, {s: i for i, s in enumerate(shapes)}
        self.word_vectors, self.shape_vectors = word_vectors, shape_vectors

    def pooled(self, text: bytes) -> np.ndarray:
        """Features of a document: mean word vector, mean shape vector, logarithm of its length. Zeros for an empty one."""
        words = words_of(text)
        out = np.zeros(2 * DIMENSIONS + 1, np.float32)
        for k, (tokens, known, vectors) in enumerate(((words, self.words, self.word_vectors), (shapes_of(text, words), self.shapes, self.shape_vectors))):
            if tokens:
                other = len(known)
                ids = np.fromiter((known.get(w, other) for w in tokens), np.int64, len(tokens))
                n = np.bincount(ids, minlength=0) if len(ids) > 4 * other else None
                out[k * DIMENSIONS : (k + 1) * DIMENSIONS] = n @ vectors[: len(n)] / len(ids) if n is not None else vectors[ids].mean(0)
        out[-1] = np.log1p(len(words)) / 10
        return out


class Network:
    """A hidden layer of rectified units, a logistic output and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.temperature = 1.0
        d = x.shape[1]
        self.weights = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        order = rng.permutation(len(x))
        kept = order[: len(x) // 5]
        self._fit(x[order[len(kept) :]], y[order[len(kept) :]], rng)
        if len(kept):
            z = self._logits(x[kept])
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, np.where(y[kept] == 1, -z, z) / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the logistic loss with weight decay."""
        m, v, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        x = (x - self.mean) / self.scale
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                w1, b1, w2, b2 = self.weights
                hidden = np.maximum(x[at] @ w1 + b1, 0)
                error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -30, 30))) - y[at]) / len(at)
                back = np.outer(error, w2) * (hidden > 0)
                step += 1
                for i, g in enumerate((x[at].T @ back + DECAY * w1, back.sum(0), hidden.T @ error + DECAY * w2, error.sum(keepdims=True))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.weights[i] = self.weights[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -30, 30)))


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """At most TRAIN_ROWS labelled documents (text, label) of at most TRAIN_BYTES: one row for each value of a hash of the id. Documents with conflicting labels are left out."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") <= TRAIN_BYTES)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most")).filter("label = most").select("of", "label")
    slot = F.pmod(F.xxhash64("of"), F.lit(TRAIN_ROWS)).alias("slot")
    chosen = written(own.select("doc_id").join(known, F.col("doc_id") == F.col("of")).groupBy(slot).agg(F.max("of").alias("of")), "quality-sample")
    # the sample has TRAIN_ROWS ids at most, so it is small; of the rows that repeat an id one stays, by a hash of its text
    picked = F.broadcast(known.join(F.broadcast(chosen), "of"))
    rows = own.join(picked, F.col("doc_id") == F.col("of")).groupBy("slot").agg(F.max_by(F.struct("text", "label"), F.xxhash64("text")).alias("row"))
    return written(rows.select("row.text", "row.label").repartition(PARTS), "quality-texts")


def _vocabulary(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The most frequent words and shapes of the sample; ties by code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for t in utf8(b.column(0)):
                words = words_of(t)
                found.update((0, w) for w in words)
                found.update((1, s) for s in shapes_of(t, words))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([t for _, t in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["kind", "token", "n"])

    counts = written(sample.select("text").mapInArrow(thrifty(count), "kind int, token binary, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")), "quality-counts")
    top = lambda kind, most: [bytes(r.token) for r in counts.filter((F.col("kind") == kind) & (F.col("n") > 1)).orderBy(F.desc("n"), "token").limit(most).select("token").collect()]
    return top(0, WORDS), top(1, SHAPES)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict | None:
    """Word vectors and network from labelled documents; None if they do not have both labels.

    ``labels`` has doc_id and ``label``. The sample, the vocabulary and so all that is gathered are bounded by the
    parameters above, whatever the input's size.
    """
    sample = sampled(docs, labels, doc_id, text, label)
    if sample.select("label").distinct().count() < 2:
        return None
    words, shapes = _vocabulary(sample)
    shared = docs.sparkSession.sparkContext.broadcast((words, shapes))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [({t: i for i, t in enumerate(x)}, np.stack([*map(index_vector, x), np.zeros(DIMENSIONS, np.float32)])) for x in shared.value]
        sums = [np.zeros((len(v), DIMENSIONS)) for _, v in both]
        for b in batches:
            ids: list[list[int]] = [[], []]
            for t in utf8(b.column(0)):
                words = words_of(t)
                for k, tokens in enumerate((words, shapes_of(t, words))):
                    ids[k] += [both[k][0].get(w, -1) for w in tokens]
                    ids[k] += [-1] * REACH
            for k in (0, 1):
                sums[k] += contexts(np.array(ids[k], np.int64), len(both[k][1]), both[k][1])
        for k in (0, 1):
            at = np.flatnonzero(np.abs(sums[k]).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([v.tobytes() for v in sums[k][at].astype(np.float32)], pa.binary())], ["kind", "token", "sums"])

    rows = sample.select("text").mapInArrow(thrifty(summed), "kind int, token int, sums binary").toArrow()  # PARTS times the vocabulary at most
    vectors = []
    for k, tokens in enumerate((words, shapes)):
        context = np.zeros((len(tokens) + 1, DIMENSIONS))
        own_rows = rows.filter(pa.compute.equal(rows["kind"], k))
        if own_rows.num_rows:
            sums = np.frombuffer(b"".join(own_rows["sums"].to_pylist()), np.float32).reshape(-1, DIMENSIONS)
            np.add.at(context, own_rows["token"].to_numpy(), sums)
        context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
        own = np.stack([*map(index_vector, tokens), index_vector(b"\x00other")])
        vectors.append((own / NON_ZEROS**0.5 + context).astype(np.float32))
    data = {"vectors": (words, shapes, *vectors)}
    rows = featured(sample.select("label", "text"), data, "label").toArrow()  # TRAIN_ROWS at most
    x, y = np.frombuffer(b"".join(rows["features"].to_pylist()), np.float32).reshape(rows.num_rows, -1), rows["label"].to_numpy()
    order = np.lexsort((*x.T[:3], y))  # rows come in any order
    data["network"] = vars(Network(x[order], y[order]))
    return data


def _vectors(data: dict) -> WordVectors:
    if "made" not in data:
        data["made"] = WordVectors(*data["vectors"])  # kept beside the broadcast data, so it is built once in each Python worker
    return data["made"]


def featured(docs: DataFrame, data: dict, keep: str) -> DataFrame:
    """Column ``keep`` (an int) and the features (32-bit floats) of the text of each row of (keep, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _vectors(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([vectors.pooled(t).tobytes() for t in utf8(b.column(1))], pa.binary())], [keep, "features"])

    return docs.mapInArrow(thrifty(each), f"{keep} int, features binary")


def scored(docs: DataFrame, data: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (score >= THRESHOLD).

    Null text counts as empty and is scored too; repeated rows are scored alike; empty tables give no rows. A model
    that is None scores all with 1. Columns of ``docs`` named score or predicted are replaced, others may have any
    name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(data or {})
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    place = rest.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value
        network = None
        if data:
            vectors = _vectors(data)
            network = Network.__new__(Network)
            vars(network).update(data["network"])
        for b in batches:
            texts = [t or b"" for t in utf8(b.column(place))]
            score = network.score(np.array([vectors.pooled(t) for t in texts]).reshape(len(texts), -1)) if network and texts else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], [*rest, "score", "predicted"])

    own = docs.select(*rest)
    schema = own.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    return own.mapInArrow(thrifty(each), schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    data = train(docs.filter(~held_out(F.col("doc_id"))), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, data).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
