"""Byte-level BPE over a contiguous rank array.

A text is cut at special tokens and then into pre-tokens. A pre-token's bytes are its first parts; beside the parts, in
one contiguous array, stand the ranks of the merges of adjacent ones. The least rank is looked for by a scan, the
boundary between its two parts is deleted, and the ranks of the new part with its two neighbours are looked up anew,
until no adjacent parts can be merged. Words are short, so a scan is cheaper than a heap; for a long word the same
arrays are numpy's and each scan deletes all boundaries of the least rank at once, which gives the same parts, as
a merge of the new part always ranks after the merge that makes it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: The tokenizer of the queries.
MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Pattern of pre-tokens of byte-level tokenizers (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes are merged by numpy; words that a task remembers; texts of more characters are matched lazily; bytes of ids of a result batch.
LONG, KNOWN, LAZY, BATCH = 256, 300_000, 1 << 20, 8 << 20
NONE = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable Latin-1 for itself, the others by the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class ByteBPE:
    """Merges and vocabulary of a byte-level BPE. Encodes and decodes one text at a time; words are remembered up to KNOWN of them."""

    def __init__(self, tokens: list[bytes | None], pairs: np.ndarray, made: np.ndarray, special: dict[str, int], odd: str):
        self.tokens, self.pairs, self.made, self.special, self.odd = tokens, pairs, made, special, odd
        self.ready = False

    def __getstate__(self):
        return self.tokens, self.pairs, self.made, self.special, self.odd

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        """From a file of the tokenizers library; ValueError for any other kind than byte-level BPE without normalizing."""
        import unicodedata

        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, pre = data["model"], data["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or data["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or data["decoder"].get("type") != "ByteLevel":
            raise ValueError(f"{path} holds no plain byte-level BPE")
        if any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that are not matched as they are")
        letters, vocabulary = byte_letters(), model["vocab"]
        tokens: list[bytes | None] = [None] * (1 + max([*vocabulary.values(), *(t["id"] for t in data["added_tokens"])]))
        for t, i in vocabulary.items():
            tokens[i] = bytes(letters[c] for c in t)
        for t in data["added_tokens"]:
            tokens[t["id"]] = t["content"].encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        # letters and digits of the regex module that are newer than the tables of this Python: the library that the file is for may not know them
        unknown = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn")
        return cls(tokens, pairs, made, {t["content"]: t["id"] for t in data["added_tokens"]}, "".join(regex.findall(r"[\p{L}\p{N}\s]", unknown)))

    def _prepare(self) -> None:
        import regex

        self.ranks = {int(p): r for r, p in enumerate(self.pairs)}
        order = np.argsort(self.pairs)
        self.sorted_pairs, self.sorted_ranks = self.pairs[order], order.astype(np.int64)
        self.new_id = self.made.tolist()
        self.byte_id = [0] * 256
        for i, t in enumerate(self.tokens):
            if t is not None and len(t) == 1:
                self.byte_id[t[0]] = i
        self.pattern = regex.compile(PATTERN)
        self.odd_letters = frozenset(self.odd)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.known = _Known(self)
        self.words = None
        self.ready = True

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if len(word) > LONG:
            return self.long_word_ids(word)
        rank_of, new_id = self.ranks.get, self.new_id
        parts = [self.byte_id[b] for b in word]
        ranks = [rank_of(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i : i + 2] = (new_id[least],)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 32 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | parts[i], NONE)
        return parts

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 32 | right
        at = np.minimum(np.searchsorted(self.sorted_pairs, pairs), len(self.sorted_pairs) - 1)
        return np.where(self.sorted_pairs[at] == pairs, self.sorted_ranks[at], NONE)

    def long_word_ids(self, word: bytes) -> list[int]:
        """As word_ids, with all merges of the least rank in one step; of overlapping ones (as in aaa) the leftmost counts."""
        parts = np.array(self.byte_id, np.int64)[np.frombuffer(word, np.uint8)]
        if not len(self.pairs) or len(parts) < 2:
            return parts.tolist()
        ranks = self._looked_up(parts[:-1], parts[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            if len(at) > 1 and (at[1:] == at[:-1] + 1).any():  # in a run of neighbours every second one
                run = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1] + 1)]))
                begin = np.searchsorted(run, run)
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            parts[at] = self.new_id[least]
            parts = np.delete(parts, at + 1)
            ranks = np.delete(ranks, at)
            new = at - np.arange(len(at))
            stale = np.concatenate([new, new - 1])
            stale = stale[(stale >= 0) & (stale < len(ranks))]
            ranks[stale] = self._looked_up(parts[stale], parts[stale + 1])
        return parts.tolist()

    def pretokens(self, text: str):
        if not text.isascii() and not self.odd_letters.isdisjoint(text):
            if self.words is None:
                from tokenizers import pre_tokenizers

                self.words = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
            return [text[a:z] for _, (a, z) in self.words.pre_tokenize_str(text)]
        return self.pattern.findall(text) if len(text) <= LAZY else map(methodcaller("group"), self.pattern.finditer(text))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not self.ready:
            self._prepare()
        if self.cut and any(n in text for n in self.special):
            return b"".join(self.special[t].to_bytes(4, "little") if t in self.special else self.encode_plain(t) for t in self.cut(text) if t)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        if len(self.known) > KNOWN:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.pretokens(text)))

    def decode(self, ids: bytes) -> str:
        """Text of ids; those that the vocabulary lacks are passed over, bytes that are no UTF-8 become U+FFFD."""
        tokens = self.tokens
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            out = b"".join(map(tokens.__getitem__, numbers))
        except (IndexError, TypeError):
            out = b"".join(tokens[i] for i in numbers if i < len(tokens) and tokens[i] is not None)
        return out.decode("utf-8", "replace")


class _Known(dict):
    """Packed ids of words, worked out when first asked for."""

    def __init__(self, model: ByteBPE):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.model.word_ids(word.encode()), "<u4").tobytes()
        if len(ids) <= 4 * LONG:
            self[word] = ids
        return ids


def encoded(docs: DataFrame, model: ByteBPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids, raw (the ids as little-endian 32-bit numbers).

    Null text counts as empty, which has no ids. Special tokens are recognized in texts; none is added. Rows that
    repeat an id are rows of their own; an empty table gives no rows; other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(ids: list, raw: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(r) // 4 for r in raw], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), lists, pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids", "raw"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encode
        for b in batches:
            ids, raw, size = [], [], 0
            for k in range(b.num_rows):
                ids.append(b.column(0)[k].as_py())
                raw.append(encode(b.column(1)[k].as_py() or ""))
                size += len(raw[-1])
                if size >= BATCH:
                    yield batch(ids, raw)
                    ids, raw, size = [], [], 0
            if ids:
                yield batch(ids, raw)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, "doc_id long, n_tokens long, ids array<int>, raw binary")


def decoded(coded: DataFrame, model: ByteBPE) -> DataFrame:
    """``coded`` (doc_id, n_tokens, raw) with the text of the ids in place of ``ids``; null ``raw`` counts as empty."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = shared.value.decode
        for b in batches:
            texts = pa.array([decode(r.as_py() or b"") for r in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], ["doc_id", "n_tokens", "raw", "text"])

    return coded.select("doc_id", "n_tokens", "raw").mapInArrow(each, "doc_id long, n_tokens long, raw binary, text string")


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    model = ByteBPE.load(MODEL)
    out = decoded(encoded(documents(spark, sf_dir), model), model)
    return out.select("doc_id", "n_tokens", F.sha2("raw", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
