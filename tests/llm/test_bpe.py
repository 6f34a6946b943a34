"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import bpe_codec

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def model():
    return bpe_codec.ByteBPE.load(bpe_codec.MODEL)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe_codec.MODEL)


def ids(raw: bytes) -> list:
    return np.frombuffer(raw, "<u4").tolist()


TEXTS = [
    "", " ", "   ", "\n\n", "one two  three\t four\r\n", "it's we're I'll 's'S ’s", "12345 ５６ x1²½", "<|endoftext|>", "a<|endoftext|><|endoftext|> b  <|endoftext|> ", "<|endoftext", "\x00\x01 x\u0085a b　c ",
    "👩‍👩‍👧 ﷺ ёлка 日本語のテキスト ไทย", "՘ ₏ \U00010940 \U00016d40 ꟎", "é" * 400, "x" * 5000, "abc" * 3000, "a" * 257, " " * 700,
]


def test_texts_equal_library(model, library):
    rng = random.Random(9)
    own = [*TEXTS, *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x4E00, 0x4F00), 32])) for _ in range(rng.randrange(1, 80))) for _ in range(1500))]
    for t in own:
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(model.encode(t)) == want, t
        assert model.decode(model.encode(t)) == library.decode(want, skip_special_tokens=False) == t
    for _ in range(500):  # also ids that no text has
        some = [rng.randrange(50_300) for _ in range(rng.randrange(9))]
        assert model.decode(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)


def test_every_character_is_cut_as_the_library_does(model, library):
    """Each letter, digit and space with neighbours, a sample of the others."""
    if not model.ready:
        model.encode("")
    for c in [*range(1, 0x3100), *range(0x3100, 0xD800, 37), *range(0xE000, 0x20000, 11)]:
        text = f"a{chr(c)}1{chr(c)} {chr(c)}!"
        assert list(model.pretokens(text)) == [text[a:z] for _, (a, z) in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_long_words_merge_alike(model, library, monkeypatch):
    rng = random.Random(1)
    for letters in ("a", "ab", "eth", "abcdefghijklmnopqrstuvwxyzé", "日本語中"):
        for n in (2, 3, 7, 100, 1200):
            word = "".join(rng.choice(letters) for _ in range(n)).encode()
            want = library.encode(word.decode(), add_special_tokens=False).ids
            assert model.long_word_ids(word) == want
            monkeypatch.setattr(bpe_codec, "LONG", 1 << 30)
            assert model.word_ids(word) == want
            monkeypatch.undo()


def test_remembered_words_are_bounded(model, monkeypatch):
    monkeypatch.setattr(bpe_codec, "KNOWN", 10)
    monkeypatch.setattr(bpe_codec, "LAZY", 20)
    own = bpe_codec.ByteBPE(*model.__getstate__())
    for k in range(50):
        text = " ".join(f"word{k}{j}" for j in range(8))
        assert own.encode(text) == model.encode(text) and len(own.known) <= 30


def test_rows(spark, model, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "BATCH", 1 << 12)
    rows = [(k, t, "x") for k, t in enumerate([None, *TEXTS])] + [(1, "one two", "y"), (1, "one two", "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, raw string").withColumn("ids", F.lit(1))
    coded = bpe_codec.encoded(docs, model)
    out = bpe_codec.decoded(coded, model)
    want = sorted((-1 if i is None else i, len(w := library.encode(t or "", add_special_tokens=False).ids), w, t or "") for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids) for r in coded.collect()) == [w[:3] for w in want]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, ids(r.raw), r.text) for r in out.collect()) == want
    assert bpe_codec.decoded(bpe_codec.encoded(docs.filter("false"), model), model).count() == 0


def test_query(spark, library, tmp_path):
    rows = [(k, t) for k, t in enumerate([None, *TEXTS])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        own = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(own), sha(np.array(own, "<u4").tobytes()), sha(library.decode(own, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, bpe_codec.op12_bpe(spark, str(tmp_path)).collect())) == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe_codec.ByteBPE.load("/opt/tokenizers/word_bpe_49k.json")
