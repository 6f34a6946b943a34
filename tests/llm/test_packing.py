import random
from collections import defaultdict

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from trackweave.llm import token_packing as P


def slow(sizes, length):
    room, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(rows)) if room[r] >= sizes[i] and room[r] > 0]
        r = min(fits, key=lambda r: room[r], default=None)
        if r is None:
            rows.append([])
            room.append(length)
            r = len(rows) - 1
        rows[r].append(i)
        room[r] -= sizes[i]
    return sorted(room)


def test_best_fit_against_scan():
    rng = random.Random(1)
    for length in (1, 7, 64, 100):
        sizes = [rng.randint(1, length) for _ in range(200)]
        rows = P.packed(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(200))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == slow(sizes, length)


def test_rows_are_lossless(spark, tmp_path):
    ranks = P.load_ranks(P.RANKS)
    own = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "one", "Zwei  Wörter \n", "long text " * 3000, "x" * 9000, "the end"] + [f"document {k} " * (k % 9) for k in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    rows = P.pack_rows(docs, ranks)
    got = defaultdict(dict)
    for r in rows.withColumn("positions", P.positions(F.col("cumulative"))).collect():
        assert len(r.ids) == len(r.positions) == P.ROW and r.cumulative[0] == 0 and len(r.cumulative) == len(r.doc_ids) + 1 == len(r.starts) + 1
        for k, (i, s) in enumerate(zip(r.doc_ids, r.starts)):
            a, b = r.cumulative[k : k + 2]
            got[i][s] = r.ids[a:b]
            assert r.positions[a:b] == list(range(b - a))
    for i, t in enumerate(texts):
        assert [x for s in sorted(got[i]) for x in got[i][s]] == [*own.encode_ordinary(t or ""), P.END]
    assert P.pack_rows(docs.limit(0), ranks).count() == 0
    P.write_packed(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).first()
    assert len(np.frombuffer(back.ids, "<i4")) == P.ROW == len(back.positions)


def test_query_has_positions_and_binary_ids(spark, tmp_path):
    spark.createDataFrame([(i, "some words " * 700) for i in range(3)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = P.op6_token_packing(spark, str(tmp_path)).collect()
    assert rows and {i for r in rows for i in r.doc_ids} == {0, 1, 2}
    for r in rows:
        assert np.frombuffer(r.raw, "<i4").tolist() == r.ids and len(r.positions) == P.ROW
        assert all(r.positions[a:b] == list(range(b - a)) for a, b in zip(r.cumulative, r.cumulative[1:]))
