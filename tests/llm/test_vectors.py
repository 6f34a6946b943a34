"""Vector codes and hard negatives against brute force: nulls, non-finite components, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trackweave.llm import hard_negatives, vector_codes, vectors
from trackweave.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, q string, row_ string, cells int, code string, score double"
DIMS = 32


def vectors_of(seed: int, n: int, ids: bool = False) -> list:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(DIMS)] for _ in range(3)]
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 1, 2, None])
        v = [np.float32(c + rng.gauss(0, 0.15)).item() for c in centres[label or 0]]
        rows.append([i if ids else rng.randrange(2 * n), v, label])
    rows[5][1] = rows[6][1] = rows[7][1]  # ties
    rows[9] = list(rows[10])  # a repeated row
    rows[11][1], rows[12][1], rows[13][1] = None, [*rows[12][1][:-1], None], [float("nan"), *rows[13][1][1:]]
    rows[14][1], rows[15][1], rows[16][1], rows[17][0] = [float("inf"), *rows[14][1][1:]], rows[15][1][:8], [], None
    return rows


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 0.5) for r in rows], SCHEMA).repartition(parts)


def clean(rows):
    """Kept rows with their integers."""
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), x) for i, v, x in rows if v is not None and None not in v and np.isfinite(v).all()]
    return [r for r in good if len(r[1]) == DIMS]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    own = clean(rows)
    m = np.array([q for _, q, _ in own])
    first = sorted(range(len(own)), key=lambda k: (own[k][0] is None, own[k][0] or 0, own[k][1].tolist()))[:entries]
    d = DIMS // parts
    books = [m[first, p * d : p * d + d].copy() for p in range(parts)]

    def assign():
        out = [((m[:, None, p * d : p * d + d] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        return np.array([x.argmin(1) for x in out]).T, sum(x.min(1) for x in out)

    for _ in range(rounds):
        near, _ = assign()
        for p in range(parts):
            for e in set(near[:, p].tolist()):
                books[p][e] = m[near[:, p] == e, p * d : p * d + d].sum(0) // (near[:, p] == e).sum()
    near, error = assign()
    by_label = {x: int(sum(e for e, r in zip(error, own) if r[2] == x)) for x in {r[2] for r in own}}
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return sorted((r[0] or -1, bytes(c.tolist()).hex(), int(e), by_label[r[2]]) for r, c, e in zip(own, near, error)), digest


@pytest.mark.parametrize("n", [30, 300])
def test_vector_codes_equal_brute_force(spark, n):
    rows = vectors_of(n, n)
    codes, books = vector_codes.compressed(table(spark, rows))
    want, digest = plain_codes(rows)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()) == want and books.digest() == digest
    ints = {}
    for i, q, _ in clean(rows):
        ints.setdefault(i, []).append(q)
    for r in vector_codes.decoded(codes, books).collect():
        assert r.error in [int(((np.array(r.q) - q) ** 2).sum()) for q in ints[r.vec_id]]


def test_no_vectors(spark):
    empty = table(spark, [(1, None, 0)]).filter("false")
    codes, books = vector_codes.compressed(empty)
    assert codes.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    assert vector_codes.compressed(table(spark, [(1, None, 0), (2, [None], 1)]))[0].count() == 0
    assert hard_negatives.mined(empty, F.col("vec_id") % 2 == 0).count() == 0
    assert hard_negatives.mined(table(spark, vectors_of(1, 30)), F.lit(False)).count() == 0


def test_uneven_parts_and_large_components(spark):
    rows = [(k, [1e9 if k == 3 else k / 10, -k / 10, 0.5, float(k % 2), 0.0], 0) for k in range(9)]
    codes, books = vector_codes.compressed(table(spark, rows), parts=2, entries=4)
    assert [b.shape[1] for b in books.books] == [2, 3] and codes.count() == 9
    assert max(b.max() for b in books.books) <= vectors.MOST


def test_bounds_hold_and_spare_entries():
    rng = np.random.default_rng(4)
    book = vector_codes.PartBook(rng.integers(-90, 90, (64, 4)))
    x = rng.integers(-150, 150, (5000, 4))
    number, distance, refined = book.nearest(x)
    every = ((x[:, None] - book.entries[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert refined < 0.25 * every.size
    grid = vectors.Grid(np.full(6, -70), np.full(6, 40), 3)
    y, a = rng.integers(-70, 41, (500, 6)), rng.integers(-50, 50, 6)
    table_, gap = grid.product_table(a)
    lower = table_[np.arange(6), grid.cells(y)].sum(1)
    assert (lower <= y @ a).all() and (y @ a <= lower + gap).all()


def plain_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    own = [(i, q, x) for i, q, x in clean(rows) if i is not None and x is not None]
    out = []
    for k, (i, a, x) in enumerate(own):
        if not is_anchor(i):
            continue
        scored = [(-int(q @ a), j, y) for n, (j, q, y) in enumerate(own) if n != k]
        for s, j, _ in sorted(r for r in scored if r[2] == x)[:positives]:
            fits = sorted(r for r in scored if r[2] != x and -low * s <= -100 * r[0] <= -high * s)[:negatives]
            out += [(i, j, n, r[1], -s, -r[0]) for n, r in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    for n, stripe, block in ((40, 32_768, 4_096), (400, 50, 30)):  # with many stripes and blocks too
        monkeypatch.setattr(hard_negatives, "STRIPE", stripe)
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        rows = vectors_of(n, n)
        got = sorted(map(tuple, hard_negatives.mined(table(spark, rows), F.col("vec_id") % 4 == 0).collect()))
        want = plain_negatives(rows, lambda i: i % 4 == 0)
        assert got == want and len(want) > 30


def test_odd_dimensions(spark):
    rng = random.Random(2)
    rows = [(i, [np.float32(rng.gauss(0.2, 0.3)).item() for _ in range(3)], i % 2) for i in range(60)]
    global DIMS
    before, DIMS = DIMS, 3
    try:
        got = sorted(map(tuple, hard_negatives.mined(table(spark, rows), F.col("vec_id") < 20).collect()))
        assert got == plain_negatives(rows, lambda i: i < 20)
    finally:
        DIMS = before


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_hard_negatives"])
def test_queries_equal_sql(spark, name, tmp_path):
    """The registered queries on a table with rows that take no part."""
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(0.02, 0.125, 64).astype("float32").tolist(), int(x)) for i, x in enumerate(rng.integers(0, 10, 240))]
    rows[3], rows[100], rows[14] = (3, None, 1), (100, [*rows[100][1][:-1], float("nan")], 2), (14, rows[15][1], None)
    rows[70] = (70, rows[71][1], 9)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    out = QUERIES[name](spark, str(tmp_path))
    names = sorted(out.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(want) and want


def test_the_given_table_is_whole():
    """Every vector of the smallest given table has 64 components, as the SQL of vector codes takes for granted."""
    column = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")["embedding"].combine_chunks()
    assert set(column.value_lengths().to_pylist()) == {64}
