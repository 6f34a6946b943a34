from pyspark.sql import functions as F

from trackweave.functions import text as T
from trackweave.operators import releases as L
from trackweave.sources import catalog as R


def test_track_total(spark):
    df = spark.createDataFrame([(1, [([1, 2],), (None,), ([3],)]), (2, None), (3, [])], "id int, media array<struct<tracks: array<int>>>")
    assert {r.id: r.n for r in df.select("id", L.track_total(F.col("media")).alias("n")).collect()} == {1: 3, 2: 0, 3: 0}


def test_release_track(spark):
    rows = [("a", 1, "one more", True), ("a", 2, "one", None), ("b", 1, "two", False), ("b", 2, "one", True), ("c", 1, None, False), ("c", 2, "", False)]
    df = spark.createDataFrame(rows, "key string, n int, title string, other boolean")
    out = L.release_track(df, "key", F.lit("one"), F.col("title"), F.col("other"), ["n"])
    assert {(r.key, r.n, r["rank"]) for r in out.collect()} == {("a", 2, 0), ("b", 2, 1), ("c", 1, 2)}
    assert L.release_track(df.limit(0), "key", F.lit("one"), F.col("title"), F.col("other"), ["n"]).count() == 0


def test_small_columns(spark):
    df = spark.createDataFrame([("  ab c ", None, "", "T"), (" \n", "", None, None), (None, "S", "M", "T")], "t string, a string, b string, c string")
    out = df.select(T.limited(F.col("t"), 3).alias("t"), L.trusted_isrc(F.col("a"), F.col("b"), F.col("c")).alias("isrc")).collect()
    assert [(r.t, r.isrc) for r in out] == [("ab ", "T"), (None, ""), (None, "S")]


def test_exported_and_tracks_of(spark):
    df = spark.createDataFrame([(1, None, "x")], "id int, name string, _own string")
    assert L.exported(df, "id").first().json == '{"id":1,"name":null}'
    albums = spark.createDataFrame([(2, "other")], "id int, album string")
    assert [tuple(r) for r in R.tracks_of(df.select("id", "name"), "id", 1, albums).collect()] == [(1, None, None)]


def test_internals(spark):
    df = spark.createDataFrame([(1, "a", "x")], "k int, n string, _own string")
    out = L.without_internals(L.with_fields(df, {"n": F.lit(5), "z": F.lit(1), "_own": F.lit("y")}))
    assert out.columns == ["k", "n"] and out.first().n == "5"
