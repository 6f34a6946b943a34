import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackweave.functions import distance as D

words = st.text("abcd e&'", max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_subsequence_against_table(a, b):
    assert D.common_subsequence(a, b) == lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_ranges(a, b):
    assert D.text_distance(a, a) == 0
    assert 0 <= D.text_distance(a, b) <= 1
    assert 0 <= D.title_likeness(a, b) <= 1.08
    assert abs(D.indel(a, b) - D.indel(b, a)) < 1e-12


def test_known_values():
    assert round(D.basic_distance("midnightcity", "midnightcities"), 6) == 0.153846
    assert round(D.basic_distance("coldwidget", "coldgizmo"), 6) == 0.473684
    assert round(D.basic_distance("martha", "marhta"), 6) == 0.038889
    assert D.basic_distance("", "") == 0 and D.basic_distance("abc", "") == 1
    assert D.text_distance(None, None) == 0 and D.text_distance(None, "a") == 1
    assert D.text_distance("Beatles, The", "the beatles") == 0


def test_columns_agree_with_functions(spark):
    rng = random.Random(3)
    rows = [tuple("".join(rng.choice("ab c") for _ in range(rng.randrange(9))) for _ in range(2)) for _ in range(50)] + [(None, "x"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", D.string_dist(F.col("a"), F.col("b")).alias("d"), D.title_similarity(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        assert abs(r.d - D.text_distance(r.a, r.b)) < 1e-12 and abs(r.s - D.title_likeness(r.a, r.b)) < 1e-12


def test_queries_compare_like_names(spark, tmp_path):
    from trackweave import queries

    names = ["cold bolt", "hot widget", "red bolt"]
    like = {(a, b) for a in names for b in names} - {("cold bolt", "hot widget"), ("hot widget", "cold bolt"), ("hot widget", "red bolt"), ("red bolt", "hot widget")}
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    for f in (queries.indel_distance, queries.title_similarity):
        assert sorted((r.a, r.b) for r in f(spark, str(tmp_path)).collect()) == sorted(like)
