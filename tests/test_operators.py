from pyspark.sql import functions as F

from trackweave.functions import edition as E
from trackweave.operators import candidates as C
from trackweave.operators import mappers as M
from trackweave.operators import merge as G
from trackweave.operators import scoring as S
from trackweave.operators import select_best as B
from trackweave.operators import store as K
from trackweave.sources import catalog as R

CAND = "query_id long, title string, artist string, album_hint string, duration_ms int, isrc string, track_name string, artist_name string, collection_name string, track_time_millis int, cand_isrc string, collection_type string"


def score(spark, hint="", ms=None, name="song", album="Other", cand_ms=None, kind="Album", isrc="", cand_isrc=""):
    row = (1, "song", "artist", hint, ms, isrc, name, "artist", album, cand_ms, cand_isrc, kind)
    return S.track_scores(S.candidate_side(S.query_side(spark.createDataFrame([row], CAND)))).first().score


def test_track_scores(spark):
    assert round(score(spark), 6) == 0.711538
    assert round(score(spark, album="song - Single"), 6) == 1.0
    assert round(score(spark, album="Other - Single"), 6) == 0.919231
    assert round(score(spark, album="Live in Paris"), 6) == 0.578125
    assert round(score(spark, ms=200000, cand_ms=209500), 6) == 0.683333
    assert round(score(spark, hint="other"), 6) == 1.0
    assert round(score(spark, album="Other (Deluxe)"), 6) == 0.616667
    assert score(spark, name="entirely different") is None
    assert score(spark, isrc="us1", cand_isrc="US1") == 1.0


def test_edition_penalty(spark):
    cases = [(["deluxe", "edition"], [], 1.0), (["deluxe", "edition"], ["edition"], 0.7), (["deluxe"], ["deluxe"], 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = {r.i: r.p for r in df.select("i", S.edition_penalty(F.col("a"), F.col("b")).alias("p")).collect()}
    assert [round(got[i], 6) for i in range(3)] == [c[2] for c in cases]


def test_release_kinds(spark):
    cases = [("Compilation", "x", 9, False, "compilation"), ("", "Foo - EP", 5, False, "single"), ("EP", "Foo", 5, False, "ep"), ("Album", "Foo - Single", 1, False, "single"), ("", "Foo", 2, True, "single"), ("", "Foo", 2, False, "unknown"), ("", "Foo", 9, False, "album")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, n string, c int, v boolean, want string")
    for r in df.withColumn("got", E.release_kind(F.col("t"), F.col("n"), F.col("c"), F.col("v"))).collect():
        assert r.got == r.want


def test_tiers(spark):
    catalog = spark.createDataFrame([(1, "Cold Widget", "Brand", "Promo"), (2, "cold bolt", "other", "none"), (3, None, "Brand", None)], "id long, t string, a string, c string")
    asked = spark.createDataFrame([(1, ["widget"], ["brand"], ["promo"]), (2, ["cold"], ["brand"], ["nope"]), (3, ["zzz"], ["brand"], []), (4, ["zzz"], ["yyy"], [])], "query_id long, x array<string>, y array<string>, z array<string>")
    got = sorted(map(tuple, C.tiered(asked, catalog, {"x": "t", "y": "a", "z": "c"}, "id").collect()))
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (3, 3, 3)]


def test_best_match_beyond_the_first_candidates(spark):
    from trackweave.plans import local_match as L

    n = C.MOST + 5
    track = "track_id long, track_name string, artist_name string, collection_name string, collection_id long, track_time_millis int, isrc string"
    catalog = spark.createDataFrame([(i, "Golden Hour" if i == n else f"Golden Rain {i}", "Hot Artist", "Sun", i % 9, None, "") for i in range(1, n + 1)], track)
    albums = spark.createDataFrame([(i, "Sun", "Hot Artist", "", 9) for i in range(9)], "collection_id long, collection_name string, artist_name string, collection_type string, track_count int")
    asked = spark.createDataFrame([(1, "Golden Hour", "Hot Artist", "Sun", None, "")], "query_id long, title string, artist string, album_hint string, duration_ms int, isrc string")
    words = L.prepared(asked)
    assert L.candidates(words, catalog).count() == n
    assert [(r.query_id, r.track_id) for r in L.matched(asked, catalog, albums).collect()] == [(1, n)]
    limited = C.tiered(spark.createDataFrame([(1, ["golden"])], "query_id long, t array<string>"), catalog, {"t": "track_name"}, "track_id", 10)
    assert sorted(r.row_id for r in limited.collect()) == list(range(1, 11))


def test_best_pick(spark):
    rows = [(1, 0, 1, "notExplicit", False, 200000, 0.95), (1, 1, 1, "explicit", False, 203000, 0.9), (1, 2, 2, "notExplicit", False, 200500, 0.9), (1, 3, None, "explicit", True, 200000, 0.9)]
    df = spark.createDataFrame(rows, "q int, pos int, cid int, e string, live boolean, ms int, score double")
    pool = B.preferred_pool(df, "q", "cid", F.col("e") == "explicit", "score", "pos")
    out = B.picked_of_pool(pool, "q", "score", F.col("live"), B.duration_delta(F.lit(200000), F.col("ms"))).collect()
    assert sorted(r.pos for r in out) == [1, 2, 3] and [r.pos for r in out if r.picked] == [2]


def test_tolerant_best_depends_on_order(spark):
    rows = [(1, 0, 0.80, 0, "aa"), (1, 1, 0.84, 1, "a"), (1, 2, 0.88, 1, "aaa"), (1, 3, 0.95, 0, "a")]
    got = B.tolerant_best(spark.createDataFrame(rows, "q int, pos int, s double, o int, n string"), "q", "pos", "s", "o", "n").first()
    assert got.pos == 3


def test_sides(spark):
    rows = [(1, x) for x in ("A1", "A2", "B1", "B2", "C1", "7", "?")]
    got = {r.n: r.position for r in B.side_numbers(spark.createDataFrame(rows, "r int, n string"), "r", "n").collect()}
    assert got == {"A1": 1, "A2": 2, "B1": 3, "B2": 4, "C1": 5, "7": 7, "?": None}


def test_merge(spark):
    base = spark.createDataFrame([(1, "", "a", "a", 3, True), (2, "x", None, "", 0, False)], "k int, a string, b string, c string, n int, f boolean")
    update = spark.createDataFrame([(1, "x", "x", "", 0, False)], "k int, a string, b string, c string, n int, f boolean")
    got = {r.k: tuple(r)[1:] for r in G.merge_records(base, update, "k", overwrite=("b", "c", "n", "f")).collect()}
    assert got[1] == ("x", "x", "a", 3, True) and got[2][0] == "x"
    again = G.merge_records(G.merge_records(base, update, "k"), update, "k").collect()
    assert sorted(map(str, again)) == sorted(map(str, G.merge_records(base, update, "k").collect()))


def test_store(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (3, "d", 1)], "k int, v string, o int")
    out = K.upsert(base, new, "k", "o")
    assert sorted(map(tuple, out.collect())) == [(1, "c"), (2, None), (3, "d")]
    assert sorted(map(tuple, K.upsert(out, new, "k", "o").collect())) == sorted(map(tuple, out.collect()))
    assert sorted(map(tuple, K.backfill(base, new.filter("o = 2").unionByName(spark.createDataFrame([(2, "z", 0)], new.schema)), "k", "v").collect())) == [(1, "a"), (2, "z")]
    assert [tuple(r) for r in K.delete(base, new, "k").collect()] == [(2, None)]
    assert [tuple(r) for r in K.patch(base, spark.createDataFrame([(2, "p", 1)], "k int, v string, other int"), "k").filter("k = 2").collect()] == [(2, "p")]


def test_year_repair(spark):
    df = spark.createDataFrame([("1996", "1990-01-01", "1980"), ("", "", "1980"), ("1990", "1995", ""), ("abcd", "12", "")], "y string, a string, b string")
    assert [r.x for r in df.select(G.repaired_year(F.col("y"), [F.col("a")], [F.col("b")]).alias("x")).collect()] == ["1990", "1980", "1990", None]


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# comment\n\n http://a \n #kept\nhttp://b\n")
    assert sorted(r.line for r in R.read_lines(spark, str(tmp_path / "list.txt")).collect()) == ["#kept", "http://a", "http://b"]
    payload = spark.createDataFrame([(1, '{"data":[{"id":1},{"id":2}]}'), (2, '{"results":[{"id":3}]}'), (3, "no json")], "k int, j string")
    assert sorted((r.k, r.item.id) for r in R.json_list(payload, "j", "id:int").collect()) == [(1, 1), (1, 2), (2, 3)]
    df = spark.createDataFrame([(1, "IT", 1), (1, "US", 2), (2, "ES", 3)], "k int, country string, v int")
    rank = F.when(F.col("country") == "US", 0).when(F.col("country") == "IT", 1).otherwise(2)
    assert sorted(r.v for r in R.first_source(df, "k", rank, ["v"]).collect()) == [2, 3]


def test_recordings(spark):
    from trackweave.functions.schemas import RECORDING, struct_of

    doc = '{"id":"r1","title":"Song","isrcs":["US1"],"first-release-date":"1999-05-01","artist-credit":[{"name":"A","joinphrase":" & ","artist":{"id":"a1"}},{"name":"B"}],"tags":[{"name":"rock","count":3},{"name":"pop","count":5}],"releases":[{"id":"x","title":"Album","country":"XW","release-group":{"id":"g"},"label-info":[{"label":{"name":"L"}}]}]}'
    df = spark.createDataFrame([(doc,)], "j string").select(F.from_json("j", struct_of(RECORDING)).alias("r")).select("r.*")
    got = M.from_recording(df).first()
    assert (got.title, got.artist, got.album, got.year, got.genre, got.isrc, got.label, got.country, got.mb_artist_id) == ("song", "a", "Album", "1999", "Pop", "US1", "L", "", "a1")


def test_enrich(spark):
    from trackweave.functions.schemas import ALBUM, META, RAW, TRACK
    from trackweave.plans.enrich import enrich

    raw = spark.createDataFrame([(1, "Someone - Midnight Song (Official Video)", None, None, None, "20200101", None, "u", None, "v1", None, None, False, None, None), (2, "Unknown Thing", "Nobody", None, 1999, None, 3, None, None, "v2", None, None, False, 12.5, None), (3, "again", None, None, None, None, None, None, None, "v1", None, None, None, None, None)], RAW)
    tracks = spark.createDataFrame([(10, 5, 7, "Someone", "Midnight Song - Single", "Midnight Song", None, "http://x/100x100bb.jpg", "explicit", 1, 1, 1, 1, 180000, "Pop", "US2")], TRACK)
    albums = spark.createDataFrame([(7, None, "Single", 5, "Someone", "Midnight Song - Single", None, None, 1, "US", None, "Pop")], ALBUM)
    provider = spark.createDataFrame([(2, "Jazz", "DE3")], "input_pos long, genre string, isrc string")
    got = {r.input_pos: r for r in enrich(raw, tracks, albums, [provider]).collect()}
    assert set(got) == {1, 2} and set(META) <= set(got[1].asDict())
    assert got[1].itunes_track_id == "10" and got[1].matched and got[1].year == "2020" and got[1].cover_url.endswith("3000x3000bb.jpg")
    assert got[2].genre == "Jazz" and got[2].isrc == "DE3" and got[2].duration_ms == 12500 and got[2].itunes_track_id == ""


def test_streaming_upsert(spark, tmp_path):
    from trackweave.streaming.upserts import upsert_stream

    schema = "k int, v string, o int"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = upsert_stream(stream, str(tmp_path / "out"), "k", "o", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/version=0")).collect())) == [(1, "b", 2), (2, "c", 1)]
