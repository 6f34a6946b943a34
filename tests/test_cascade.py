"""The provider cascade, provider mappings, hints, bands and classes."""

import re

import pytest
from pyspark.sql import functions as F

from trackweave.functions import text as T
from trackweave.functions.schemas import RECORDING, struct_of
from trackweave.operators import hints as I
from trackweave.operators import lookups as U
from trackweave.operators import providers as O
from trackweave.operators import releases as L
from trackweave.operators import resolver as Z
from trackweave.plans import resolve as R


def record(spark, k=1, **own):
    kinds = R.FIELDS | {"raw_title": "string", "raw_year": "string"}
    return spark.createDataFrame([(k, *[own.get(n) for n in kinds])], "input_pos long, " + ", ".join(f"{n} {t}" for n, t in kinds.items()))


def result(spark, k=1, **own):
    kinds = R.FIELDS | R.FACTS
    return spark.createDataFrame([(k, *own.values())], "input_pos long, " + ", ".join(f"{n} {kinds[n]}" for n in own))


def resolved(spark, own, **results):
    return R.resolved(record(spark, **own), {n: result(spark, **r) for n, r in results.items()}).first()


OWN = {"title": "Song", "artist": "A", "album": "Album", "year": "2001", "raw_title": "Song", "raw_year": "1999", "duration_ms": 200_000}


def test_all_providers_come_by_one_shuffle(spark):
    results = {n: result(spark, title="x") for n in R.PROVIDERS}
    plan = R.gathered(record(spark), results, "input_pos")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) <= 2  # the results, and the records


def test_a_local_hit_ends_the_cascade(spark):
    r = resolved(spark, OWN, local={"title": "Local", "artist": "B", "track_number": 0, "disc_number": 4}, catalog={"title": "Song (Catalog)", "cover_url": "c"}, recording={"title": "Song", "confidence": "high", "track_number": 9, "disc_number": 9})
    assert (r.title, r.artist, r.cover_url, r.track_number, r.disc_number, r.source, r.year) == ("Local", "B", "", 9, 4, "local", "2001")


def test_numbers_need_a_consistent_catalog_hit(spark):
    own = OWN | {"track_number": 2}
    hit = {"title": "Song", "artist": "A", "track_number": 7, "disc_number": 1, "duration_ms": 201_000}
    assert resolved(spark, own, catalog=hit).track_number == 7
    assert resolved(spark, own, catalog=hit | {"duration_ms": 300_000}).track_number == 7  # durations count only beside a sure recording
    far = hit | {"duration_ms": 300_000}
    assert resolved(spark, own, catalog=far, recording={"title": "Song", "artist": "A", "confidence": "good"}).track_number == 2
    assert resolved(spark, own, catalog=hit, recording={"title": "Song", "confidence": "good", "track_number": 5}).track_number == 5
    assert resolved(spark, own, catalog=hit, recording={"title": "Song", "confidence": "low", "track_number": 5}).track_number == 7
    assert resolved(spark, OWN | {"title": "Song (Remix)", "track_number": 2}, catalog=hit).track_number == 2
    safe = {"title": "Song", "artist": "A", "confidence": "high", "isrc": "x1", "edition": "album"}
    assert resolved(spark, own, catalog=hit | {"isrc": "X1", "edition": "single"}, recording=safe).track_number == 2
    assert resolved(spark, own, catalog=hit | {"isrc": "X1", "edition": "album"}, recording=safe).track_number == 7
    exact = {"title": "Other thing", "artist": "Somebody", "confidence": "isrc"}
    assert resolved(spark, own, catalog=hit, recording=exact).track_number == 2
    assert resolved(spark, own, catalog=hit | {"by_isrc": True}, recording=exact).track_number == 7


def test_richer_titles_and_years(spark):
    r = resolved(spark, OWN, catalog={"title": "Song (feat. B)", "artist": "A", "year": "2015"}, recording={"title": "Song", "confidence": "good", "first_date": "1998-02-01"})
    assert (r.title, r.sort_title, r.year, r.source) == ("Song (feat. B)", "Song (feat. B)", "1998", "catalog")
    assert resolved(spark, OWN, catalog={"title": "Melody in D", "artist": "A"}).title == "Song"
    assert resolved(spark, OWN | {"year": ""}, optional={"title": "x"}).year == "1999"


def test_misses_are_filled(spark):
    last = {"title": "F", "cover_url": "fc", "track_number": 8, "genre": "G", "year": "2012"}
    r = resolved(spark, OWN | {"year": ""}, fallback=last)
    assert (r.title, r.cover_url, r.track_number, r.genre, r.year, r.source) == ("Song", "fc", 8, "G", "2012", "fallback")
    r = resolved(spark, OWN, fallback=last, catalog={"title": "Song", "cover_url": f"http://{R.CATALOG_COVERS}/1", "track_number": 3})
    assert (r.cover_url, r.track_number, r.genre) == (f"http://{R.CATALOG_COVERS}/1", 3, "G")
    r = resolved(spark, OWN)
    assert (r.title, r.source, r.artist_collection, r.compilation) == ("Song", "none", "A", False)


def test_artists_of_the_optional_provider(spark):
    r = resolved(spark, OWN, optional={"title": "S", "artist": "New", "artist_collection": "N; M"}, by_code={"artist_collection": "C & D"})
    assert (r.artist, r.artist_collection, r.source) == ("New", "N, M", "by_code")
    r = resolved(spark, OWN, by_code={"artist_collection": "C & D", "title": "Song", "track_number": 4})
    assert (r.artist_collection, r.track_number) == ("C, D", 4)
    assert resolved(spark, OWN | {"title": "Song (Live)", "track_number": 1}, by_code={"title": "Song", "track_number": 4}).track_number == 1


def test_hints(spark):
    cases = [("Nights - Something", "Something", "Nights"), ("Nights (Deluxe) - Something", "x", "Nights (Deluxe) - Something"), ("Song", "song", "Song"), ("A very long title of a song", "a very long title of a song", ""), ("Song - EP", "Song", ""), ("", "Song", ""), (None, "Song", ""),
             ("A very long title of a songs", "A very long title of a song", ""), ("A very long title of a song deluxe", "A very long title of a song", "A very long title of a song deluxe")]
    df = spark.createDataFrame([(i, h, t) for i, (h, t, _) in enumerate(cases)], "i int, hint string, title string")
    assert {r.i: r.hint for r in I.usable_hints(df, "hint", "title").collect()} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_recording_queries(spark):
    cases = [
        (("Song (Remix) [Bonus]", "A & B", "", False), 'recording:Song AND artist:A'), (("Song (Club Mix)", "", "The Album", True), 'recording:"Song Club Mix" AND release:"The Album"'), (("(Intro)", "A", "", False), "recording:(Intro) AND artist:A"),
        (("Song feat. C, D", "A", "", False), 'recording:"Song feat. C, D" AND artist:A AND artist:C'), (("", "", "", False), ""), (("Song (feat. C)", "", "", True), "recording:Song AND artist:C"),
    ]
    for (title, artist, album, tag), want in cases:
        df = spark.createDataFrame([(title, artist, album)], "t string, a string, b string")
        assert df.select(Z.recording_query(F.col("t"), F.col("a"), F.col("b"), tag).alias("q")).first().q == want


def test_provider_mappings(spark):
    rows = spark.createDataFrame([(1, "T", "", None, 0, 3, None, "G", "2001", "us")], "k int, title string, album string, cover_url string, duration_ms int, track_number int, disc_number int, genre string, year string, isrc string")
    assert tuple(O.from_code_lookup(rows, "k").first()) == (1, "T", None, None, None, 3, None, "G", "2001", "us")
    kind = "k int, name string, artists array<struct<name:string>>, album struct<name:string,artists:array<struct<name:string>>,release_date:string,images:array<struct<url:string>>,total_tracks:int>, external_ids struct<isrc:string>, track_number int, disc_number int, explicit boolean, duration_ms int"
    tracks = spark.createDataFrame([(1, "S", [("A",), (None,), ("B",)], ("L", [], "2001-01", None, None), None, None, 1, None, 5), (2, None, None, None, None, None, None, None, None)], kind)
    got = {r.k: r for r in O.from_optional(tracks, "k").collect()}
    assert (got[1].artist, got[1].album_artist, got[1].artist_collection, got[1].year, got[1].cover_url) == ("A, B", "A", "A; B", "2001", "") and got[2].title == ""


def test_exclusive_fields(spark):
    doc = '{"id":"r1","isrcs":["US1"],"artist-credit":[{"artist":{"id":""}},{"artist":{"id":"a2"}}],"releases":[{"id":"x","title":"First","country":"XW"},{"id":"y","title":"My Album (Deluxe)","country":" gb ","release-group":{"id":"g"},"label-info":[{"label":{"name":"L"}}],"artist-credit":[{"artist":{"id":"o"}}]}]}'
    names = ("isrc", "mb_track_id", "mb_album_id", "mb_release_group_id", "mb_artist_id", "mb_album_artist_id", "label", "country", "album_artist")
    rows = [(1, "my album", "own", *[""] * 8, doc), (2, "", None, *[""] * 8, doc), (3, "x", "", *[""] * 8, None)]
    df = spark.createDataFrame(rows, "k int, album string, " + ", ".join(f"{n} string" for n in names) + ", j string")
    df = df.withColumn("recording", F.from_json("j", struct_of(RECORDING))).drop("j")
    got = {r.k: r for r in O.exclusive_fields(df).collect()}
    assert [got[1][n] for n in names[:8]] == ["own", "r1", "y", "g", "a2", "o", "L", "GB"]
    assert [got[2][n] for n in names[:8]] == ["US1", "r1", "x", "", "a2", "", "", ""] and got[3].label == ""
    mapped = spark.createDataFrame([(2, "US9", "Mapped")], "k int, isrc string, album string")
    out = {r.k: (r.isrc, r.album) for r in O.recording_fallback(df, mapped, "k").collect()}
    assert out[2] == ("US9", "Mapped") and out[1] == ("own", "my album")


def test_bands_and_classes(spark):
    rows = [(1, "a", 0), (2, "a", 5000), (3, "a", 10001), (4, "b", 1), (5, "a", None), (6, None, 3), (7, "a", 5000), (8, "a", -4999)]
    got = {r.k: r.partners for r in U.band_partners(spark.createDataFrame(rows, "k int, n string, v int"), "n", "v", 5000).collect()}
    want = {k: sum(n == m and v is not None and w is not None and abs(v - w) <= 5000 for j, m, w in rows if j != k) if n and v is not None else None for k, n, v in rows}
    assert got == want
    codes = spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, None), (5, "y")], "k int, c string")
    assert sorted(map(tuple, U.code_classes(codes, F.col("c"), "k").collect())) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1), (5, 5, 1)]


def test_long_lists_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(L, "LISTED", 1)
    listed = spark.createDataFrame([("a", "x"), ("b", "y")], "artist string, word string")
    df = spark.createDataFrame([("a", "xx"), ("a", "z"), ("c", "x")], "by string, title string")
    out = L.not_listed(df, listed, F.col("by"), F.col("title"))
    assert sorted(map(tuple, out.collect())) == [("a", "z"), ("c", "x")] and "broadcast" not in out._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("title, want", [("Song ((Live))", "Song"), ("Song [Official Music Video 4K]", "Song"), ("Song (Official Video HD)", "Song"), ("Song ([])", "Song"), ("Video Killed the Radio Star", "Video Killed the Radio Star"), ("Song (Full Moon)", "Song (Full Moon)"), ("Song (Music)", "Song (Music)")])
def test_remarks_of_several_words(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(T.clean_title(F.col("t")).alias("x")).first().x == want


def test_edition_words_of_a_long_run_take_little_time(spark):
    text = "word " * 40_000 + "radio edit"
    assert spark.createDataFrame([(text,)], "t string").select(T.edition_tokens(F.col("t")).alias("x")).first().x != []


def test_catalog_search(spark):
    from trackweave.plans.catalog_search import search

    track = "track_id long, track_name string, artist_name string, artist_id long, collection_artist_name string, collection_name string, collection_id long, track_time_millis int, track_explicitness string"
    tracks = spark.createDataFrame([
        (1, "Midnight Song", "The Band", 5, "", "Blue Nights", 10, 200_000, "notExplicit"), (2, "Midnight Song", "The Band", 5, "", "Midnight Song - Single", 11, 200_000, "notExplicit"), (3, "Morning Song", "The Band", 5, "", "Blue Nights", 10, 180_000, "notExplicit"),
        (4, "Midnight Song", "Others", 6, "", "Red Days", 12, 200_000, "notExplicit"), (5, "Evening", "The Band", 5, "", "Late", 13, 150_000, "explicit"),
    ], track)
    albums = spark.createDataFrame([(10, "Blue Nights", "The Band", "Album", 12), (11, "Midnight Song - Single", "The Band", "Single", 1), (12, "Red Days", "Others", "Album", 9), (13, "Late", "The Band", "Album", 8)], "collection_id long, collection_name string, artist_name string, collection_type string, track_count int")
    asked = spark.createDataFrame([
        (1, "Midnight Song (Official Video)", "The Band", "Blue Nights", 200_000), (2, "Midnight Song", "The Band", "", 200_000), (3, "The Band - Midnight Song", "Some Records", "", None), (4, "Nothing like it", "The Band", "", None), (5, "Eveningg", "The Band", None, None), (6, "  ", "x", "", None),
    ], "query_id long, title string, artist string, album_hint string, duration_ms int")
    got = {r.query_id: (r.row_id, r.strategy) for r in search(asked, tracks, albums).collect()}
    assert got == {1: (1, "album"), 2: (2, "title"), 3: (2, "title"), 5: (5, "title")}
