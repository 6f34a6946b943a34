"""Staged strategies, evaluation, ranked lookups, resolving, persisting, nested rewriting, penalties and status."""

import random

import pytest
from pyspark.sql import functions as F

from trackweave import search_queries as X
from trackweave.functions import distance as D
from trackweave.operators import evaluator as V
from trackweave.operators import lookups as U
from trackweave.operators import merge as G
from trackweave.operators import nested as N
from trackweave.operators import penalties as P
from trackweave.operators import resolver as Z
from trackweave.operators import status as H
from trackweave.operators import store as K
from trackweave.operators.strategies import first_stage_rows, staged


def test_strategies_stop_early(spark):
    asked = spark.createDataFrame([(k,) for k in range(5)], "k long")
    seen = {}

    def strategy(name, rows):
        def run(left, best):
            seen[name] = sorted(r.k for r in left.collect())
            return spark.createDataFrame(rows, "k long, score double, hit string").join(left, "k")

        return run

    first = strategy("first", [(0, 0.95, "a"), (1, 0.5, "b"), (1, 0.5, "a"), (2, 0.7, "a"), (9, 1.0, "x")])
    second = strategy("second", [(0, 1.0, "never"), (1, 0.5, "c"), (2, 0.9, "b"), (3, None, "d")])
    third = strategy("third", [(1, 0.6, "z"), (2, 1.0, "never")])
    out = staged(asked, {"first": first, "second": second, "third": third}, "k", order=[F.col("hit")])
    assert sorted((r.k, r.score, r.hit, r.strategy, r.stage) for r in out.collect()) == [(0, 0.95, "a", "first", 1), (1, 0.6, "z", "third", 3), (2, 0.9, "b", "second", 2)]
    assert seen == {"first": [0, 1, 2, 3, 4], "second": [1, 2, 3, 4], "third": [1, 3, 4]}
    one = staged(asked.filter("k = 0"), {"first": first, "second": second}, "k")
    seen.clear()
    assert one.count() == 1 and staged(asked.filter("k = 0"), {"first": first, "second": second}, "k").count() == 1 and "second" not in seen
    assert staged(asked.filter("false"), {"first": first}, "k").count() == 0


def test_first_stage_rows(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    stage = lambda rows: lambda left: left.join(spark.createDataFrame(rows, "k long, v int"), "k")
    out = first_stage_rows(asked, [stage([(1, 10), (1, 11)]), stage([(1, 20), (2, 20)])], "k")
    assert sorted(map(tuple, out.collect())) == [(1, 10), (1, 11), (2, 20)]


def test_cascade_takes_the_first_stage(spark):
    stage = lambda rows: spark.createDataFrame(rows, "k long, v string")
    stages = [stage([(1, "a"), (1, "b"), (None, "n")]), stage([(1, "c"), (2, "d"), (None, "m")]), stage([(3, "e"), (2, "f")])] + [stage([(4, str(n)), (1, "no")]) for n in range(5)]
    out = G.cascade(stages, "k")
    assert sorted((r.k or 0, r.v) for r in out.collect()) == [(0, "m"), (0, "n"), (1, "a"), (1, "b"), (2, "d"), (3, "e"), (4, "0")]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # one, however many stages


def test_likeness_bound_loses_no_pair(spark):
    rng = random.Random(6)
    words = ["love", "song", "the", "of", "night", "nights", "ii", "iv", "2", "pt 2", "a", "remix", "x", "beyond", "be-yond", "yond", "10cc", "don't", "..."]
    made = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))
    pairs = [(made(), made()) for _ in range(1500)]
    for a, _ in list(pairs)[:600]:
        b = list(a)
        for _ in range(rng.randrange(1, 4)):
            if b:
                b[rng.randrange(len(b))] = rng.choice("abe 2")
        pairs.append((a, "".join(b).strip()))
    df = spark.createDataFrame([(D.to_normal(a), D.to_normal(b)) for a, b in pairs], "a string, b string")
    c = F.col
    out = df.select("a", "b", D.likeness_bound(c("a"), c("b"), D.profile(c("a")), D.profile(c("b")), D.numbers(c("a")), D.numbers(c("b"))).alias("bound")).collect()
    known = [(D.title_likeness(r.a, r.b), r.bound) for r in out]
    assert all(sim <= bound for sim, bound in known)
    assert any(sim >= 0.88 for sim, _ in known) and sum(bound < 0.88 for _, bound in known) > 0.4 * len(known)


def test_conditions_run_before_the_distances(spark, tmp_path):
    """The plan filters by the bound below the Python stage."""
    spark.createDataFrame([(k, f"{a} {b}", f"Brand#{k % 3}", "SMALL", k) for k, (a, b) in enumerate((a, b) for a in ("cold", "hot") for b in ("ring", "rod"))], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    plan = V.prefiltered(X._pairs(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("aggregate(zip_with(a_profile")


def items(spark, rows):
    names = "query_id long, raw_title string, artist string, album_hint string, duration_ms int, row_id long, track_name string, artist_name string, collection_artist_name string, collection_name string, collection_type string, collection_id long, track_count int, track_time_millis int, track_explicitness string"
    df = spark.createDataFrame(rows, names)
    asked, item = names.split(", ")[:5], names.split(", ")[5:]
    left = V.asked_side(df.select("query_id", *[x.split()[0] for x in asked[1:]]).distinct())
    right = V.item_side(df.select("query_id", *[x.split()[0] for x in item]).withColumnRenamed("query_id", "of"))
    return left.join(right, F.col("query_id") == F.col("of"))


def test_evaluated(spark):
    row = lambda q, title, hint, i, name, artist="The Band", owner="", album="Nights", kind="Album", cid=1, n=10, ms=200_000, exp="explicit": (q, title, "The Band", hint, 200_000, i, name, artist, owner, album, kind, cid, n, ms, exp)
    rows = [
        row(1, "Midnight Song (Official Video)", "", 1, "Midnight Song", exp="notExplicit"), row(1, "Midnight Song (Official Video)", "", 2, "Midnight Song", ms=203_000),  # the explicit one of an album
        row(1, "Midnight Song (Official Video)", "", 3, "Midnight Song (Mixed)"), row(1, "Midnight Song (Official Video)", "", 4, "Noon Song"), row(1, "Midnight Song (Official Video)", "", 5, "Midnight Song", artist="Someone Else", cid=5),
        row(2, "Other Song", "", 6, "Other Song", owner="Various Artists", kind="Compilation", cid=2), row(2, "Other Song", "", 7, "Other Song", album="Greatest Hits", cid=3),  # compilations
        row(3, "Third Song", "Blue Album", 8, "Third Song", album="Blue Album", cid=4), row(3, "Third Song", "Blue Album", 9, "Third Song", album="Third Song - Single", kind="Single", cid=6, n=1),  # an equivalent single
    ]
    got = {r.query_id: (r.row_id, r.swapped) for r in V.evaluated(items(spark, rows)).collect()}
    assert got == {1: (2, False), 3: (9, True)}
    got = {r.query_id: (r.row_id, r.swapped) for r in V.evaluated(items(spark, rows), prefer_album=True, prefer_explicit=False).collect()}
    assert got == {1: (1, False), 3: (8, False)}


def test_accepted(spark):
    cases = [  # score, title, same, asks artist, artist, owner, within, asks album, album, prefix
        ((0.7, 0.8, False, True, 0.9, 0.0, False, False, 0.0, False), True), ((0.7, 0.7, False, True, 0.9, 0.0, False, False, 0.0, False), False), ((0.7, 0.7, True, True, 0.9, 0.0, False, False, 0.0, False), True),
        ((0.99, 0.8, False, True, 0.5, 0.5, False, False, 0.0, False), False), ((0.7, 0.8, False, True, 0.5, 0.5, True, True, 0.5, False), False), ((0.7, 0.8, False, True, 0.5, 0.5, True, True, 0.5, True), True),
        ((0.9, 0.8, False, True, 0.5, 0.5, True, True, 0.5, False), True), ((0.7, 0.8, False, False, 0.5, 0.5, False, True, 0.85, False), True), ((0.7, 0.8, False, True, 0.5, 0.85, False, True, 0.5, False), False),
    ]
    names = [f"c{k}" for k in range(10)]
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k int, " + ", ".join(f"{n} {t}" for n, t in zip(names, ["double", "double", "boolean", "boolean", "double", "double", "boolean", "boolean", "double", "boolean"])))
    got = {r.k: r.ok for r in df.select("k", V.accepted(*map(F.col, names)).alias("ok")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_best_albums(spark):
    asked = spark.createDataFrame([(1, "the band", "blue album"), (2, "", "blue album (deluxe edition)")], "query_id long, artist string, album_hint string")
    rows = [(1, 0, 10, "Blue Album", "Nobody"), (1, 1, 11, "Blue Albums", "The Band"), (1, 2, 12, "Blue Album", "The Band & Co"), (2, 0, 20, "Blue Album", "X"), (2, 1, 21, "Blue Album (Deluxe Edition)", "Y"), (2, 2, 22, "Red", "Z")]
    got = V.best_albums(asked, spark.createDataFrame(rows, "query_id long, pos int, collection_id long, collection_name string, album_artist string"))
    assert sorted((r.query_id, r.collection_id) for r in got.collect()) == [(1, 11), (2, 21)]


def test_ranked_lookup_shuffles_the_dimension_once(spark):
    dim = spark.createDataFrame([(1, "Song", "A", "X", None), (2, "song ", "a", "Y", "c2"), (3, "Song", "A", "Y", "c3"), (4, "Z", "A", "", "c4")], "id long, title string, artist string, album string, cover string")
    asked = spark.createDataFrame([(1, "song", "a", "x"), (2, "song", "a", "y"), (3, "none", "A", None), (4, None, "", "y"), (5, "song", "B", "Y"), (6, "A", None, "")], "q long, title string, artist string, album string")
    ways = [("title", "artist", "album"), ("title", "artist"), ("artist",)]
    out = U.ranked_lookup(asked, dim, "q", ways, [F.col("id")], ["id", "cover"], F.col("cover").isNotNull())
    assert sorted((r.q, r["rank"], r.found.cover) for r in out.collect()) == [(1, 1, "c2"), (2, 0, "c2"), (3, 2, "c2")]
    plan = U.indexed(dim, [[("title", F.col("title"))], [("artist", F.col("artist"))]], [F.col("id")], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_negative_cache(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (None, "none")], "k long, name string")
    asked = spark.createDataFrame([(10, 1), (11, 7), (12, None), (13, 1)], "id long, k long")
    rows, cache = U.with_negative_cache(asked, U.empty_cache(dim), dim, "k")
    assert sorted((r.id, r.name) for r in rows.collect()) == [(10, "a"), (11, None), (12, None), (13, "a")]
    assert sorted((r.k, r.hit) for r in cache.collect()) == [(1, True), (7, False)]
    late = spark.createDataFrame([(7, "found later"), (8, "new")], "k long, name string")
    rows, cache = U.with_negative_cache(spark.createDataFrame([(1, 7), (2, 8)], "id long, k long"), cache, late, "k")
    assert sorted((r.id, r.name) for r in rows.collect()) == [(1, None), (2, "new")] and cache.count() == 3


def test_enriched_and_hits(spark):
    tracks = spark.createDataFrame([(1, 5), (2, None)], "t long, a long")
    details = spark.createDataFrame([(1, 3, 1, "US1", None, ["A", "", "B"])], "t long, track_position int, disk_number int, isrc string, explicit boolean, contributors array<string>")
    albums = spark.createDataFrame([(5, ["hip hop"], "2001-02-03", "", "compile", 9)], "a long, genres array<string>, release_date string, upc string, record_type string, nb_tracks int")
    got = {r.t: r for r in U.enriched(tracks, details, albums, "t", "a").collect()}
    assert (got[1].track_number, got[1].artist_collection, got[1].explicit, got[1].genre, got[1].year, got[1].upc, got[1].edition_kind) == (3, "A, B", False, "Hip Hop", "2001", None, "compilation")
    assert got[2].genre is None and got[2].explicit is None


def test_by_code_and_retry(spark):
    asked = spark.createDataFrame([(1, "Song", "us1"), (2, "Song (Remix)", "US1"), (3, "Song (Remix)", "US2"), (4, "Song", ""), (5, "Song", "US9")], "query_id long, raw_title string, isrc string")
    known = spark.createDataFrame([(7, "Song", "US1"), (8, "Song (Live)", "us1"), (9, "Song (remix)", "us2")], "recording_id long, title string, isrc string")
    out = Z.by_code(asked, known, lambda rows: rows.withColumn("score", F.lit(0.8)), [F.col("recording_id")])
    assert sorted((r.query_id, r.recording_id) for r in out.collect()) == [(1, 7), (3, 9)]

    wants = F.contains("raw_title", F.lit("(Remix)"))
    seen = []
    first = lambda rows: rows.join(spark.createDataFrame([(1, "Song"), (2, "Song"), (3, "Song (Remix)"), (5, "x")], "query_id long, found string"), "query_id").select("query_id", "found")

    def again(rows):
        seen.extend(sorted(r.query_id for r in rows.collect()))
        return rows.select("query_id", F.when(F.col("query_id") == 2, "Song (Remix)").otherwise("Song").alias("found"))

    has = lambda: F.contains("found", F.lit("(Remix)"))
    more = asked.unionByName(spark.createDataFrame([(6, "No hit (Remix)", ""), (7, "Untagged (Remix)", "")], asked.schema))
    first_more = lambda rows: first(rows).unionByName(rows.filter("query_id = 7").select("query_id", F.lit("Untagged").alias("found")))
    got = Z.tag_retried(more, wants, first_more, again, "query_id", has())
    assert sorted((r.query_id, r.outcome) for r in got.collect()) == [(1, "hit"), (2, "retry"), (3, "hit"), (5, "hit")] and seen == [2, 6, 7]
    got = Z.tag_retried(more, wants, first_more, again, "query_id", has(), untagged_stays=True)
    assert (7, "untagged") in [(r.query_id, r.outcome) for r in got.collect()]


def test_artist_rules(spark):
    credits = [("A", " & "), ("B", None), ("C", " feat. "), (None, "")]
    recordings = spark.createDataFrame([("us1", "Song (Karaoke)", 0, [("no", "")]), ("US1", "Song", 1, credits), ("US2", "x", 0, [])], "isrc string, title string, pos int, credits array<struct<name:string,joinphrase:string>>")
    asked = spark.createDataFrame([(1, "us1", "Song"), (2, "US1", "Song karaoke"), (3, "", "Song"), (4, "US2", "x")], "query_id long, isrc string, raw_title string")
    got = {r.query_id: (r.artists, r.first_artist) for r in Z.artists_by_code(asked, recordings, [F.col("pos")]).collect()}
    assert got == {1: ("A & BC feat.", "A"), 2: ("no", "no"), 4: ("", "")}
    cases = [("", "A", "t", "", ["", "X & Y"], "X, Y"), ("", "A", "t", "B & C", [None], "B, C"), ("", "A", "Song (feat. Guest)", "A", [""], "A, Guest"), ("own", "A", "Song (feat. A)", "", [], "own"), ("", "A", "t", "A", [], "A")]
    for own, artist, title, found, trusted, want in cases:
        df = spark.createDataFrame([(own, artist, title, found)], "own string, artist string, title string, found string")
        assert df.select(Z.artist_collection(F.col("own"), F.col("artist"), F.col("title"), F.col("found"), [F.lit(t).cast("string") for t in trusted] or [F.lit("")]).alias("x")).first().x == want
    countries = spark.createDataFrame([(1, 0, 0.8, "IT"), (1, 1, 0.9, "US"), (1, 2, 0.9, "FR"), (2, 0, 0.84, "IT")], "k long, pos int, sim double, country string")
    assert [tuple(r) for r in Z.artist_country(countries, "k", "sim", "pos", "country").collect()] == [(1, "US")]


def test_queries_by_field(spark):
    df = spark.createDataFrame([("Déjà  Vu!", "Simon & Co", None)], "t string, a string, b string")
    r = df.select(Z.fielded_query(track=F.col("t"), artist=F.col("a"), album=F.col("b")).alias("x"), Z.free_query(F.col("t"), F.col("b"), F.col("a")).alias("y"), Z.quoted_term("release", F.col("a")).alias("z"), Z.quoted_term("release", F.lit("One")).alias("w")).first()
    assert tuple(r) == ('track:"Deja Vu" artist:"Simon Co"', "Deja Vu Simon Co", 'release:"Simon & Co"', "release:One")


def test_numbers_and_albums(spark):
    df = spark.createDataFrame([(1, 2, 7, 3, "good", False, False), (1, 2, 7, 0, "high", True, True), (1, 2, 7, 3, "low", False, False), (1, 2, 7, 3, "isrc", True, False)], "t int, d int, ft int, fd int, c string, wants boolean, has boolean")
    forced = Z.forced_numbers(*[F.col(c) for c in ("t", "d", "ft", "fd", "c", "wants", "has")])
    assert [tuple(r) for r in df.select(*[c.alias(n) for n, c in forced.items()]).collect()] == [(7, 3), (7, 2), (1, 2), (1, 2)]
    albums = spark.createDataFrame([("Nights", "Nights II"), ("Nights (Deluxe)", "Nights"), ("Nights", "")], "own string, found string")
    assert [r.x for r in albums.select(Z.search_album(F.col("own"), F.col("found")).alias("x")).collect()] == ["Nights II", "Nights (Deluxe)", "Nights"]
    conf = spark.createDataFrame([(0.9, 0.9), (0.8, 0.7), (0.6, 0.5), (0.5, 0.5)], "t double, a double")
    assert [r.x for r in conf.select(Z.blended_confidence(F.col("t"), F.col("a")).alias("x")).collect()] == ["high", "good", "low", "none"]


TRACK = "track_id long, collection_id long, collection_name string, artist_name string, collection_artist_name string, artist_id long, track_count int, primary_genre_name string"


def test_persisting(spark, tmp_path):
    albums = spark.createDataFrame([(1, "Old", "A", "EP")], "collection_id long, collection_name string, artist_name string, collection_type string")
    tracks = spark.createDataFrame([(1, 1, "Old", "A", None, 5, 3, "Pop"), (2, 9, "Other", "B", None, 6, 1, "Pop")], TRACK)
    best = spark.createDataFrame([("track", 1, 1, "New", "A", "", 5, 3, "Rock"), ("track", 3, 4, "Fresh", "C", "D", 7, 2, "Jazz"), ("track", None, 5, "No id", "x", "", 1, 1, ""), ("collection", 8, 8, "No track", "x", "", 1, 1, ""), ("track", 6, 0, "No album", "x", "", 1, 1, "")], "wrapper_type string, " + TRACK)
    once = K.persisted(albums, tracks, best)
    assert sorted((r.collection_id, r.collection_name, r.artist_name) for r in once[0].collect()) == [(1, "New", "A"), (4, "Fresh", "D")]
    assert sorted((r.track_id, r.primary_genre_name) for r in once[1].collect()) == [(1, "Rock"), (2, "Pop"), (3, "Jazz"), (6, "")]
    again = K.persisted(*once, best)
    assert all(sorted(map(str, a.collect())) == sorted(map(str, b.collect())) for a, b in zip(once, again))
    assert K.persisted(albums, tracks, best, read_only=True) == (albums, tracks)

    path = str(tmp_path / "catalog")
    albums.write.parquet(f"{path}/albums/version=000")
    tracks.write.parquet(f"{path}/tracks/version=000")
    K.save_best(spark, path, best, "001", read_only=True)
    assert not (tmp_path / "catalog/albums/version=001").exists()
    K.save_best(spark, path, best, "001")
    wanted = sorted(map(str, once[1].collect()))
    assert sorted(map(str, spark.read.parquet(f"{path}/tracks/version=001").collect())) == wanted
    stamp = (tmp_path / "catalog/albums/version=001/_SUCCESS").stat().st_mtime_ns
    (tmp_path / "catalog/tracks/version=001/_SUCCESS").unlink()  # as if the run had been lost after the albums
    K.save_best(spark, path, best, "001")
    K.save_best(spark, path, best, "001")
    assert sorted(map(str, spark.read.parquet(f"{path}/tracks/version=001").collect())) == wanted and (tmp_path / "catalog/albums/version=001/_SUCCESS").stat().st_mtime_ns == stamp


def test_upsert_of_null_keys(spark):
    base = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "x", 1), (1, "c", 1)], "k int, v string, o int")
    once = K.upsert(base, new, "k", "o")
    assert sorted((r.k or 0, r.v) for r in once.collect()) == [(0, "a"), (1, "c")] == sorted((r.k or 0, r.v) for r in K.upsert(once, new, "k", "o").collect())


def test_nested_rewriting(spark):
    schema = "k int, releases array<struct<title:string,media:array<struct<title:string,tracks:array<struct<title:string,n:int>>>>>>"
    rows = [(1, [("r", [("m", [("t", 1), (None, 2)]), (None, None)]), None, ("s", [])]), (2, None)]
    df = spark.createDataFrame(rows, schema)
    out = N.rewrite_leaves(df, {"releases.title": F.upper, "releases.media.title": lambda c: F.concat(c, F.lit("!")), "releases.media.tracks.title": F.upper, "releases.media.tracks.n": lambda c: c * 10})
    assert out.schema.simpleString() == df.schema.simpleString()
    got = {r.k: r.asDict(True)["releases"] for r in out.collect()}
    assert got[2] is None and got[1] == [{"title": "R", "media": [{"title": "m!", "tracks": [{"title": "T", "n": 10}, {"title": None, "n": 20}]}, {"title": None, "tracks": None}]}, None, {"title": "S", "media": []}]
    for path in ("releases.none", "other", "k.x"):
        with pytest.raises(ValueError):
            N.rewrite_leaves(df, {path: F.upper})


def test_penalties(spark):
    c = F.col
    df = spark.createDataFrame([(1, 0.5, None, 3, 1), (2, 2.0, -1.0, 1, 1)], "k int, a double, b double, x int, y int")
    own = P.with_penalty(P.penalties(a=c("a"), b=c("b")), "n", P.number_penalty(c("x"), c("y")))
    rows = df.select("k", own.alias("own"))
    assert {r.k: r.own for r in rows.collect()} == {1: {"a": [0.5], "n": [1.0, 1.0]}, 2: {"a": [1.0], "b": [0.0], "n": [0.0]}}
    weights = {"a": 2.0, "n": 1.0}
    got = {r.k: (round(r.d, 6), [(x.name, round(x.share, 6)) for x in r.c]) for r in rows.select("k", P.distance(c("own"), weights).alias("d"), P.contributions(c("own"), weights).alias("c")).collect()}
    assert got == {1: (0.75, [("n", 0.5), ("a", 0.25)]), 2: (0.5, [("a", 0.5), ("b", 0.0), ("n", 0.0)])}
    both = rows.select("k", P.combined(c("own"), P.penalties(a=F.lit(0.1), z=F.lit(1.0))).alias("own"))
    assert both.filter("k = 1").first().own == {"a": [0.5, 0.1], "n": [1.0, 1.0], "z": [1.0]}
    assert [(r["rank"], r.name) for r in P.breakdown(both, "k", "own", weights).filter("k = 1").orderBy("rank").collect()] == [(1, "n"), (2, "a"), (3, "z")]
    none = spark.range(1).select(P.distance(P.penalties(a=F.lit(None)), weights).alias("d")).first().d
    assert none == 0


def test_status(spark):
    rows = [(1, 1, "download", "a", ""), (1, 2, "finalize", "no", ""), (1, 3, "tag", "a", ""), (1, 4, "finalize", "b", ""), (1, 5, "fail", "", "late"), (2, 1, "fail", "", "broken"), (2, 2, "tag", "x", ""), (2, 3, "download", "y", ""), (2, 4, "?", "z", ""), (3, 1, None, "q", None)]
    df = spark.createDataFrame(rows, "k int, n int, e string, p string, why string")
    got = {r.k: tuple(r)[1:] for r in H.folded_status(df, "k", ["n"], F.col("e"), F.col("p"), F.col("why")).collect()}
    assert got == {1: ("done", "b", "b", None, ["a"], 2), 2: ("downloading", "y", None, "broken", [], 2), 3: ("downloading", None, None, None, [], 1)}


def test_settings(spark):
    from trackweave.functions.settings import Settings

    assert Settings.load(spark) == Settings()
    names = {"trackweave.prefer_album": "Yes", "trackweave.threshold": "0.75", "trackweave.fallback_countries": " IT, ,FR,", "trackweave.candidates": "10", "trackweave.country": "DE"}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert Settings.load(spark) == Settings("DE", ("IT", "FR"), 0.75, True, True, 10)
        spark.conf.set("trackweave.candidates", "many")
        with pytest.raises(ValueError):
            Settings.load(spark)
    finally:
        for k in names:
            spark.conf.unset(k)
