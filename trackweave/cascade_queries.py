"""Queries of the provider cascade and its rules over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similarity_sql as Q
from .functions import distance as D
from .functions import text as T
from .operators import hints as I
from .operators import providers as O
from .operators import resolver as Z
from .operators import scoring as S
from .plans import resolve as R
from .queries import _CREDIT_SQL, _credit, query, table


def _choice(k: Column, options: dict[int, str], by: int, other: str = "") -> Column:
    out = F.lit(other)
    for n, text in options.items():
        out = F.when(k % by == n, text).otherwise(out)
    return out


def _records(spark, sf_dir) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Records of customers, and what six providers found for some of them."""
    k = F.col("input_pos")
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_pos"))
    title = F.when(k % 4 == 0, "song (Remix)").otherwise("song")
    records = own.select(
        "input_pos", title.alias("title"), F.lit("artist").alias("artist"), F.when(k % 6 == 0, "album deluxe").otherwise("album").alias("album"), F.lit("artist").alias("album_artist"), F.when(k % 5 != 0, "2001").otherwise("").alias("year"), F.lit("").alias("genre"),
        F.lit("").alias("label"), F.lit("").alias("country"), F.lit("").alias("artist_collection"), F.when(k % 2 == 0, "us1").otherwise("").alias("isrc"), F.lit("").alias("cover_url"), F.lit("").alias("upc"), F.lit("").alias("sort_title"),
        F.when(k % 7 == 0, 3).otherwise(0).alias("track_number"), F.lit(0).alias("disc_number"), F.when(k % 3 != 0, 200_000).alias("duration_ms"), F.lit(False).alias("explicit"), F.lit(False).alias("compilation"), title.alias("raw_title"), F.lit("1999").alias("raw_year"),
    )
    some = lambda condition, **fields: own.filter(condition).select("input_pos", *[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in fields.items()])
    results = {
        R.LOCAL: some(k % 11 == 0, title="local song", artist="local artist", album="local album", track_number=F.when(k % 22 == 0, 0).otherwise(9), year="2005", cover_url="lc"),
        R.OPTIONAL: some(k % 3 == 0, title="optional song", artist="optional artist", artist_collection="A; B", isrc="op", year="2010"),
        R.RECORDING: some(k % 2 == 0, title=F.when(k % 8 == 0, "song (Remix)").otherwise("song"), artist="artist", album="rec album", confidence=_choice(k, {0: "isrc", 1: "high", 2: "good", 3: "low"}, 5, "none"), isrc="us1", track_number=5, disc_number=1, cover_url="rc",
                          genre="rg", year="1998", alternative=k % 12 == 0, edition=F.when(k % 10 == 0, "single").otherwise("album"), first_date=F.when(k % 4 == 2, "1997-01-01"), release_date="2020"),
        R.BY_CODE: some(k % 5 < 2, title=F.when(k % 8 == 0, "song (Live)").otherwise("song"), cover_url="bc", genre="bg", year="1996", track_number=6, disc_number=2, explicit=True, artist_collection="C & D"),
        R.CATALOG: some(k % 7 < 5, title=_choice(k, {0: "song (feat. Guest)", 1: "melody"}, 9, "song"), artist=F.when(k % 13 == 0, "other people").otherwise("artist"), album=F.when(k % 5 == 2, "cat album (remix)").otherwise("cat album"), track_number=7, disc_number=3, year="2015",
                        duration_ms=F.when(k % 2 == 0, 203_000).otherwise(300_000), isrc=F.when(k % 3 == 0, "US1").otherwise(""), by_isrc=k % 6 == 0, edition="album", cover_url="http://mzstatic.com/image/x", explicit=k % 2 == 1, label="lab"),
        R.FALLBACK: some(k % 4 < 2, title="fb", artist="fb artist", cover_url="fc", genre="fg", track_number=8, disc_number=4, year="2012"),
    }
    return records, results


_SQL_FIELDS = ("title", "artist", "album", "year", "genre", "label", "artist_collection", "isrc", "cover_url", "sort_title", "track_number", "disc_number", "explicit")
_EMPTY = {"track_number": "0", "disc_number": "0", "explicit": "false"}


def _put(provider: str, found: dict[str, str], when: str, overwrite: dict[str, str], before: str) -> str:
    """A stage in SQL: fields of ``found`` put into the rows of ``before`` where the provider found something."""
    out = []
    for name in _SQL_FIELDS:
        if name not in found:
            out.append(name)
            continue
        none = _EMPTY.get(name, "''")
        new, old = f"nullif(CASE WHEN {provider} AND ({when}) THEN {found[name]} END, {none})", f"nullif({name}, {none})"
        rule = overwrite.get(name, "false")
        out.append(f"CASE WHEN {rule} THEN coalesce({new}, {old}) ELSE coalesce({old}, {new}) END AS {name}")
    return f"SELECT k, {', '.join(out)}, local, optional, recording, code, catalog, fallback, sure, consistent, richer FROM {before}"


_OPTIONAL = {"title": "'optional song'", "artist": "'optional artist'", "artist_collection": "'A; B'", "isrc": "'op'", "year": "'2010'"}
_RECORDING = {"title": "CASE WHEN k % 8 = 0 THEN 'song (Remix)' ELSE 'song' END", "artist": "'artist'", "album": "'rec album'", "isrc": "'us1'", "track_number": "5", "disc_number": "1", "cover_url": "'rc'", "genre": "'rg'", "year": "'1998'"}
_CODE = {"title": "CASE WHEN k % 8 = 0 THEN 'song (Live)' ELSE 'song' END", "cover_url": "'bc'", "genre": "'bg'", "year": "'1996'", "track_number": "6", "disc_number": "2", "explicit": "true", "artist_collection": "'C & D'"}
_CATALOG = {
    "title": "CASE k % 9 WHEN 0 THEN 'song (feat. Guest)' WHEN 1 THEN 'melody' ELSE 'song' END", "artist": "CASE WHEN k % 13 = 0 THEN 'other people' ELSE 'artist' END", "album": "CASE WHEN k % 5 = 2 THEN 'cat album (remix)' ELSE 'cat album' END", "track_number": "7",
    "disc_number": "3", "year": "'2015'", "isrc": "CASE WHEN k % 3 = 0 THEN 'US1' ELSE '' END", "cover_url": "'http://mzstatic.com/image/x'", "explicit": "k % 2 = 1", "label": "'lab'",
}
_FALLBACK = {"title": "'fb'", "artist": "'fb artist'", "cover_url": "'fc'", "genre": "'fg'", "track_number": "8", "disc_number": "4", "year": "'2012'"}
_LOCAL = {"title": "'local song'", "artist": "'local artist'", "album": "'local album'", "track_number": "CASE WHEN k % 22 = 0 THEN 0 ELSE 9 END", "year": "'2005'", "cover_url": "'lc'"}
_NUMBERS_BY_CODE = "k % 4 <> 0 OR k % 8 = 0"

_CASCADE_SQL = f"""WITH RECURSIVE own AS (SELECT c_custkey AS k FROM customer), names(a, b) AS (VALUES ('song (remix)', 'song'), ('song (remix)', 'melody'), ('song', 'song'), ('song', 'melody'), ('artist', 'artist'), ('artist', 'other people')),
  {Q.likeness("SELECT a, b FROM names")},
  flags AS (SELECT k, k % 11 = 0 AS local, k % 3 = 0 AS optional, k % 2 = 0 AS recording, k % 5 < 2 AS code, k % 7 < 5 AS catalog, k % 4 < 2 AS fallback, CASE WHEN k % 8 = 0 THEN 'song (remix)' ELSE 'song' END AS t0, CASE WHEN k % 9 = 1 THEN 'melody' ELSE 'song' END AS t1,
                   CASE WHEN k % 13 = 0 THEN 'other people' ELSE 'artist' END AS a1 FROM own),
  judged AS (SELECT f.*, recording AND k % 5 < 3 AND (k % 4 <> 0 OR k % 8 = 0) AS sure,
                    catalog AND (k % 4 <> 0 OR k % 5 = 2) AND (NOT (recording AND k % 5 < 3) OR k % 3 = 0 OR k % 2 = 0)
                    AND (NOT (recording AND k % 5 = 0) OR k % 6 = 0 OR (t.sim >= 0.75 AND a.sim >= 0.6)) AND (NOT recording OR k % 3 <> 0 OR k % 10 <> 0) AS consistent,
                    catalog AND k % 9 = 0 AS richer
             FROM flags f JOIN likeness t ON t.a = t0 AND t.b = t1 JOIN likeness a ON a.a = 'artist' AND a.b = a1),
  s0 AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'song (Remix)' ELSE 'song' END AS title, 'artist' AS artist, CASE WHEN k % 6 = 0 THEN 'album deluxe' ELSE 'album' END AS album, CASE WHEN k % 5 <> 0 THEN '2001' ELSE '' END AS year, '' AS genre, '' AS label, '' AS artist_collection,
                CASE WHEN k % 2 = 0 THEN 'us1' ELSE '' END AS isrc, '' AS cover_url, '' AS sort_title, CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END AS track_number, 0 AS disc_number, false AS explicit FROM judged),
  s1 AS ({_put("local", _LOCAL, "true", dict.fromkeys(_LOCAL, "true"), "s0")}),
  s2 AS (SELECT * REPLACE (CASE WHEN local AND k % 22 = 0 AND sure THEN 5 ELSE track_number END AS track_number, CASE WHEN local AND sure THEN 1 ELSE disc_number END AS disc_number) FROM s1),
  s3 AS ({_put("optional", _OPTIONAL, "NOT local", {"artist": "true", "artist_collection": "true"}, "s2")}),
  s4 AS ({_put("recording", _RECORDING, "NOT local", {"cover_url": "true", "genre": "true", "year": "k % 12 <> 0"}, "s3")}),
  s5 AS ({_put("code", _CODE, "NOT local", {"cover_url": "true", "explicit": "true", "genre": "true", "year": "true", "track_number": _NUMBERS_BY_CODE, "disc_number": _NUMBERS_BY_CODE}, "s4")}),
  s6 AS ({_put("catalog", _CATALOG, "NOT local", {"cover_url": "true", "explicit": "true", "title": "richer", "track_number": "consistent AND NOT sure", "disc_number": "consistent AND NOT sure"}, "s5")}),
  s7 AS (SELECT * REPLACE (CASE WHEN NOT local AND catalog AND sure THEN 5 ELSE track_number END AS track_number, CASE WHEN NOT local AND catalog AND sure THEN 1 ELSE disc_number END AS disc_number, CASE WHEN NOT local AND richer THEN title ELSE sort_title END AS sort_title) FROM s6),
  s8 AS ({_put("optional", _OPTIONAL, "NOT local AND NOT catalog AND NOT code", {}, "s7")}),
  s9 AS ({_put("recording", _RECORDING, "NOT local AND NOT catalog AND NOT code AND NOT optional", {}, "s8")}),
  s10 AS ({_put("fallback", _FALLBACK, "NOT local AND NOT catalog AND NOT recording AND NOT code", {}, "s9")}),
  s11 AS (SELECT * REPLACE (CASE WHEN NOT local AND fallback AND NOT contains(coalesce(cover_url, ''), 'mzstatic.com/image') THEN 'fc' ELSE cover_url END AS cover_url,
                            coalesce(nullif(track_number, 0), CASE WHEN NOT local AND fallback THEN 8 END) AS track_number, coalesce(nullif(disc_number, 0), CASE WHEN NOT local AND fallback THEN 4 END) AS disc_number, coalesce(nullif(genre, ''), CASE WHEN NOT local AND fallback THEN 'fg' END) AS genre) FROM s10),
  s12 AS (SELECT * REPLACE (coalesce(CASE WHEN NOT local AND catalog AND recording THEN CASE WHEN k % 4 = 2 AND 1997 < coalesce(CAST(nullif(year, '') AS INTEGER), 9999) THEN '1997' WHEN nullif(year, '') IS NULL THEN '2020' ELSE year END ELSE nullif(year, '') END, CASE WHEN NOT local THEN '1999' END) AS year) FROM s11)
  SELECT k AS input_pos, coalesce(title, '') AS title, coalesce(artist, '') AS artist, coalesce(album, '') AS album, coalesce(year, '') AS year, coalesce(genre, '') AS genre, coalesce(label, '') AS label, coalesce(isrc, '') AS isrc, coalesce(cover_url, '') AS cover_url,
         coalesce(sort_title, '') AS sort_title, CAST(coalesce(track_number, 0) AS INTEGER) AS track_number, CAST(coalesce(disc_number, 0) AS INTEGER) AS disc_number, coalesce(explicit, false) AS explicit,
         CASE WHEN optional THEN 'A, B' WHEN code AND NOT local THEN 'C, D' ELSE coalesce(nullif(artist_collection, ''), artist) END AS artist_collection,
         CASE WHEN local THEN 'local' WHEN catalog THEN 'catalog' WHEN optional AND NOT code THEN 'optional' WHEN code THEN 'by_code' WHEN recording THEN 'recording' WHEN fallback THEN 'fallback' ELSE 'none' END AS source FROM s12"""


@query(_CASCADE_SQL)
def resolved_records(spark, sf_dir):
    """The whole cascade of providers over records that hit them in all combinations."""
    records, results = _records(spark, sf_dir)
    out = R.resolved(records, results)
    return out.select("input_pos", *_SQL_FIELDS, "source")


@query("""SELECT c_custkey AS input_pos, CASE WHEN c_custkey % 4 = 0 THEN 'song (Remix)' ELSE 'song' END AS search_title, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 6 <> 0 THEN 'rec album' WHEN c_custkey % 6 = 0 THEN 'album deluxe' ELSE 'album' END AS search_album,
                 CASE WHEN c_custkey % 3 = 0 THEN 'op' WHEN c_custkey % 2 = 0 THEN 'us1' ELSE '' END AS search_isrc, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 3 THEN 0.7 ELSE 0.55 END::DOUBLE AS least_score FROM customer""")
def search_inputs(spark, sf_dir):
    """What the catalog is searched by after the earlier providers."""
    records, results = _records(spark, sf_dir)
    rows = R.gathered(records.withColumn("title_0", F.col("title")), results, "input_pos")
    return R.search_inputs(rows).select("input_pos", "search_title", "search_album", "search_isrc", "least_score")


def _neighbours(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    own = part.select(F.col("p_partkey").alias("k"), T.normalize(F.col("p_name")).alias("a"), T.normalize(F.col("p_type")).alias("x"))
    return own.join(part.select((F.col("p_partkey") - 3).alias("k"), T.normalize(F.col("p_name")).alias("b"), T.normalize(F.col("p_type")).alias("y")), "k")


_NEIGHBOURS = "neighbours AS (SELECT p.p_partkey AS k, p.p_name AS a, q.p_name AS b, lower(p.p_type) AS x, lower(q.p_type) AS y FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 3)"


@query(f"""WITH RECURSIVE {_NEIGHBOURS}, {Q.likeness("SELECT a, b FROM neighbours UNION SELECT x, y FROM neighbours")},
  blend AS (SELECT k, x, t.sim AS t, s.sim AS s, round(0.6 * t.sim + 0.4 * s.sim, 12) AS c FROM neighbours n JOIN likeness t ON t.a = n.a AND t.b = n.b JOIN likeness s ON s.a = x AND s.b = y)
  SELECT k, CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.75 THEN 'good' WHEN c >= 0.55 THEN 'low' ELSE 'none' END AS confidence, t >= 0.75 AND (x = 'small' OR s >= 0.6) AS agree FROM blend""")
def blended_confidences(spark, sf_dir):
    """Confidence and agreement of pairs, from similarities of names and types."""
    known = S.distances(_neighbours(spark, sf_dir), {"t": ("a", "b"), "s": ("x", "y")}, D.title_similarity)
    return known.select("k", Z.blended_confidence(F.col("t"), F.col("s")).alias("confidence"), Z.names_agree(F.col("t"), F.col("x") != "small", F.col("s")).alias("agree"))


@query("""WITH c AS (SELECT s_nationkey AS k, s_suppkey, 0.8 + (s_suppkey % 20) / 100.0 AS sim, n_name FROM supplier JOIN nation ON n_nationkey = s_suppkey % 25)
  SELECT k, n_name AS country FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY sim DESC, s_suppkey) = 1) WHERE sim >= 0.85""")
def artist_countries(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", (0.8 + (F.col("s_suppkey") % 20) / 100.0).alias("sim"), (F.col("s_suppkey") % 25).alias("n")).join(nation, "n")
    return Z.artist_country(rows, "k", "sim", "s_suppkey", "n_name")


_LISTED = r"trim(regexp_replace({}, '\s*(?:feat\.?|ft\.?|with|&|\+|and|;)\s*', ', ', 'gi'), ', ')"


@query(rf"""WITH c AS (SELECT c_custkey, c_name, {_CREDIT_SQL} AS credit, CASE c_custkey % 3 WHEN 0 THEN 'Song (feat. Guest)' WHEN 1 THEN 'Song (ft. ' || c_name || ')' ELSE 'Song' END AS title, CASE WHEN c_custkey % 7 = 0 THEN 'X & Y; Z' ELSE '' END AS trusted, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE '' END AS own FROM customer)
  SELECT c_custkey, CASE WHEN trusted <> '' THEN 'X, Y, Z' WHEN c_custkey % 5 IN (0, 1, 2) THEN {_LISTED.format("credit")} WHEN c_custkey % 3 = 0 THEN {_LISTED.format("coalesce(nullif(own, ''), c_name) || ', Guest'")} WHEN c_custkey % 3 = 1 THEN own
         ELSE coalesce(nullif(own, ''), c_name) END AS artists FROM c""")
def artist_collections(spark, sf_dir):
    """Artist lists by trust: a trusted list, several names, the guest of the title, the artist."""
    k = F.col("c_custkey")
    title = F.when(k % 3 == 0, "Song (feat. Guest)").when(k % 3 == 1, F.concat(F.lit("Song (ft. "), "c_name", F.lit(")"))).otherwise("Song")
    credit = F.when(k % 5 == 3, F.col("c_name")).otherwise(_credit())
    out = Z.artist_collection(F.when(k % 2 == 0, "own").otherwise(""), F.col("c_name"), title, credit, [F.lit(""), F.when(k % 7 == 0, "X & Y; Z")])
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("artists"))


@query(r"""WITH p AS (SELECT *, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (Remix)' WHEN 1 THEN ' (Deluxe)' WHEN 2 THEN ' feat. Some Guest, Other' ELSE '' END AS title FROM part),
  terms AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN p_name || ' feat. Some Guest, Other' ELSE p_name END AS core, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS album FROM p)
  SELECT p_partkey, concat_ws(' AND ', 'recording:"' || core || '"', 'artist:' || p_brand, CASE WHEN p_partkey % 4 = 2 THEN 'artist:"Some Guest"' END, CASE WHEN album <> '' THEN 'release:' || album END) AS query,
         concat_ws(' AND ', 'recording:"' || core || CASE p_partkey % 4 WHEN 0 THEN ' Remix' WHEN 1 THEN ' Deluxe' ELSE '' END || '"', 'artist:' || p_brand, CASE WHEN p_partkey % 4 = 2 THEN 'artist:"Some Guest"' END, CASE WHEN album <> '' THEN 'release:' || album END) AS tagged,
         concat_ws(' ', 'track:"' || p_name || '"', 'artist:"' || replace(p_brand, '#', ' ') || '"', CASE WHEN album <> '' THEN 'album:"' || album || '"' END) AS fielded, concat_ws(' ', p_name, replace(p_brand, '#', ' ')) AS free FROM terms JOIN part USING (p_partkey, p_brand)""")
def built_queries(spark, sf_dir):
    """Queries for a recording search, with and without the version tag, and for a fielded and a free one."""
    k = F.col("p_partkey")
    title = F.concat("p_name", _choice(k, {0: " (Remix)", 1: " (Deluxe)", 2: " feat. Some Guest, Other"}, 4))
    album = F.when(k % 3 == 0, F.col("p_type")).otherwise("")
    own = Z.recording_query(title, F.col("p_brand"), album)
    tagged = Z.recording_query(title, F.col("p_brand"), album, with_tag=True)
    return table(spark, sf_dir, "part").select("p_partkey", own.alias("query"), tagged.alias("tagged"), Z.fielded_query(track=F.col("p_name"), artist=F.col("p_brand"), album=album).alias("fielded"), Z.free_query(F.col("p_name"), F.col("p_brand")).alias("free"))


@query(rf"""WITH RECURSIVE h AS (SELECT p_partkey AS k, lower(p_name) AS title, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' - EP' WHEN 2 THEN p_name || ' - Something' WHEN 3 THEN p_name || ' deluxe - Something' WHEN 4 THEN '' ELSE p_name || 's' END AS hint FROM part),
  cut AS (SELECT k, title, hint, CASE WHEN k % 6 = 2 THEN split_part(hint, ' - ', 1) ELSE hint END AS own FROM h),
  {Q.likeness("SELECT lower(own) AS a, title AS b FROM cut")}
  SELECT k, CASE WHEN hint = '' THEN '' WHEN lower(own) = title THEN CASE WHEN length(replace(title, ' ', '')) <= 20 THEN own ELSE '' END WHEN k % 6 = 1 THEN '' WHEN sim >= 0.92 AND NOT contains(own, 'deluxe') AND length(replace(own, ' ', '')) > 20 THEN '' ELSE own END AS hint
  FROM cut JOIN likeness ON a = lower(own) AND b = title""")
def usable_hints(spark, sf_dir):
    """Album hints without what a title adds, or none where they are the title."""
    k, name = F.col("p_partkey"), F.col("p_name")
    hint = F.when(k % 6 == 0, name).when(k % 6 == 1, F.concat(name, F.lit(" - EP"))).when(k % 6 == 2, F.concat(name, F.lit(" - Something"))).when(k % 6 == 3, F.concat(name, F.lit(" deluxe - Something"))).when(k % 6 == 5, F.concat(name, F.lit("s"))).otherwise("")
    return I.usable_hints(table(spark, sf_dir, "part").select(k.alias("k"), name.alias("title"), hint.alias("hint")), "hint", "title").select("k", "hint")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(CAST(l_quantity AS INTEGER) % 3, 0) AS track_number, nullif(CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END, '') AS genre, nullif(CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'us' || l_partkey END, '') AS isrc FROM lineitem""")
def copied_fields(spark, sf_dir):
    """A provider's fields, without empty texts and zeros."""
    line = table(spark, sf_dir, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")
    text = F.lit("x")
    rows = line.select(key, text.alias("title"), text.alias("album"), text.alias("cover_url"), F.lit(1).alias("duration_ms"), (F.col("l_quantity").cast("int") % 3).alias("track_number"), F.lit(0).alias("disc_number"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise("").alias("genre"), F.lit("").alias("year"), F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("us"), F.col("l_partkey").cast("string"))).otherwise("").alias("isrc"))
    return O.from_code_lookup(rows, "key").select("key.*", "track_number", "genre", "isrc")


@query("""WITH a AS (SELECT l_orderkey, string_agg(nullif(CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'artist ' || l_partkey END, ''), ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS names, string_agg(nullif(CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'artist ' || l_partkey END, ''), '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS listed,
                            first(CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'artist ' || l_partkey END ORDER BY l_linenumber, l_partkey, l_suppkey) AS first_name FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey, coalesce(names, '') AS artist, CASE WHEN o_custkey % 3 = 0 THEN 'owner' ELSE first_name END AS album_artist, coalesce(listed, '') AS artist_collection, strftime(o_orderdate, '%Y') AS year, CASE WHEN o_custkey % 2 = 0 THEN 'image' ELSE '' END AS cover_url FROM orders JOIN a ON l_orderkey = o_orderkey""")
def optional_provider(spark, sf_dir):
    """Nested tracks of the optional provider as canonical fields."""
    name = F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("artist "), F.col("l_partkey").cast("string"))).otherwise("")
    people = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", name.alias("name"))))
    artists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(people.alias("artists"))
    owner = F.when(F.col("o_custkey") % 3 == 0, F.array(F.struct(F.lit("owner").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    images = F.when(F.col("o_custkey") % 2 == 0, F.array(F.struct(F.lit("image").alias("url"))))
    album = F.struct(F.lit("album").alias("name"), owner.alias("artists"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), images.alias("images"), F.lit(9).alias("total_tracks"))
    rows = table(spark, sf_dir, "orders").join(artists, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select("o_orderkey", F.lit("song").alias("name"), "artists", album.alias("album"), F.struct(F.lit("us1").alias("isrc")).alias("external_ids"), F.lit(None).cast("int").alias("track_number"), F.lit(1).alias("disc_number"), F.lit(True).alias("explicit"), F.lit(1).alias("duration_ms"))
    return O.from_optional(rows, "o_orderkey").select("o_orderkey", "artist", "album_artist", "artist_collection", "year", "cover_url")


@query("""WITH r AS (SELECT l_orderkey, list({pos: l_linenumber, a: l_partkey, b: l_suppkey, title: 'album ' || l_returnflag, id: 'r' || l_partkey, country: CASE WHEN l_partkey % 3 = 0 THEN 'xw' WHEN l_partkey % 3 = 1 THEN ' gb ' ELSE 'IT' END, label: CASE WHEN l_partkey % 2 = 0 THEN 'label ' || l_suppkey ELSE '' END} ORDER BY l_linenumber, l_partkey, l_suppkey) AS releases FROM lineitem GROUP BY l_orderkey),
  o AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'album n' ELSE 'other' END AS album, CASE WHEN o_custkey % 4 = 0 THEN 'own' ELSE '' END AS own, releases FROM orders JOIN r ON l_orderkey = o_orderkey),
  p AS (SELECT o_orderkey, own, coalesce([x for x in releases if album <> '' AND (contains(lower(x.title), album) OR contains(album, lower(x.title)))][1], releases[1]) AS release FROM o)
  SELECT o_orderkey, coalesce(nullif(own, ''), release.id) AS mb_album_id, coalesce(nullif(own, ''), release.label) AS label, CASE WHEN upper(trim(release.country)) IN ('GB', 'IT') THEN upper(trim(release.country)) ELSE '' END AS country, 'code' AS isrc FROM p""")
def exclusive_fields(spark, sf_dir):
    """Fields filled from the release of a nested recording that fits the album."""
    credit = F.array().cast("array<struct<name:string,artist:struct<id:string>>>")

    def release(x: Column) -> Column:
        p = x["l_partkey"]
        label = F.when(p % 2 == 0, F.concat(F.lit("label "), x["l_suppkey"].cast("string"))).otherwise("")
        return F.struct(
            F.concat(F.lit("r"), p.cast("string")).alias("id"), F.concat(F.lit("album "), x["l_returnflag"]).alias("title"), F.when(p % 3 == 0, "xw").when(p % 3 == 1, " gb ").otherwise("IT").alias("country"), F.struct(F.lit("g").alias("id")).alias("release-group"),
            F.array(F.struct(F.struct(label.alias("name")).alias("label"))).alias("label-info"), credit.alias("artist-credit"),
        )

    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines")).select("l_orderkey", F.transform("lines", release).alias("releases"))
    c = F.col("o_custkey")
    own = F.when(c % 4 == 0, "own").otherwise("")
    recording = F.struct(F.lit("id").alias("id"), F.array(F.lit("code")).alias("isrcs"), credit.alias("artist-credit"), "releases")
    rows = table(spark, sf_dir, "orders").join(docs, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.when(c % 3 == 0, "").when(c % 3 == 1, "album n").otherwise("other").alias("album"), own.alias("mb_album_id"), own.alias("label"), recording.alias("recording"), *[F.lit("").alias(n) for n in ("isrc", "mb_track_id", "mb_release_group_id", "mb_artist_id", "mb_album_artist_id", "country")])
    return O.exclusive_fields(rows).select("o_orderkey", "mb_album_id", "label", "country", "isrc")
