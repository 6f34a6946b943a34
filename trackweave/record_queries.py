"""Queries of sources, records, settings and text rules over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import similarity_sql as Q
from .functions import distance as D
from .functions import edition as E
from .functions import settings as C
from .functions import text as T
from .functions.schemas import RAW, RECORDING, struct_of
from .operators import mappers as M
from .operators import releases as L
from .operators import scoring as S
from .operators import store as K
from .queries import query, table
from .sources import catalog as R
from .storage import new_folder


@query("""WITH l AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '   ' || p_name || ' ' WHEN 2 THEN '   ' WHEN 3 THEN ' #' || p_name ELSE p_name END AS line FROM part)
          SELECT trim(line) AS line, count(*) AS n FROM l WHERE NOT starts_with(line, '#') AND trim(line) <> '' GROUP BY 1""")
def line_source(spark, sf_dir):
    """Lines of text files without comments."""
    k, path = F.col("p_partkey") % 5, new_folder(spark, "lines")
    line = F.when(k == 0, F.concat(F.lit("# "), "p_name")).when(k == 1, F.concat(F.lit("   "), "p_name", F.lit(" "))).when(k == 2, "   ").when(k == 3, F.concat(F.lit(" #"), "p_name")).otherwise(F.col("p_name"))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return R.read_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS e FROM lineitem GROUP BY l_orderkey)
          SELECT o_orderkey, CAST(pos - 1 AS INTEGER) AS entry_pos, e[pos] AS entry FROM orders JOIN l ON l_orderkey = o_orderkey, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS pos)
          UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def playlist_entries(spark, sf_dir):
    """Entries of lists; a list without entries stays as one row."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"]).alias("parts"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "parts")
    return R.entries(orders, "parts")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'remote ' || c_custkey END AS name FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 <> 0")
def read_through(spark, sf_dir):
    """Local rows, and remote ones for keys that are not known locally."""
    customer = table(spark, sf_dir, "customer")
    local = customer.filter("c_custkey % 3 = 0").select("c_custkey", F.col("c_name").alias("name"))
    remote = customer.filter("c_custkey % 4 <> 0").select("c_custkey", F.concat(F.lit("remote "), F.col("c_custkey").cast("string")).alias("name"))
    return R.read_through(local, remote, "c_custkey")


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS rank FROM orders), b AS (SELECT *, min(rank) OVER (PARTITION BY k) AS best FROM r)
          SELECT k, o_orderkey, rank AS source FROM b WHERE rank = best""")
def country_fallback(spark, sf_dir):
    """All rows of the first of several sources that has any for a key."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", rank.alias("source"))
    return R.first_source(orders, "k", F.col("source"), ["o_orderkey"])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1, 2, 3""")
def json_lists(spark, sf_dir):
    """Rows of JSON lists under either of two keys; texts that are no JSON give none."""
    items = F.to_json(F.collect_list(F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))))
    k = F.col("l_orderkey")
    body = F.when(k % 5 == 0, F.concat(F.lit("no json "), "items")).when(k % 2 == 0, F.concat(F.lit('{"data":'), "items", F.lit("}"))).otherwise(F.concat(F.lit('{"results":'), "items", F.lit("}")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("items")).select("l_orderkey", body.alias("body"))
    return R.json_list(rows, "body", "p:bigint,s:bigint").groupBy("l_orderkey", F.col("item.p").alias("l_partkey"), F.col("item.s").alias("l_suppkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULLIF('http://b/' || page_id, CASE WHEN page_id % 2 = 0 THEN 'http://b/' || page_id END) WHEN page_id % 3 = 1 THEN 'http://a/' || page_id ELSE NULL END AS cover FROM pages")
def cover_cascade(spark, sf_dir):
    """The first address that is there and not of a host to skip."""
    k = F.col("page_id")
    at = lambda host: F.concat(F.lit(f"http://{host}/"), k.cast("string"))
    cover = M.first_cover(F.when(k % 3 == 1, at("a")).when(k % 3 == 0, ""), F.when(k % 3 == 0, F.when(k % 2 == 0, at("skipped")).otherwise(at("b"))), skip="skipped")
    return table(spark, sf_dir, "pages").select("page_id", cover.alias("cover"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_name ELSE 'raw ' || p_name END AS rename_title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'raw ' || p_brand END AS rename_artist FROM part")
def rename_names(spark, sf_dir):
    """Names for files: the raw ones where nothing matched."""
    raw = lambda c: F.concat(F.lit("raw "), c)
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("matched"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.when(F.col("p_size") % 3 == 0, "").otherwise(raw("p_name")).alias("raw_title"), raw("p_brand").alias("raw_artist"))
    return M.rename_names(rows).select("p_partkey", "rename_title", "rename_artist")


@query("SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'album' ELSE 'track' END AS kind, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS keys FROM lineitem WHERE l_linenumber % 3 < 2 GROUP BY 1")
def split_lookup(spark, sf_dir):
    """Mixed results as albums and tracks; others are left out."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "collection").when(F.col("l_linenumber") % 3 == 1, "track").otherwise("artist")
    albums, tracks = M.split_lookup(table(spark, sf_dir, "lineitem").withColumn("wrapper_type", kind))
    both = albums.withColumn("kind", F.lit("album")).unionByName(tracks.withColumn("kind", F.lit("track")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("keys"))


@query(f"""WITH RECURSIVE neighbours AS (SELECT p.p_partkey AS k, p.p_name AS a, q.p_name AS b, lower(p.p_type) AS x, lower(q.p_type) AS y, abs(p.p_size - q.p_size) * 1000 AS ms FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 7),
  {Q.likeness("SELECT a, b FROM neighbours UNION SELECT x, y FROM neighbours")}
  SELECT k, round(CASE WHEN t.sim >= 0.55 AND s.sim >= 0.5 THEN 0.6 * t.sim + 0.4 * s.sim + CASE WHEN ms <= 5000 THEN 0.05 ELSE 0 END END, 6) AS score FROM neighbours n JOIN likeness t ON t.a = n.a AND t.b = n.b JOIN likeness s ON s.a = x AND s.b = y""")
def recording_scores(spark, sf_dir):
    """Scores of recordings by title, artist and duration."""
    part = table(spark, sf_dir, "part")
    own = part.select(F.col("p_partkey").alias("k"), T.normalize(F.col("p_name")).alias("a"), T.normalize(F.col("p_type")).alias("x"), F.col("p_size").alias("n"))
    pairs = own.join(part.select((F.col("p_partkey") - 7).alias("k"), T.normalize(F.col("p_name")).alias("b"), T.normalize(F.col("p_type")).alias("y"), F.col("p_size").alias("m")), "k")
    known = S.distances(pairs, {"t": ("a", "b"), "s": ("x", "y")}, D.title_similarity)
    return known.select("k", F.round(S.recording_score(F.col("t"), F.col("s"), (F.col("n") - F.col("m")) * 1000), 6).alias("score"))


@query("""WITH e AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'compilation' WHEN 1 THEN 'ep' ELSE CASE WHEN p_size % 5 > 2 THEN 'album' WHEN p_size % 5 > 0 AND p_size % 2 = 0 THEN 'single' ELSE 'unknown' END END AS kind, p_size % 5 AS n, p_partkey % 4 < 2 OR p_size % 2 = 0 OR p_size % 5 > 0 AS sure FROM part)
          SELECT p_partkey, kind || ' (' || n || ' tracks, ' || CASE WHEN sure THEN 'verified' ELSE 'unverified' END || ')' AS edition FROM e""")
def edition_descriptions(spark, sf_dir):
    k = F.col("p_partkey") % 4
    edition = E.release_edition(F.when(k == 0, "Compilation").when(k == 1, "EP").otherwise(""), F.col("p_name"), F.col("p_size") % 5, F.col("p_size") % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", E.described(edition).alias("edition"))


@query(r"""WITH t AS (SELECT p_partkey AS k, p_name || CASE p_partkey % 6 WHEN 0 THEN ' - Single' WHEN 1 THEN ' (Live) [HD]' WHEN 2 THEN ' - Remix' WHEN 3 THEN ' – EP' WHEN 4 THEN '®™ Ønö' ELSE '' END AS name, p_name, string_split(p_name, ' ')[1] AS word FROM part)
  SELECT k, replace(p_name, ' ', '') || CASE k % 6 WHEN 0 THEN 'single' WHEN 1 THEN 'livehd' WHEN 2 THEN 'remix' WHEN 3 THEN 'ep' WHEN 4 THEN 'ono' ELSE '' END AS letters, trim(regexp_replace(name, '[\(\[][^\)\]]*[\)\]]', '', 'g')) AS bare, CASE WHEN k % 6 = 0 THEN p_name ELSE name END AS album,
         CASE WHEN k % 6 IN (0, 2) THEN p_name ELSE name END AS base, regexp_matches(name, '\b' || word || '\b') AS whole, contains(lower(name), 'remix') AS remix,
         round(CASE WHEN k % 6 IN (0, 2, 3, 4) THEN 1 - length(replace(p_name, ' ', '')) / length(replace(p_name, ' ', '') || CASE k % 6 WHEN 0 THEN 'single' WHEN 2 THEN 'remix' WHEN 3 THEN 'ep' ELSE 'ono' END) ELSE 0 END, 6) AS cut FROM t""")
def text_forms(spark, sf_dir):
    """Letters, names without brackets and suffixes, whole words, remixes, and how much of a title a name lacks."""
    k = F.col("p_partkey")
    ending = F.when(k % 6 == 0, " - Single").when(k % 6 == 1, " (Live) [HD]").when(k % 6 == 2, " - Remix").when(k % 6 == 3, " – EP").when(k % 6 == 4, "®™ Ønö").otherwise("")
    rows = table(spark, sf_dir, "part").select(k.alias("k"), F.concat("p_name", ending).alias("name"), "p_name")
    name = F.col("name")
    return rows.select("k", T.alnum(name).alias("letters"), T.without_brackets(name).alias("bare"), T.without_single(name).alias("album"), T.without_album_suffix(name).alias("base"), T.contains_word(name, F.substring_index("p_name", " ", 1)).alias("whole"), T.is_remix(name).alias("remix"), F.round(T.truncation(name, F.col("p_name")), 6).alias("cut"))


@query("""WITH s AS (SELECT c_custkey AS k, c_name FROM customer)
  SELECT k, CASE WHEN k % 4 = 3 THEN 'Song (Live)' ELSE 'Song' END AS title, CASE k % 4 WHEN 2 THEN 'Label Records' ELSE c_name END AS artist, CASE WHEN k % 3 = 0 THEN 'Listed Album' WHEN k % 3 = 1 THEN 'Own Album' ELSE '' END AS album, CASE WHEN k % 5 = 0 THEN '1999' WHEN k % 5 = 1 THEN '2020' ELSE '' END AS year,
         CASE WHEN k % 2 = 0 THEN CAST(k * 500 AS INTEGER) END AS duration_ms FROM s WHERE k > 0 AND k % 4 <> 2
  UNION ALL SELECT k, 'Song', c_name, CASE WHEN k % 3 = 0 THEN 'Listed Album' WHEN k % 3 = 1 THEN 'Own Album' ELSE '' END, CASE WHEN k % 5 = 0 THEN '1999' WHEN k % 5 = 1 THEN '2020' ELSE '' END, CASE WHEN k % 2 = 0 THEN CAST(k * 500 AS INTEGER) END FROM s WHERE k > 0 AND k % 4 = 2""")
def record_seeds(spark, sf_dir):
    """Raw records as seeds: titles, artists, albums of playlists, years, durations."""
    k, name = F.col("c_custkey"), F.col("c_name")
    fields = {
        "input_pos": k, "title": F.when(k % 4 == 0, F.concat(name, F.lit(" - Song (Official Video)"))).when(k % 4 == 2, F.concat(name, F.lit(" - Song"))).when(k % 4 == 3, "Song (live)").otherwise("Song"),
        "artist": F.when(k % 4 == 0, "").when(k % 4 == 2, "Label Records").otherwise(name), "album": F.when(k % 3 == 1, "Own Album"), "release_year": F.when(k % 5 == 0, 1999), "upload_date": F.when(k % 5 == 1, "20200131"),
        "playlist_title": F.when(k % 3 == 0, "Album - Listed Album"), "is_ytmusic": F.lit(False), "duration": F.when(k % 2 == 0, k * 0.5),
    }
    kinds = dict(x.strip().split(" ") for x in RAW.split(","))
    raw = table(spark, sf_dir, "customer").filter("c_custkey > 0").select(*[(fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
    return M.seeds(raw).select(F.col("input_pos").alias("k"), "title", "artist", "album", "year", "duration_ms")


@query("""WITH t AS (SELECT l_orderkey, list({n: l_linenumber, p: l_partkey, s: l_suppkey, name: 'artist ' || l_partkey, phrase: CASE WHEN l_linenumber % 2 = 0 THEN ' & ' ELSE '' END} ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem GROUP BY l_orderkey)
  SELECT 'r' || o_orderkey AS mb_track_id, 'artist ' || c[1].p || CASE WHEN c[1].n % 2 = 0 OR len(c) = 1 THEN '' ELSE rest END AS artist, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Album ' || o_custkey END AS album, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y') END AS year,
         CASE WHEN o_orderkey % 2 = 0 THEN 'Rock' WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Deep House' END AS genre, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_custkey % 2 = 0 THEN 'GB' ELSE '' END AS country
  FROM orders JOIN t ON l_orderkey = o_orderkey, LATERAL (SELECT CASE WHEN list_position([x.n % 2 for x in c[1:len(c) - 1]], 0) IS NULL THEN array_to_string(['artist ' || x.p for x in c[2:]], '') ELSE array_to_string(['artist ' || x.p for x in c[2 : list_position([x.n % 2 for x in c[1:len(c) - 1]], 0)]], '') END AS rest)""")
def recording_records(spark, sf_dir):
    """Nested recordings as canonical fields: credits, first release, dates, the most counted genre, countries that stand for one."""
    phrase = F.when(F.col("l_linenumber") % 2 == 0, " & ")
    credits = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", phrase.alias("j")))), lambda c: F.struct(F.concat(F.lit("Artist "), c["l_partkey"].cast("string")).alias("name"), c["j"].alias("joinphrase")))
    people = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(credits.alias("credits"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tags = lambda *pairs: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("count")) for n, x in pairs])
    release = F.struct(F.concat(F.lit("Album "), c.cast("string")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(c % 2 == 0, "gb").otherwise("xw").alias("country"), tags(("house", 2), ("deep house", 3)).alias("tags"))
    doc = F.struct(F.concat(F.lit("r"), k.cast("string")).alias("id"), F.lit("Song").alias("title"), F.col("credits").alias("artist-credit"), F.when(k % 2 == 0, tags(("pop", 1), ("rock", 5))).alias("genres"), F.when(k % 3 != 0, F.array(release)).alias("releases"))
    rows = table(spark, sf_dir, "orders").join(people, k == F.col("l_orderkey")).select(F.to_json(doc).alias("j")).select(F.from_json("j", struct_of(RECORDING)).alias("r")).select("r.*")
    return M.from_recording(rows).select("mb_track_id", "artist", "album", "year", "genre", "country")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new name' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def partial_updates(spark, sf_dir):
    """Non-null values of changes put into a table, by key; columns that it lacks are passed over."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = customer.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("new name").alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, 0.0).alias("c_acctbal"), F.lit(1).alias("other"))
    return K.patch(customer, changes, "c_custkey")


@query("""SELECT p_partkey, p_partkey % 5 IN (0, 1) OR p_partkey % 5 = 4 AS flag, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE -1 END AS number, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN 'GB|CA' ELSE '' END AS list FROM part""")
def typed_settings(spark, sf_dir):
    """Texts as flags, numbers and lists, with defaults."""
    k = F.col("p_partkey")
    flag = F.when(k % 5 == 0, "YES").when(k % 5 == 1, "1").when(k % 5 == 2, "off").when(k % 5 == 3, "yes please")
    number = F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(k % 4 == 1, "many").when(k % 4 == 3, "-1")
    names = F.when(k % 3 == 0, F.concat("p_brand", F.lit(" , ,"), "p_type", F.lit(","))).when(k % 3 == 2, " , ")
    return table(spark, sf_dir, "part").select("p_partkey", C.as_flag(flag, True).alias("flag"), C.as_number(number, "int", 3).alias("number"), F.array_join(C.as_list(names, "GB,CA"), "|").alias("list"))


@query(rf"""SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '{T.REMIX}') AS remix, regexp_matches(lower(coalesce(text, '')), '\bacoustic\b') AS acoustic,
                  regexp_matches(lower(coalesce(text, '')), '\b{T.any_of(T.CHANNELS)}\b') AS label FROM documents""")
def version_flags(spark, sf_dir):
    s = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.is_remix(s).alias("remix"), T.is_acoustic(s).alias("acoustic"), T.looks_like_label(s).alias("label"))


@query("SELECT c_custkey, 'set' AS c_name, CAST(c_custkey % 7 AS INTEGER) AS c_nationkey FROM customer")
def cleared_records(spark, sf_dir):
    """Records without internal columns, with fields set by name."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit("x").alias("_kept_suffix"), F.lit(1.0).alias("_score"))
    return L.without_internals(L.with_fields(rows, {"c_name": F.lit("set"), "c_nationkey": F.col("c_custkey") % 7, "other": F.lit(1)}))
