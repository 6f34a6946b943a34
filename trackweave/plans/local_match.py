"""Matching queries against a local catalog: candidates, scores, best pick, threshold, canonical record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as T
from ..functions.edition import release_edition
from ..operators.candidates import tiered
from ..operators.lookups import value_classes
from ..operators.mappers import from_catalog
from ..operators.scoring import candidate_side, distances, edition_likeness, edition_score, query_side, track_scores
from ..operators.select_best import first_of
from ..storage import written

#: Least score of a candidate, and of a match that stands alone.
LEAST, ACCEPT = 0.55, 0.7


def prepared(requests: DataFrame) -> DataFrame:
    """Requests (query_id, title, artist, album_hint, duration_ms, isrc) in normal form, with keywords and flags."""
    title, hint = T.normalize(F.col("title")), T.normalize(F.col("album_hint"))
    core = T.without_brackets(title)
    short = (hint == "") | T.has_album_suffix(hint) | (hint == title) | (hint == core)
    return requests.filter(T.stripped(T.text_or_empty(F.col("title"))) != "").select(
        "query_id", title.alias("title"), T.normalize(T.primary_artist(F.col("artist"))).alias("artist"), hint.alias("album_hint"), "duration_ms", F.upper(T.text_or_empty(F.col("isrc"))).alias("isrc"),
        T.has_version_tag(F.col("title")).alias("has_version"), short.alias("expects_short"),
    )


def candidates(requests: DataFrame, tracks: DataFrame) -> DataFrame:
    """(query_id, row_id, tier) for prepared requests and catalog tracks."""
    words = requests.select("query_id", *[T.keywords(F.col(c)).alias(f"{c}_words") for c in ("title", "artist", "album_hint")])
    return tiered(words, tracks, {"title_words": "track_name", "artist_words": "artist_name", "album_hint_words": "collection_name"}, "track_id")


def scored(requests: DataFrame, classes: DataFrame, places: DataFrame, albums: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, row_id) with base score and total: the base and the album's edition score.

    ``classes`` are distinct tracks (track_id and what the base score depends on), ``pairs`` has their ids; ``places`` (class_id, collection_id, row_id, n)
    are the albums that each is on, with the first of its n rows there.
    """
    cand = candidate_side(classes.select(F.col("track_id").alias("row_id"), "track_name", "artist_name", "collection_name", "track_time_millis", F.lit("").alias("cand_isrc"), F.lit("").alias("collection_type")))
    cand = cand.withColumn("c_version", T.has_version_tag(F.col("track_name")))
    asked = query_side(requests.withColumn("isrc", F.lit("")))
    rows = pairs.join(asked, "query_id").join(cand, "row_id").filter(~F.col("has_version") | F.col("c_version"))
    rows = track_scores(rows, LEAST).filter("score IS NOT NULL").select("query_id", F.col("row_id").alias("class_id"), "score", "title", "album_hint", "q_words", "expects_short")
    rows = rows.join(places.filter("row_id IS NOT NULL").drop("n"), "class_id")
    counts = places.groupBy("collection_id").agg(F.sum("n").cast("int").alias("real_count"))
    name = T.normalize(F.col("collection_name"))
    known = albums.select(
        "collection_id", F.col("collection_type").alias("a_type"), T.is_various(F.col("artist_name")).alias("a_various"), F.col("collection_name").alias("a_name"), F.col("track_count").alias("a_count"), F.lit(True).alias("known"),
        name.alias("a_norm"), T.edition_tokens(name).alias("a_words"), T.without_single(F.col("collection_name")).alias("a_single"), T.is_single_name(F.col("collection_name")).alias("a_suffixed"),
    ).join(counts, "collection_id", "left")
    rows = rows.join(known, "collection_id", "left")
    rows = distances(distances(rows, {"likeness": ("album_hint", "a_norm")}, D.title_similarity), {"d_album_title": ("title", "a_single")})
    declared = F.coalesce("a_count", F.lit(0)) > 0
    count = F.when(declared, F.col("a_count")).otherwise(F.col("real_count"))
    kind = F.when(declared, F.col("a_type")).otherwise(F.lit(""))
    edition = release_edition(kind, F.col("a_name"), count, F.coalesce(count, F.lit(0)) > 0, F.col("a_suffixed") & (F.col("d_album_title") < 0.15))
    rows = rows.withColumns({"edition": edition, "likeness": edition_likeness(F.col("likeness"), F.col("q_words"), F.col("a_words"))})
    bonus = edition_score(F.coalesce("known", F.lit(False)), F.coalesce("a_various", F.lit(False)), F.col("edition"), F.col("album_hint"), F.col("likeness"), F.col("expects_short"))
    return rows.select("query_id", "row_id", F.col("score").alias("base"), (F.col("score") + bonus).alias("total"))


def matched(requests: DataFrame, tracks: DataFrame, albums: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(query_id, track_id, score) of the best catalog track of each request; those under ``accept`` are misses.

    Tracks that differ in their ids only are one class: the smallest id wins a tie, so a class is found and scored once.
    """
    asked = prepared(requests)
    members, classes = value_classes(tracks, "track_id", ["track_name", "artist_name", "collection_name", "track_time_millis", "isrc"], ["collection_id"])
    places = written(members.groupBy("class_id", "collection_id").agg(F.min("track_id").alias("row_id"), F.count(F.lit(1)).alias("n")), "places")
    own = classes.withColumnRenamed("class_id", "track_id")
    best = first_of(scored(asked, own, places, albums, candidates(asked, own)), ["query_id"], [F.desc("total"), F.col("row_id")])
    hits = best.filter(F.col("total") >= accept).select("query_id", F.col("row_id").alias("track_id"), F.col("total").alias("score"))
    both = hits.withColumn("way", F.lit(0)).unionByName(matched_by_isrc(asked, classes.withColumnRenamed("first_id", "track_id"), accept).withColumn("way", F.lit(1)))
    return first_of(both, ["query_id"], [F.col("way")]).drop("way")


def matched_by_isrc(asked: DataFrame, tracks: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Fallback for prepared requests: tracks of the same ISRC, if the titles agree; ties to the smallest id."""
    rows = asked.filter("isrc <> ''").join(tracks.select("track_id", "track_name", F.upper("isrc").alias("isrc"), T.normalize(F.col("track_name")).alias("name")), "isrc")
    rows = distances(rows, {"likeness": ("title", "name")}, D.title_similarity)
    wanted = (F.col("has_version") & ~T.has_version_tag(F.col("track_name"))).cast("int")
    best = first_of(rows, ["query_id"], [wanted, F.desc("likeness"), F.col("track_id")])
    return best.filter(F.col("likeness") >= accept).select("query_id", "track_id", F.col("likeness").alias("score"))


def match_records(requests: DataFrame, tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """Canonical records of the matches, with query_id and score."""
    return from_catalog(matched(requests, tracks, albums).join(tracks, "track_id"))
