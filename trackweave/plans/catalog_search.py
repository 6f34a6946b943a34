"""Searching a catalog as a remote provider would be searched: by the hinted album, by title and artist, then through the artist's tracks.

Each way is a strategy; later ones run only for requests that earlier ones have not settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluator as V
from ..operators.candidates import field_hits, tiered
from ..operators.hints import usable_hints
from ..operators.strategies import HIGH_CONFIDENCE, staged
from ..storage import written

#: Least score of an item.
LEAST = 0.5


def asked_of(requests: DataFrame) -> DataFrame:
    """Requests (query_id, title, artist, album_hint, duration_ms) as they are searched: a label is no artist, guests of the title are, and hints that are the title are none."""
    rows = requests.filter(T.stripped(T.text_or_empty(F.col("title"))) != "")
    pair = T.artist_from_title(F.col("title"), T.text_or_empty(F.col("artist")))
    rows = rows.withColumn("p_", pair).select("query_id", F.col("p_.title").alias("raw_title"), F.col("p_.artist").alias("artist"), "album_hint", "duration_ms")
    rows = rows.withColumn("artist", T.artist_with_featured(F.col("raw_title"), F.col("artist")))
    return usable_hints(rows, "album_hint", "raw_title")


def items_of(tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """Tracks with what their albums say of kind and size."""
    known = albums.select("collection_id", F.col("collection_type").alias("collection_type"), F.col("track_count").alias("album_count"))
    own = tracks.select(F.col("track_id").alias("row_id"), "track_name", "artist_name", "artist_id", "collection_artist_name", "collection_name", "collection_id", "track_time_millis", "track_explicitness")
    return own.join(known, "collection_id", "left").withColumnRenamed("album_count", "track_count")


def search(requests: DataFrame, tracks: DataFrame, albums: DataFrame, prefer_album: bool = False, prefer_explicit: bool = True, least: float = LEAST, accept: float = HIGH_CONFIDENCE) -> DataFrame:
    """(query_id, row_id, score, artist_id, kind, swapped, strategy, stage): the best track of each request; those without any are left out.

    Both sides are put into normal form once and written; every strategy only brings pairs of ids, which are then evaluated.
    """
    asked = written(V.asked_side(asked_of(requests)), "asked")
    items = written(V.item_side(items_of(tracks, albums)), "items")

    def judged(pairs: DataFrame) -> DataFrame:
        rows = pairs.distinct().join(asked, "query_id").join(items, "row_id")
        best = V.evaluated(rows, prefer_album, prefer_explicit, least)
        return best.join(items.select("row_id", "artist_id"), "row_id").select("query_id", "row_id", "score", "artist_id", F.col("edition.kind").alias("kind"), "swapped")

    def by_album(left: DataFrame, best: DataFrame | None) -> DataFrame:
        own = left.filter("album_hint <> ''")
        words = own.select("query_id", T.keywords(F.col("album_hint")).alias("words"))
        hits = field_hits(words, "words", albums, "collection_name", "collection_id").withColumnRenamed("row_id", "collection_id")
        rows = hits.join(albums.select("collection_id", "collection_name", F.col("artist_name").alias("album_artist")), "collection_id").withColumn("pos", F.col("collection_id"))
        found = V.best_albums(own, rows)
        return judged(found.join(items.select("row_id", "collection_id"), "collection_id").select("query_id", "row_id"))

    def by_title(left: DataFrame, best: DataFrame | None) -> DataFrame:
        words = left.select("query_id", T.keywords(F.col("a_core")).alias("titles"), T.keywords(F.col("artist")).alias("artists"))
        return judged(tiered(words, tracks, {"titles": "track_name", "artists": "artist_name"}, "track_id").select("query_id", "row_id"))

    def by_artist(left: DataFrame, best: DataFrame | None) -> DataFrame:
        named = items.select(F.col("i_artist").alias("artist"), F.col("artist_id").alias("named")).filter("artist <> ''").groupBy("artist").agg(F.min("named").alias("named"))
        own = left.filter("artist <> ''").join(best.select("query_id", F.col("artist_id").alias("known")), "query_id", "left").join(named, "artist", "left")
        own = own.select("query_id", F.coalesce("known", "named").alias("artist_id")).filter("artist_id IS NOT NULL")
        return judged(own.join(items.select("row_id", "artist_id"), "artist_id").select("query_id", "row_id"))

    return staged(asked, {"album": by_album, "title": by_title, "artist": by_artist}, "query_id", order=[F.col("row_id")], accept=accept)
