"""Further providers' rows to canonical fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.schemas import META
from .mappers import credited
from .merge import missing

#: Fields that are taken over as they are, if they are there.
COPIED = ("title", "album", "cover_url", "duration_ms", "track_number", "disc_number", "genre", "year")


def copied(df: DataFrame, key: str, fields: tuple[str, ...] = COPIED) -> DataFrame:
    """``key`` and fields of a provider; empty texts and zeros are null."""
    return df.select(key, *[missing(F.col(f).cast(META[f]), META[f]).alias(f) for f in fields])


def from_code_lookup(df: DataFrame, key: str) -> DataFrame:
    """As copied, with the code."""
    return copied(df, key, (*COPIED, "isrc"))


def named(people: Column, by: str = ", ") -> Column:
    """Names of an array of structs, without missing ones."""
    return F.array_join(F.filter(F.transform(people, lambda p: T.text_or_empty(p["name"])), lambda n: n != ""), by)


def from_optional(df: DataFrame, key: str) -> DataFrame:
    """Tracks of the optional provider (name, artists, album, external_ids, numbers) as canonical fields: first image, year of the release, two forms of the list of artists."""
    album, artists = F.col("album"), F.col("artists")
    date = T.text_or_empty(album["release_date"])
    first = lambda people: T.text_or_empty(F.get(people, F.lit(0))["name"])
    return df.select(
        key, T.text_or_empty(F.col("name")).alias("title"), named(artists).alias("artist"), F.when(F.coalesce(F.size(album["artists"]), F.lit(0)) > 0, first(album["artists"])).otherwise(first(artists)).alias("album_artist"),
        T.text_or_empty(album["name"]).alias("album"), F.when(F.length(date) >= 4, F.substring(date, 1, 4)).otherwise("").alias("year"), F.coalesce("track_number", F.lit(0)).alias("track_number"),
        F.coalesce("disc_number", F.lit(0)).alias("disc_number"), F.coalesce(album["total_tracks"], F.lit(0)).alias("total_tracks"), T.text_or_empty(F.get(album["images"], F.lit(0))["url"]).alias("cover_url"),
        F.coalesce("explicit", F.lit(False)).alias("explicit"), T.text_or_empty(F.col("external_ids.isrc")).alias("isrc"), "duration_ms", named(artists, "; ").alias("artist_collection"),
    )


def exclusive_fields(df: DataFrame, valid_countries: tuple[str, ...] = T.STOREFRONTS) -> DataFrame:
    """``df`` (canonical fields and ``recording``, a nested document) with eight fields filled from the document where they are empty.

    The release is the first whose title and the record's album hold one another, else the first. A country must be one of
    the valid ones.
    """
    doc = F.col("recording")
    wanted = T.clean_text(T.text_or_empty(F.col("album")), "album")
    title = lambda r: T.clean_text(T.text_or_empty(r["title"]), "album")
    fits = lambda w: lambda r: T.once(title(r), lambda t: (t != "") & (F.contains(t, w) | F.contains(w, t)))
    first = F.get(doc["releases"], F.lit(0))
    # the album's form is computed once, not per release, and titles only where there is an album to compare
    release = T.once(wanted, lambda w: F.when(w == "", first).otherwise(F.coalesce(F.get(F.filter(doc["releases"], fits(w)), F.lit(0)), first)))
    rows = df.withColumn("release_", release)
    release = F.col("release_")
    first_id = lambda people: F.get(F.filter(F.transform(people, lambda c: T.text_or_empty(c["artist"]["id"])), lambda i: i != ""), F.lit(0))
    country = F.upper(F.trim(T.text_or_empty(release["country"])))
    new = {
        "isrc": F.get(doc["isrcs"], F.lit(0)), "mb_track_id": doc["id"], "mb_album_id": release["id"], "mb_release_group_id": release["release-group"]["id"], "mb_artist_id": first_id(doc["artist-credit"]),
        "mb_album_artist_id": first_id(release["artist-credit"]), "label": F.get(release["label-info"], F.lit(0))["label"]["name"], "country": F.when(country.isin(*valid_countries), country),
    }
    return rows.withColumns({n: F.coalesce(missing(F.col(n), "string"), missing(c, "string"), F.lit("")) for n, c in new.items()}).drop("release_")


def recording_fallback(df: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """``df`` (with ``recording``) filled from its mapped recording, then by exclusive_fields, then the album's artists by its release's credits."""
    kinds = dict(df.dtypes)
    shared = [c for c in mapped.columns if c in kinds and c != key]
    new = mapped.select(key, *[F.col(c).alias(f"{c}__new") for c in shared])
    filled = df.join(new, key, "left").withColumns({c: F.coalesce(missing(F.col(c), kinds[c]), missing(F.col(f"{c}__new"), kinds[c])) for c in shared}).drop(*[f"{c}__new" for c in shared])
    out = exclusive_fields(filled)
    owner = credited(F.transform(F.get(F.col("recording.releases"), F.lit(0))["artist-credit"], lambda c: F.struct(c["name"].alias("name"), F.lit("").alias("joinphrase"))))
    return out.withColumn("album_artist", F.coalesce(missing(F.col("album_artist"), "string"), missing(owner, "string"), F.lit("")))
