"""Provider rows to canonical rows, seeds from raw records, and tag rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.schemas import META
from .merge import is_compilation, missing
from .select_best import top_tag

# Patterns of seeds, country codes that stand for no country, and names of tag atoms.
KEPT_SUFFIX = r"\((instrumental|interlude|acoustic|live|remaster(?:ed)?|extended)\)"
GENERIC_CHANNEL = r"(?:vevo|topic|official|channel|music|lyrics|audio|video|mix|playlist|sounds?|records?|entertainment)$"
NO_COUNTRY = ("XW", "XE", "XU", "XX")
TEXT_ATOMS = {"title": "\xa9nam", "album_artist": "aART", "album": "\xa9alb", "genre": "\xa9gen", "composer": "\xa9wrt", "sort_title": "sonm", "sort_artist": "soar", "sort_album": "soal", "sort_album_artist": "soaa", "label": "\xa9lab", "isrc": "\xa9isr"}
FREE_ATOMS = {
    "label": "LABEL", "upc": "BARCODE", "country": "MusicBrainz Album Release Country", "isrc": "ISRC", "itunes_track_id": "iTunes_CDDB_TrackNumber", "itunes_artist_id": "iTunes_CDDB_ArtistID",
    "itunes_collection_id": "iTunes_CDDB_CollectionID", "mb_track_id": "MusicBrainz Track Id", "mb_album_id": "MusicBrainz Album Id", "mb_artist_id": "MusicBrainz Artist Id",
    "mb_album_artist_id": "MusicBrainz Album Artist Id", "mb_release_group_id": "MusicBrainz Release Group Id",
}
NUMBER_ATOMS = (("itunes_collection_id", "plID"), ("itunes_collection_id", "cnID"), ("itunes_artist_id", "atID"), ("itunes_track_id", "cmID"))


def cover_sized(url: Column, size: str = "3000x3000") -> Column:
    return F.regexp_replace(T.text_or_empty(url), r"\d+x\d+bb", f"{size}bb")


def artwork_stored(url: Column) -> Column:
    """An artwork address as it is stored."""
    return F.regexp_replace(url, r"/\d+x\d+bb\.jpg$", "/1000x1000bb.jpg")


def first_cover(*urls: Column, skip: str = "") -> Column:
    """The first address that is there and not of the host to skip."""
    return F.coalesce(*[F.when((T.text_or_empty(u) != "") & (F.lit(not skip) | ~F.contains(u, F.lit(skip))), u) for u in urls])


def from_catalog(df: DataFrame, title: str = "", artist: str = "") -> DataFrame:
    """Catalog tracks as canonical fields; ``title`` and ``artist`` stand in for missing ones."""
    name, by = F.coalesce(F.col("track_name"), F.lit(title)), F.coalesce(F.nullif(F.col("artist_name"), F.lit("")), F.lit(artist))
    album_artist = F.coalesce(F.nullif(F.col("collection_artist_name"), F.lit("")), by)
    primary, owner = T.normalize(T.primary_artist(by)), T.normalize(album_artist)
    year = F.substring(F.col("release_date").cast("string"), 1, 4) if "release_date" in df.columns else F.lit("")
    return df.select(
        *[c for c in ("query_id", "score") if c in df.columns],
        name.alias("title"), by.alias("artist"), album_artist.alias("album_artist"), T.text_or_empty(F.col("collection_name")).alias("album"),
        F.when(year.isin("", "0"), "").otherwise(F.coalesce(year, F.lit(""))).alias("year"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(n) for c, n in (("track_number", "track_number"), ("disc_number", "disc_number"), ("track_count", "total_tracks"), ("disc_count", "total_discs"))],
        cover_sized(F.col("artwork_url")).alias("cover_url"), T.text_or_empty(F.col("primary_genre_name")).alias("genre"),
        *[T.text_or_empty(F.col(c)).alias(n) for c, n in (("track_id", "itunes_track_id"), ("artist_id", "itunes_artist_id"), ("collection_id", "itunes_collection_id"))],
        F.lower(T.text_or_empty(F.col("track_explicitness"))).isin("explicit", "cleaned").alias("explicit"),
        is_compilation(T.is_various(album_artist), primary, owner, T.contains_word(owner, primary)).alias("compilation"),
        F.col("track_time_millis").alias("duration_ms"), T.text_or_empty(F.col("isrc")).alias("isrc"),
    )


def credited(credits: Column) -> Column:
    """Names of an array of credits with the phrases that join them."""
    parts = F.transform(credits, lambda c: F.concat(T.text_or_empty(c["name"]), T.text_or_empty(c["joinphrase"])))
    return F.trim(F.coalesce(F.array_join(parts, ""), F.lit("")))


def from_recording(df: DataFrame) -> DataFrame:
    """Nested recordings as canonical fields: first release, first valid date, most counted genre."""
    release = F.get("releases", F.lit(0))
    group = release["release-group"]
    date = F.coalesce(F.nullif(F.col("first-release-date"), F.lit("")), F.nullif(release["date"], F.lit("")), F.lit(""))
    country = F.upper(F.trim(T.text_or_empty(release["country"])))
    tag = F.coalesce(*[F.nullif(top_tag(x[k] if x is not None else F.col(k)), F.lit("")) for x in (None, group, release) for k in ("genres", "tags")])
    first_id = lambda credits: F.get(F.filter(F.transform(credits, lambda c: c["artist"]["id"]), lambda i: T.text_or_empty(i) != ""), F.lit(0))
    return df.select(
        F.col("id").alias("mb_track_id"), T.clean_text(F.col("title"), "title").alias("title"), T.clean_text(credited(F.col("artist-credit")), "artist").alias("artist"),
        T.text_or_empty(release["title"]).alias("album"), F.when(F.length(date) >= 4, F.substring(date, 1, 4)).otherwise("").alias("year"), F.initcap(T.text_or_empty(tag)).alias("genre"),
        T.text_or_empty(F.get("isrcs", F.lit(0))).alias("isrc"), T.text_or_empty(F.get(release["label-info"], F.lit(0))["label"]["name"]).alias("label"),
        F.when((F.length(country) == 2) & ~country.isin(*NO_COUNTRY), country).otherwise("").alias("country"),
        T.text_or_empty(release["id"]).alias("mb_album_id"), T.text_or_empty(group["id"]).alias("mb_release_group_id"),
        first_id(F.col("artist-credit")).alias("mb_artist_id"), first_id(release["artist-credit"]).alias("mb_album_artist_id"),
    )


def seeds(raw: DataFrame) -> DataFrame:
    """Raw records as seeds: cleaned title, primary artist, album, year, and what identifies the source."""
    given = F.coalesce(F.nullif(F.col("artist"), F.lit("")), F.col("uploader"), F.lit(""))
    title = T.text_or_empty(F.col("title"))
    dashed = F.contains(title, F.lit(" - ")) & (given == "")
    pair = F.when(dashed, F.struct(F.substring_index(title, " - ", 1).alias("artist"), F.substring(title, F.locate(" - ", title) + 3, F.length(title)).alias("title"))).otherwise(T.artist_from_title(title, given))
    df = raw.withColumn("own_", F.coalesce("is_ytmusic", F.lit(False))).withColumn("pair_", pair)
    df = df.withColumn("name_", T.artist_with_featured(F.col("pair_.title"), F.col("pair_.artist")))
    df = df.withColumn("name_", F.when(T.matches(F.col("name_"), GENERIC_CHANNEL), "").otherwise(F.col("name_")))
    kept = F.regexp_extract(F.col("pair_.title"), f"(?iuU){KEPT_SUFFIX}", 1)
    df = df.withColumn("kept_", F.when(kept != "", F.concat(F.lit(" ("), F.upper(F.substring(kept, 1, 1)), F.lower(F.substring(kept, 2, 99)), F.lit(")"))).otherwise(""))
    df = df.withColumn("clean_", T.clean_title(F.col("pair_.title"), F.col("name_")))
    clean = F.when(F.contains(F.lower("clean_"), F.lower("kept_")), F.col("clean_")).otherwise(F.concat("clean_", "kept_"))
    listed = T.stripped(F.regexp_extract(T.text_or_empty(F.col("playlist_title")), r"(?iuU)^Album\s*[-–]\s*(.+)$", 1))
    inner = T.stripped(F.regexp_extract(T.text_or_empty(F.col("playlist_title")), "['‘’ʼ](.+?)['‘’ʼ]", 1))
    df = df.withColumns({"album_": T.text_or_empty(F.col("album")), "listed_": listed, "inner_": inner})
    better = (F.col("listed_") != "") & ((F.col("album_") == "") | (T.is_deluxe(F.col("listed_")) & ~T.is_deluxe(F.col("album_"))))
    df = df.withColumn("album_", F.when(better, F.col("listed_")).otherwise(F.col("album_")))
    album = F.when(T.has_album_suffix(F.col("album_")) & (F.col("inner_") != "") & ~T.has_album_suffix(F.col("inner_")), F.col("inner_")).otherwise(F.col("album_"))
    full = F.when(F.col("own_"), T.stripped(given)).otherwise(F.col("name_"))
    return df.select(
        "input_pos", F.when(F.col("own_"), T.stripped(title)).otherwise(clean).alias("title"), T.primary_artist(full).alias("artist"), album.alias("album"),
        F.coalesce(F.nullif(F.col("release_year"), F.lit(0)).cast("string"), F.substring(F.col("upload_date"), 1, 4), F.lit("")).alias("year"),
        F.coalesce("track_number", F.lit(0)).alias("track_number"), (F.nullif(F.col("duration"), F.lit(0.0)) * 1000).cast("int").alias("duration_ms"),
        T.text_or_empty(F.col("thumbnail")).alias("cover_url"), T.text_or_empty(F.col("isrc")).alias("isrc"), "video_id",
    )


def finished(df: DataFrame) -> DataFrame:
    """Records with sort names, album artist, compilation and matched flags; all fields of the output in order, with their defaults."""
    for name, kind in META.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    primary = T.primary_artist(F.col("artist"))
    df = df.withColumn("album_artist", F.coalesce(missing(F.col("album_artist"), "string"), primary))
    for field, source in (("sort_title", F.col("title")), ("sort_artist", primary), ("sort_album", F.col("album")), ("sort_album_artist", F.col("album_artist"))):
        df = df.withColumn(field, F.coalesce(missing(F.col(field), "string"), T.sort_name(source)))
    owner, own = T.normalize(F.col("album_artist")), T.normalize(primary)
    df = df.withColumn("compilation", F.coalesce(F.when(F.col("compilation"), F.lit(True)), is_compilation(T.is_various(F.col("album_artist")), own, owner, T.contains_word(owner, own))))
    known = [T.text_or_empty(F.col(c)) != "" for c in ("itunes_track_id", "mb_track_id", "isrc")]
    df = df.withColumn("matched", known[0] | known[1] | known[2])
    defaults = {"string": F.lit(""), "int": F.lit(0), "boolean": F.lit(False)}
    own_columns = [c for c in df.columns if c not in META]
    fields = [F.col(n) if n == "duration_ms" else F.coalesce(F.nullif(F.col(n), F.lit(0)), F.lit(1)).alias(n) if n == "media_type" else F.coalesce(F.col(n), defaults[k]).alias(n) for n, k in META.items()]
    return df.select(*own_columns, *fields)


def rename_names(df: DataFrame, raw_title: str = "raw_title", raw_artist: str = "raw_artist") -> DataFrame:
    """Title and artist for a file name: the raw ones where nothing matched."""
    pick = lambda own, raw: F.when(F.col("matched"), F.col(own)).otherwise(F.coalesce(F.nullif(F.col(raw), F.lit("")), F.col(own)))
    return df.withColumn("rename_title", pick("title", raw_title)).withColumn("rename_artist", pick("artist", raw_artist))


def tag_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, atom, value): one row for each tag that a record has. Fields that are missing have no tag."""
    text = lambda c: F.nullif(T.text_or_empty(F.col(c)), F.lit(""))
    tags: list[tuple[str, Column]] = [(atom, text(field)) for field, atom in TEXT_ATOMS.items()]
    tags += [(f"----:com.apple.iTunes:{atom}", text(field)) for field, atom in FREE_ATOMS.items()]
    tags += [(atom, F.when(F.col(field).rlike(r"^\d+$"), F.col(field))) for field, atom in NUMBER_ATOMS]
    tags.append(("\xa9ART", F.when(text("artist").isNotNull(), F.coalesce(text("artist_collection"), text("raw_artist_name"), text("artist")))))
    tags.append(("\xa9day", F.when(F.col("year").rlike(r"^\d+$") & F.col("year").cast("int").between(1900, 2100), F.col("year"))))
    tags += [(atom, F.when(F.col(n) > 0, F.concat_ws("/", F.col(n).cast("string"), F.greatest(F.col(of), F.lit(0)).cast("string")))) for atom, n, of in (("trkn", "track_number", "total_tracks"), ("disk", "disc_number", "total_discs"))]
    tags.append(("cpil", F.when(F.col("compilation"), "1")))
    tags.append(("rtng", F.when(F.col("explicit"), "4").otherwise("0")))
    tags.append(("stik", F.col("media_type").cast("string")))
    tags += [("pgap", F.lit("0")), ("akID", F.lit("1"))]
    tags.append(("cprt", F.coalesce(text("copyright"), F.when(text("label").isNotNull() & text("year").isNotNull(), F.concat_ws(" ", F.lit("℗"), "year", "label")))))
    rows = F.array(*[F.struct(F.lit(a).alias("atom"), v.cast("string").alias("value")) for a, v in tags])
    return df.select(key, F.explode(F.filter(rows, lambda t: t["value"].isNotNull())).alias("tag")).select(key, "tag.atom", "tag.value")


def split_lookup(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mixed results as album rows and track rows."""
    return results.filter("wrapper_type = 'collection'"), results.filter("wrapper_type = 'track'")


def album_of_track(tracks: DataFrame) -> DataFrame:
    """Album rows derived from track rows, one for each collection: the one of its smallest track id."""
    owner = F.coalesce(F.nullif(F.col("collection_artist_name"), F.lit("")), F.col("artist_name"))
    row = F.struct("track_id", "collection_name", owner.alias("artist_name"), "artist_id", "track_count", "primary_genre_name")
    best = tracks.filter("collection_id IS NOT NULL").groupBy("collection_id").agg(F.min(row).alias("r"))
    return best.select("collection_id", "r.collection_name", "r.artist_name", "r.artist_id", "r.track_count", "r.primary_genre_name", F.lit("Album").alias("collection_type"))
