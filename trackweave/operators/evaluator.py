"""Evaluating search results: cheap conditions, an exact bound of the title similarity, scores, final conditions, the pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as T
from ..functions.edition import is_short_form, release_edition
from . import scoring as S
from .select_best import duration_delta, first_of, picked_of_pool, preferred_pool, tolerant_best

# Limits of similarities, the kinds of a song, and artists that stand for another in titles.
CORE_TITLE, TITLE, ARTIST, ALBUM, HIGH, SURE = 0.88, 0.75, 0.85, 0.85, 0.90, 0.95
SWAP_TITLE, SWAP_ARTIST = 0.9, 0.8
SONG_KINDS = ("song", "music-video")
MIXED = r"[\(\[]\s*mixed\s*[\)\]]"
BLACKLIST = {"wudo beatz": ("jackboys", "gang gang"), "unleash the archers": ("apex",), "jackboy": ("jackboys 2", "jb2 radio", "2000 excursion")}


def is_song(kind: Column, wrapper: Column, name: Column) -> Column:
    """Whether a result is a track of a kind that counts, with a name."""
    return F.coalesce((wrapper == "track") & kind.isin(*SONG_KINDS), F.lit(False)) & (T.text_or_empty(name) != "")


def blacklisted(artist: Column, title: Column, listed: dict[str, tuple[str, ...]] = BLACKLIST) -> Column:
    """Whether an artist (normal form) is listed with a word that the title holds."""
    out = F.lit(False)
    for name, words in listed.items():
        for word in words:
            out = out | ((artist == name) & F.contains(title, F.lit(word)))
    return out


def is_live_item(track: Column, album: Column) -> Column:
    """Whether 'live' is anywhere in the track's or the album's name, also inside a word."""
    has = lambda c: F.contains(F.lower(T.text_or_empty(c)), F.lit("live"))
    return has(track) | has(album)


def is_compilation_item(kind: Column, album: Column, artist: Column, owner: Column, likeness: Column) -> Column:
    """Whether a result is from a compilation: declared as one of various artists, or named like one.

    Never if the album is like the hint, or a single or EP. ``likeness`` is that of the hinted and the result's album.
    """
    various = (T.text_or_empty(artist) != "") & (T.normalize(owner) == "various artists")
    found = ((T.text_or_empty(kind) == "Compilation") & various) | T.is_compilation_name(album)
    return (F.coalesce(likeness, F.lit(0.0)) < ALBUM) & ~T.text_or_empty(kind).isin("Single", "EP") & found


def alternative_rejected(candidate: Column, wanted: Column) -> Column:
    """Whether a candidate's title is an alternative version and the wanted one is not."""
    return T.is_alternative(T.text_or_empty(candidate)) & ~T.is_alternative(T.text_or_empty(wanted))


def asked_side(df: DataFrame) -> DataFrame:
    """Requests (query_id, raw_title, artist, album_hint, duration_ms) with normal forms and what the conditions need of them, once per request."""
    title, artist, hint = F.col("raw_title"), T.text_or_empty(F.col("artist")), T.text_or_empty(F.col("album_hint"))
    out = df.withColumns({"title": T.normalize(T.clean_title(title, artist)), "artist": T.normalize(T.primary_artist(artist)), "album_hint": T.normalize(hint), "isrc": F.lit("")})
    out = out.withColumn("a_core", T.normalize(T.without_brackets(T.clean_title(title)))).withColumn("a_plain", T.normalize(T.without_brackets(F.col("title"))))
    out = out.withColumns({"a_profile": D.profile(F.col("a_core")), "a_numbers": D.numbers(F.col("a_core"))})
    return S.query_side(out)


def item_side(df: DataFrame) -> DataFrame:
    """Results (row_id, track_name, artist_name, collection_artist_name, collection_name, collection_type, track_time_millis) with what the conditions need of them, once per result."""
    out = df.withColumn("i_core", T.normalize(T.without_brackets(T.clean_title(F.col("track_name")))))
    out = out.withColumns({
        "i_profile": D.profile(F.col("i_core")), "i_numbers": D.numbers(F.col("i_core")), "i_artist": T.normalize(F.col("artist_name")), "i_owner": T.normalize(F.col("collection_artist_name")), "i_album": T.normalize(F.col("collection_name")),
        "i_mixed": T.matches(F.col("track_name"), MIXED), "i_live": is_live_item(F.col("track_name"), F.col("collection_name")),
        "i_compilation": is_compilation_item(F.col("collection_type"), F.col("collection_name"), F.col("artist_name"), F.col("collection_artist_name"), F.lit(0.0)), "cand_isrc": F.lit(""),
    })
    return S.candidate_side(out)


def prefiltered(pairs: DataFrame, least: float = CORE_TITLE, listed: dict[str, tuple[str, ...]] = BLACKLIST) -> DataFrame:
    """Pairs of asked_side and item_side that are worth a score, with ``core_likeness`` and ``hint_likeness`` (of albums; 0 without a hint).

    Mixed items, listed artists, and pairs whose lengths, letter counts or numbers rule out a title similarity of ``least``
    go before any distance is computed; the bound loses no pair that the similarity would keep.
    """
    bound = D.likeness_bound(F.col("a_core"), F.col("i_core"), F.col("a_profile"), F.col("i_profile"), F.col("a_numbers"), F.col("i_numbers"))
    cheap = pairs.filter(~F.col("i_mixed") & ~blacklisted(F.col("i_artist"), F.col("title"), listed) & (bound >= least))
    hint = F.nullif(F.col("album_hint"), F.lit(""))
    known = S.distances(cheap.withColumn("hint_", hint), {"core_likeness": ("a_core", "i_core"), "hint_base": ("hint_", "i_album")}, D.title_similarity)
    likeness = F.when(hint.isNull(), 0.0).otherwise(S.edition_likeness(F.col("hint_base"), F.col("q_words"), F.col("i_words")))
    known = known.withColumn("i_words", T.edition_tokens(F.col("i_album"))).withColumn("hint_likeness", likeness).drop("hint_", "hint_base", "i_words")
    return known.filter((F.col("core_likeness") >= least) & (~F.col("i_compilation") | (F.col("hint_likeness") >= ALBUM)))


def accepted(score: Column, title: Column, same_title: Column, asks_artist: Column, artist: Column, owner: Column, artist_within: Column, asks_album: Column, album: Column, album_prefix: Column) -> Column:
    """The condition after scoring, from similarities of titles, artists, album artists and albums.

    The title must be alike or equal, and the artist alike or contained. A high score needs no more; else a hinted
    album must be alike, or the score nearly sure, or the hint begin with the album, or the artist alike.
    """
    by_artist = ~asks_artist | (artist >= ARTIST) | (owner >= ARTIST) | artist_within
    by_album = ~asks_album | (album >= ALBUM) | (score >= SURE) | album_prefix | (asks_artist & (artist >= ARTIST))
    return ((title >= TITLE) | same_title) & by_artist & ((score >= HIGH) | by_album)


def with_valid_candidate(pairs: DataFrame, title: float = TITLE, artist: float = ARTIST) -> DataFrame:
    """(query_id) of the requests that have a result of like title and, if they name an artist, like artist. Pairs are those of asked_side and item_side.

    Titles that the bound of their lengths and letters rules out are not compared.
    """
    bound = D.ratio_bound(F.col("a_profile"), F.col("i_profile"))
    known = S.distances(pairs.filter(bound >= D.LEAST_RATIO), {"t_": ("a_core", "i_core"), "s_": ("artist", "i_artist")}, D.title_similarity)
    return known.filter((F.col("t_") >= title) & ((F.col("artist") == "") | (F.col("s_") >= artist))).select("query_id").distinct()


def finally_kept(scored: DataFrame) -> DataFrame:
    """Scored pairs of prefiltered that pass ``accepted``."""
    known = S.distances(scored, {"title_likeness": ("a_plain", "i_core"), "artist_likeness": ("artist", "i_artist"), "owner_likeness": ("artist", "i_owner")}, D.title_similarity)
    artist, owner = F.col("artist"), F.col("i_owner")
    within = T.contains_word(F.col("i_artist"), artist) | ((owner != "") & (F.contains(owner, artist) | F.contains(artist, owner)))
    plain = lambda c: F.trim(F.regexp_replace(c, r"[^a-z0-9\s]", ""))
    prefix = (plain(F.col("i_album")) != "") & F.startswith(plain(F.col("album_hint")), plain(F.col("i_album")))
    ok = accepted(F.col("score"), F.col("title_likeness"), F.col("i_core") == F.col("a_plain"), artist != "", F.col("artist_likeness"), F.col("owner_likeness"), within, F.col("album_hint") != "", F.col("hint_likeness"), prefix)
    return known.filter(ok).drop("title_likeness", "owner_likeness", "artist_likeness")


def swapped(best: DataFrame, kept: DataFrame, prefer_album: bool = False) -> DataFrame:
    """``best`` (a row for each query) with rows replaced by the equivalent of the wanted form, if there is one.

    With ``prefer_album`` singles and EPs give way to others, else albums to singles and EPs. Equivalent rows of the same
    query have a title similarity over 0.9 and an artist similarity over 0.8; of several the highest score, then the first position.
    """
    short = is_short_form(F.col("edition.kind"))
    leaves = short if prefer_album else F.col("edition.kind") == "album"
    own = best.filter(leaves).select("query_id", F.col("i_title").alias("b_title"), F.col("i_artist").alias("b_artist"))
    others = kept.filter(~short if prefer_album else short).join(own, "query_id")
    bound = D.ratio_bound(D.profile(F.col("b_title")), D.profile(F.col("i_title")))
    others = S.distances(others.filter(bound >= D.LEAST_RATIO), {"t_": ("b_title", "i_title"), "a_": ("b_artist", "i_artist")}, D.title_similarity)
    found = first_of(others.filter((F.col("t_") > SWAP_TITLE) & (F.col("a_") > SWAP_ARTIST)), ["query_id"], [F.desc("score"), F.col("row_id")]).select(*best.columns)
    return best.join(found.select("query_id"), "query_id", "left_anti").withColumn("swapped", F.lit(False)).unionByName(found.withColumn("swapped", F.lit(True)))


def evaluated(pairs: DataFrame, prefer_album: bool = False, prefer_explicit: bool = True, least: float = 0.5) -> DataFrame:
    """The pick of each query among pairs of asked_side and item_side: query_id, row_id, score, edition, swapped.

    Items also need collection_id, track_count and track_explicitness. Of a collection's rows the preferred explicitness counts first; of the pool,
    the highest score, then what is not live, then the nearest duration, then the first (row_id).
    """
    scored = S.track_scores(prefiltered(pairs), least).filter("score IS NOT NULL")
    kept = finally_kept(scored)
    edition = release_edition(F.col("collection_type"), F.col("collection_name"), F.col("track_count"), F.lit(False))
    explicit = F.lower(T.text_or_empty(F.col("track_explicitness"))) == "explicit"
    kept = kept.select("query_id", "row_id", "score", "i_artist", "i_live", "duration_ms", "track_time_millis", F.nullif(F.col("collection_id"), F.lit(0)).alias("collection_id"), edition.alias("edition"), T.normalize(T.clean_title(F.col("track_name"))).alias("i_title"), explicit.alias("explicit"))
    pool = preferred_pool(kept, "query_id", "collection_id", F.col("explicit") == F.lit(prefer_explicit), "score", "row_id")
    best = picked_of_pool(pool, "query_id", "score", F.col("i_live"), duration_delta(F.col("duration_ms"), F.col("track_time_millis"))).filter("picked").select(*kept.columns)
    return swapped(best, kept, prefer_album).select("query_id", "row_id", "score", "edition", "swapped")


def best_albums(asked: DataFrame, albums: DataFrame) -> DataFrame:
    """(query_id, collection_id) of the album that each request's hint means, from pairs to consider.

    ``asked`` has query_id, artist and album_hint in normal form; ``albums`` has query_id, pos, collection_id, collection_name, album_artist. The artist
    must be alike (0.7) or contained; an album must be more like the hint than 0.7, or 0.85 without edition words, with 0.2 off
    where the edition words differ. The pick is by position, see tolerant_best.
    """
    pairs = albums.join(asked.select("query_id", "artist", "album_hint"), "query_id").withColumns({"name_": T.normalize(F.col("collection_name")), "by_": T.normalize(F.col("album_artist"))})
    known = S.distances(pairs, {"by_likeness": ("artist", "by_"), "base_": ("album_hint", "name_")}, D.title_similarity)
    known = known.withColumns({"hint_words": T.edition_tokens(F.col("album_hint")), "words": T.edition_tokens(F.col("name_"))})
    artist, by = F.col("artist"), F.col("by_")
    fits = (artist == "") | (T.text_or_empty(F.col("album_artist")) == "") | (F.col("by_likeness") >= 0.7) | F.contains(by, artist) | F.contains(artist, by)
    likeness = S.edition_likeness(F.col("base_"), F.col("hint_words"), F.col("words")) - F.when(F.col("hint_words") == F.col("words"), 0.0).otherwise(0.2)
    known = known.withColumns({"likeness": F.greatest(F.lit(0.0), likeness), "overlap": F.size(F.array_intersect("hint_words", "words"))})
    known = known.filter(fits & (F.col("likeness") > F.when(F.size("hint_words") > 0, 0.70).otherwise(ALBUM)))
    best = tolerant_best(known, "query_id", "pos", "likeness", "overlap", "name_")
    return best.join(known.select("query_id", "pos", "collection_id"), ["query_id", "pos"]).select("query_id", "collection_id")
