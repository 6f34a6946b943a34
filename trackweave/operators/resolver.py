"""Resolving recordings: attempts by code and text, a second round for lost version tags, the release, artists, confidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written
from .evaluator import alternative_rejected
from .mappers import credited
from .scoring import CONFIDENCE
from .select_best import first_of

#: Least score of a recording, and the tolerance of durations.
LEAST_SCORE, TOLERANCE_MS = 0.35, 5000
#: Least similarity of an artist whose country counts; of titles and artists that agree.
COUNTRY, SAME_TITLE, SAME_ARTIST = 0.85, 0.75, 0.60
#: Remarks that are no part of a query's title, a bracketed tag, guests of any form, artist-list separators, and bracketed guests (fixed values).
QUERY_REMARKS = r"\s*[\(\[](bonus track|bonus|deluxe|explicit|clean|radio edit|interlude)[\)\]]"
QUERY_TAG, QUERY_GUESTS = r"[\(\[]([^\)\]]+)[\)\]]", r"\b(?:ft\.?|feat\.?|featuring|w/)\s+([^(\[\)\]]+)"
SEVERAL, GUESTS = r"[,;&]|\s+(?:feat\.?|ft\.?|with|x|and)\s+", r"(?iu)\((?:feat|ft)\.?\s+([^)]+)\)"


def by_code(requests: DataFrame, recordings: DataFrame, score: Callable[[DataFrame], DataFrame], order: Sequence[Column]) -> DataFrame:
    """(query_id, recording_id, score) of requests whose code leads to a recording that can be trusted.

    Requests have query_id, raw_title, isrc; recordings have recording_id, title, isrc. Of a code's recordings the first by
    ``order`` counts. If the wanted title has a version tag, the recording's must have one too. ``score`` takes the
    joined rows and adds a column score, null where they do not match.
    """
    first = first_of(recordings.filter(T.text_or_empty(F.col("isrc")) != "").withColumn("code_", F.upper("isrc")), ["code_"], order)
    asked = requests.filter(T.text_or_empty(F.col("isrc")) != "").withColumn("code_", F.upper("isrc")).drop("isrc")
    pairs = asked.join(first, "code_").filter(~T.has_version_tag(F.col("raw_title")) | T.has_version_tag(F.col("title")))
    return score(pairs).filter(F.col("score") > 0).select("query_id", "recording_id", "score")


def tag_retried(requests: DataFrame, wants_tag: Column, search: Callable[[DataFrame], DataFrame], retry: Callable[[DataFrame], DataFrame], key: str, has_tag: Column, untagged_stays: bool = False) -> DataFrame:
    """Hits of ``search`` (a row of each request at most), and for those that lack the version tag that was wanted, of a second round.

    ``retry`` gets only the requests that want a tag and whose hit has none (or that have no hit); of its rows only tagged ones count. A tagged hit
    stays (``outcome`` 'hit'), a tagged second one comes in its place ('retry'), and an untagged hit goes, or stays as
    'untagged' with ``untagged_stays``. Requests without any row are left out. ``has_tag`` is a condition of hits.
    """
    marked = requests.withColumn("wants_", F.coalesce(wants_tag, F.lit(False)))
    hits = written(search(requests), "hits").join(marked.select(key, "wants_"), key).withColumn("tagged_", F.coalesce(has_tag, F.lit(False)))
    fine = hits.filter(~F.col("wants_") | F.col("tagged_"))
    again = written(marked.filter("wants_").drop("wants_").join(fine.select(key), key, "left_anti"), "asked-again")
    second = written(retry(again).filter(has_tag), "second-hits")
    out = fine.drop("wants_", "tagged_").withColumn("outcome", F.lit("hit")).unionByName(second.withColumn("outcome", F.lit("retry")))
    if untagged_stays:
        rest = hits.filter(F.col("wants_") & ~F.col("tagged_")).drop("wants_", "tagged_").join(second.select(key), key, "left_anti")
        out = out.unionByName(rest.withColumn("outcome", F.lit("untagged")))
    return out


def best_release(releases: DataFrame, key: str | Sequence[str], title: Column, wanted_title: Column, likeness: Column, asks_album: Column, order: Sequence[Column]) -> DataFrame:
    """One release of each recording: alternative versions count only if the wanted title is one, or if there are no others; of the rest the one most like
    the album that is asked for, or the first by ``order`` (total) if none is."""
    other = T.is_alternative(T.text_or_empty(title)) & ~T.is_alternative(T.text_or_empty(wanted_title))
    rank = F.when(asks_album, F.coalesce(likeness, F.lit(0.0))).otherwise(0.0)
    return first_of(releases.withColumns({"alternative_": other.cast("int"), "likeness_": rank}), [key] if isinstance(key, str) else key, [F.col("alternative_"), F.desc("likeness_"), *order]).drop("alternative_", "likeness_")


def recording_confidence(score: Column, isrc: Column, isrc_hint: Column, wanted_ms: Column, found_ms: Column, trusted: Column) -> Column:
    """Name of the confidence of a recording: its code is the asked one, or by score; a good one needs agreeing durations too."""
    exact = trusted & (T.text_or_empty(isrc) != "") & (F.upper(T.text_or_empty(isrc)) == F.upper(T.text_or_empty(isrc_hint)))
    known = (F.coalesce(wanted_ms, F.lit(0)) != 0) & (F.coalesce(found_ms, F.lit(0)) != 0)
    near = ~known | (F.abs(wanted_ms - found_ms) <= TOLERANCE_MS)
    return F.when(exact, "isrc").when(score >= CONFIDENCE["high"], "high").when((score >= 0.70) & near, "good").when(score >= CONFIDENCE["low"], "low").otherwise("none")


def blended_confidence(title: Column, artist: Column) -> Column:
    """Name of the confidence of a catalog match, from similarities of title and artist."""
    blend = F.round(0.6 * title + 0.4 * artist, 12)
    return F.when(blend >= 0.90, "high").when(blend >= 0.75, "good").when(blend >= 0.55, "low").otherwise("none")


def recording_result(best: DataFrame, details: DataFrame, releases: DataFrame, by: Sequence[str] = ("query_id", "recording_id")) -> DataFrame:
    """What a resolved request is: query_id, recording_id, score, isrc, confidence, release_id, album_score, album_is_deluxe, title_has_tag.

    ``best`` (a row of each request) has query_id, recording_id, score, own_isrc, raw_title, album_hint (normal form), isrc_hint, duration_ms, trusted; ``details``
    recording_id, isrc, length_ms; ``releases`` pos, release_id, release_title and ``likeness`` to the hint. Both have the columns ``by``, which say whose releases
    they are. Scores under LEAST_SCORE are misses.

    The pick depends on ``by`` and on two conditions of the request only, so releases that many requests share are picked from once for all of them.
    """
    hint = T.text_or_empty(F.col("album_hint"))
    rows = best.filter(F.col("score") >= LEAST_SCORE).join(details.select("recording_id", F.col("isrc").alias("detail_isrc"), "length_ms"), "recording_id")
    isrc = F.coalesce(F.nullif(F.col("detail_isrc"), F.lit("")), F.col("own_isrc"), F.lit(""))
    rows = rows.withColumn("isrc", isrc)
    rows = rows.withColumn("confidence", recording_confidence(F.col("score"), F.col("isrc"), F.col("isrc_hint"), F.col("duration_ms"), F.col("length_ms"), F.col("trusted")))
    rows = rows.withColumns({"asks_": hint != "", "other_": T.is_alternative(T.text_or_empty(F.col("raw_title")))})
    keys = [*by, "asks_", "other_"]
    asked = rows.groupBy(*keys).agg(F.min("raw_title").alias("wanted_"))
    picked = best_release(asked.join(releases.select(*by, "pos", "release_id", "release_title", "likeness"), [*by]), keys, F.col("release_title"), F.col("wanted_"), F.col("likeness"), F.col("asks_"), [F.col("pos")])
    picked = written(picked.select(*keys, "release_id", "release_title", F.when(F.col("asks_"), F.col("likeness")).otherwise(0.0).alias("album_score")), "picked-releases")
    out = rows.join(picked, keys, "left")
    return out.select(
        "query_id", "recording_id", "score", "isrc", "confidence", "release_id", F.coalesce("album_score", F.lit(0.0)).alias("album_score"),
        T.is_deluxe(F.col("release_title")).alias("album_is_deluxe"), T.has_version_tag(F.col("raw_title")).alias("title_has_tag"),
    )


def artists_by_code(requests: DataFrame, recordings: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(query_id, artists, first_artist): the credits of the first recording of each request's code that is no unwanted alternative version.

    Requests have query_id, isrc, raw_title; recordings have isrc, title and credits (an ordered array of name, joinphrase). Each
    name is followed by its own phrase; null phrases join without one. Requests without such a recording are left out.
    """
    asked = requests.filter(T.text_or_empty(F.col("isrc")) != "").select("query_id", F.upper("isrc").alias("code_"), "raw_title")
    rows = asked.join(recordings.withColumn("code_", F.upper("isrc")).drop("isrc"), "code_").filter(~alternative_rejected(F.col("title"), F.col("raw_title")))
    best = first_of(rows, ["query_id"], order)
    return best.select("query_id", credited(F.col("credits")).alias("artists"), T.text_or_empty(F.get("credits", F.lit(0))["name"]).alias("first_artist"))


def artist_collection(own: Column, artist: Column, raw_title: Column, found: Column, trusted: Sequence[Column]) -> Column:
    """A record's list of artists: the first trusted list, else the catalog's if it names several, else with the guest of the title, else the artist."""
    best = F.coalesce(*[F.nullif(T.text_or_empty(t), F.lit("")) for t in trusted])
    several = T.matches(T.text_or_empty(found), SEVERAL) & F.contains(T.artist_list(found), F.lit(","))
    guest = F.trim(F.regexp_extract(T.text_or_empty(raw_title), GUESTS, 1))
    now = F.coalesce(F.nullif(T.text_or_empty(own), F.lit("")), T.text_or_empty(artist))
    there = F.contains(F.lower(T.text_or_empty(artist)), F.lower(guest)) | F.contains(F.lower(now), F.lower(guest))
    return F.when(best.isNotNull(), T.artist_list(best)).when(several, T.artist_list(found)).when((guest != "") & ~there, T.artist_list(F.concat(now, F.lit(", "), guest))).when(guest != "", F.coalesce(own, F.lit(""))).otherwise(now)


def artist_country(candidates: DataFrame, key: str, likeness: str, pos: str, country: str) -> DataFrame:
    """(key, country) of the candidate artist that is most like the asked one, if it is at least COUNTRY; ties to the first."""
    best = first_of(candidates, [key], [F.desc(likeness), F.col(pos)])
    return best.filter(F.col(likeness) >= COUNTRY).select(key, F.col(country).alias("country"))


def names_agree(title: Column, has_artist: Column, artist: Column) -> Column:
    """Whether two records agree by name, from similarities; an artist that is not known does not contradict."""
    return (title >= SAME_TITLE) & (~has_artist | (artist >= SAME_ARTIST))


def search_album(own: Column, found: Column) -> Column:
    """The album to search by: the recording's, unless there is none or the own one names a deluxe edition."""
    found = T.text_or_empty(found)
    return F.when((found != "") & ~T.is_deluxe(own), found).otherwise(T.text_or_empty(own))


def forced_numbers(track: Column, disc: Column, found_track: Column, found_disc: Column, confidence: Column, wants_tag: Column, has_tag: Column) -> dict[str, Column]:
    """Track and disc numbers: the recording's, if it is good or better and its version tag agrees, else the own ones."""
    sure = confidence.isin("isrc", "high", "good") & (~wants_tag | has_tag)
    pick = lambda new, old: F.coalesce(F.when(sure, F.nullif(new, F.lit(0))), old)
    return {"track_number": pick(found_track, track), "disc_number": pick(found_disc, disc)}


def quoted_term(field: str, value: Column) -> Column:
    """A term of a fielded query; values of several words are quoted."""
    return F.concat(F.lit(f"{field}:"), F.when(F.contains(value, F.lit(" ")), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value))


def recording_query(title: Column, artist: Column, album: Column, with_tag: bool = False) -> Column:
    """A fielded query for a recording: its title without brackets, the first artist, the title's first guest, the album.

    ``with_tag`` adds the words of the title's first bracket, without guests, to the title.
    """
    title = T.text_or_empty(title)
    plain = T.stripped(T.without(title, QUERY_REMARKS))
    core = F.coalesce(F.nullif(T.without_brackets(plain), F.lit("")), plain)
    tag = F.regexp_replace(T.without(T.stripped(F.regexp_extract(title, QUERY_TAG, 1)), QUERY_GUESTS), r"^[ \[\]()\-]+|[ \[\]()\-]+$", "")
    name = F.when(tag != "", F.concat(core, F.lit(" "), tag)).otherwise(core) if with_tag else core
    guest = T.stripped(F.substring_index(T.stripped(F.regexp_extract(title, f"(?iuU){QUERY_GUESTS}", 1)), ",", 1))
    there = lambda field, value, known: F.when(known != "", quoted_term(field, value))
    by = T.text_or_empty(artist)
    return F.concat_ws(" AND ", there("recording", name, core), there("artist", T.primary_artist(by), by), there("artist", guest, guest), there("release", album, T.text_or_empty(album)))


def plain_term(c: Column) -> Column:
    """A term of a free query: ASCII letters, digits, apostrophes and underscores, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(T.folded(T.text_or_empty(c)), r"[^\w\s']", " "), r"\s{2,}", " "))


def fielded_query(**fields: Column) -> Column:
    """A query that asks field by field for plain terms; fields without a term are left out."""
    terms = [F.when(plain_term(c) != "", F.concat(F.lit(f'{name}:"'), plain_term(c), F.lit('"'))) for name, c in fields.items()]
    return F.concat_ws(" ", *terms)


def free_query(*fields: Column) -> Column:
    """All plain terms of a query without fields."""
    return F.concat_ws(" ", *[F.when(T.text_or_empty(c) != "", plain_term(c)) for c in fields])
