"""Scores of a query and a candidate, from Column expressions over precomputed distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as T
from ..functions.edition import is_confident, is_short_form

# Weights of penalties, and limits beyond which a candidate is rejected.
WEIGHTS = {
    "track_title": 6.0, "track_artist": 3.0, "track_length": 2.0, "album": 2.0, "album_edition": 2.0, "collection_type": 0.5, "single_bonus": 3.5,
    "track_id": 10.0, "live_mismatch": 3.0, "remix_mismatch": 3.0, "acoustic_mismatch": 3.0, "compilation_penalty": 2.0,
}
TITLE_REJECT, TRUNCATION_REJECT, ARTIST_REJECT, CLOSE_TITLE, EPONYMOUS = 0.35, 0.25, 0.8, 0.08, 0.15
GRACE_MS, SPAN_MS = 2000, 15000
CONFIDENCE = {"isrc": 1.0, "high": 0.9, "good": 0.75, "low": 0.55, "none": 0.0}



def distances(pairs: DataFrame, columns: dict[str, tuple[str, str]], f=D.string_dist) -> DataFrame:
    """``pairs`` with a distance column for each pair of columns. All are computed in one pass over the rows, and equal pairs of a batch once."""
    return pairs.select("*", *[f(F.col(a), F.col(b)).alias(name) for name, (a, b) in columns.items()])


def query_side(df: DataFrame) -> DataFrame:
    """Queries (query_id, title, artist, album_hint, duration_ms, isrc; texts in normal form) with what scores need of them, computed once per query."""
    for c in ("title", "artist", "album_hint", "isrc"):
        df = df.withColumn(c, F.trim(T.text_or_empty(F.col(c))))
    title, hint = F.col("title"), F.col("album_hint")
    flags = {"q_live": T.is_live(title) | T.is_live(hint), "q_remix": T.is_remix(title) | T.is_remix(hint), "q_acoustic": T.is_acoustic(title) | T.is_acoustic(hint), "q_single": T.is_single_name(hint)}
    return df.withColumns({"q_core": T.alnum(T.without_brackets(title)), "q_artist": T.alnum(F.col("artist")), "q_words": T.edition_tokens(hint), **flags})


def candidate_side(df: DataFrame) -> DataFrame:
    """Candidates (track_name, artist_name, collection_name, track_time_millis, cand_isrc, collection_type) with what scores need of them, computed once per candidate."""
    for c in ("track_name", "artist_name", "collection_name", "cand_isrc", "collection_type"):
        df = df.withColumn(c, F.trim(T.text_or_empty(F.col(c))))
    name, album = F.col("track_name"), F.col("collection_name")
    flags = {"c_live": T.is_live(name) | T.is_live(album), "c_remix": T.is_remix(name) | T.is_remix(album), "c_acoustic": T.is_acoustic(name) | T.is_acoustic(album), "c_single": T.is_single_name(album)}
    texts = {"c_core": T.alnum(T.without_brackets(name)), "c_artist": T.alnum(F.col("artist_name")), "c_words": T.edition_tokens(album), "c_base": T.without_single(album)}
    return df.withColumns({**texts, **flags, "c_various": F.lower("artist_name").isin(*T.VARIOUS_IN_SCORES)})


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def edition_penalty(hint: Column, candidate: Column) -> Column:
    """Penalty of two sets of edition words: differing ones less 0.3 of the common, over all; doubled if the sets differ."""
    common = F.size(F.array_intersect(hint, candidate))
    every = F.greatest(F.size(F.array_union(hint, candidate)), F.lit(1))
    share = clamp((F.size(F.array_union(hint, candidate)) - common - 0.3 * common) / every)
    return clamp(F.when(common == F.size(F.array_union(hint, candidate)), share).otherwise(2 * share))


#: Penalties that are added after that of the length.
AFTER_LENGTH = ("single_bonus", "collection_type", "album", "album_edition", "compilation_penalty")


def track_scores(pairs: DataFrame, least: float = 0.5, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Joined pairs of query_side and candidate_side with their score, null where rejected or below ``least``, and its ``terms``.

    The score is 1 less the weighted mean of the penalties that apply. Equal ISRCs count more than all else. ``terms`` depend on
    the texts alone: timed_score gives the score of pairs of the same texts and other durations from them.
    """
    hint = F.col("album_hint")
    a, b = F.col("q_core"), F.col("c_core")
    cut = F.when((b != "") & (F.length(b) < F.length(a)) & F.startswith(a, b), 1 - F.length(b) / F.length(a)).otherwise(0.0)
    contained = (F.col("q_artist") != "") & F.contains("c_artist", "q_artist")
    by_id = (F.col("isrc") != "") & (F.upper("isrc") == F.upper("cand_isrc"))
    p = distances(pairs, {"d_title": ("title", "track_name")}).withColumn("cut", cut).withColumn("eff", clamp(F.col("d_title") + 0.3 * F.col("cut")))
    # pairs that the title rejects need no other distance: theirs are of nulls
    open_ = by_id | ((F.col("cut") <= TRUNCATION_REJECT) & (F.col("eff") <= TITLE_REJECT))
    p = p.withColumns({"x_artist": F.when(open_ & ~contained, F.col("artist")), "x_hint": F.when(open_, hint), "x_title": F.when(open_, F.col("title"))})
    p = distances(p, {"d_artist": ("x_artist", "artist_name"), "d_album": ("x_hint", "collection_name"), "d_single": ("x_title", "c_base")})
    p = p.withColumn("d_artist", F.when(contained, 0.0).otherwise(F.col("d_artist"))).drop("x_artist", "x_hint", "x_title")
    cut, eff, d_artist = F.col("cut"), F.col("eff"), F.col("d_artist")
    asks_artist = (F.col("artist") != "") & ~F.col("c_various")
    single = F.col("collection_type").isin("Single", "EP") | F.col("c_single")
    eponymous = F.col("c_single") & (F.col("d_single") < EPONYMOUS)
    from_album = (hint != "") & ~F.col("q_single")
    hint_words, cand_words = F.col("q_words"), F.col("c_words")
    some_words = (F.size(hint_words) > 0) | (F.size(cand_words) > 0)
    other = F.when(eponymous & ~from_album, F.lit(0)).when(single & ~from_album, F.lit(1)).when(from_album & ~single, F.lit(2)).otherwise(F.lit(3))
    penalties: dict[str, tuple[Column, Column]] = {
        "track_title": (F.lit(True), eff),
        **{f"{k}_mismatch": (F.col(f"q_{k}") != F.col(f"c_{k}"), F.lit(1.0)) for k in ("live", "remix", "acoustic")},
        "track_artist": (asks_artist, F.when(eff < CLOSE_TITLE, d_artist * 0.5).otherwise(d_artist)),
        "single_bonus": (F.lit(True), F.when(other == 1, 0.3).when(other == 3, 1.0).otherwise(0.0)),
        "collection_type": (F.lit(True), F.when(other == 3, 0.5).otherwise(0.0)),
        "album": (hint != "", F.col("d_album")),
        "album_edition": (F.when(hint != "", some_words).otherwise(F.size(cand_words) > 0), F.when(hint != "", edition_penalty(hint_words, cand_words)).otherwise(1.0)),
        "compilation_penalty": (F.col("collection_type") == "Compilation", F.lit(1.0)),
    }
    costs = {name: F.when(applies, weights[name] * F.coalesce(value, F.lit(0.0))).otherwise(0.0) for name, (applies, value) in penalties.items()}
    before, most = F.lit(0.0), F.lit(0.0)
    for name, (applies, _) in penalties.items():
        before = before if name in AFTER_LENGTH else before + costs[name]
        most = most + F.when(applies, weights[name]).otherwise(0.0)
    rejected = (cut > TRUNCATION_REJECT) | (eff > TITLE_REJECT) | (asks_artist & (d_artist > ARTIST_REJECT))
    id_score = 1 - (weights["track_title"] * 0.1 * F.col("d_title") + weights["track_artist"] * 0.1 * F.col("d_artist")) / (weights["track_id"] + weights["track_title"] + weights["track_artist"])
    terms = F.struct(F.when(by_id, id_score).alias("id_score"), rejected.alias("rejected"), before.alias("before"), *[costs[name].alias(name) for name in AFTER_LENGTH], most.alias("most"))
    score = timed_score(F.col("terms"), length_penalty(F.col("duration_ms"), F.col("track_time_millis")), least, weights)
    return p.withColumn("terms", terms).withColumn("score", score).drop("d_title", "d_artist", "d_album", "d_single", "cut", "eff")


def length_penalty(asked_ms: Column, ms: Column) -> Column:
    """Penalty of two durations, null if either is null or 0."""
    known = (F.coalesce(asked_ms, F.lit(0)) != 0) & (F.coalesce(ms, F.lit(0)) != 0)
    return F.when(known, clamp((F.abs(ms - asked_ms) - GRACE_MS) / SPAN_MS))


def timed_score(terms: Column, length: Column, least: float = 0.5, weights: dict[str, float] = WEIGHTS) -> Column:
    """The score of track_scores from its terms and a length_penalty."""
    total = terms["before"] + F.coalesce(weights["track_length"] * length, F.lit(0.0))
    for name in AFTER_LENGTH:
        total = total + terms[name]
    most = terms["most"] + F.when(length.isNotNull(), weights["track_length"]).otherwise(0.0)
    score = F.coalesce(terms["id_score"], F.when(~terms["rejected"], 1 - total / most))
    return F.when(score >= least, score)


def common_scores(terms: Column, digits: int, least: float = 0.5, weights: dict[str, float] = WEIGHTS) -> list[Column]:
    """Rounded scores of durations that are near, far apart and missing. They depend on the texts alone, and most pairs of rows with these texts have one of them."""
    lengths = {"near": F.lit(0.0), "far": F.lit(1.0), "untimed": F.lit(None).cast("double")}
    return [F.round(timed_score(terms, length, least, weights), digits).alias(name) for name, length in lengths.items()]


def scores_by_duration(asked_ms: Column, ms: Column, digits: int, least: float = 0.5, weights: dict[str, float] = WEIGHTS) -> tuple[Column, Column]:
    """Whether rows with ``terms`` and their common_scores have a score, and the score, rounded.

    It falls with the gap of the durations, so where all common scores are there, none between is missing.
    """
    gap = F.abs(F.nullif(ms, F.lit(0)) - F.nullif(asked_ms, F.lit(0)))
    between = timed_score(F.col("terms"), (gap - GRACE_MS) / SPAN_MS, least, weights)
    pick = lambda common, own: F.when(gap.isNull(), common("untimed")).when(gap <= GRACE_MS, common("near")).when(gap >= GRACE_MS + SPAN_MS, common("far")).otherwise(own)
    there = lambda name: F.col(name).isNotNull()
    return (there("near") & there("far") & there("untimed")) | pick(there, between.isNotNull()), pick(F.col, F.round(between, digits))


def edition_likeness(base: Column, hint_words: Column, words: Column) -> Column:
    """A title similarity of two album names, less what their edition words differ in."""
    common = F.size(F.array_intersect(hint_words, words))
    differ = F.size(F.array_union(hint_words, words)) - common
    return F.when((base == 0) | (differ == 0), base).otherwise(F.greatest(F.lit(0.0), base - (0.18 * differ - 0.04 * common)))


def edition_score(known: Column, various: Column, edition: Column, hint: Column, likeness: Column, expects_short: Column) -> Column:
    """Bonus of a catalog album for a query: ``likeness`` is edition_likeness of the hint and the album."""
    kind = edition["kind"]
    asked = T.text_or_empty(hint) != ""
    return (
        F.when(~known, 0.0)
        .when(various | (kind == "compilation"), -0.5)
        .when(asked & (likeness >= 0.9), 1.0)
        .when(asked & (likeness >= 0.7), 0.5 + likeness * 0.3)
        .when(expects_short & ~is_confident(edition), -0.05)
        .when(expects_short, F.when(is_short_form(kind), 0.2).otherwise(-0.15))
        .when(asked, F.when(is_short_form(kind), -0.25).otherwise(likeness * 0.3 - 0.05))
        .otherwise(0.0)
    )


def recording_score(title: Column, artist: Column, delta_ms: Column) -> Column:
    """0.6 title and 0.4 artist similarity, a little more within five seconds; null under 0.55 and 0.5."""
    near = F.when(F.abs(delta_ms) <= 5000, 0.05).otherwise(0.0)
    return F.when((title >= 0.55) & (artist >= 0.5), 0.6 * title + 0.4 * artist + near)


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' words, lower case; 0 if both are empty."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(T.text_or_empty(c)), F.lit(r"(?U)\w+"), 0))
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def confidence(by_isrc: Column, score: Column, good: float = 0.7) -> Column:
    """Confidence of a match as a number."""
    return F.when(by_isrc, CONFIDENCE["isrc"]).when(score >= 0.9, CONFIDENCE["high"]).when(score >= good, CONFIDENCE["good"]).when(score >= 0.55, CONFIDENCE["low"]).otherwise(CONFIDENCE["none"])


def confidence_name(value: Column) -> Column:
    out = F.when(value >= CONFIDENCE["isrc"], "isrc")
    for name in ("high", "good", "low"):
        out = out.when(value >= CONFIDENCE[name], name)
    return out.otherwise("none")
