"""The similarities of titles and names in SQL, against which the queries' Python distances are held.

Texts are taken to be in normal form: lower-case ASCII without outer white space.
"""

from __future__ import annotations

from .functions.distance import BLENDS, SHORT
from .functions.text import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_NUMBERS = r"\b(?:\d+|ii|iii|iv|v|vi|vii|viii|ix|x|pt\s*\d+)\b"


def common(pairs: str) -> str:
    """CTEs ending in lcs (p, q, n): the length of the longest common subsequence of each pair of ``pairs`` (a query of p, q), a row of the table a step."""
    return f"""need AS (SELECT DISTINCT p, q FROM ({pairs})),
    steps AS (
      SELECT p, q, 0 AS i, [0 for j in range(length(q) + 1)] AS line FROM need
      UNION ALL
      SELECT p, q, i + 1, [list_max([CASE WHEN k > 1 AND substr(q, k - 1, 1) = substr(p, i + 1, 1) THEN greatest(line[k], line[k - 1] + 1) ELSE line[k] END for k in range(1, j + 1)]) for j in range(1, length(q) + 2)]
      FROM steps WHERE i < length(p)
    ), lcs AS MATERIALIZED (SELECT p, q, line[length(q) + 1] AS n FROM steps WHERE i = length(p))"""


def basic(a: str, b: str, n: str) -> str:
    """Distance of two texts of letters and digits, given the length n of their common subsequence."""
    return f"""CASE WHEN {a} = {b} THEN 0 WHEN {a} = '' OR {b} = '' THEN 1 WHEN least(length({a}), length({b})) <= {SHORT} THEN 1 - jaro_winkler_similarity({a}, {b})
               ELSE 1 - 2.0 * {n} / (length({a}) + length({b})) END"""


def likeness(pairs: str, more: str = "SELECT '' AS p, '' AS q WHERE false") -> str:
    """CTEs ending in likeness (a, b, sim): title_similarity of the pairs of ``pairs`` (a query of a, b). lcs also has the pairs of ``more`` (p, q)."""
    share = " ".join(f"WHEN least(length(a), length(b)) <= {n} THEN {w}" for n, w in BLENDS)
    return f"""asked_pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM ({pairs})),
    tokens AS (SELECT a, b, list_sort(list_distinct([w for w in string_split(a, ' ') if w <> ''])) AS x, list_sort(list_distinct([w for w in string_split(b, ' ') if w <> ''])) AS y FROM asked_pairs),
    sets AS MATERIALIZED (SELECT *, array_to_string([w for w in x if list_contains(y, w)], ' ') AS c, array_to_string([w for w in x if NOT list_contains(y, w)], ' ') AS l, array_to_string([w for w in y if NOT list_contains(x, w)], ' ') AS r FROM tokens),
    {common(f"SELECT a AS p, b AS q FROM asked_pairs UNION SELECT l, r FROM sets UNION ({more})")},
    sized AS (
      SELECT s.*, CASE WHEN a = '' AND b = '' THEN 1 ELSE 2.0 * own.n / (length(a) + length(b)) END AS ratio, rest.n AS rest,
             length(c) + (CASE WHEN c <> '' THEN 1 ELSE 0 END) + length(l) AS la, length(c) + (CASE WHEN c <> '' THEN 1 ELSE 0 END) + length(r) AS lb
      FROM sets s JOIN lcs own ON own.p = a AND own.q = b JOIN lcs rest ON rest.p = l AND rest.q = r
    ), token_sets AS (
      SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN c <> '' AND (l = '' OR r = '') THEN 1
                     ELSE greatest(1 - (length(l) + length(r) - 2.0 * rest) / (la + lb), CASE WHEN c <> '' THEN greatest(1 - (la - length(c)) / (length(c) + la), 1 - (lb - length(c)) / (length(c) + lb)) ELSE 0 END) END AS token_set,
             list_distinct([w for w in regexp_extract_all(a, '\\w+') if w NOT IN ({_STOP})]) AS wa, list_distinct([w for w in regexp_extract_all(b, '\\w+') if w NOT IN ({_STOP})]) AS wb,
             list_sort(list_distinct(regexp_extract_all(a, '{_NUMBERS}'))) = list_sort(list_distinct(regexp_extract_all(b, '{_NUMBERS}'))) AS same_numbers,
             CASE {share} ELSE 0.6 END AS share
      FROM sized
    ), blended AS (
      SELECT *, share * token_set + (1 - share) * ratio AS s0, CASE WHEN len(wa) > 0 AND len(wb) > 0 THEN len(list_intersect(wa, wb)) / greatest(len(wa), len(wb)) END AS overlap FROM token_sets
    ), worded AS (SELECT *, (CASE WHEN overlap = 1 THEN least(1, s0 + 0.08) WHEN overlap = 0 AND len(wa) > 1 THEN s0 - 0.1 ELSE s0 END) - (CASE WHEN same_numbers THEN 0 ELSE 0.4 END) AS s1 FROM blended
    ), likeness AS MATERIALIZED (
      SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 WHEN ratio < 0.45 THEN 0
                        ELSE greatest(0, s1 * CASE WHEN least(length(a), length(b)) / greatest(length(a), length(b)) >= 0.5 THEN 1
                                                   WHEN contains(a, b) OR contains(b, a) THEN 0.85 + 0.15 * least(length(a), length(b)) / greatest(length(a), length(b))
                                                   ELSE 0.5 + 0.5 * least(length(a), length(b)) / greatest(length(a), length(b)) END) END AS sim
      FROM worded
    )"""


def track_scores(rows: str, least: float) -> str:
    """CTEs ending in scored: ``rows`` (a table of row columns, title, artist, hint, ms, name, by_name, album, cand_ms, kind) with base, the score of track_scores.

    For names without remarks, whose only edition word is 'standard'; scores under ``least`` are null. Needs lcs (see common) of the letters and
    digits of titles and names, of artists, and of hints and albums.
    """
    letters = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
    standard = lambda c: f"regexp_matches(lower({c}), '\\bstandard\\b')"
    return f"""lettered AS (SELECT *, {letters("title")} AS x1, {letters("name")} AS y1, {letters("artist")} AS x2, {letters("by_name")} AS y2, {letters("hint")} AS x3, {letters("album")} AS y3 FROM {rows}),
    apart AS (
      SELECT r.*, {basic("x1", "y1", "a.n")} AS d_title, CASE WHEN x2 <> '' AND contains(y2, x2) THEN 0 ELSE {basic("x2", "y2", "b.n")} END AS d_artist, {basic("x3", "y3", "c.n")} AS d_album,
             CASE WHEN y1 <> '' AND length(y1) < length(x1) AND starts_with(x1, y1) THEN 1 - length(y1) / length(x1) ELSE 0 END AS cut
      FROM lettered r JOIN lcs a ON a.p = x1 AND a.q = y1 JOIN lcs b ON b.p = x2 AND b.q = y2 JOIN lcs c ON c.p = x3 AND c.q = y3
    ), effective AS (SELECT *, least(1, greatest(0, d_title + 0.3 * cut)) AS eff FROM apart
    ), penalised AS (
      SELECT *, 6 * eff + 3 * (CASE WHEN eff < 0.08 THEN d_artist * 0.5 ELSE d_artist END)
             + CASE WHEN coalesce(ms, 0) <> 0 AND coalesce(cand_ms, 0) <> 0 THEN 2 * least(1, greatest(0, (abs(cand_ms - ms) - 2000) / 15000)) ELSE 0 END
             + CASE WHEN hint = '' THEN 3.5 + 0.5 * 0.5 ELSE 2 * d_album END
             + CASE WHEN hint <> '' AND {standard("hint")} <> {standard("album")} THEN 2 WHEN hint = '' AND {standard("album")} THEN 2 ELSE 0 END AS total,
             6 + 3 + 3.5 + 0.5 + CASE WHEN coalesce(ms, 0) <> 0 AND coalesce(cand_ms, 0) <> 0 THEN 2 ELSE 0 END + CASE WHEN hint <> '' THEN 2 ELSE 0 END
             + CASE WHEN hint <> '' AND ({standard("hint")} OR {standard("album")}) THEN 2 WHEN hint = '' AND {standard("album")} THEN 2 ELSE 0 END AS most
      FROM effective
    ), scored AS MATERIALIZED (
      SELECT * EXCLUDE (total, most), CASE WHEN cut <= 0.25 AND eff <= 0.35 AND d_artist <= 0.8 AND 1 - total / most >= {least} THEN 1 - total / most END AS base FROM penalised
    )"""


def letter_pairs(rows: str) -> str:
    """The pairs that track_scores needs, as a query of p, q."""
    letters = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
    return " UNION ".join(f"SELECT {letters(a)} AS p, {letters(b)} AS q FROM {rows}" for a, b in (("title", "name"), ("artist", "by_name"), ("hint", "album")))
