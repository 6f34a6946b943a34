"""String distances as Arrow UDFs; each batch computes a distinct pair once."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import LETTERS, STOPWORDS

# What a distance may forgive, and the share of the gain that it then costs.
FORGIVEN = (
    (r"^the\s+", 0.1),
    (r"[\[\(]?\s*(ep|single)\s*[\]\)]?", 0.0),
    (r"[\[\(]?\s*(featuring|feat\.?|ft\.?)\s*.+", 0.1),
    (r"\(.*?\)", 0.3),
    (r"\[.*?\]", 0.3),
)
#: Share of the token-set ratio in a similarity, up to a length of the shorter text.
BLENDS = ((6, 0.15), (12, 0.25), (20, 0.45))
#: Up to this many characters Jaro-Winkler is used.
SHORT = 6

_FORGIVEN = [(re.compile(p, re.I), w) for p, w in FORGIVEN]
_NUMBERS = re.compile(r"\b(?:\d+|ii|iii|iv|v|vi|vii|viii|ix|x|pt\s*\d+)\b")


def to_alnum(s: str) -> str:
    s = re.sub("[®™©]", "", s)
    s = "".join(LETTERS.get(c, c) for c in s)
    return re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower())


def to_normal(s: str) -> str:
    return unicodedata.normalize("NFKD", re.sub("[´`]", "'", s)).encode("ascii", "ignore").decode().lower().strip()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table as the bits of one number."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u) | (row - u)
    return len(a) - (row & (1 << len(a)) - 1).bit_count()


def indel(a: str, b: str) -> float:
    """Insertions and deletions, as a share of both lengths."""
    return 1 - 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 0.0


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity: prefix weight 0.1 for up to 4 characters, above 0.7 only."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(first, second)) // 2
    m = len(first)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def basic_distance(a: str, b: str) -> float:
    """Distance on letters and digits: Jaro-Winkler for short texts, else indel."""
    a, b = to_alnum(a), to_alnum(b)
    if a == b:
        return 0.0
    if not a or not b:
        return 1.0
    return 1 - jaro_winkler(a, b) if min(len(a), len(b)) <= SHORT else indel(a, b)


def text_distance(a: str | None, b: str | None) -> float:
    """Distance of two names; articles, features and brackets cost only a part of what they differ by."""
    if a is None or b is None:
        return 0.0 if a is b else 1.0
    a, b = (s.lower().strip() for s in (a, b))
    if a == b:
        return 0.0

    def plain(s: str) -> str:
        for article in ("the", "a", "an"):
            if s.endswith(f", {article}"):
                s = f"{article} {s[: -len(article) - 2]}"
        return re.sub(r"\s*'\s*", "'", re.sub(r"\s*&\s*", " and ", s).strip()).strip()

    a, b = plain(a), plain(b)
    now, cost = basic_distance(a, b), 0.0
    for pattern, weight in _FORGIVEN:
        x, y = (pattern.sub("", s).strip() if pattern.search(s) else s for s in (a, b))
        if (x, y) != (a, b) and (then := basic_distance(x, y)) < now:
            cost += weight * (now - then)
            a, b, now = x, y, then
    return min(1.0, now + cost)


def token_set(a: str, b: str) -> float:
    """Similarity of two texts as sets of tokens: the shared tokens, and each side with its own ones."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 1.0
    space = 1 if both else 0
    la, lb = len(both) + space + len(left), len(both) + space + len(right)
    gap = len(left) + len(right) - 2 * common_subsequence(left, right)
    best = 1 - gap / (la + lb)
    if both:
        best = max(best, 1 - (la - len(both)) / (len(both) + la), 1 - (lb - len(both)) / (len(both) + lb))
    return best


def title_likeness(a: str | None, b: str | None) -> float:
    """Similarity of two titles; not symmetric: only a first title of several words pays for sharing none."""
    if not a or not b:
        return 0.0
    a, b = to_normal(a), to_normal(b)
    if a == b:
        return 1.0
    ratio = 1 - indel(a, b)
    if ratio < 0.45:
        return 0.0
    share = next((w for n, w in BLENDS if min(len(a), len(b)) <= n), 0.6)
    out = share * token_set(a, b) + (1 - share) * ratio
    x, y = (set(re.findall(r"\b\w+\b", s)) - set(STOPWORDS) for s in (a, b))
    if x and y:
        overlap = len(x & y) / max(len(x), len(y))
        if overlap == 1:
            out = min(1.0, out + 0.08)
        elif overlap == 0 and len(x) > 1:
            out -= 0.1
    if set(_NUMBERS.findall(a)) != set(_NUMBERS.findall(b)):
        out -= 0.4
    if a and b and (lengths := min(len(a), len(b)) / max(len(a), len(b))) < 0.5:
        out *= 0.85 + 0.15 * lengths if a in b or b in a else 0.5 + 0.5 * lengths
    return max(0.0, out)


def _column(f: Callable[[str | None, str | None], float], a: Column, b: Column) -> Column:
    def each(left: pd.Series, right: pd.Series, *_: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for pair in zip(left, right):
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    # named twice, which costs nothing, as Spark sends equal arguments once: it keeps the optimizer from moving what computes them into the call
    return F.pandas_udf(each, "double")(a, b, a, b)


def string_dist(a: Column, b: Column) -> Column:
    return _column(text_distance, a, b)


def basic_dist(a: Column, b: Column) -> Column:
    """Distance on letters and digits; null counts as empty."""
    return _column(lambda x, y: basic_distance(x or "", y or ""), a, b)


def title_similarity(a: Column, b: Column) -> Column:
    return _column(title_likeness, a, b)


#: Letters that a profile counts one by one; all others are counted together.
PROFILE = "abcdefghijklmnopqrstuvwxyz0123456789"
#: What equal words add to a similarity, and what different numbers take from it (as in title_likeness).
SAME_WORDS, OTHER_NUMBERS, LEAST_RATIO = 0.08, 0.4, 0.45


def profile(c: Column) -> Column:
    """How often a normal form has each letter of PROFILE, and all other characters. Computed once per text, not per pair."""
    counts = [F.length(c) - F.length(F.replace(c, F.lit(x))) for x in PROFILE]
    return F.array(*counts, F.length(F.regexp_replace(c, f"[{PROFILE}]", "")))


def numbers(c: Column) -> Column:
    """The numbers of a normal form, Roman ones too, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(_NUMBERS.pattern), 0)))


def ratio_bound(a: Column, b: Column) -> Column:
    """The largest share of common characters that two texts of these profiles can have in order."""
    total = lambda p: F.aggregate(p, F.lit(0), lambda s, n: s + n)
    common = total(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    return F.coalesce(F.try_divide(2.0 * common, total(a) + total(b)), F.lit(1.0))


def likeness_bound(a: Column, b: Column, profile_a: Column, profile_b: Column, numbers_a: Column, numbers_b: Column) -> Column:
    """An upper bound of title_similarity of two normal forms, by their lengths, letter counts and numbers. Needs no Python."""
    short = F.least(F.length(a), F.length(b))
    share = F.lit(0.6)
    for n, w in reversed(BLENDS):
        share = F.when(short <= n, w).otherwise(share)
    ratio = ratio_bound(profile_a, profile_b)
    most = F.least(F.lit(1.0), share + (1 - share) * ratio + SAME_WORDS)
    other = F.when(numbers_a == numbers_b, most).otherwise(most - OTHER_NUMBERS)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(ratio < LEAST_RATIO, 0.0).otherwise(F.greatest(F.lit(0.0), other)) + 1e-9


def register(spark: SparkSession) -> None:
    """Make the distances usable in SQL."""
    for name, f in (("string_dist", text_distance), ("title_similarity", title_likeness), ("indel_distance", lambda a, b: indel(a or "", b or "")), ("jaro_winkler", lambda a, b: jaro_winkler(a or "", b or ""))):
        spark.udf.register(name, F.pandas_udf((lambda g: lambda a, b: pd.Series([g(x, y) for x, y in zip(a, b)], dtype="float64"))(f), "double"))
