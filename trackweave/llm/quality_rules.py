"""Quality rules with risk-controlled thresholds.

Each rule compares a measure of a document with a cutoff. Cutoffs are selected by labelled documents, stratum by
stratum: a cutoff is safe if an exact binomial test on the good documents of the stratum shows that it rejects at
most a given share of good documents. A rule's cutoffs are tested from lenient to strict and testing stops at the
first that fails (a fixed sequence, which needs no correction); over rules and strata the level is divided by
their number (Bonferroni). A stratum with too few labels for a rule has no cutoff for it and keeps everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, small, utf8, written

#: Share of good documents that all rules together may reject in a stratum, and the chance that this fails anywhere.
RISK, LEVEL = 0.1, 0.05
#: Rules: a measure per document and its cutoffs, lenient first; a document over the cutoff is rejected.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2),
    "upper_share": (0.95, 0.8, 0.6, 0.5, 0.4, 0.3),
    "exclamations_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.3),
    "repeat_share": (0.18, 0.15, 0.1, 0.05),
    "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3),
}
#: Base rules.
LEAST_WORDS, MOST_REPEATS = 10, 20
#: Strata are looked up by broadcast up to this many.
BROADCAST_STRATA = 10_000

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
NOT_IN_WORDS = SPACE + bytes(range(0x80, 0xC0))  # with white space gone, bytes that do not start a code point
COLUMNS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, symbols_per_word double, upper_share double, exclamations_per_word double, repeat_share double, dup_line_share double"


def without(text: bytes, gone: bytes) -> int:
    """Number of bytes that are not in ``gone``."""
    return len(text.translate(None, gone))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found at least twice in the text, first finds included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    codes, limit = ids[:n], len(numbers)
    for k in range(1, width):
        if limit * len(numbers) >= 1 << 62:  # number the windows so far anew
            codes = np.unique(codes, return_inverse=True)[1]
            limit = n
        codes = codes * len(numbers) + ids[k : n + k]
        limit *= len(numbers)
    order = np.sort(codes)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    found = np.isin(codes, again)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= found
    return int(covered.sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            n += 1
            seen.add(line)
    return n - len(seen), n


def measures(text: bytes) -> tuple:
    words = text.split()
    n = len(words)
    chars, symbols = without(text, NOT_IN_WORDS), len(text) - without(text, SYMBOLS)
    dups, lines = duplicate_lines(text)
    repeats = repeated_words(words)
    upper, lower = len(text) - without(text, UPPER), len(text) - without(text, LOWER)
    return n, chars, symbols, dups, repeats, symbols / max(n, 1), upper / max(upper + lower, 1), text.count(b"!") / max(n, 1), repeats / max(n, 1), dups / max(lines, 1)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The measures of each row's whole text (null: empty) with its stratum (null: und)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for b in batches:
            rows = [measures(t or b"") for t in utf8(b.column(2))]
            columns = list(zip(*rows)) or [()] * 10
            arrays = [pa.array(c, pa.int64() if k < 5 else pa.float64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), F.col(text).alias("text"))
    return own.mapInArrow(each, COLUMNS)


#: Terms of the binomial that are smaller than this part of the sum so far end it.
LEAST_TERM = 1e-22


def at_most(k: int, n: int, p: float) -> float:
    """The chance of at most k successes in n trials of chance p.

    Terms are summed from the largest on, both ways, until they no longer count in a double.
    """
    if k >= n:
        return 1.0
    top = min(k, int((n + 1) * p))
    log = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    total = term = 1.0
    for i in range(top, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < LEAST_TERM * total:
            break
    term = 1.0
    for i in range(top + 1, k + 1):
        term *= (n - i + 1) * p / (i * (1 - p))
        total += term
        if term < LEAST_TERM * total:
            break
    return min(1.0, math.exp(log + math.log(total)))


def safe_cutoff(n: int, rejected: list[int], cutoffs: tuple[float, ...], risk: float, level: float) -> float | None:
    """The strictest cutoff of the sequence such that it and all more lenient ones reject a share of at most ``risk``, shown at ``level``."""
    best = None
    for cutoff, k in zip(cutoffs, rejected):
        if k > n * risk or at_most(k, n, risk) > level:
            break
        best = cutoff
    return best


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum that has good documents: stratum, n_good and a cutoff for each rule (null: none is safe).

    ``labels`` has doc_id and quality; a document is good if all its labels are 1. Documents that the base rules
    reject are left out, as no cutoff decides about them.
    """
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").alias("quality")).filter("quality = 1")
    rows = stats.filter(~base_failed()).join(good, F.col("doc_id") == F.col("of"))
    counts = [F.sum(F.when(F.col(rule) > c, 1).otherwise(0)).alias(f"{rule}_{i}") for rule, grid in RULES.items() for i, c in enumerate(grid)]
    counted = written(rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *counts), "rule-counts")
    each = level / max(1, counted.count() * len(RULES))

    def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = {"stratum": list(pdf.stratum), "n_good": list(pdf.n_good)}
            for rule, grid in RULES.items():
                out[rule] = [safe_cutoff(int(r.n_good), [int(getattr(r, f"{rule}_{i}")) for i in range(len(grid))], grid, risk / len(RULES), each) for r in pdf.itertuples()]
            yield pd.DataFrame(out).astype(dict.fromkeys(RULES, "float64"))

    return counted.mapInPandas(select, "stratum string, n_good long, " + ", ".join(f"{r} double" for r in RULES))


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per row of ``docs``: its measures, base_failed and kept.

    Null or empty text has no words and fails the base rules. Without labels nothing but the base rules
    rejects. Rows that repeat an id are judged alike. Empty tables give no rows; other columns may have any name.
    """
    stats = written(measured(docs, doc_id, text, stratum), "rule-measures")
    found = written(cutoffs(stats, labels, risk, level), "rule-cutoffs")
    found = small(found.select(F.col("stratum").alias("for"), *[F.col(r).alias(f"most_{r}") for r in RULES]), BROADCAST_STRATA)
    passed = F.lit(True)
    for rule in RULES:
        passed = passed & F.coalesce(F.col(rule) <= F.col(f"most_{rule}"), F.lit(True))
    return stats.join(found, F.col("stratum") == F.col("for"), "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passed).drop("for", *[f"most_{r}" for r in RULES])


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
