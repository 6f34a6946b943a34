"""Penalties of a match as a map from their names to lists of values: what a score is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def penalties(**values: Column) -> Column:
    """A map of named penalties, each held within 0 and 1; a null value is a penalty that does not apply."""
    entries = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), F.array(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v.cast("double")))).alias("value"))) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def number_penalty(a: Column, b: Column) -> Column:
    """The values that two numbers add: 1 for each unit that they differ by, a single 0 if they are equal."""
    apart = F.abs(a - b)
    return F.when(apart > 0, F.array_repeat(F.lit(1.0), apart.cast("int"))).otherwise(F.array(F.lit(0.0)))


def with_penalty(own: Column, name: str, values: Column) -> Column:
    """``own`` with a list of further values under a name."""
    return combined(own, F.create_map(F.lit(name), values))


def combined(a: Column, b: Column) -> Column:
    """Both maps' values, joined by name."""
    empty = F.array().cast("array<double>")
    return F.map_zip_with(a, b, lambda _, x, y: F.concat(F.coalesce(x, empty), F.coalesce(y, empty)))


def _weight(weights: dict[str, float]):
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
    return lambda name: F.coalesce(F.try_element_at(table, name), F.lit(1.0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def contributions(own: Column, weights: dict[str, float]) -> Column:
    """An array of (name, share): what each penalty adds to the distance, the largest first, ties by name."""
    weight = _weight(weights)
    most = _total(F.transform(F.map_entries(own), lambda e: weight(e["key"]) * F.size(e["value"])))
    shares = F.transform(F.map_entries(F.map_filter(own, lambda _, v: F.size(v) > 0)), lambda e: F.struct((-F.coalesce(F.try_divide(weight(e["key"]) * _total(e["value"]), most), F.lit(0.0))).alias("less"), e["key"].alias("name")))
    return F.transform(F.array_sort(shares), lambda s: F.struct(s["name"].alias("name"), F.abs(s["less"]).alias("share")))


def distance(own: Column, weights: dict[str, float]) -> Column:
    """The weighted mean of all penalties; 0 if there are none."""
    return _total(F.transform(contributions(own, weights), lambda c: c["share"]))


def breakdown(df: DataFrame, key: str, column: str, weights: dict[str, float]) -> DataFrame:
    """(key, rank, name, share): one row for each penalty of a row's map, the largest contribution first."""
    rows = df.select(key, F.posexplode(contributions(F.col(column), weights)).alias("pos", "c"))
    return rows.select(key, (F.col("pos") + 1).alias("rank"), "c.name", "c.share")
