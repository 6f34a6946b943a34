"""Release kinds: what an album is (compilation, single, ep, album, unknown) and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_single_name, text_or_empty

SHORT = ("single", "ep")


def release_kind(kind: Column, name: Column, count: Column, verified: Column, eponymous: Column | None = None) -> Column:
    """Kind from a declared type, a name and a track count.

    ``verified`` says that the count is known to be right; ``eponymous`` that the name is the title of its track.
    """
    kind, name, count = text_or_empty(kind), text_or_empty(name), F.coalesce(count, F.lit(0))
    suffixed = is_single_name(name)
    few = count.between(1, 2)
    eponymous = F.lit(False) if eponymous is None else F.coalesce(eponymous, F.lit(False))
    last = F.lower(F.trim(F.element_at(F.split(name, "-"), -1)))
    return (
        F.when(kind == "Compilation", "compilation")
        .when((kind == "Single") | (suffixed & (kind == "")), "single")
        .when((kind == "EP") | (F.contains(name, F.lit("-")) & (last == "ep")), "ep")
        .when(few & (suffixed | eponymous), "single")
        .when(few & F.coalesce(verified, F.lit(False)), "single")
        .when((kind == "Album") | (count > 2), "album")
        .otherwise("unknown")
    )


def release_edition(kind: Column, name: Column, count: Column, verified: Column, eponymous: Column | None = None) -> Column:
    """(kind, track_count, verified) of a release."""
    sure = F.coalesce(verified, F.lit(False)) | (text_or_empty(kind) != "") | (F.coalesce(count, F.lit(0)) > 0)
    return F.struct(release_kind(kind, name, count, verified, eponymous).alias("kind"), F.coalesce(count, F.lit(0)).cast("int").alias("track_count"), sure.alias("verified"))


def is_short_form(kind: Column) -> Column:
    return kind.isin(*SHORT)


def is_confident(edition: Column) -> Column:
    """Whether the kind is known from more than an unverified name."""
    return (edition["kind"] != "unknown") & edition["verified"]


def described(edition: Column) -> Column:
    return F.format_string("%s (%d tracks, %s)", edition["kind"], edition["track_count"], F.when(edition["verified"], "verified").otherwise("unverified"))
