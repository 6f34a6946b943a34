"""Typed settings: from texts as Column functions, and from a session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Texts that mean yes (a fixed value).
YES = ("true", "1", "yes", "y", "on")


def as_flag(c: Column, default: bool = False) -> Column:
    """Whether a text means yes; ``default`` for null."""
    return F.coalesce(F.lower(c).isin(*YES), F.lit(default))


def as_number(c: Column, kind: str, default: float) -> Column:
    """A text as a number of a type; ``default`` for null and for what is no number."""
    return F.coalesce(F.trim(c).try_cast(kind), F.lit(default).cast(kind))


def as_list(c: Column, default: str = "") -> Column:
    """The parts of a comma-separated text, stripped, without empty ones; those of ``default`` for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit(default)), ","), lambda x: F.trim(x)), lambda x: x != "")  # F.trim itself would get the index too


@dataclass(frozen=True)
class Settings:
    """What matching is run with. Defaults hold for what the session does not set."""

    country: str = "US"
    fallback_countries: tuple[str, ...] = ("GB", "CA")
    threshold: float = 0.5
    prefer_album: bool = False
    prefer_explicit: bool = True
    candidates: int = 3000

    @classmethod
    def load(cls, spark: SparkSession, prefix: str = "trackweave.") -> Settings:
        """Settings of a session, by names with a prefix, as in trackweave.prefer_album; ValueError for a number that is none."""

        def typed(text: str, default: Any) -> Any:
            if isinstance(default, bool):
                return text.strip().lower() in YES
            if isinstance(default, tuple):
                return tuple(x.strip() for x in text.split(",") if x.strip())
            return type(default)(text)

        given = {f.name: spark.conf.get(prefix + f.name, None) for f in fields(cls)}
        return cls(**{f.name: typed(given[f.name], f.default) for f in fields(cls) if given[f.name] is not None})
