"""The provider cascade: records put together from what each provider found, stage by stage, each with its own rule of what may overwrite.

All providers' results are brought to the records by one shuffle; the stages are column expressions, one projection each.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as T
from ..operators import merge as G
from ..operators import resolver as Z
from ..operators import scoring as S
from ..operators.releases import trusted_isrc

#: Fields that stages change.
FIELDS = {
    "title": "string", "artist": "string", "album": "string", "album_artist": "string", "year": "string", "genre": "string", "label": "string", "country": "string", "artist_collection": "string", "isrc": "string",
    "cover_url": "string", "upc": "string", "sort_title": "string", "track_number": "int", "disc_number": "int", "duration_ms": "int", "explicit": "boolean", "compilation": "boolean",
}
#: What a provider's result may have beside the fields: how sure it is, what is known of its release, and dates.
FACTS = {"confidence": "string", "by_isrc": "boolean", "alternative": "boolean", "edition": "string", "first_date": "string", "release_date": "string"}
#: Providers in the order of the stages. A record has one result of each at most.
LOCAL, OPTIONAL, RECORDING, BY_CODE, CATALOG, FALLBACK = "local", "optional", "recording", "by_code", "catalog", "fallback"
PROVIDERS = (LOCAL, OPTIONAL, RECORDING, BY_CODE, CATALOG, FALLBACK)
#: Host of the catalog's covers, which need no other (a fixed value).
CATALOG_COVERS = "mzstatic.com/image"


def gathered(records: DataFrame, results: dict[str, DataFrame], key: str) -> DataFrame:
    """``records`` with a struct column for each provider, null where it found nothing.

    All results go through one union and one aggregate by key, which are one shuffle, and one join. Of several results of a provider for a record the
    smallest counts.
    """
    kinds = FIELDS | FACTS
    empty = F.lit(None).cast(f"struct<{','.join(f'{n}:{k}' for n, k in kinds.items())}>")
    payload = lambda df: F.struct(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
    rows = [df.filter(F.col(key).isNotNull()).select(key, F.lit(name).alias("provider_"), payload(df).alias("found_")) for name, df in results.items()]
    if not rows:
        return records.withColumns({name: empty for name in PROVIDERS})
    found = reduce(DataFrame.unionByName, rows).groupBy(key).agg(*[F.min(F.when(F.col("provider_") == name, F.col("found_"))).alias(name) for name in PROVIDERS])
    return records.join(found, key, "left")


def applied(df: DataFrame, provider: str, overwrite: Iterable[str] | dict[str, Column] = (), when: Column | None = None, leave: Iterable[str] = ()) -> DataFrame:
    """``df`` with a provider's fields put in: those in ``overwrite`` over what is there (under a condition, if it is a map), the others where nothing is.

    ``when`` says for which records at all; fields in ``leave`` are not touched.
    """
    rules = overwrite if isinstance(overwrite, dict) else dict.fromkeys(overwrite, True)
    out = {}
    for name, kind in FIELDS.items():
        if name not in leave:
            new = F.col(f"{provider}.{name}") if when is None else F.when(when, F.col(f"{provider}.{name}"))
            out[name] = G.merged(F.col(name), new, kind, rules.get(name, False))
    return df.withColumns(out)


def has(name: str) -> Column:
    return F.col(name).isNotNull()


def tag(c: Column) -> Column:
    return T.has_version_tag(T.text_or_empty(c))


def safe_code(edition_a: Column, edition_b: Column, isrc_a: Column, isrc_b: Column) -> Column:
    """Whether equal codes also mean releases of one form: a single or EP and an album are not; what is not known does not contradict."""
    a, b = F.coalesce(edition_a, F.lit("unknown")), F.coalesce(edition_b, F.lit("unknown"))
    short = lambda k: k.isin("single", "ep")
    return (F.upper(isrc_a) == F.upper(isrc_b)) & ((a == "unknown") | (b == "unknown") | (short(a) == short(b)))


def guarded(df: DataFrame) -> DataFrame:
    """``df`` with ``consistent_`` and ``richer_``: whether the catalog's result agrees with the recording, and whether its title is a longer spelling of the original one."""
    core = lambda c: T.normalize(T.without_brackets(c))
    cleaned = lambda c, kind: T.clean_text(T.text_or_empty(c), kind)
    texts = {
        "c0_": core(F.col("title_0")), "c1_": core(F.col(f"{CATALOG}.title")), "t0_": cleaned(F.col(f"{RECORDING}.title"), "title"), "t1_": cleaned(F.col(f"{CATALOG}.title"), "title"),
        "a0_": cleaned(F.col(f"{RECORDING}.artist"), "artist"), "a1_": cleaned(F.col(f"{CATALOG}.artist"), "artist"),
    }
    known = S.distances(df.withColumns(texts), {"core_": ("c0_", "c1_"), "same_": ("t0_", "t1_"), "by_": ("a0_", "a1_")}, D.title_similarity)
    found, original, own = F.col(CATALOG), F.col("title_0"), F.col(RECORDING)
    tags = G.tags_agree(tag(original), tag(found["title"]), tag(found["album"]))
    good = own["confidence"].isin("isrc", "high", "good")
    near = G.durations_agree(F.col("duration_0"), found["duration_ms"], Z.TOLERANCE_MS)
    names = Z.names_agree(F.col("same_"), F.col("a0_") != "", F.col("by_"))
    codes = T.text_or_empty(own["isrc"]), T.text_or_empty(found["isrc"])
    by_code = F.coalesce(own["confidence"] == "isrc", F.lit(False))
    consistent = G.consistent_match(found.isNotNull(), tags, F.when(F.coalesce(good, F.lit(False)), 1.0).otherwise(0.0), near, by_code, F.coalesce(found["by_isrc"], F.lit(False)), names, *codes, safe_code(own["edition"], found["edition"], *codes))
    title = T.text_or_empty(found["title"])
    richer = (title != "") & (title != original) & (F.col("c0_") != "") & (F.col("c1_") != "") & (F.col("core_") >= 0.92) & (F.length(title) > F.length(original))
    return known.withColumns({"consistent_": F.coalesce(consistent, F.lit(False)), "richer_": F.coalesce(richer, F.lit(False))}).drop(*texts, "core_", "same_", "by_")


def search_inputs(df: DataFrame) -> DataFrame:
    """What the catalog is searched by: title, album and code with their overrides, and the least score.

    The code is the most trusted one; the album is the recording's, unless the own one names a deluxe edition.
    """
    own = F.col(RECORDING)
    title = F.coalesce(F.nullif(F.trim("title_0"), F.lit("")), own["title"], F.lit(""))
    least = F.when(own["confidence"] == "low", 0.70).otherwise(0.55)
    return df.withColumns({"search_title": title, "search_album": Z.search_album(F.col("album"), own["album"]), "search_isrc": trusted_isrc(F.col(f"{OPTIONAL}.isrc"), own["isrc"], F.col("isrc")), "least_score": least})


def resolved(records: DataFrame, results: dict[str, DataFrame], key: str = "input_pos") -> DataFrame:
    """``records`` (FIELDS and ``raw_title``, ``raw_year``) after all stages, with ``source``, the provider that decided.

    Local hits overwrite all fields and end the cascade, but for track and disc numbers of a sure recording that they lack. The optional provider overwrites artists;
    the recording cover, genre and, unless it is a rejected alternative, the year; the provider by code also flags, and numbers if its title has the
    wanted tag; the catalog covers and flags, the title if it is richer, and numbers if it is consistent and the recording has none. Without a catalog
    hit the optional provider or the recording fill what is empty. The last provider fills what is still missing, all of it where neither
    catalog nor recording found anything. Then follow years, artist lists and the compilation flag.
    """
    df = records.withColumns({"title_0": T.text_or_empty(F.col("title")), "duration_0": F.col("duration_ms")})
    df = gathered(df, results, key)
    local, own, code, catalog = has(LOCAL), F.col(RECORDING), has(BY_CODE), has(CATALOG)
    open_ = ~local
    wants = tag(F.col("title_0"))
    sure = own.isNotNull() & own["confidence"].isin("isrc", "high", "good") & (~wants | tag(own["title"]))
    df = df.withColumns({f"forced_{n}": F.when(F.coalesce(sure, F.lit(False)), F.nullif(own[n], F.lit(0))) for n in ("track_number", "disc_number")})
    df = applied(df, LOCAL, list(FIELDS))
    df = df.withColumns({n: F.when(local & (F.coalesce(F.col(f"{LOCAL}.{n}"), F.lit(0)) == 0), F.coalesce(F.col(f"forced_{n}"), F.col(n))).otherwise(F.col(n)) for n in ("track_number", "disc_number")})
    df = applied(df, OPTIONAL, ("artist_collection", "artist"), open_)
    year = {"cover_url": F.lit(True), "genre": F.lit(True), "year": ~F.coalesce(own["alternative"], F.lit(False))}
    df = applied(df, RECORDING, year, open_)
    numbers = ~wants | tag(F.col(f"{BY_CODE}.title"))
    df = applied(df, BY_CODE, {**dict.fromkeys(("cover_url", "explicit", "genre", "year"), F.lit(True)), "track_number": numbers, "disc_number": numbers}, open_)
    df = guarded(df)
    free = {n: F.col("consistent_") & F.col(f"forced_{n}").isNull() for n in ("track_number", "disc_number")}
    before = F.col("title")
    df = df.withColumn("title_1", before)
    df = applied(df, CATALOG, {"cover_url": F.lit(True), "explicit": F.lit(True), "title": F.col("richer_"), **free}, open_, leave=("sort_title",))
    df = df.withColumns({n: F.when(open_ & catalog, F.coalesce(F.col(f"forced_{n}"), F.col(n))).otherwise(F.col(n)) for n in ("track_number", "disc_number")})
    df = df.withColumn("sort_title", F.when(open_ & F.col("richer_"), T.sort_name(F.col("title"))).otherwise(F.col("sort_title")))
    missed = open_ & ~catalog & ~code
    df = applied(df, OPTIONAL, (), missed)
    df = applied(df, RECORDING, (), missed & ~has(OPTIONAL))
    full = open_ & ~catalog & ~has(RECORDING) & ~code
    df = applied(df, FALLBACK, (), full)
    last = F.col(FALLBACK)
    elsewhere = ~F.contains(T.text_or_empty(F.col("cover_url")), F.lit(CATALOG_COVERS))
    fill = lambda n, kind: F.coalesce(G.missing(F.col(n), kind), F.when(open_, G.missing(last[n], kind)))
    df = df.withColumns({
        "cover_url": F.when(open_ & elsewhere, F.coalesce(G.missing(last["cover_url"], "string"), F.col("cover_url"))).otherwise(F.col("cover_url")),
        "track_number": fill("track_number", "int"), "disc_number": fill("disc_number", "int"), "genre": fill("genre", "string"),
    })
    dates = [own["first_date"], own["release_date"]]
    repaired = G.repaired_year(F.col("year"), dates, dates)
    df = df.withColumn("year", F.when(open_ & catalog, repaired).otherwise(F.col("year")))
    df = df.withColumn("year", F.coalesce(G.missing(F.col("year"), "string"), F.when(open_, F.nullif(T.text_or_empty(F.col("raw_year")), F.lit("")))))
    trusted = [F.col(f"{OPTIONAL}.artist_collection"), F.when(open_, F.col(f"{BY_CODE}.artist_collection"))]
    df = df.withColumn("artist_collection", Z.artist_collection(F.col("artist_collection"), F.col("artist"), F.col("raw_title"), F.when(local, F.col(f"{LOCAL}.artist")).otherwise(F.col(f"{CATALOG}.artist")), trusted))
    primary, owner = T.normalize(T.primary_artist(F.col("artist"))), T.normalize(F.col("album_artist"))
    df = df.withColumn("compilation", G.is_compilation(T.is_various(F.col("album_artist")), primary, owner, T.contains_word(owner, primary)))
    source = F.when(local, F.lit(LOCAL)).when(catalog, F.lit(CATALOG)).when(has(OPTIONAL) & ~code, F.lit(OPTIONAL)).when(code, F.lit(BY_CODE)).when(has(RECORDING), F.lit(RECORDING)).when(has(FALLBACK), F.lit(FALLBACK))
    kinds = {"string": "", "int": 0, "boolean": False}
    fields = [F.col(n) if n == "duration_ms" else F.coalesce(F.col(n), F.lit(kinds[k])).alias(n) for n, k in FIELDS.items()]
    return df.select(key, *fields, F.coalesce(source, F.lit("none")).alias("source"))
