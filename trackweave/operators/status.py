"""Status and path of records, folded from their events in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOWNLOADING, TAGGING, DONE, ERROR = "downloading", "tagging", "done", "error"
#: What each kind of event leads to, and from which states it may come.
TRANSITIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "download": (DOWNLOADING, (DOWNLOADING, ERROR)),
    "tag": (TAGGING, (DOWNLOADING, TAGGING)),
    "finalize": (DONE, (TAGGING,)),
    "fail": (ERROR, (DOWNLOADING, TAGGING)),
}


def folded_status(events: DataFrame, key: str, order: list[str], event: Column, path: Column, reason: Column, transitions: dict[str, tuple[str, tuple[str, ...]]] = TRANSITIONS, start: str = DOWNLOADING) -> DataFrame:
    """(key, status, path, final_path, error, history, refused): where each record stands after its events, in ``order`` (total within a key).

    An event of a kind that is not known, or that may not follow the present status, is refused and changes
    nothing. An event's path, if it is there and new, becomes the present one, and the one before goes to the history. The last
    accepted finalize gives final_path, the last fail error. A record's events are folded in one array: they are the
    steps of one file, so few.
    """
    steps = F.array_sort(F.collect_list(F.struct(*order, event.alias("event_"), path.alias("path_"), reason.alias("reason_"))))
    text = lambda v=None: F.lit(v).cast("string")
    begin = F.struct(text(start).alias("status"), text().alias("path"), text().alias("final_path"), text().alias("error"), F.array().cast("array<string>").alias("history"), F.lit(0).alias("refused"))

    def allowed(state: Column, e: Column) -> Column:
        out = F.lit(False)
        for kind, (_, before) in transitions.items():
            out = out | ((e["event_"] == kind) & state["status"].isin(*before))
        return F.coalesce(out, F.lit(False))

    def target(e: Column) -> Column:
        out = text()
        for kind, (to, _) in transitions.items():
            out = F.when(e["event_"] == kind, to).otherwise(out)
        return out

    def step(state: Column, e: Column) -> Column:
        ok, to, new = allowed(state, e), target(e), F.nullif(e["path_"], F.lit(""))
        moves = ok & new.isNotNull() & ~new.eqNullSafe(state["path"])
        now = F.when(moves, new).otherwise(state["path"])
        return F.struct(
            F.when(ok, to).otherwise(state["status"]).alias("status"), now.alias("path"), F.when(ok & (to == DONE), now).otherwise(state["final_path"]).alias("final_path"),
            F.when(ok & (to == ERROR), e["reason_"]).otherwise(state["error"]).alias("error"),
            F.when(moves & state["path"].isNotNull(), F.array_append(state["history"], state["path"])).otherwise(state["history"]).alias("history"),
            (state["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"),
        )

    lists = events.groupBy(key).agg(steps.alias("steps_"))
    return lists.select(key, F.aggregate("steps_", begin, step).alias("s")).select(key, "s.*")
