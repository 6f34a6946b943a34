"""Search strategies in stages: each runs only for the requests that no earlier one has settled."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .select_best import first_of

#: Open requests, and the best rows so far (None in the first stage), to scored rows.
Strategy = Callable[[DataFrame, DataFrame | None], DataFrame]

#: A score from which a request is settled.
HIGH_CONFIDENCE = 0.90


def staged(requests: DataFrame, strategies: dict[str, Strategy], key: str, score: str = "score", order: Sequence[Column] = (), accept: float = HIGH_CONFIDENCE) -> DataFrame:
    """The best row of each request over all strategies, with ``strategy`` and ``stage`` (from 1); requests without any are left out.

    A strategy gets the requests whose best score is still under ``accept`` and returns rows of ``key``, ``score`` and
    whatever else, the same columns for all. A later row replaces an earlier one only if its score is higher;
    within a strategy, ties go by ``order``, which should be total. The open requests and the best rows are written
    after each stage, so a stage costs what its own requests cost, and no stage runs when none is open. Null scores count as none.
    """
    left, best = written(requests, "requests"), None
    for stage, (name, strategy) in enumerate(strategies.items(), 1):
        found = first_of(strategy(left, best).filter(F.col(score).isNotNull()), [key], [F.desc(score), *order])
        found = written(found.withColumns({"strategy": F.lit(name), "stage": F.lit(stage)}), f"strategy-{stage}")
        best = found if best is None else written(first_of(best.unionByName(found), [key], [F.desc(score), F.col("stage")]), f"best-{stage}")
        if stage < len(strategies):
            left = written(left.join(found.filter(F.col(score) >= accept).select(key), key, "left_anti"), f"open-{stage}")
            if left.isEmpty():
                break
    return best


def first_stage_rows(requests: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]], key: str) -> DataFrame:
    """All rows of the first stage that has any for a request. A stage gets the requests that earlier ones had none for."""
    left, out = requests, None
    for n, stage in enumerate(stages, 1):
        found = written(stage(left), f"stage-{n}")
        out = found if out is None else out.unionByName(found)
        if n < len(stages):
            left = written(left.join(found.select(key).distinct(), key, "left_anti"), f"left-{n}")
            if left.isEmpty():
                break
    return out
