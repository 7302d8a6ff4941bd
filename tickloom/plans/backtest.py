"""One backtest: raw ticks, window dimension and optional bars to results and a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import features, rolling, studies, triggers
from tickloom.operators.asof import dedupe_ticks
from tickloom.params import parameter_set
from tickloom.plans.staging import stage

WINDOW = ("series_key", "ws")


def prepare_ticks(raw: DataFrame, bars: DataFrame | None = None, *, window: Sequence[str] = WINDOW, time: str = "t",
                  seq: str | None = None, **bar_args) -> DataFrame:
    """Cleaned ticks with ``twap`` and ``rng``, at most one per window and second.

    A feed may repeat seconds; with ``seq`` (a column that orders them) the last tick of each second
    stays. Without it the raw ticks must already be distinct, as recorded tick tables are. Without bars the
    range is zero (the volatility filter is off) and there is no TWAP.
    """
    ticks = features.clean_ticks(raw if seq is None else dedupe_ticks(raw, window, time, seq))
    if bars is None:
        return ticks.withColumns({"rng": F.lit(0.0), "twap": F.lit(None).cast("double")})
    return rolling.tick_volatility(ticks, bars, **bar_args)


def with_score(ticks: DataFrame, window: Sequence[str] = WINDOW, *, spot: str = "twap",
               elapsed: str = "elapsed", **feature_args) -> DataFrame:
    """Add the reversal score; needed only when some parameter set has a score gate."""
    scored = features.feature_snapshot(ticks, window, spot=spot, elapsed=elapsed, **feature_args)
    return scored.select(*ticks.columns, "score")


def run_backtest(raw: DataFrame, windows: DataFrame, params: Mapping | None = None, *,
                 bars: DataFrame | None = None, window: Sequence[str] = WINDOW,
                 time_scale: int = 1, **bar_args) -> DataFrame:
    """Result row per decided window under one parameter set."""
    p = parameter_set(**(params or {}))
    ticks = prepare_ticks(raw, bars, **bar_args)
    score = None
    if p["min_reversal_score"] is not None:
        ticks, score = with_score(ticks, window, scale=time_scale), "score"
    return triggers.replay(ticks, windows, {"base": p}, window, score=score, time_scale=time_scale)


def backtest_report(results: DataFrame, windows: DataFrame, by: Sequence[str] = ("series_key",)
                    ) -> tuple[DataFrame, DataFrame]:
    """(summary per series, entries by side and price); the results are staged once."""
    kept = stage(results)
    return studies.run_report(kept, windows, by), studies.entry_distribution(kept, by)
