"""Parameter sweeps and grids: every set over every window from one scan of the ticks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import studies, triggers
from tickloom.plans.staging import stage


def param_sweep(ticks: DataFrame, windows: DataFrame, sets: Mapping[str, Mapping],
                window: Sequence[str], *, series: str, **replay_args) -> DataFrame:
    """Summary per named override and series."""
    results = triggers.replay(ticks, windows, sets, window, series=series, **replay_args)
    return studies.run_summary(results, ["param_id", series])


def split_results(results: DataFrame, series: str, start: str, window_len: int, windows: DataFrame) -> DataFrame:
    return studies.position_split(results, [series], start, window_len, windows=windows)


def _staged_replay(ticks: DataFrame, windows: DataFrame, sets: Mapping[str, Mapping], window: Sequence[str],
                   **replay_args) -> tuple[DataFrame, DataFrame]:
    """Results of all sets, replayed once and staged, and the windows they cover, once each."""
    results = stage(triggers.replay(ticks, windows, sets, window, **replay_args))
    first = next(iter(sets))
    return results, results.filter(F.col("param_id") == first).select(*window)


def param_grid_ranking(ticks: DataFrame, windows: DataFrame, sets: Mapping[str, Mapping],
                       window: Sequence[str], *, series: str, window_len: int = 300, top: int = 15,
                       **replay_args) -> DataFrame:
    """Sets ranked by the validation mean result summed over series (rounded to 4 decimals)."""
    start = [c for c in window if c != series][0]
    results, covered = _staged_replay(ticks, windows, sets, window, series=series, **replay_args)
    split = split_results(results, series, start, window_len, covered)
    stats = studies.run_summary(split, ["param_id", series, "split"])
    val = F.col("split") == "val"
    rounded = F.rint(F.col("pnl_per") * 1e4) / 1e4
    totals = stats.groupBy("param_id").agg(
        F.sum(F.when(~val, F.col("n"))).alias("train_n"), F.sum(F.when(val, F.col("n"))).alias("val_n"),
        F.sum(F.when(val, rounded)).alias("val_per"))
    # one row per parameter set reaches this ordering
    metric: Column = F.rint(F.col("val_per") * 1e6) / 1e6
    return studies.rank_top_per_key(totals.withColumn("_all", F.lit(1)), ["_all"], metric, top,
                                    ["param_id"]).drop("_all")


def marginal_report(ticks: DataFrame, windows: DataFrame, sets: Mapping[str, Mapping], loose: str,
                    tight: str, window: Sequence[str], *, series: str, window_len: int = 300,
                    **replay_args) -> DataFrame:
    """What a tighter set filters out and keeps, per series and train/val split."""
    start = [c for c in window if c != series][0]
    results, covered = _staged_replay(ticks, windows, {k: sets[k] for k in (loose, tight)}, window, **replay_args)
    split = split_results(results, series, start, window_len, covered)
    return studies.run_summary(triggers.marginal_split(split, loose, tight, window),
                               [series, "split", "split_group"])
