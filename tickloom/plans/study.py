"""Feature study: captured feature rows with labels, candidate orders, and their statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import features, labels, studies, triggers
from tickloom.params import parameter_set
from tickloom.plans.staging import stage


def capture_features(ticks: DataFrame, windows: DataFrame, params: Mapping | None = None, *,
                     window: Sequence[str] = ("series_key", "ws"), spot: str = "twap",
                     time_scale: int = 1, min_samples: int = features.MIN_SAMPLES_60) -> DataFrame:
    """Feature rows around the entry seconds, entry flag and look-ahead labels.

    ``ticks`` are prepared ticks (cleaned, with ``rng`` and the spot column). Features, labels
    and triggers all work on the event window, so they share one partitioning.
    """
    p = parameter_set(**(params or {}))
    live = stage(triggers.ticks_with_outcome(ticks, windows, window))  # five readers below
    feats = features.feature_snapshot(live, window, spot=spot, scale=time_scale, min_samples=min_samples)
    full = labels.label_columns(feats, window, scale=time_scale)
    score = "score" if p["min_reversal_score"] is not None else None
    source = full if score else live
    entries = triggers.first_trigger_entry(source, {"base": p}, window, score=score, time_scale=time_scale)
    exits = triggers.first_trigger_exit(entries, live, window)
    decided = triggers.windows_with_ticks(windows, live, window)
    stops = triggers.stop_times(entries, exits, decided, window)
    return triggers.capture_rows(full, stops, window, entry_after=p["entry_after"],
                                 entry_until=p["entry_until"], time_scale=time_scale)


def candidate_orders(captured: DataFrame, *, time_scale: int = 1) -> DataFrame:
    """Candidate orders, written once: every study below reads them several times."""
    return stage(studies.would_enter(captured, time_scale=time_scale))


def profile_candidates(orders: DataFrame, names: Sequence[str], *, series: str = "series_key",
                       start: str = "ws", window_len: int = 300, min_class: int = 100,
                       min_train: int = 500, min_keep: int = 200, top: int = 20,
                       rule_features: int = 12, negative_features: int | None = None) -> dict[str, DataFrame]:
    """Walk-forward profile: separation on val, rules from train judged on val, hard negatives.

    ``rule_features`` of the best separating features are swept for rules; hard negatives are
    profiled on all ``names`` or on the best ``negative_features``.
    """
    keys = [series]
    split = stage(studies.walk_forward_split(orders, keys, start, window_len))
    train, val = split.filter(F.col("split") == "train"), split.filter(F.col("split") == "val")
    profile = stage(studies.separation_profile(val, keys, names, "win_label", min_class))
    strength = F.abs(F.col("auc") - 0.5)
    ranked = studies.rank_top_per_key(profile, keys, strength, top, ["feature"])
    leaders = studies.rank_top_per_key(profile, keys, strength, rule_features, ["feature"]).drop("place")
    rules = studies.rule_threshold_sweep(train, val, keys, leaders, names, min_train=min_train,
                                         min_keep=min_keep)
    negatives = studies.hard_negative_profile(val, keys, names)
    if negative_features is not None:
        best = studies.rank_top_per_key(profile, keys, strength, negative_features, ["feature"]).select(*keys, "feature")
        negatives = negatives.join(best, [*keys, "feature"], "left_semi")
    return {
        "profile": ranked,
        "rules": studies.rank_top_per_key(rules, keys, F.col("ev"), top, ["feature", "q"]),
        "hard_negatives": negatives,
    }
