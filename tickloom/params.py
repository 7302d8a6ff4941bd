"""Strategy parameter rows and fixed values shared by rules, features and studies."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of one parameter set. None switches an optional gate off.
DEFAULT_PARAMS: dict[str, Any] = {
    "target_notional": 2.00,
    "entry_after": 90,
    "entry_until": 150,
    "take_profit_price": 0.99,
    "take_profit_multiple": None,
    "stop_loss_price": 0.0,
    "max_entry": 0.30,
    "min_entry": 0.15,
    "max_vol": 30.0,
    "min_reversal_score": None,
    "min_depth_ratio": None,
    "min_size": 5,
}

# Thresholds of the additive reversal score.
SCORE_WEIGHTS: dict[str, float] = {
    "near_extreme_usd": 3.0,
    "obi_improve": 0.5,
    "new_extreme_burst": 3,
    "trend_ret_15": 0.0002,
    "fav_delta_30": 0.02,
    "ud_delta_deep": 0.15,
    "ud_delta_mild": 0.08,
    "thin_depth_ratio": 0.27,
    "momentum_flat": 0.0001,
}

# Study band, entry seconds, sample-size flag, taker fee rate.
STUDY_BAND = (0.20, 0.30)
STUDY_SECONDS = (90, 150)
MIN_SAMPLE = 384
FEE_RATE = "0.07"
TAKE_PROFIT_CAP = 0.99
TRAIN_FRACTION = 0.7

# Axes, constants and per-series volatility caps of the published grid.
GRID_AXES: dict[str, list] = {
    "min_reversal_score": [None, 1, 2],
    "take_profit_multiple": [None, 1.5, 2.0, 2.5, 3.0],
}
GRID_FIXED: dict[str, Any] = {
    "take_profit_price": 0.99,
    "min_entry": 0.20,
    "max_entry": 0.30,
    "entry_until": 100,
}
GRID_SERIES_MAX_VOL = {"btc": 20.0, "eth": 0.65}  # for by_series=series_overrides("max_vol", ...)

_INT_FIELDS = ("entry_after", "entry_until", "min_size", "min_reversal_score")

#: Parameter sets per array literal; larger grids are cut into several literals.
PARAM_BATCH = 512
#: Key of a set's per-series overrides: {series: {parameter: value}}.
BY_SERIES = "by_series"


def parameter_set(**overrides: Any) -> dict[str, Any]:
    """Defaults with some fields replaced; unknown names are rejected."""
    unknown = set(overrides) - set(DEFAULT_PARAMS) - {BY_SERIES}
    unknown |= {n for own in overrides.get(BY_SERIES, {}).values() for n in set(own) - set(DEFAULT_PARAMS)}
    if unknown:
        raise ValueError(f"unknown parameter(s): {sorted(unknown)}")
    return {**DEFAULT_PARAMS, **overrides}


def series_sets(p: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    """Full parameter set of every series that has overrides of its own."""
    base = {k: v for k, v in p.items() if k != BY_SERIES}
    return {s: parameter_set(**{**base, **own}) for s, own in p.get(BY_SERIES, {}).items()}


def series_overrides(field: str, values: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    """Overrides of one parameter, as ``by_series`` takes them."""
    return {s: {field: v} for s, v in values.items()}


def parameter_grid(axes: Mapping[str, Iterable], **fixed: Any) -> dict[str, dict[str, Any]]:
    """Cartesian product of the axes on top of fixed overrides, keyed g00, g01, ..."""
    names = list(axes)
    combos = itertools.product(*(list(axes[n]) for n in names))
    return {
        f"g{i:02d}": parameter_set(**{**fixed, **dict(zip(names, combo))})
        for i, combo in enumerate(combos)
    }


def _literal(name: str, value: Any) -> Column:
    kind = "bigint" if name in _INT_FIELDS else "double"
    return F.lit(value).cast(kind).alias(name)


def param_structs(param_sets: Mapping[str, Mapping[str, Any]]) -> Column:
    """Array literal, one element per named parameter set: its row and the rows of series of its own."""
    if not param_sets:
        raise ValueError("at least one parameter set is needed")
    def row(pid: str, p: Mapping[str, Any]) -> Column:
        return F.struct(F.lit(pid).alias("param_id"), *[_literal(n, p[n]) for n in DEFAULT_PARAMS])

    rows = []
    for pid, p in param_sets.items():
        p = parameter_set(**p)
        own = [c for s, q in series_sets(p).items() for c in (F.lit(s), row(pid, q))]
        rows.append(F.struct(row(pid, p).alias("base"), (F.create_map(*own) if own else F.lit(None)).alias(BY_SERIES)))
    return F.array(*rows)


def param_batches(param_sets: Mapping[str, Mapping[str, Any]]) -> list[dict[str, Mapping[str, Any]]]:
    """The sets in pieces of PARAM_BATCH, those with per-series overrides apart from those without."""
    kinds = [{k: p for k, p in param_sets.items() if bool(p.get(BY_SERIES)) is own} for own in (False, True)]
    return [dict(list(kind.items())[i: i + PARAM_BATCH]) for kind in kinds for i in range(0, len(kind), PARAM_BATCH)]


def envelope(param_sets: Mapping[str, Mapping[str, Any]]) -> dict[str, Any]:
    """Loosest time and price bounds over all sets, used to prune rows before they are multiplied."""
    full = [q for p in param_sets.values() for q in (parameter_set(**p), *series_sets(p).values())]
    return {
        "entry_after": min(p["entry_after"] for p in full),
        "entry_until": max(p["entry_until"] for p in full),
        "min_entry": min(p["min_entry"] for p in full),
        "max_entry": max(p["max_entry"] for p in full),
        "max_vol": max(p["max_vol"] for p in full),
    }
