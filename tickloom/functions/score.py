"""Additive reversal score over feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.params import SCORE_WEIGHTS


def _points(condition: Column, points: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(points)).otherwise(F.lit(0))


def reversal_score(weights: dict | None = None, col=F.col) -> Column:
    """Score of a feature row; NULL when the feed is stale or the 60 s slope is NULL or flat.

    Every term is symmetric in the trend direction; a missing operand adds nothing.
    """
    unknown = set(weights or {}) - set(SCORE_WEIGHTS)
    if unknown:
        raise ValueError(f"unknown score weight(s): {sorted(unknown)}")
    w = {**SCORE_WEIGHTS, **(weights or {})}
    slope = col("slope_60")
    d = F.signum(slope)
    falling = d < 0

    def toward(low: str, high: str) -> Column:
        return F.when(falling, col(low)).otherwise(col(high))

    drop = col("ud_ask_delta_30")
    terms = [
        F.when(drop <= -w["ud_delta_deep"], F.lit(2))
         .when(drop <= -w["ud_delta_mild"], F.lit(1)).otherwise(F.lit(0)),
        _points(F.signum(col("slope_15")) == -d, 2),
        _points(F.signum(col("ret_30")) == -d, 1),
        _points(toward("dist_low", "dist_high") <= w["near_extreme_usd"], 1),
        _points(toward("new_low_count_15", "new_high_count_15") == 0, 1),
        _points(col("relative_obi") >= w["obi_improve"], 1),
        _points(col("momentum_decay") <= w["momentum_flat"], 1),
        _points(col("depth_ratio_underdog") < w["thin_depth_ratio"], -2),
        _points(toward("new_low_count_30", "new_high_count_30") >= w["new_extreme_burst"], -3),
        _points((F.signum(col("slope_15")) == d) & (F.signum(col("slope_30")) == d)
                & (F.abs(col("ret_15")) >= w["trend_ret_15"]), -2),
        _points((F.signum(col("fav_mid_delta_30")) == d)
                & (F.abs(col("fav_mid_delta_30")) >= w["fav_delta_30"]), -2),
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    usable = F.coalesce(col("feed_fresh"), F.lit(False)) & slope.isNotNull() & (slope != 0)
    return F.when(usable, total.cast("int"))
