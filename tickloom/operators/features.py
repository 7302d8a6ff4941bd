"""Per-tick feature table (backward-looking only; labels live in another module)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import book
from tickloom.functions.numeric import ten_dp
from tickloom.functions.score import reversal_score
from tickloom.operators.asof import asof, backwards, ordered
from tickloom.operators.rolling import (
    add_new_extreme_counts,
    add_rolling_slopes,
    carry,
    freshness,
    memory_extremes,
    rolling_count,
    rolling_return,
)

# Horizons in seconds, memory of the spot series, freshness thresholds.
RETURN_SECONDS = (15, 30, 60, 90, 120)
SLOPE_SECONDS = (15, 30, 60)
EXTREME_SECONDS = (15, 30)
ASK_DELTA_SECONDS = (5, 10, 15, 30, 60)
MID_DELTA_SECONDS = (10, 30, 60)
SPOT_MEMORY = 130
MAX_AGE = 5
MIN_SAMPLES_60 = 45

FEATURES = (
    [f"ret_{n}" for n in RETURN_SECONDS] + [f"slope_{n}" for n in SLOPE_SECONDS]
    + ["acceleration", "momentum_decay", "dist_high", "dist_low",
       "new_low_count_15", "new_low_count_30", "new_high_count_15", "new_high_count_30",
       "time_since_low", "time_since_high"]
    + [f"ud_ask_delta_{n}" for n in ASK_DELTA_SECONDS]
    + [f"ud_mid_delta_{n}" for n in MID_DELTA_SECONDS]
    + [f"fav_mid_delta_{n}" for n in MID_DELTA_SECONDS]
    + ["obi_up", "obi_down", "relative_obi", "spread_underdog", "spread_favorite",
       "depth_ratio_underdog"]
    + [f"spot_token_divergence_{n}" for n in MID_DELTA_SECONDS]
)


def clean_ticks(raw: DataFrame) -> DataFrame:
    """Raw two-sided ticks with cleaned levels, the candidate side and its ask."""
    cleaned = raw.withColumns(book.clean_tick_columns())
    return cleaned.withColumn("cand", book.candidate_side(F.col("au"), F.col("ad"))).withColumn(
        "cand_ask", book.candidate_ask(F.col("au"), F.col("ad")))


def book_features(df: DataFrame) -> DataFrame:
    """Imbalance, spreads and depth ratio of one cleaned tick; needs no history."""
    role = book.role_columns()
    obi_up = book.order_imbalance(F.col("su"), F.col("sau"))
    obi_down = book.order_imbalance(F.col("sd"), F.col("sad"))
    cand, fav = (book.by_role(F.col("cand"), obi_up, obi_down),
                 book.by_role(F.col("cand"), obi_down, obi_up))
    return df.withColumns({
        "obi_up": obi_up, "obi_down": obi_down, "relative_obi": ten_dp(cand - fav),
        "spread_underdog": book.spread(role["cand_ask"], role["cand_bid"]),
        "spread_favorite": book.spread(role["fav_ask"], role["fav_bid"]),
        "depth_ratio_underdog": book.depth_ratio(
            role["cand_ask"], role["cand_ask_size"], role["fav_bid"], role["fav_bid_size"]),
    })


def trend_features(df: DataFrame, keys: Sequence[str], *, spot: str = "spot", time: str = "t",
                   elapsed: str = "elapsed", scale: int = 1, max_age: int = MAX_AGE,
                   min_samples: int = MIN_SAMPLES_60) -> DataFrame:
    """Freshness, returns, slopes and extremes of the spot series; NULL unless fresh.

    All frames share one partitioning by keys, so the data is shuffled once.
    """
    w = ordered(keys, time)
    v, age = F.col(spot), max_age * scale
    lags = (0, 10, *RETURN_SECONDS)
    step1 = {f"_s{n}": asof(v, w, n * scale, age) for n in lags}
    step1["spot_sample_count_60"] = rolling_count(v, w, 60 * scale)
    step1["feed_fresh"] = freshness(v, w, window=60 * scale, min_samples=min_samples, max_age=age)
    found = memory_extremes(v, F.col(time), w, SPOT_MEMORY * scale, backwards(keys, time))
    out = df.withColumns(step1 | {f"_m_{k}": c for k, c in found.items()})
    out = out.withColumns({f"_c_{k}": carry(F.col(f"_m_{k}"), w) for k in found})
    out = add_rolling_slopes(out, w, spot, elapsed, {f"_slope{n}": n * scale for n in SLOPE_SECONDS})
    out = add_new_extreme_counts(out, keys, spot, time, {n * scale: (f"_highs{n}", f"_lows{n}") for n in EXTREME_SECONDS})

    fresh = F.col("feed_fresh")
    only = lambda c: F.when(fresh, c)
    ret = {n: rolling_return(F.col("_s0"), F.col(f"_s{n}")) for n in (10, *RETURN_SECONDS)}
    cols = {f"ret_{n}": only(ret[n]) for n in RETURN_SECONDS}
    cols["_ret_10"] = only(ret[10])
    cols |= {f"slope_{n}": only(F.col(f"_slope{n}")) for n in SLOPE_SECONDS}
    cols["acceleration"] = only(ten_dp(F.col("_slope15") - F.col("_slope60")))
    cols["momentum_decay"] = only(ten_dp(F.abs(ret[60]) - F.abs(ret[15])))
    cols["dist_high"] = only(ten_dp(F.col("_c_high") - F.col("_s0")))
    cols["dist_low"] = only(ten_dp(F.col("_s0") - F.col("_c_low")))
    cols["time_since_high"] = only((F.col(time) - F.col("_c_t_high")).cast("double"))
    cols["time_since_low"] = only((F.col(time) - F.col("_c_t_low")).cast("double"))
    for n in EXTREME_SECONDS:
        cols |= {f"new_high_count_{n}": only(F.col(f"_highs{n}")), f"new_low_count_{n}": only(F.col(f"_lows{n}"))}
    out = out.withColumns(cols)
    scratch = [c for c in out.columns if c.startswith("_") and c != "_ret_10"]
    return out.drop(*scratch)


def book_delta_features(df: DataFrame, keys: Sequence[str], *, time: str = "t", scale: int = 1,
                        max_age: int = MAX_AGE) -> DataFrame:
    """Ask and mid changes of today's candidate and favourite side.

    The lagged value belongs to the side that is the candidate now, so all four series are
    looked up first and the role is chosen afterwards.
    """
    w, age = ordered(keys, time), max_age * scale
    ask_lags, mid_lags = (0, *ASK_DELTA_SECONDS), (0, *MID_DELTA_SECONDS)
    look = {}
    for side, ask, bid in (("u", "au", "bu"), ("d", "ad", "bd")):
        for n in ask_lags:
            look[f"_a{side}{n}"] = asof(F.col(ask), w, n * scale, age)
        for n in mid_lags:
            look[f"_b{side}{n}"] = asof(F.col(bid), w, n * scale, age)
    out = df.withColumns(look)

    cand = F.col("cand")
    mid = lambda side, n: book.midpoint(F.col(f"_a{side}{n}"), F.col(f"_b{side}{n}"))
    roles = {}
    for n in ask_lags:
        roles[f"_ca{n}"] = book.by_role(cand, F.col(f"_au{n}"), F.col(f"_ad{n}"))
    for n in mid_lags:
        roles[f"_cm{n}"] = book.by_role(cand, mid("u", n), mid("d", n))
        roles[f"_fm{n}"] = book.by_role(cand, mid("d", n), mid("u", n))
    out = out.withColumns(roles)

    cols = {f"ud_ask_delta_{n}": ten_dp(F.col("_ca0") - F.col(f"_ca{n}"))
            for n in ASK_DELTA_SECONDS}
    for n in MID_DELTA_SECONDS:
        cols[f"ud_mid_delta_{n}"] = ten_dp(F.col("_cm0") - F.col(f"_cm{n}"))
        cols[f"fav_mid_delta_{n}"] = ten_dp(F.col("_fm0") - F.col(f"_fm{n}"))
        base = F.col(f"_cm{n}")
        cols[f"_udr_{n}"] = F.when(base != 0, (F.col("_cm0") - base) / base)
    out = out.withColumns(cols)
    keep = {f"_udr_{n}" for n in MID_DELTA_SECONDS} | {"_ret_10"}
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in keep])


def cross_divergence(df: DataFrame) -> DataFrame:
    """Spot return minus candidate mid return; NULL when the feed is stale."""
    spot_ret = {10: F.col("_ret_10"), 30: F.col("ret_30"), 60: F.col("ret_60")}
    cols = {f"spot_token_divergence_{n}": ten_dp(spot_ret[n] - F.col(f"_udr_{n}"))
            for n in MID_DELTA_SECONDS}
    out = df.withColumns(cols)
    return out.drop("_ret_10", *[f"_udr_{n}" for n in MID_DELTA_SECONDS])


def feature_snapshot(ticks: DataFrame, keys: Sequence[str], *, spot: str = "spot",
                     time: str = "t", elapsed: str = "elapsed", scale: int = 1,
                     max_age: int = MAX_AGE, min_samples: int = MIN_SAMPLES_60,
                     weights: dict | None = None) -> DataFrame:
    """Every feature and the reversal score for each cleaned tick; one shuffle on ``keys``."""
    out = book_features(ticks)
    out = trend_features(out, keys, spot=spot, time=time, elapsed=elapsed, scale=scale,
                         max_age=max_age, min_samples=min_samples)
    out = book_delta_features(out, keys, time=time, scale=scale, max_age=max_age)
    out = cross_divergence(out)
    return out.withColumn("score", reversal_score(weights))
