"""Top-of-book expressions over a two-sided tick (Up/Down best prices and sizes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.numeric import half_even, ten_dp


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (x <= 0)


def clean_price(x: Column) -> Column:
    """NULL, NaN and non-positive prices mean "no level"; the rest is rounded to cents."""
    x = x.cast("double")
    return F.when(~_missing(x), half_even(x, 2))


def clean_size(x: Column) -> Column:
    """Missing sizes count as zero; the rest is truncated to whole shares."""
    x = x.cast("double")
    return F.when(~_missing(x), F.floor(x).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def candidate_side(up_ask: Column, down_ask: Column, tie: str = "Up") -> Column:
    """Cheaper side by ask; a missing side loses; both missing gives Up."""
    if tie not in ("Up", "Down"):
        raise ValueError("tie must be 'Up' or 'Down'")
    up_wins = (up_ask <= down_ask) if tie == "Up" else (up_ask < down_ask)
    return (F.when(down_ask.isNull(), F.lit("Up"))
            .when(up_ask.isNotNull() & up_wins, F.lit("Up"))
            .otherwise(F.lit("Down")))


def candidate_ask(up_ask: Column, down_ask: Column) -> Column:
    return F.least(up_ask, down_ask)


def by_role(cand: Column, up: Column, down: Column) -> Column:
    """Value of the candidate side; swap the arguments for the favourite side."""
    return F.when(cand == "Up", up).otherwise(down)


def order_imbalance(bid_size: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    ratio = (bid_size - ask_size).cast("double") / total.cast("double")
    return F.when(total > 0, ten_dp(ratio))


def spread(ask: Column, bid: Column) -> Column:
    return ten_dp(ask - bid)


def midpoint(ask: Column, bid: Column) -> Column:
    return ten_dp((ask + bid) / 2)


def depth_ratio(cand_ask: Column, cand_ask_size: Column,
                fav_bid: Column, fav_bid_size: Column) -> Column:
    """Candidate ask notional over favourite bid notional; NULL if either side is empty."""
    usable = (cand_ask.isNotNull() & (cand_ask_size > 0)
              & (fav_bid > 0) & (fav_bid_size > 0))
    return F.when(usable, ten_dp((cand_ask * cand_ask_size) / (fav_bid * fav_bid_size)))


def best_of_levels(levels: Column, side: str) -> Column:
    """Best level of a nested array<struct<price,size>>: highest bid or lowest ask."""
    ordered = F.array_sort(levels)
    best = F.element_at(ordered, -1) if side == "bid" else F.element_at(ordered, 1)
    return F.when(F.size(levels) > 0, best)


def clean_tick_columns() -> dict[str, Column]:
    """All four prices and four sizes of a raw tick row, cleaned, under the same names."""
    prices = {c: clean_price(F.col(c)) for c in ("au", "bu", "ad", "bd")}
    sizes = {c: clean_size(F.col(c)) for c in ("su", "sau", "sd", "sad")}
    return {**prices, **sizes}


def role_columns(tie: str = "Up") -> dict[str, Column]:
    """Candidate and favourite views of a cleaned tick; needs au, bu, ad, bd and the sizes."""
    cand = F.col("cand")
    pick = lambda up, down: by_role(cand, F.col(up), F.col(down))
    return {
        "cand_ask": pick("au", "ad"), "cand_bid": pick("bu", "bd"),
        "cand_ask_size": pick("sau", "sad"), "cand_bid_size": pick("su", "sd"),
        "fav_ask": pick("ad", "au"), "fav_bid": pick("bd", "bu"),
        "fav_ask_size": pick("sad", "sau"), "fav_bid_size": pick("sd", "su"),
    }
