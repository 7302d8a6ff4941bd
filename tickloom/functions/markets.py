"""Market metadata expressions: window names, token pairing, winners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_align(t: Column, width: int) -> Column:
    return (t - F.pmod(t, F.lit(width))).cast("bigint")


def window_slug(series: Column, start: Column, known: Sequence[str], label: str = "updown-5m"
                ) -> Column:
    """``{series}-{label}-{start}``; an unknown series fails the query."""
    key = F.lower(series)
    name = F.concat_ws("-", key, F.lit(label), start.cast("string"))
    failure = F.raise_error(F.concat(F.lit("unknown series key: "), F.coalesce(series, F.lit("NULL"))))
    return F.when(key.isin(*known), name).otherwise(failure.cast("string"))


def is_tradeable() -> Column:
    return F.col("active") & ~F.col("closed") & (F.size("tokens") >= 2)


def _zipped(names: Column, values: Column) -> Column:
    """Pair by position, cut to the shorter array, as array<struct<name,value>>."""
    n = F.least(F.size(names), F.size(values))
    return F.transform(
        F.slice(names, F.lit(1), n),
        lambda name, i: F.struct(name.alias("name"), F.get(values, i).alias("value")))


def pair_tokens(outcomes: Column, tokens: Column) -> tuple[Column, Column]:
    """(up token, down token): by case-insensitive outcome name, else by position."""
    pairs = _zipped(outcomes, tokens)

    def named(name: str, position: int) -> Column:
        hit = F.get(F.filter(pairs, lambda p: F.lower(p["name"]) == name), F.lit(0))["value"]
        return F.coalesce(hit, F.get(pairs, F.lit(position))["value"])

    return named("up", 0), named("down", 1)


def winner_strict(outcomes: Column, prices: Column, closed: Column) -> Column:
    """Closed two-outcome markets with prices exactly one and zero; anything else is NULL."""
    first = F.get(prices, F.lit(0)).try_cast("double")
    second = F.get(prices, F.lit(1)).try_cast("double")
    shaped = closed & (F.size(outcomes) == 2) & (F.size(prices) == 2)
    return (F.when(shaped & (first == 1) & (second == 0), F.get(outcomes, F.lit(0)))
            .when(shaped & (second == 1) & (first == 0), F.get(outcomes, F.lit(1))))


def winner_member(outcomes: Column, prices: Column) -> Column:
    """First outcome whose price text is 1, 1.0 or 0.999."""
    pairs = _zipped(outcomes, prices)
    hits = F.filter(pairs, lambda p: p["value"].isin("1", "1.0", "0.999"))
    return F.get(hits, F.lit(0))["name"]


def up_won_by_price(outcomes: Column, prices: Column) -> Column:
    """Whether the Up price is above one half; NULL without an Up outcome or a number."""
    pairs = _zipped(outcomes, prices)
    up = F.get(F.filter(pairs, lambda p: F.lower(p["name"]) == "up"), F.lit(0))
    return up["value"].try_cast("double") > 0.5
