"""Rounding and money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.params import FEE_RATE


def half_even(x: Column, digits: int) -> Column:
    """Round a double half-even with plain arithmetic (stays inside generated code)."""
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def ten_dp(x: Column) -> Column:
    """Feature values carry ten decimals, so thresholds on 2-dp prices compare exactly."""
    return half_even(x, 10)


def price_decimal(p: Column) -> Column:
    return p.cast("decimal(9,4)")


def taker_fee(shares: Column, price: Column) -> Column:
    """shares * rate * p * (1-p), shares may be fractional; zero when there are none. Exact decimal(28,10)."""
    p = price_decimal(price)
    n = shares.cast("decimal(18,6)")
    fee = (n * F.lit(FEE_RATE).cast("decimal(3,2)") * p * (F.lit(1).cast("decimal(1,0)") - p))
    return (F.when(shares <= 0, F.lit(0).cast("decimal(28,10)"))
            .otherwise(fee.cast("decimal(28,10)")))


def notional(shares: Column, price: Column) -> Column:
    return (shares.cast("decimal(18,6)") * price_decimal(price)).cast("decimal(28,10)")


def order_size(ask: Column, target_notional: Column, min_size: Column) -> Column:
    """Whole shares for a target notional, at least the minimum size; NULL without a price."""
    exact = target_notional.cast("decimal(9,4)") / price_decimal(ask)
    return F.when(ask.isNotNull(), F.greatest(F.ceil(exact).cast("bigint"), min_size.cast("bigint")))


def breakeven_price(ask: Column) -> Column:
    """Win rate at which holding to settlement pays for ask and fee."""
    rate = F.lit(float(FEE_RATE))
    return ask + rate * ask * (F.lit(1.0) - ask)


def hold_to_settle_ev(ask: Column, won: Column) -> Column:
    """Per-share result of one row: 1-ask-fee when won, -(ask+fee) otherwise."""
    return F.when(won, F.lit(1.0) - breakeven_price(ask)).otherwise(-breakeven_price(ask))
