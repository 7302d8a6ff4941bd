"""Entry and exit rules as column expressions (no look-ahead input is allowed here)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.numeric import ten_dp
from tickloom.params import TAKE_PROFIT_CAP


def classify_entry(elapsed: Column, ask: Column, rng: Column, p) -> Column:
    """First matching verdict wins. ``p(name)`` returns the parameter column.

    The time test comes first, so a row outside the entry seconds is WAIT or MISSED even
    when its data is missing; the price band is open at both ends.
    """
    return (
        F.when(elapsed < p("entry_after"), F.lit("WAIT"))
        .when(elapsed > p("entry_until"), F.lit("MISSED"))
        .when(ask.isNull() | rng.isNull(), F.lit("ABORT_DATA"))
        .when(rng >= p("max_vol"), F.lit("ABORT_VOL"))
        .when(ask >= p("max_entry"), F.lit("OBSERVE"))
        .when(ask <= p("min_entry"), F.lit("OBSERVE"))
        .otherwise(F.lit("ENTER"))
    )


def apply_gates(base: Column, score: Column, depth: Column, p) -> Column:
    """Re-test ENTER rows; a switched-on gate without a value fails closed to OBSERVE."""
    score_need, depth_need = p("min_reversal_score"), p("min_depth_ratio")
    score_fails = score_need.isNotNull() & (score.isNull() | (score < score_need))
    depth_fails = depth_need.isNotNull() & (depth.isNull() | (depth < depth_need))
    return F.when((base == "ENTER") & (score_fails | depth_fails), F.lit("OBSERVE")).otherwise(base)


def take_profit_hit(bid: Column, entry_ask: Column, p) -> Column:
    """Relative target capped at 0.99 when a multiple is set, else the fixed price."""
    relative = F.least(ten_dp(entry_ask * p("take_profit_multiple")), F.lit(TAKE_PROFIT_CAP))
    target = F.when(p("take_profit_multiple").isNotNull() & entry_ask.isNotNull(), relative
                    ).otherwise(p("take_profit_price"))
    return F.coalesce(bid >= target, F.lit(False))


def stop_hit(bid: Column, p) -> Column:
    threshold = p("stop_loss_price")
    return F.coalesce((threshold > 0) & (bid <= threshold), F.lit(False))


def order_gate_verdict(notional: Column, ctx, limits: dict) -> Column:
    """Order admission verdict over intent rows; ``ctx(name)`` gives the context column."""
    lim = {k: F.lit(v).cast("double") for k, v in limits.items()}
    live = F.coalesce(ctx("live"), F.lit(False))
    return (
        F.when(F.coalesce(ctx("kill_switch"), F.lit(False)), F.lit("KILL_SWITCH"))
        .when(notional > lim["max_notional"], F.lit("MAX_NOTIONAL"))
        .when(F.coalesce(ctx("same_window_open"), F.lit(False)), F.lit("DUP_WINDOW"))
        .when(ctx("invested_today") + notional > lim["max_daily_notional"], F.lit("DAILY_CAP"))
        .when(ctx("realized_today") <= -lim["max_daily_loss"], F.lit("CIRCUIT_BREAK"))
        .when(live & ctx("balance").isNull(), F.lit("BALANCE_UNKNOWN"))
        .when(live & (ctx("balance") < notional + lim["min_buffer"]), F.lit("BALANCE_LOW"))
        .otherwise(F.lit("PASS"))
    )


# Default limits of the order gate.
GATE_LIMITS = {"max_notional": 5.0, "max_daily_notional": 20.0,
               "max_daily_loss": 10.0, "min_buffer": 1.0}
