"""Positions, settlement, exposure and the latest state of upsert logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.decision import GATE_LIMITS, order_gate_verdict

GRACE_SECONDS = 360
WINDOW_SECONDS = 300


def settle_positions(positions: DataFrame, winners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open positions against winners: won, lost, or still open when the winner is unknown.

    Win: shares - cost - fee. Lose: -(cost + fee). Both tables grow together, so this is a
    plain equi-join on the position key.
    """
    j = positions.filter(F.col("status") == "open").join(winners, list(keys), "left")
    won = F.col("winner") == F.col("side")
    pnl = F.when(won, F.col("filled_size") - F.col("cost") - F.col("fee")).when(
        ~won, -(F.col("cost") + F.col("fee")))
    return (j.withColumn("settlement", F.when(won, F.lit("win")).when(~won, F.lit("lose")))
            .withColumn("new_status", F.when(won.isNotNull(), F.lit("settled")).otherwise(F.lit("open")))
            .withColumn("settle_pnl", pnl))


def redeem_payout(balances: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Payout per held outcome: balance times settle price; empty balances and unsettled drop out."""
    j = balances.filter(F.col("balance") > 0).join(
        prices.filter(F.col("settle_price").isNotNull()), list(keys))
    return j.withColumn("payout", F.col("balance") * F.col("settle_price")).withColumn(
        "is_winner", F.col("settle_price") == 1)


def pending_settlement(positions: DataFrame, now: Column, *, grace: int = GRACE_SECONDS,
                       window_len: int = WINDOW_SECONDS, start: str = "window_start") -> DataFrame:
    return positions.filter(
        (F.col("status") == "open") & (F.col(start) + window_len + grace <= now))


def duplicate_entry(intents: DataFrame, positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intents whose window already has an open position."""
    held = positions.filter(F.col("status") == "open").select(*keys)
    return intents.join(held, list(keys), "left_semi")


def missing_windows(settled: DataFrame, series: DataFrame, now: Column, *, key: str = "series_key",
                    start: str = "window_start", last_n: int | None = None,
                    since: Column | None = None, window_len: int = WINDOW_SECONDS) -> DataFrame:
    """Expected finished windows per series without a settled row; the current one is excluded."""
    if (last_n is None) == (since is None):
        raise ValueError("give either last_n or since")
    current = now - F.pmod(now, F.lit(window_len))
    first = (current - last_n * window_len) if last_n is not None else since - F.pmod(since, F.lit(window_len))
    # two steps of explode, so no array grows with the length of the history
    span = window_len * 4096
    last, step = current - window_len, F.lit(window_len).cast("bigint")
    blocks = F.when(first <= last, F.sequence(first, last, F.lit(span).cast("bigint")))
    expected = (series.select(key).distinct().withColumn("_from", F.explode(blocks))
                .withColumn(start, F.explode(F.sequence(
                    F.col("_from"), F.least(F.col("_from") + span - window_len, last), step)))
                .drop("_from"))
    return expected.join(settled.select(key, start), [key, start], "left_anti")


def daily_exposure(windows: DataFrame, start: str = "window_start") -> DataFrame:
    """Per UTC day: entry cost and realised plus settled result; missing amounts count as zero."""
    day = (F.col(start) - F.pmod(F.col(start), F.lit(86400))).alias("day_start")
    zero = F.lit(0.0)
    total = lambda c: F.coalesce(F.sum(c), zero)
    return windows.groupBy(day).agg(
        total("entry_cost").alias("invested"),
        (total("realized_pnl") + total("settle_pnl")).alias("realized"))


def latest_state(changes: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str],
                 changed: str = "changed") -> DataFrame:
    """Current row per key from an upsert log.

    A later write wins, only for the columns it supplies; an explicit NULL is a write. Each
    column is one max_by, so the log is combined before the shuffle and a hot key stays cheap.
    """
    picks = []
    for c in columns:
        supplied = F.array_contains(changed, c)
        boxed = F.when(supplied, F.struct(F.col(c).alias("v")))
        picks.append(F.max_by(boxed, F.when(supplied, F.col(seq)))["v"].alias(c))
    return changes.groupBy(*keys).agg(*picks)


def order_intents_with_exposure(intents: DataFrame, exposure: DataFrame, day: str = "day_start", *,
                                seq: str | None = None, limits: Mapping[str, float] = GATE_LIMITS) -> DataFrame:
    """Attach the day's invested and realised sums to intents (zero when the day is empty).

    With ``seq``, the order of intents within a day, an intent also sees what the gate has let pass before it that day. That
    depends on the verdicts one after the other, so a day is one fold over its intents in order (a number and a flag
    each); what comes out of it are the passed ones, which the daily limit keeps few.
    """
    zero = F.lit(0.0)
    out = intents.join(exposure, day, "left").withColumns({
        "invested_today": F.coalesce("invested", zero), "realized_today": F.coalesce("realized", zero),
    }).drop("invested", "realized")
    if seq is None:
        return out
    # an intent that fails for another reason does not count, whatever has been invested
    open_day = {**limits, "max_daily_notional": float("inf")}
    allowed = order_gate_verdict(F.col("notional"), F.col, open_day) == "PASS"
    rows = out.select(day, "invested_today", F.struct(F.col(seq).alias("seq"), F.col("notional").alias("x"), allowed.alias("ok")).alias("_i"))
    days = rows.groupBy(day).agg(F.max("invested_today").alias("_base"), F.array_sort(F.collect_list("_i")).alias("_all"))
    start = F.struct(F.col("_base").alias("sum"), F.expr("filter(_all, x -> false)").alias("passed"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.coalesce(x["ok"] & (acc["sum"] + x["x"] <= F.lit(float(limits["max_daily_notional"]))), F.lit(False))
        return F.struct(F.when(fits, acc["sum"] + x["x"]).otherwise(acc["sum"]).alias("sum"),
                        F.when(fits, F.concat(acc["passed"], F.array(x))).otherwise(acc["passed"]).alias("passed"))

    passed = days.select(day, F.aggregate("_all", start, step)["passed"].alias("_passed"))
    before = F.aggregate(F.filter("_passed", lambda x: x["seq"] < F.col(seq)), zero, lambda acc, x: acc + x["x"])
    return out.join(passed, day, "left").withColumn(
        "invested_today", F.col("invested_today") + F.coalesce(before, zero)).drop("_passed")
