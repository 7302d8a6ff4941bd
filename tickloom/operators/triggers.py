"""First-trigger entries, exits and settlement over ticks x parameter sets.

Every grouping and join is keyed by the event window, which holds at most one tick per second;
that bounds every group. Parameter sets are array literals (no join) and are multiplied in only
after the rows have been cut to those some set could act on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import book, decision
from tickloom.functions.numeric import notional, order_size, taker_fee
from tickloom.params import BY_SERIES, envelope, param_batches, param_structs
from tickloom.plans.staging import stage

ENTRY_FIELDS = ("entry_t", "entry_ask", "cand", "ask_size", "size")


def _p(name: str) -> Column:
    return F.col(f"p.{name}")


def param_cross(df: DataFrame, param_sets: Mapping[str, Mapping], series: str = "series_key") -> DataFrame:
    """Every row once per parameter set, as struct column ``p``; no join is involved.

    A set's own values for a series replace its general ones on rows of that series. Any number of sets
    is taken; each batch of them is one array literal.
    """
    out = None
    for batch in param_batches(param_sets):
        crossed = df.withColumn("_q", F.explode(param_structs(batch)))
        own = F.try_element_at(F.col(f"_q.{BY_SERIES}"), F.col(series)) if any(p.get(BY_SERIES) for p in batch.values()) else None
        base = F.col("_q.base")
        crossed = crossed.withColumn("p", base if own is None else F.coalesce(own, base)).drop("_q")
        out = crossed if out is None else out.unionByName(crossed)
    if out is None:
        raise ValueError("at least one parameter set is needed")
    return out


def entry_decisions(ticks: DataFrame, param_sets: Mapping[str, Mapping], *,
                    elapsed: str = "elapsed", rng: str = "rng", score: str | None = None,
                    depth: str | None = None, time_scale: int = 1, series: str = "series_key") -> DataFrame:
    """Base and gated verdict for each tick and parameter set; ``series`` holds the keys of per-series values."""
    seconds = F.col(elapsed) / time_scale
    base = decision.classify_entry(seconds, F.col("cand_ask"), F.col(rng), _p)
    gated = decision.apply_gates(
        F.col("action"), F.col(score) if score else F.lit(None).cast("int"),
        F.col(depth) if depth else F.lit(None).cast("double"), _p)
    return (param_cross(ticks, param_sets, series)
            .withColumn("action", base).withColumn("gated_action", gated))


def with_depth_ratio(ticks: DataFrame) -> DataFrame:
    role = book.role_columns()
    return ticks.withColumn("depth_ratio", book.depth_ratio(
        role["cand_ask"], role["cand_ask_size"], role["fav_bid"], role["fav_bid_size"]))


def first_trigger_entry(ticks: DataFrame, param_sets: Mapping[str, Mapping],
                        window: Sequence[str], *, time: str = "t", elapsed: str = "elapsed",
                        rng: str = "rng", score: str | None = None,
                        time_scale: int = 1, series: str | None = None) -> DataFrame:
    """First tick per (window, parameter set) whose gated verdict is ENTER.

    ``depth_ok`` is false when the ask size is below the order size: that window ends there. Per-series values go by
    ``series``, the first window column unless told otherwise.
    """
    env = envelope(param_sets)
    ready = with_depth_ratio(ticks)
    seconds = F.col(elapsed) / time_scale
    possible = ready.filter(
        (seconds >= env["entry_after"]) & (seconds <= env["entry_until"])
        & (F.col("cand_ask") > env["min_entry"]) & (F.col("cand_ask") < env["max_entry"])
        & (F.col(rng) < env["max_vol"]))
    sizes = book.by_role(F.col("cand"), F.col("sau"), F.col("sad"))
    judged = entry_decisions(possible, param_sets, elapsed=elapsed, rng=rng, score=score,
                             depth="depth_ratio", time_scale=time_scale, series=series or window[0])
    hit = F.struct(
        F.col(time).alias("entry_t"), F.col("cand_ask").alias("entry_ask"), F.col("cand"),
        sizes.alias("ask_size"),
        order_size(F.col("cand_ask"), _p("target_notional"), _p("min_size")).alias("size"))
    return (judged.filter(F.col("gated_action") == "ENTER")
            .groupBy(*window, F.col("p.param_id").alias("param_id"))
            .agg(F.min_by(hit, F.col(time)).alias("e"), F.first("p").alias("p"))
            .select(*window, "param_id", "p", "e.*")
            .withColumn("depth_ok", F.col("ask_size") >= F.col("size")))


def first_trigger_exit(entries: DataFrame, ticks: DataFrame, window: Sequence[str], *,
                       time: str = "t") -> DataFrame:
    """First tick strictly after entry whose bid can absorb the position and meets a target.

    Take-profit wins over stop on the same tick.
    """
    held = entries.filter("depth_ok").select(*window, "param_id", "p", *ENTRY_FIELDS)
    quotes = ticks.select(*window, F.col(time).alias("exit_t"), "bu", "bd", "su", "sd")
    bid = book.by_role(F.col("cand"), F.col("bu"), F.col("bd"))
    bid_size = book.by_role(F.col("cand"), F.col("su"), F.col("sd"))
    kind = F.when(decision.take_profit_hit(bid, F.col("entry_ask"), _p), F.lit("TAKE_PROFIT")
                  ).when(decision.stop_hit(bid, _p), F.lit("STOP_LOSS"))
    hits = (held.join(quotes, list(window))
            .filter((F.col("exit_t") > F.col("entry_t")) & (bid_size >= F.col("size")))
            .withColumn("exit_kind", kind).withColumn("exit_bid", bid)
            .filter(F.col("exit_kind").isNotNull()))
    return (hits.groupBy(*window, "param_id")
            .agg(F.min_by(F.struct("exit_t", "exit_bid", "exit_kind"), "exit_t").alias("x"))
            .select(*window, "param_id", "x.*"))


def pair_and_settle(windows: DataFrame, entries: DataFrame, exits: DataFrame,
                    window: Sequence[str], param_sets: Mapping[str, Mapping],
                    outcome: str = "outcome") -> DataFrame:
    """One result row per (window, parameter set): exit kind, size, fee and net result."""
    ids = F.array(*[F.lit(pid) for pid in param_sets])
    grid = windows.select(*window, outcome).withColumn("param_id", F.explode(ids))
    keys = [*window, "param_id"]
    paired = (grid.join(entries.select(*keys, *ENTRY_FIELDS, "depth_ok"), keys, "left")
              .join(exits, keys, "left"))
    return _settled(paired, keys, outcome)


def _settled(paired: DataFrame, keys: Sequence[str], outcome: str) -> DataFrame:
    """Exit kind, fee and net result of paired rows (entry and exit columns side by side)."""
    filled = F.coalesce(F.col("depth_ok"), F.lit(False))
    exited = filled & F.col("exit_kind").isNotNull()
    won = F.coalesce(F.col(outcome) == F.col("cand"), F.lit(False))
    size, ask, bid = F.col("size"), F.col("entry_ask"), F.col("exit_bid")
    entry_fee, exit_fee = taker_fee(size, ask), taker_fee(size, bid)
    cost = notional(size, ask) + entry_fee
    zero = F.lit(0).cast("decimal(28,10)")
    pnl = (F.when(~filled, zero)
           .when(exited, notional(size, bid) - exit_fee - cost)
           .when(won, size.cast("decimal(28,10)") - cost)
           .otherwise(-cost))
    fee = F.when(~filled, zero).when(exited, entry_fee + exit_fee).otherwise(entry_fee)
    end = (F.when(F.col("entry_t").isNull(), F.lit("NO_ENTRY"))
           .when(~filled, F.lit("NO_ENTRY_DEPTH"))
           .when(exited, F.col("exit_kind"))
           .when(won, F.lit("SETTLE_WIN"))
           .otherwise(F.lit("SETTLE_LOSE")))
    reason = F.when(F.col("entry_t").isNotNull() & ~filled,
                    F.format_string("depth %d<%d", F.col("ask_size"), size))
    return paired.select(
        *keys, outcome, end.alias("exit_kind"), "cand", "entry_ask",
        F.when(filled, F.col("entry_t")).alias("entry_t"), F.when(exited, F.col("exit_t")).alias("exit_t"),
        F.when(exited, bid).alias("exit_bid"),
        F.when(filled, size).otherwise(F.lit(0)).cast("bigint").alias("size"),
        pnl.cast("decimal(28,10)").alias("pnl"), fee.cast("decimal(28,10)").alias("fee"),
        F.filter(F.array(reason), lambda r: r.isNotNull()).alias("reasons"))


def ticks_with_outcome(ticks: DataFrame, windows: DataFrame, window: Sequence[str],
                       outcome: str = "outcome") -> DataFrame:
    """Ticks of windows that ended Up or Down, with the outcome attached.

    The window dimension grows with the data, so no broadcast is requested; the join uses the
    window key, the partitioning that all later steps want anyway.
    """
    decided = windows.filter(F.col(outcome).isin("Up", "Down")).select(*window, outcome)
    return ticks.join(decided, list(window))


def windows_with_ticks(windows: DataFrame, ticks: DataFrame, window: Sequence[str],
                       outcome: str = "outcome") -> DataFrame:
    decided = windows.filter(F.col(outcome).isin("Up", "Down"))
    return decided.join(ticks.select(*window), list(window), "left_semi")


def replay(ticks: DataFrame, windows: DataFrame, param_sets: Mapping[str, Mapping],
           window: Sequence[str], *, time: str = "t", elapsed: str = "elapsed",
           rng: str = "rng", score: str | None = None, time_scale: int = 1, series: str | None = None) -> DataFrame:
    """Entry, exit and settlement of every decided window under every parameter set.

    Same result as first_trigger_entry, first_trigger_exit and pair_and_settle, arranged for
    many parameter sets: the ticks are shuffled once, folded to one sorted array per window,
    and each set is evaluated on that array, so neither the ticks nor their shuffle is repeated
    per set. The array is bounded by the window length because ``ticks`` (cleaned) must hold at
    most one row per second (see dedupe_ticks). ``rng`` is the volatility column, a zero
    literal when there are no bars. Per-series values go by ``series``, the first window column unless told otherwise.
    """
    role = book.role_columns()
    tick = F.struct(
        F.col(time).alias("t"), (F.col(elapsed) / time_scale).alias("s"), F.col(rng).alias("rng"),
        F.col("cand"), F.col("cand_ask"), role["cand_ask_size"].alias("ask_size"),
        book.depth_ratio(role["cand_ask"], role["cand_ask_size"], role["fav_bid"],
                         role["fav_bid_size"]).alias("depth"),
        (F.col(score) if score else F.lit(None).cast("int")).alias("score"),
        "bu", "bd", "su", "sd")
    folded = ticks.groupBy(*window).agg(F.sort_array(F.collect_list(tick)).alias("ticks"))
    decided = windows.filter(F.col("outcome").isin("Up", "Down")).select(*window, "outcome")
    env = envelope(param_sets)
    possible = F.filter("ticks", lambda x: (
        (x["s"] >= env["entry_after"]) & (x["s"] <= env["entry_until"])
        & (x["cand_ask"] > env["min_entry"]) & (x["cand_ask"] < env["max_entry"])
        & (x["rng"] < env["max_vol"])))

    def enters(x: Column) -> Column:
        base = decision.classify_entry(x["s"], x["cand_ask"], x["rng"], _p)
        return decision.apply_gates(base, x["score"], x["depth"], _p) == "ENTER"

    ready = decided.join(folded, list(window))
    if len(param_batches(param_sets)) > 1:  # every batch reads the folded windows
        ready = stage(ready)
    entered = param_cross(ready.withColumn("possible", possible), param_sets, series or window[0]).withColumn("e", F.get(F.filter("possible", enters), F.lit(0)))
    entered = entered.withColumn("size", order_size(
        F.col("e.cand_ask"), _p("target_notional"), _p("min_size"))).withColumn(
        "depth_ok", F.col("e.ask_size") >= F.col("size"))

    entry_ask, cand = F.col("e.cand_ask"), F.col("e.cand")

    def kind_of(x: Column) -> Column:
        bid = book.by_role(cand, x["bu"], x["bd"])
        return F.when(decision.take_profit_hit(bid, entry_ask, _p), F.lit("TAKE_PROFIT")).when(
            decision.stop_hit(bid, _p), F.lit("STOP_LOSS"))

    def leaves(x: Column) -> Column:
        enough = book.by_role(cand, x["su"], x["sd"]) >= F.col("size")
        return (x["t"] > F.col("e.t")) & enough & kind_of(x).isNotNull()

    exited = entered.withColumn(
        "x", F.when(F.col("depth_ok"), F.get(F.filter("ticks", leaves), F.lit(0))))
    flat = exited.select(
        *window, "outcome", F.col("p.param_id").alias("param_id"), F.col("e.t").alias("entry_t"),
        entry_ask.alias("entry_ask"), cand.alias("cand"), F.col("e.ask_size").alias("ask_size"),
        "size", "depth_ok", F.col("x.t").alias("exit_t"),
        book.by_role(cand, F.col("x.bu"), F.col("x.bd")).alias("exit_bid"),
        F.when(F.col("x").isNotNull(), kind_of(F.col("x"))).alias("exit_kind"))
    return _settled(flat, [*window, "param_id"], "outcome")


def marginal_split(results: DataFrame, loose: str, tight: str, window: Sequence[str]
                   ) -> DataFrame:
    """Rows entered under the loose set only ("filtered") and those under the tight one ("kept")."""
    pick = lambda pid: F.max(F.when(F.col("param_id") == pid, F.col("size")))
    sizes = (results.filter(F.col("param_id").isin(loose, tight)).groupBy(*window)
             .agg(pick(loose).alias("_loose"), pick(tight).alias("_tight")))
    tagged = results.join(sizes, list(window)).withColumn(
        "split_group",
        F.when((F.col("param_id") == loose) & (F.col("_loose") > 0) & (F.col("_tight") == 0),
               F.lit("filtered"))
        .when((F.col("param_id") == tight) & (F.col("_tight") > 0), F.lit("kept")))
    return tagged.filter(F.col("split_group").isNotNull()).drop("_loose", "_tight")


def capture_rows(features: DataFrame, results: DataFrame, window: Sequence[str], *,
                 entry_after: int, entry_until: int, time: str = "t", elapsed: str = "elapsed",
                 time_scale: int = 1) -> DataFrame:
    """Feature rows around the entry seconds, with ``entered`` set from the entry tick on.

    ``results`` is :func:`replay` output for one parameter set plus ``stop_t``, the tick at
    which the scan ended (exit or depth abort), or NULL when it ran to the last tick.
    """
    lo, hi = entry_after - 30, min(entry_until + 30, 240)
    seconds = F.col(elapsed) / time_scale
    trail = results.select(*window, "entry_t", "stop_t")
    return (features.filter((seconds >= lo) & (seconds <= hi) & F.col("cand_ask").isNotNull())
            .join(trail, list(window))
            .filter(F.col("stop_t").isNull() | (F.col(time) <= F.col("stop_t")))
            .withColumn("entered", F.coalesce(F.col(time) >= F.col("entry_t"), F.lit(False)))
            .drop("entry_t", "stop_t"))


def stop_times(entries: DataFrame, exits: DataFrame, windows: DataFrame, window: Sequence[str]
               ) -> DataFrame:
    """entry_t and stop_t per window of a single-parameter replay, for :func:`capture_rows`."""
    e = entries.select(*window, F.col("entry_t").alias("_e"), "depth_ok")
    x = exits.select(*window, "exit_t")
    j = windows.select(*window).join(e, list(window), "left").join(x, list(window), "left")
    ok = F.coalesce(F.col("depth_ok"), F.lit(False))
    return j.select(*window, F.when(ok, F.col("_e")).alias("entry_t"),
                    F.when(ok, F.col("exit_t")).otherwise(F.col("_e")).alias("stop_t"))
