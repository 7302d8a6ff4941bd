"""Entry, exit and settlement against the rule walked in plain Python, on generated books."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import numeric
from tickloom.operators import features, triggers
from tickloom.params import BY_SERIES, parameter_grid, parameter_set
from tickloom.plans import backtest

START = 612_000
W = ["coin", "ws"]
RULES = dict(entry_after=37, entry_until=118, take_profit_price=.58, min_entry=.12, max_entry=.36)
COLUMNS = ("bu", "au", "bd", "ad", "su", "sd", "sau", "sad")
SCHEMA = "coin string, ws bigint, t bigint, elapsed int, " + ", ".join(f"{c} double" for c in COLUMNS)


def _market(seed, n=150):
    """A wandering two-sided book by an own rule: both sides near each other's complement, some levels and sizes missing."""
    rnd = random.Random(seed)
    price, out = rnd.randint(18, 45), []
    for off in range(n):
        price = min(70, max(6, price + rnd.choice([-3, -1, 0, 0, 1, 3])))
        up, down = price / 100, (101 - price) / 100
        row = {"au": up, "bu": round(up - .01 * rnd.randint(1, 2), 2), "ad": down, "bd": round(down - .02, 2),
               **{c: float(rnd.randint(0, 26)) for c in ("su", "sd", "sau", "sad")}}
        if rnd.random() < .04:
            row[rnd.choice(["au", "bu", "ad", "bd"])] = rnd.choice([None, float("nan"), 0.0])
        out.append((off, row))
    return out


def _still(offs=range(150), **changes):
    """One quote for all seconds: 0.22/0.24 against 0.74/0.77; changes: name=(seconds, value)."""
    rows = []
    for off in offs:
        row = dict(bu=.22, au=.24, bd=.74, ad=.77, su=90., sd=80., sau=70., sad=60.)
        row |= {c: value for c, (seconds, value) in changes.items() if off in seconds}
        rows.append((off, row))
    return rows


def _walk(market, outcome, p):
    """The rule, second by second: (kind, size, entry second, exit second, result)."""
    def level(x):
        return None if x is None or x != x or x <= 0 else x

    entry = None
    for off, raw in market:
        q = {c: level(raw[c]) for c in ("au", "bu", "ad", "bd")}
        if entry is None:
            up = q["ad"] is None or (q["au"] is not None and q["au"] <= q["ad"])
            ask, favourite = (q["au"], q["bd"]) if up else (q["ad"], q["bu"])
            if not p["entry_after"] <= off <= p["entry_until"] or ask is None or not p["min_entry"] < ask < p["max_entry"]:
                continue
            held, bid_held = (raw["sau"], raw["sd"]) if up else (raw["sad"], raw["su"])
            if p.get("min_depth_ratio") is not None:
                known = held > 0 and favourite is not None and bid_held > 0
                if not known or round(ask * held / (favourite * bid_held), 10) < p["min_depth_ratio"]:
                    continue
            size = max(math.ceil(round(200 / round(ask * 100), 9)), 5)
            if held < size:
                return "NO_ENTRY_DEPTH", 0, None, None, 0.0
            entry = off, ask, size, up
            continue
        start, ask, size, up = entry
        bid, depth = (q["bu"], raw["su"]) if up else (q["bd"], raw["sd"])
        target = min(ask * p["take_profit_multiple"], .99) if p.get("take_profit_multiple") else p["take_profit_price"]
        if bid is None or depth < size:
            continue
        kind = "TAKE_PROFIT" if bid >= round(target, 10) else "STOP_LOSS" if p.get("stop_loss_price", 0) and bid <= p["stop_loss_price"] else None
        if kind:
            fees = .07 * size * (ask * (1 - ask) + bid * (1 - bid))
            return kind, size, start, off, size * (bid - ask) - fees
    if entry is None:
        return "NO_ENTRY", 0, None, None, 0.0
    start, ask, size, up = entry
    won = outcome == ("Up" if up else "Down")
    return "SETTLE_WIN" if won else "SETTLE_LOSE", size, start, None, size * (won - ask) - .07 * size * ask * (1 - ask)


def _frame(rows, markets):
    data = [(coin, START, START + off, off, *[row[c] for c in COLUMNS]) for coin, market in markets.items() for off, row in market]
    return rows(data, SCHEMA)


def _windows(rows, outcomes):
    return rows([(coin, START, o) for coin, o in outcomes.items()], "coin string, ws bigint, outcome string")


def _replayed(rows, markets, outcomes, sets):
    ticks = features.clean_ticks(_frame(rows, markets)).withColumn("rng", F.lit(0.0))
    out = triggers.replay(ticks, _windows(rows, outcomes), {k: parameter_set(**v) for k, v in sets.items()}, W).collect()
    since = lambda t: None if t is None else t - START
    return {(r.coin, r.param_id): (r.exit_kind, r.size, since(r.entry_t), since(r.exit_t), float(r.pnl)) for r in out}


def test_replay_follows_the_rule_second_by_second(rows):
    markets = {f"m{i}": _market(i) for i in range(24)}
    outcomes = {c: "Up" if i % 3 else "Down" for i, c in enumerate(markets)}
    sets = {"plain": RULES, "stop": {**RULES, "stop_loss_price": .11}, "multiple": {**RULES, "take_profit_multiple": 1.4},
            "deep": {**RULES, "min_depth_ratio": .5}, "late": {**RULES, "entry_after": 90, "entry_until": 140, "max_entry": .45}}
    got = _replayed(rows, markets, outcomes, sets)
    kinds = set()
    for (coin, name), result in got.items():
        want = _walk(markets[coin], outcomes[coin], sets[name])
        assert result[:4] == want[:4] and result[4] == pytest.approx(want[4], abs=1e-8), (coin, name)
        kinds.add(want[0])
    assert len(got) == len(markets) * len(sets) and kinds == {
        "NO_ENTRY", "NO_ENTRY_DEPTH", "TAKE_PROFIT", "STOP_LOSS", "SETTLE_WIN", "SETTLE_LOSE"}


@pytest.mark.parametrize("changes, rules, want", [
    ({}, {}, ("SETTLE_LOSE", 9, 37, None)),
    ({"bu": ([37, 64], .61)}, {}, ("TAKE_PROFIT", 9, 37, 64)),  # not on the entry second itself
    ({"bu": ([64], .61), "su": ([64], 8.)}, {}, ("SETTLE_LOSE", 9, 37, None)),  # nobody takes nine shares
    ({"bu": ([52], .07)}, {"stop_loss_price": .09}, ("STOP_LOSS", 9, 37, 52)),
    ({"bu": ([52], .07)}, {"stop_loss_price": 0.0}, ("SETTLE_LOSE", 9, 37, None)),  # zero is off
    ({"bu": ([52], .60)}, {"stop_loss_price": .66}, ("STOP_LOSS", 9, 37, 38)),  # a stop above the market
    ({"bu": ([38], .60)}, {"stop_loss_price": .66}, ("TAKE_PROFIT", 9, 37, 38)),  # both: the target wins
    ({"bu": ([70], .97)}, {"take_profit_multiple": 4.4}, ("SETTLE_LOSE", 9, 37, None)),  # capped at 0.99
    ({"sau": ([37], 8.)}, {}, ("NO_ENTRY_DEPTH", 0, None, None)),
    ({"au": (range(0, 81), .47)}, {}, ("SETTLE_LOSE", 9, 81, None)),
    ({"au": (range(150), .36)}, {}, ("NO_ENTRY", 0, None, None)),  # the band is open
    ({"sd": (range(150), 0.)}, {"min_depth_ratio": .1}, ("NO_ENTRY", 0, None, None)),
    ({"au": (range(0, 55), float("nan")), "ad": (range(0, 55), None)}, {}, ("SETTLE_LOSE", 9, 55, None))])
def test_cases_of_the_rule(rows, changes, rules, want):
    market, p = _still(**changes), {**RULES, **rules}
    assert _walk(market, "Down", p)[:4] == want
    assert _replayed(rows, {"m": market}, {"m": "Down"}, {"p": p})["m", "p"][:4] == want


def test_per_series_values_go_by_the_window_column(rows):
    markets = {"m": _still(), "n": _still()}
    sets = {"p": {**RULES, BY_SERIES: {"n": {"entry_after": 61}}}}
    ticks = features.clean_ticks(_frame(rows, markets)).withColumn("rng", F.lit(0.0))
    windows = _windows(rows, {"m": "Up", "n": "Up"})
    full = {"p": parameter_set(**sets["p"])}
    by_replay = {r.coin: r.entry_t - START for r in triggers.replay(ticks, windows, full, W).collect()}
    by_entry = {r.coin: r.entry_t - START for r in triggers.first_trigger_entry(ticks, full, W).collect()}
    assert by_replay == by_entry == {"m": 37, "n": 61}
    assert triggers.entry_decisions(ticks, full, series="coin").filter("gated_action = 'ENTER'").groupBy("coin").count().count() == 2


def test_backtest_skips_undecided_windows_and_needs_a_score(rows):
    ticks = _frame(rows, {"m": _still()}).withColumnRenamed("coin", "series_key")
    windows = lambda outcome: rows([("m", START, outcome)], "series_key string, ws bigint, outcome string")
    assert backtest.run_backtest(ticks, windows(None), RULES).count() == 0
    assert backtest.run_backtest(ticks, windows("Up"), RULES).first().exit_kind == "SETTLE_WIN"
    assert backtest.run_backtest(ticks, windows("Up"), {**RULES, "min_reversal_score": 1}).first().exit_kind == "NO_ENTRY", "no score without bars"


def test_fee_and_size(spark):
    r = spark.range(1).select(
        numeric.taker_fee(F.lit(40), F.lit(0.25)).alias("a"), numeric.taker_fee(F.lit(0), F.lit(0.31)).alias("b"),
        numeric.order_size(F.lit(0.24), F.lit(2.0), F.lit(5)).alias("n"),
        numeric.order_size(F.lit(0.62), F.lit(2.0), F.lit(5)).alias("m")).first()
    assert (float(r.a), float(r.b), r.n, r.m) == (40 * .07 * .25 * .75, 0.0, 9, 5)


@pytest.mark.parametrize("batch", [512, 5])
def test_replay_equals_the_relational_operators(rows, monkeypatch, batch):
    """The folded replay and the separate operators agree for every parameter set."""
    from tickloom import params

    monkeypatch.setattr(params, "PARAM_BATCH", batch)
    markets = {f"m{i}": _market(100 + i) for i in range(4)}
    ticks = features.clean_ticks(_frame(rows, markets)).withColumn("rng", F.lit(0.0))
    sets = parameter_grid({"take_profit_price": [.3, .45, .9], "stop_loss_price": [0.0, .14],
                           "min_depth_ratio": [None, .02], "max_entry": [.25, .4]}, entry_after=12, entry_until=130)
    windows = _windows(rows, {c: "Up" for c in markets})
    entries = triggers.first_trigger_entry(ticks, sets, W)
    exits = triggers.first_trigger_exit(entries, ticks, W)
    order = ["coin", "param_id"]
    a = triggers.pair_and_settle(windows, entries, exits, W, sets).orderBy(*order).collect()
    b = triggers.replay(ticks, windows, sets, W).orderBy(*order).collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]
    assert len({r.exit_kind for r in a}) >= 3


def test_capture_window_and_entry_flag(rows):
    live = features.clean_ticks(_frame(rows, {"m": _still(range(30, 150))})).withColumns({"rng": F.lit(0.0), "outcome": F.lit("Down")})
    e = triggers.first_trigger_entry(live, {"base": parameter_set(**RULES)}, W)
    x = triggers.first_trigger_exit(e, live, W)
    stops = triggers.stop_times(e, x, _windows(rows, {"m": "Down"}), W)
    got = triggers.capture_rows(live, stops, W, entry_after=RULES["entry_after"], entry_until=RULES["entry_until"]).orderBy("t").collect()
    # 30 seconds before the first entry second to 30 after the last
    assert [r.elapsed for r in got] == [s for s in range(30, 150) if 7 <= s <= 148]
    assert [r.elapsed for r in got if r.entered] == list(range(37, 149))


def test_parameter_names_are_checked():
    with pytest.raises(ValueError):
        parameter_set(max_volume=3)


def test_series_overrides_and_batches_of_sets(spark, rows, monkeypatch):
    from tickloom import params

    ticks = rows([("a", 0.27), ("b", 0.27)], "series_key string, cand_ask double")
    sets = params.parameter_grid({"max_entry": [0.2, 0.3, 0.4]}, by_series=params.series_overrides("max_entry", {"b": 0.1}))
    sets["plain"] = params.parameter_set(max_entry=0.25)
    monkeypatch.setattr(params, "PARAM_BATCH", 2)
    got = {(r.series_key, r.param_id): r.max_entry for r in triggers.param_cross(ticks, sets).select("series_key", "p.*").collect()}
    assert got == {("a", "g00"): 0.2, ("a", "g01"): 0.3, ("a", "g02"): 0.4, ("b", "g00"): 0.1, ("b", "g01"): 0.1,
                   ("b", "g02"): 0.1, ("a", "plain"): 0.25, ("b", "plain"): 0.25}
    assert params.envelope(sets)["max_entry"] == 0.4
    with pytest.raises(ValueError):
        params.parameter_set(by_series={"a": {"max_entrance": 1}})


def test_unknown_score_weights_are_refused():
    from tickloom.functions.score import reversal_score

    with pytest.raises(ValueError):
        reversal_score({"near_extreme": 1.0})


def test_fractional_shares_and_market_orders(spark, rows):
    from tickloom.functions.numeric import notional, taker_fee
    from tickloom.operators.execution import depth_walk, market_buy_need

    r = rows([(2.5, 0.5)], "n double, p double").select(taker_fee(F.col("n"), F.col("p")).alias("fee"), notional(F.col("n"), F.col("p")).alias("cost")).first()
    assert (float(r.fee), float(r.cost)) == (0.04375, 1.25)
    levels = rows([("x", "ask", 0.4, 3.0), ("x", "ask", 0.5, 3.0), ("x", "bid", 0.3, 2.0)], "asset string, side string, price double, size double")
    orders = rows([(1, "x", "BUY", "FAK", None, 4.0), (2, "x", "BUY", "FAK", 0.45, None), (3, "x", "SELL", "FAK", None, None),
                   (4, "y", "BUY", "FAK", None, 1.0)],
                  "order_id int, asset string, side string, order_type string, limit_price double, notional double")
    orders = market_buy_need(orders, levels).withColumn("need", F.coalesce(F.when(F.col("notional").isNotNull(), F.col("need")), F.lit(5.0)))
    got = {r.order_id: (r.filled, r.status) for r in depth_walk(orders, levels).collect()}
    assert got == {1: (6.0, "PARTIAL"), 2: (3.0, "CANCELED"), 3: (2.0, "PARTIAL"), 4: (0.0, "FAILED")}


def test_a_released_job_leaves_no_folder(spark, rows):
    import os

    from tickloom.plans import staging

    folder = staging.stage_folder(spark).removeprefix("file:")
    assert staging.stage(rows([(1,)], "a int")).count() == 1 and os.listdir(folder)
    staging.release(spark)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("master,setting,want", [
    ("local-cluster[3,4,1024]", "/mnt/shared", "file:/mnt/shared"),
    ("local-cluster[3,4,1024]", "file:/mnt/shared", "file:/mnt/shared"),
    ("local-cluster[3,4,1024]", None, "file:/mnt/warehouse"),  # the other folder all executors share
    ("local[2]", None, "file:/tmp/spark-")])
def test_stages_lie_in_a_shared_folder_with_or_without_scheme(spark, monkeypatch, master, setting, want):
    from tickloom.plans import staging

    conf = {"spark.checkpoint.dir": setting, "spark.sql.warehouse.dir": "/mnt/warehouse"}
    monkeypatch.setattr(spark.sparkContext, "master", master)
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: conf[key])
    root = staging.stage_root(spark)
    assert root.startswith(want) and root == staging.stage_root(spark)
