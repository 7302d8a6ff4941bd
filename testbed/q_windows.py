"""Registered queries: rolling and first-trigger operators (W1-W20) and replay summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import fixtures as fx
from testbed.fixtures import SCALE, WINDOW, big, r6
from testbed.registry import register
from tickloom.operators import execution, features, labels, rolling, studies, triggers
from tickloom.operators.asof import asof, backwards, ordered
from tickloom.params import parameter_set
from tickloom.plans import study as study_plan

MIN_SAMPLES = 8
AGE = 5 * SCALE


def rng(n: int) -> str:
    """(t-n, t] frame of the oracle, scaled."""
    return f"over (partition by series_key, ws order by t range between {n * SCALE - 1} preceding and current row)"


def sql_asof(col: str, lag: int) -> str:
    lo, hi = lag * SCALE + AGE, lag * SCALE
    upper = "current row" if hi == 0 else f"{hi} preceding"
    return (f"last_value({col} ignore nulls) over (partition by series_key, ws order by t "
            f"range between {lo} preceding and {upper})")


# the spot series with holes, so NULL handling is exercised
SPOT = "case when event_id % 11 = 0 then null else spot end"


def holey(spark, sf):
    return fx.clean(spark, sf).withColumn("spot", F.expr(SPOT))


VSPOT = f"s as (select * replace ({SPOT} as spot) from v_clean)"


@register("W1_rolling_count", f"""
with {VSPOT} select series_key, t, count(spot) {rng(60)} as n60, count(spot) {rng(15)} as n15 from s
""")
def w1(spark, sf):
    w = ordered(WINDOW)
    return holey(spark, sf).select(
        "series_key", "t", rolling.rolling_count(F.col("spot"), w, 60 * SCALE).alias("n60"),
        rolling.rolling_count(F.col("spot"), w, 15 * SCALE).alias("n15"))


def _ret(n):
    a, b = sql_asof("spot", 0), sql_asof("spot", n)
    return f"round(round_even(case when {b} <> 0 then ({a} - {b}) / {b} end, 10), 6) + 0.0::double as ret_{n}"


@register("W2_rolling_return", f"with {VSPOT} select series_key, t, {_ret(15)}, {_ret(60)}, {_ret(120)} from s")
def w2(spark, sf):
    w, v = ordered(WINDOW), F.col("spot")
    now = asof(v, w, 0, AGE)
    return holey(spark, sf).select("series_key", "t", *[
        r6(rolling.rolling_return(now, asof(v, w, n * SCALE, AGE))).alias(f"ret_{n}")
        for n in (15, 60, 120)])


def _slope(n):
    return (f"case when count(spot) {rng(n)} >= 3 then round(round_even(regr_slope(spot, elapsed::double) "
            f"{rng(n)}, 10), 6) + 0.0::double end as slope_{n}")


@register("W3_rolling_slope", f"with {VSPOT} select series_key, t, {_slope(15)}, {_slope(30)}, {_slope(60)} from s")
def w3(spark, sf):
    df = rolling.add_rolling_slopes(holey(spark, sf), ordered(WINDOW), "spot", "elapsed",
                                    {f"slope_{n}": n * SCALE for n in (15, 30, 60)})
    return df.select("series_key", "t", *[r6(f"slope_{n}").alias(f"slope_{n}") for n in (15, 30, 60)])


def _extreme_sql(n: int) -> str:
    """Self join on the frame, then a running extreme inside each frame."""
    return f"""
x{n} as (select a.series_key, a.t, b.t as bt, b.spot,
    max(b.spot) over (partition by a.series_key, a.ws, a.t order by b.t rows between unbounded preceding and 1 preceding) as hi,
    min(b.spot) over (partition by a.series_key, a.ws, a.t order by b.t rows between unbounded preceding and 1 preceding) as lo
  from s a join s b on a.series_key = b.series_key and a.ws = b.ws and b.t <= a.t and b.t > a.t - {n * SCALE}
  where b.spot is not null),
c{n} as (select series_key, t, cast(count(case when spot > hi then 1 end) as integer) as highs_{n},
    cast(count(case when spot < lo then 1 end) as integer) as lows_{n} from x{n} group by 1, 2)"""


@register("W4_new_extreme_count", f"""
with {VSPOT}, {_extreme_sql(15)}, {_extreme_sql(30)}
select s.series_key, s.t, highs_15, lows_15, highs_30, lows_30 from s
left join c15 on s.series_key = c15.series_key and s.t = c15.t
left join c30 on s.series_key = c30.series_key and s.t = c30.t
""")
def w4(spark, sf):
    names = {n * SCALE: (f"highs_{n}", f"lows_{n}") for n in (15, 30)}
    return rolling.add_new_extreme_counts(holey(spark, sf), WINDOW, "spot", "t", names).select(
        "series_key", "t", *[c for pair in names.values() for c in pair])


MEM = 130 * SCALE
MEMORY_SQL = f"""
m as (select series_key, ws, t, spot,
    case when spot is not null then max(spot) over f end as hi, case when spot is not null then min(spot) over f end as lo,
    case when spot is not null then arg_max(t, spot) over f end as tie_probe
  from s window f as (partition by series_key, ws order by t range between {MEM} preceding and current row)),
j as (select a.series_key, a.ws, a.t, a.hi, a.lo, min(case when b.spot = a.hi then b.t end) as t_high,
    min(case when b.spot = a.lo then b.t end) as t_low
  from m a join s b on a.series_key = b.series_key and a.ws = b.ws and b.t <= a.t and b.t >= a.t - {MEM}
  where a.hi is not null group by 1, 2, 3, 4, 5),
e as (select s.series_key, s.ws, s.t, s.spot, j.hi, j.lo, j.t_high, j.t_low from s left join j using (series_key, ws, t)),
carried as (select series_key, ws, t,
    last_value(hi ignore nulls) over c as high, last_value(lo ignore nulls) over c as low,
    last_value(t_high ignore nulls) over c as t_high, last_value(t_low ignore nulls) over c as t_low
  from e window c as (partition by series_key, ws order by t rows between unbounded preceding and current row))"""


def _memory(spark, sf):
    w = ordered(WINDOW)
    df = holey(spark, sf)
    found = rolling.memory_extremes(F.col("spot"), F.col("t"), w, MEM, backwards(WINDOW))
    df = df.withColumns({f"m_{k}": c for k, c in found.items()})
    return df.withColumns({k: rolling.carry(F.col(f"m_{k}"), w) for k in found})


@register("W5_running_extremes", f"with {VSPOT}, {MEMORY_SQL} select series_key, t, high, low from carried")
def w5(spark, sf):
    return _memory(spark, sf).select("series_key", "t", "high", "low")


@register("W6_time_since_extreme", f"""
with {VSPOT}, {MEMORY_SQL} select series_key, t, t - t_high as since_high, t - t_low as since_low from carried
""")
def w6(spark, sf):
    return _memory(spark, sf).select(
        "series_key", "t", (F.col("t") - F.col("t_high")).alias("since_high"),
        (F.col("t") - F.col("t_low")).alias("since_low"))


ROWS, LEAD, STEP = 6, 21600, 3600
TWAP_SQL = """
tw as (select series_key, ts, round_even(avg(close) over (partition by series_key order by ts rows between 5 preceding and current row) * 1e6, 0) / 1e6 as twap from v_bars)"""


@register("W7_twap", f"with {TWAP_SQL} select series_key, ts, twap from tw")
def w7(spark, sf):
    return rolling.rolling_mean_rows(fx.bars(spark, sf), ["series_key"], "ts", "close", "twap",
                                     rows=ROWS, chunk=5 * fx.DAY).select(
        "series_key", "ts", "twap")


GATE_SQL = f"""
sp as (select series_key, ws, max(t) as last_t from v_ticks group by 1, 2),
g as (select sp.series_key, sp.ws, count(b.ts) as n_bars,
    count(b.ts) > 0 and count(b.ts) >= ((max(sp.last_t) - (sp.ws - {LEAD})) / {STEP}.0::double + 1) * 0.95::double
      and min(b.ts) <= sp.ws - {LEAD - STEP} as covered
  from sp left join v_bars b on b.series_key = sp.series_key and b.ts >= sp.ws - {LEAD} and b.ts <= sp.last_t
  group by sp.series_key, sp.ws)"""


@register("W8_coverage_gate", f"with {GATE_SQL} select series_key, ws, n_bars, covered from g")
def w8(spark, sf):
    return rolling.window_coverage_gate(
        fx.ticks(spark, sf), fx.bars(spark, sf), WINDOW, "series_key", "ws", "t", "ts", lead=LEAD,
        first_within=LEAD - STEP, step=STEP, window_len=fx.DAY).select(
        "series_key", "ws", big("n_bars").alias("n_bars"), "covered")


RANGE_SQL = f"""
{TWAP_SQL}, {GATE_SQL},
k as (select v.*, case when g.covered and tw.ts >= v.ws - {LEAD} then tw.twap end as twap
  from v_clean v left join g on g.series_key = v.series_key and g.ws = v.ws
  asof left join tw on tw.series_key = v.series_key and tw.ts <= v.t),
rr as (select *, case when twap is not null then round_even(max(twap) over f - min(twap) over f, 2) end as rng
  from k window f as (partition by series_key, ws order by t rows between unbounded preceding and current row))"""


def volatility(spark, sf):
    return rolling.tick_volatility(
        fx.clean(spark, sf), fx.bars(spark, sf), rows=ROWS, lead=LEAD, first_within=LEAD - STEP,
        step=STEP, window_len=fx.DAY, chunk=5 * fx.DAY)


@register("W9_running_range", f"with {RANGE_SQL} select series_key, t, twap, rng + 0.0::double as rng from rr")
def w9(spark, sf):
    return volatility(spark, sf).select("series_key", "t", "twap", "rng")


@register("W10_freshness_flag", f"""
with {VSPOT} select series_key, t, count(spot) {rng(60)} >= {MIN_SAMPLES} and {sql_asof('spot', 0)} is not null as fresh,
  count(spot) {rng(60)} >= {MIN_SAMPLES} and {sql_asof('spot', 0)} is not null and event_id % 3 <> 0 as fresh_flagged from s
""")
def w10(spark, sf):
    w, v = ordered(WINDOW), F.col("spot")
    kw = dict(window=60 * SCALE, min_samples=MIN_SAMPLES, max_age=AGE)
    return holey(spark, sf).select(
        "series_key", "t", rolling.freshness(v, w, **kw).alias("fresh"),
        rolling.freshness(v, w, flag=F.col("event_id") % 3 != 0, **kw).alias("fresh_flagged"))


# ------------------------------------------------------------------ the feature table

def _r10(x: str) -> str:
    return f"round_even({x}, 10)"


def _trend_sql() -> str:
    lags = (0, 10, 15, 30, 60, 90, 120)
    asofs = ", ".join(f"{sql_asof('spot', n)} as s{n}" for n in lags)
    slopes = ", ".join(
        f"case when count(spot) {rng(n)} >= 3 then {_r10(f'(regr_slope(spot, elapsed::double) {rng(n)})')} end as sl{n}"
        for n in (15, 30, 60))
    rets = ", ".join(f"case when s{n} <> 0 then {_r10(f'(s0 - s{n}) / s{n}')} end as r{n}" for n in lags[1:])
    return f"""
f1 as (select *, {asofs}, {slopes}, count(spot) {rng(60)} as spot_sample_count_60 from s),
f2 as (select f1.*, spot_sample_count_60 >= {MIN_SAMPLES} and s0 is not null as feed_fresh, {rets},
    carried.high, carried.low, carried.t_high, carried.t_low, c15.highs_15, c15.lows_15, c30.highs_30, c30.lows_30
  from f1 left join carried using (series_key, ws, t)
  left join c15 on c15.series_key = f1.series_key and c15.t = f1.t
  left join c30 on c30.series_key = f1.series_key and c30.t = f1.t),
trend as (select *, """ + ", ".join(
        f"case when feed_fresh then {e} end as {n}" for n, e in {
            **{f"ret_{n}": f"r{n}" for n in (15, 30, 60, 90, 120)},
            **{f"slope_{n}": f"sl{n}" for n in (15, 30, 60)},
            "acceleration": _r10("sl15 - sl60"), "momentum_decay": _r10("abs(r60) - abs(r15)"),
            "dist_high": _r10("high - s0"), "dist_low": _r10("s0 - low"),
            "time_since_high": "cast(t - t_high as double)", "time_since_low": "cast(t - t_low as double)",
            "new_high_count_15": "highs_15", "new_low_count_15": "lows_15",
            "new_high_count_30": "highs_30", "new_low_count_30": "lows_30"}.items()) + " from f2)"


TREND_SQL = f"{VSPOT}, {_extreme_sql(15)}, {_extreme_sql(30)}, {MEMORY_SQL}, {_trend_sql()}"
TREND_COLS = ("ret_15 ret_30 ret_60 ret_90 ret_120 slope_15 slope_30 slope_60 acceleration momentum_decay "
              "dist_high dist_low time_since_high time_since_low").split()
COUNT_COLS = "new_high_count_15 new_low_count_15 new_high_count_30 new_low_count_30".split()


def _rounded_sql(cols, of: str = ""):
    return ", ".join(f"round({of}{c}, 6) + 0.0::double as {c}" for c in cols)


@register("W11_trend_features", f"""
with {TREND_SQL} select series_key, t, feed_fresh, spot_sample_count_60, {_rounded_sql(TREND_COLS)}, {', '.join(COUNT_COLS)} from trend
""")
def w11(spark, sf):
    df = features.trend_features(holey(spark, sf), WINDOW, scale=SCALE, min_samples=MIN_SAMPLES)
    return df.select("series_key", "t", "feed_fresh", "spot_sample_count_60",
                     *[r6(c).alias(c) for c in TREND_COLS], *COUNT_COLS)


def _delta_sql() -> str:
    look = []
    for side in ("u", "d"):
        look += [f"{sql_asof('a' + side, n)} as a{side}{n}" for n in (0, 5, 10, 15, 30, 60)]
        look += [f"{sql_asof('b' + side, n)} as b{side}{n}" for n in (0, 10, 30, 60)]
    roles = [f"case when cand = 'Up' then au{n} else ad{n} end as ca{n}" for n in (0, 5, 10, 15, 30, 60)]
    for n in (0, 10, 30, 60):
        up, down = _r10(f"(au{n} + bu{n}) / 2"), _r10(f"(ad{n} + bd{n}) / 2")
        roles += [f"case when cand = 'Up' then {up} else {down} end as cm{n}",
                  f"case when cand = 'Up' then {down} else {up} end as fm{n}"]
    out = [f"{_r10(f'ca0 - ca{n}')} as ud_ask_delta_{n}" for n in (5, 10, 15, 30, 60)]
    for n in (10, 30, 60):
        out += [f"{_r10(f'cm0 - cm{n}')} as ud_mid_delta_{n}", f"{_r10(f'fm0 - fm{n}')} as fav_mid_delta_{n}",
                f"case when cm{n} <> 0 then (cm0 - cm{n}) / cm{n} end as udr{n}"]
    return f"""
d1 as (select *, {', '.join(look)} from base),
d2 as (select *, {', '.join(roles)} from d1),
deltas as (select *, {', '.join(out)} from d2)"""


DELTA_COLS = ([f"ud_ask_delta_{n}" for n in (5, 10, 15, 30, 60)]
              + [f"{a}_mid_delta_{n}" for n in (10, 30, 60) for a in ("ud", "fav")])


@register("W12_book_delta_features", f"""
with base as (select * from v_clean), {_delta_sql()} select series_key, t, {_rounded_sql(DELTA_COLS)} from deltas
""")
def w12(spark, sf):
    df = features.book_delta_features(fx.clean(spark, sf), WINDOW, scale=SCALE)
    return df.select("series_key", "t", *[r6(c).alias(c) for c in DELTA_COLS])


DIV_COLS = [f"spot_token_divergence_{n}" for n in (10, 30, 60)]
BOOK_COLS = "obi_up obi_down relative_obi spread_underdog spread_favorite depth_ratio_underdog".split()
SNAP_SQL = f"""
{TREND_SQL}, base as (select * from trend), {_delta_sql()},
snap0 as (select *, {', '.join(
    f"case when feed_fresh then {_r10(f'r{n} - udr{n}')} end as spot_token_divergence_{n}" for n in (10, 30, 60))},
  {_r10('(su - sau) / (su + sau)::double')} as obi_up, {_r10('(sd - sad) / (sd + sad)::double')} as obi_down,
  {_r10('cand_ask - cand_bid')} as spread_underdog, {_r10('fav_ask - fav_bid')} as spread_favorite,
  case when cand_ask is not null and cand_ask_size > 0 and fav_bid > 0 and fav_bid_size > 0
    then {_r10('cand_ask * cand_ask_size / (fav_bid * fav_bid_size)')} end as depth_ratio_underdog from deltas),
snap1 as (select *, {_r10("case when cand = 'Up' then obi_up - obi_down else obi_down - obi_up end")} as relative_obi,
  sign(slope_60) as sg from snap0),
snap as (select *, case when feed_fresh and slope_60 is not null and slope_60 <> 0 then cast(
    case when ud_ask_delta_30 <= -0.15::double then 2 when ud_ask_delta_30 <= -0.08::double then 1 else 0 end
  + case when sign(slope_15) = -sg then 2 else 0 end + case when sign(ret_30) = -sg then 1 else 0 end
  + case when case when sg < 0 then dist_low else dist_high end <= 3 then 1 else 0 end
  + case when case when sg < 0 then new_low_count_15 else new_high_count_15 end = 0 then 1 else 0 end
  + case when relative_obi >= 0.5 then 1 else 0 end + case when momentum_decay <= 0.0001::double then 1 else 0 end
  - case when depth_ratio_underdog < 0.27::double then 2 else 0 end
  - case when case when sg < 0 then new_low_count_30 else new_high_count_30 end >= 3 then 3 else 0 end
  - case when sign(slope_15) = sg and sign(slope_30) = sg and abs(ret_15) >= 0.0002::double then 2 else 0 end
  - case when sign(fav_mid_delta_30) = sg and abs(fav_mid_delta_30) >= 0.02::double then 2 else 0 end as integer) end as score
  from snap1)"""


def snapshot(spark, sf):
    return features.feature_snapshot(holey(spark, sf), WINDOW, scale=SCALE, min_samples=MIN_SAMPLES)


@register("W13_cross_divergence", f"with {SNAP_SQL} select series_key, t, {_rounded_sql(DIV_COLS)} from snap")
def w13(spark, sf):
    return snapshot(spark, sf).select("series_key", "t", *[r6(c).alias(c) for c in DIV_COLS])


SNAP_COLS = [*TREND_COLS, *DELTA_COLS, *BOOK_COLS, *DIV_COLS]


@register("W14_feature_snapshot", f"""
with {SNAP_SQL} select series_key, ws, t, cand, feed_fresh, spot_sample_count_60, score, {_rounded_sql(SNAP_COLS)}, {', '.join(COUNT_COLS)} from snap
""")
def w14(spark, sf):
    return snapshot(spark, sf).select(
        "series_key", "ws", "t", "cand", "feed_fresh", "spot_sample_count_60", "score",
        *[r6(c).alias(c) for c in SNAP_COLS], *COUNT_COLS)


# ------------------------------------------------------------------ entries, exits, settlement

TP94 = {"base": parameter_set(take_profit_price=0.94, stop_loss_price=0.06)}

REPLAY_SQL = """
tk as (select v.*, w.outcome from v_clean v join v_windows w using (series_key, ws) where w.outcome in ('Up', 'Down')),
ent0 as (select *, greatest(cast(ceil(round(200.0::double / round(cand_ask * 100), 9)) as bigint), 5) as size,
    row_number() over (partition by series_key, ws order by t) as rn
  from tk where elapsed between 25920 and 43200 and cand_ask < 0.30::double and cand_ask > 0.15::double),
ent as (select series_key, ws, t as entry_t, cand, cand_ask as entry_ask, cand_ask_size as ask_size, size,
    cand_ask_size >= size as depth_ok from ent0 where rn = 1),
ex0 as (select e.series_key, e.ws, k.t as exit_t, case when e.cand = 'Up' then k.bu else k.bd end as bid,
    case when e.cand = 'Up' then k.su else k.sd end as bid_size, e.size, e.entry_t
  from ent e join v_clean k using (series_key, ws) where e.depth_ok and k.t > e.entry_t),
ex1 as (select *, case when bid >= 0.94::double then 'TAKE_PROFIT' when bid <= 0.06::double then 'STOP_LOSS' end as kind
  from ex0 where bid_size >= size),
ex as (select series_key, ws, exit_t, bid as exit_bid, kind from (select *, row_number() over (partition by series_key, ws order by exit_t) as rn
  from ex1 where kind is not null) q where rn = 1),
fee_in as (select w.series_key, w.ws, w.outcome, e.entry_t, e.cand, e.entry_ask, e.ask_size, e.size, e.depth_ok, x.exit_t, x.exit_bid, x.kind,
    e.size * 0.07::double * e.entry_ask * (1 - e.entry_ask) as f1, e.size * 0.07::double * x.exit_bid * (1 - x.exit_bid) as f2
  from v_windows w left join ent e using (series_key, ws) left join ex x using (series_key, ws)
  where w.outcome in ('Up', 'Down')),
res as (select series_key, ws, outcome, cand, entry_ask, case when depth_ok then entry_t end as entry_t, exit_t,
    case when entry_t is null then 'NO_ENTRY' when not depth_ok then 'NO_ENTRY_DEPTH' when kind is not null then kind
         when outcome = cand then 'SETTLE_WIN' else 'SETTLE_LOSE' end as exit_kind,
    case when depth_ok then size else 0 end as size,
    case when entry_t is null or not depth_ok then 0.0::double when kind is not null then size * exit_bid - f2 - size * entry_ask - f1
         when outcome = cand then size - size * entry_ask - f1 else -(size * entry_ask + f1) end as pnl,
    case when entry_t is null or not depth_ok then 0.0::double when kind is not null then f1 + f2 else f1 end as fee,
    case when entry_t is not null and not depth_ok then 'depth ' || ask_size || '<' || size else '' end as reasons,
    case when depth_ok then exit_t else entry_t end as stop_t
  from fee_in)"""


def no_vol(df):
    return df.withColumn("rng", F.lit(0.0))


def replayed(spark, sf, sets=TP94):
    return triggers.replay(no_vol(fx.clean(spark, sf)), fx.windows(spark, sf), sets, WINDOW,
                           time_scale=SCALE)


def _entries(spark, sf, sets=TP94):
    live = triggers.ticks_with_outcome(no_vol(fx.clean(spark, sf)), fx.windows(spark, sf), WINDOW)
    return live, triggers.first_trigger_entry(live, sets, WINDOW, time_scale=SCALE)


@register("W16_first_trigger_entry", f"""
with {REPLAY_SQL} select series_key, ws, entry_t, cand, round(entry_ask, 6) as entry_ask, ask_size, size, depth_ok from ent
""")
def w16(spark, sf):
    _, e = _entries(spark, sf)
    return e.select("series_key", "ws", "entry_t", "cand", r6("entry_ask").alias("entry_ask"),
                    "ask_size", "size", "depth_ok")


@register("W17_first_trigger_exit", f"""
with {REPLAY_SQL} select series_key, ws, exit_t, round(exit_bid, 6) as exit_bid, kind as exit_kind from ex
""")
def w17(spark, sf):
    live, e = _entries(spark, sf)
    return triggers.first_trigger_exit(e, live, WINDOW).select(
        "series_key", "ws", "exit_t", r6("exit_bid").alias("exit_bid"), "exit_kind")


@register("W18_pair_and_settle", f"""
with {REPLAY_SQL} select series_key, ws, outcome, exit_kind, cand, round(entry_ask, 6) as entry_ask, entry_t, exit_t, size,
  round(pnl, 6) + 0.0::double as pnl, round(fee, 6) + 0.0::double as fee, reasons from res
""")
def w18(spark, sf):
    live, e = _entries(spark, sf)
    exits = triggers.first_trigger_exit(e, live, WINDOW)
    decided = triggers.windows_with_ticks(fx.windows(spark, sf), live, WINDOW)
    return triggers.pair_and_settle(decided, e, exits, WINDOW, TP94).select(
        "series_key", "ws", "outcome", "exit_kind", "cand", r6("entry_ask").alias("entry_ask"),
        "entry_t", "exit_t", "size", r6("pnl").alias("pnl"), r6("fee").alias("fee"),
        F.concat_ws(";", "reasons").alias("reasons"))


def _label_sql() -> str:
    def ahead(side, n):
        lo, hi = n * SCALE - AGE, n * SCALE
        lower = f"{lo} following" if lo > 0 else f"{-lo} preceding"
        upper = "current row" if hi == 0 else f"{hi} following"
        return (f"last_value(m{side}) over (partition by series_key, ws order by t range between {lower} and {upper}) as m{side}{n}")
    mids = ", ".join(ahead(s, n) for s in "ud" for n in (0, 30, 60, 120))
    exc = ", ".join(
        f"{f}(q{s}) over (partition by series_key, ws order by t range between 1 following and {60 * SCALE} following) as {f}{s}"
        for s in "ud" for f in ("max", "min"))
    pick = lambda a, b: f"case when cand = 'Up' then {a} else {b} end"
    rets = ", ".join(
        f"case when {pick('mu0', 'md0')} > 0 then {_r10(f'({pick(f'mu{n}', f'md{n}')} - {pick('mu0', 'md0')}) / {pick('mu0', 'md0')}')} end as future_return_{n}"
        for n in (30, 60, 120))
    return f"""
l0 as (select v.*, w.outcome, case when au is not null and bu is not null then {_r10('(au + bu) / 2')} end as mu,
    case when ad is not null and bd is not null then {_r10('(ad + bd) / 2')} end as md,
    case when au is not null and bu is not null then bu end as qu, case when ad is not null and bd is not null then bd end as qd
  from v_clean v join v_windows w using (series_key, ws) where w.outcome in ('Up', 'Down')),
l1 as (select *, {mids}, {exc} from l0),
lab as (select *, {rets}, {_r10(pick('maxu', 'maxd') + ' - cand_ask')} as mfe_60, {_r10('cand_ask - ' + pick('minu', 'mind'))} as mae_60,
    outcome as final_outcome from l1)"""


LABEL_SQL = _label_sql()
LABEL_COLS = "future_return_30 future_return_60 future_return_120 mfe_60 mae_60".split()


def labelled(spark, sf):
    live = triggers.ticks_with_outcome(fx.clean(spark, sf), fx.windows(spark, sf), WINDOW)
    return labels.label_columns(live, WINDOW, scale=SCALE)


@register("W15_capture_rows", f"""
with {REPLAY_SQL}, {SNAP_SQL}, {LABEL_SQL}
select k.series_key, k.ws, k.t, k.cand, round(k.cand_ask, 6) as cand_ask, coalesce(k.t >= r.entry_t, false) as entered, k.feed_fresh,
  k.score, lab.final_outcome, {_rounded_sql(SNAP_COLS, 'k.')}, {', '.join('k.' + c for c in COUNT_COLS)}, {_rounded_sql(LABEL_COLS, 'lab.')}
from snap k join res r on r.series_key = k.series_key and r.ws = k.ws join lab on lab.series_key = k.series_key and lab.t = k.t
where k.elapsed between 60 * 288 and 180 * 288 and k.cand_ask is not null and (r.stop_t is null or k.t <= r.stop_t)
""")
def w15(spark, sf):
    """Every feature and label of the captured rows."""
    rows = study_plan.capture_features(no_vol(holey(spark, sf)), fx.windows(spark, sf), TP94["base"], window=WINDOW,
                                       spot="spot", time_scale=SCALE, min_samples=MIN_SAMPLES)
    return rows.select("series_key", "ws", "t", "cand", r6("cand_ask").alias("cand_ask"), "entered", "feed_fresh", "score",
                       "final_outcome", *[r6(c).alias(c) for c in (*SNAP_COLS, *LABEL_COLS)], *COUNT_COLS)


@register("W19_label_columns", f"with {LABEL_SQL} select series_key, t, final_outcome, {_rounded_sql(LABEL_COLS)} from lab")
def w19(spark, sf):
    return labelled(spark, sf).select("series_key", "t", "final_outcome",
                                      *[r6(c).alias(c) for c in LABEL_COLS])


@register("W20_depth_walk", """
with best as (select asset, min(price_c) as best_c from v_levels where side = 'ask' group by asset),
o0 as (select o_orderkey as order_id, o_orderkey - o_orderkey % 2 as asset, case when o_custkey % 3 = 0 then 'SELL' else 'BUY' end as side,
        1 + o_custkey % 200 as shares, case when o_custkey % 5 = 1 then 4000000 + o_orderkey % 7000000 end as notional_c,
        case o_orderkey % 3 when 0 then 'FOK' when 1 then 'FAK' else 'GTC' end as order_type,
        case when o_orderkey % 4 = 0 then 150000 + o_orderkey % 60000 end as limit_c from orders),
o as (select order_id, o0.asset, side, order_type, case when notional_c is null or side = 'SELL' then limit_c end as limit_c,
        case when notional_c is not null and side = 'BUY' then notional_c::double / best_c else shares end as need,
        case when side = 'BUY' then 1 else -1 end as sign from o0 left join best on best.asset = o0.asset),
ask as (select asset, price_c, size, case when side = 'ask' then 1 else -1 end as sign from v_levels),
lv as (select o.*, a.price_c, a.size, sum(a.size) over (partition by o.order_id order by a.price_c * o.sign) as cum,
        sum(a.size) over (partition by o.order_id) as available
  from o join ask a on a.asset = o.asset and a.sign = o.sign where o.limit_c is null or a.price_c * o.sign <= o.limit_c * o.sign),
f as (select *, greatest(least(need - (cum - size), size), 0) as fill from lv where not (order_type = 'FOK' and available < need)),
g as (select order_id, sum(fill)::double as filled, sum(fill * price_c)::double / sum(fill) as vwap_c from f group by order_id having sum(fill) > 0),
has as (select distinct asset, sign from ask), crossed as (select distinct order_id from lv)
select o.order_id, round(coalesce(g.filled, 0), 6) as filled, round(o.need - coalesce(g.filled, 0), 6) as unfilled, round(g.vwap_c, 6) as vwap_c,
  case when has.asset is null and o.limit_c is null then 'FAILED' when crossed.order_id is null then 'OPEN'
       when coalesce(g.filled, 0) >= o.need then 'FILLED'
       when o.order_type = 'FOK' or (o.order_type = 'FAK' and o.limit_c is not null) then 'CANCELED' else 'PARTIAL' end as status
from o left join g using (order_id) left join has on has.asset = o.asset and has.sign = o.sign left join crossed on crossed.order_id = o.order_id
""")
def w20(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    side = F.when(F.col("o_custkey") % 3 == 0, F.lit("SELL")).otherwise(F.lit("BUY"))
    sized = (F.col("o_custkey") % 5 == 1) & (side == "BUY")  # market buys that state a notional
    orders = o.select(
        k.alias("order_id"), (k - k % 2).alias("asset"), side.alias("side"),
        (1 + F.col("o_custkey") % 200).cast("double").alias("shares"),
        F.when(sized, (4000000 + k % 7000000).cast("double")).alias("notional"),
        F.when(k % 3 == 0, F.lit("FOK")).when(k % 3 == 1, F.lit("FAK")).otherwise(F.lit("GTC")).alias("order_type"),
        F.when((k % 4 == 0) & ~sized, (150000 + k % 60000).cast("double")).alias("limit_price"))
    levels = fx.book_levels(spark, sf).select(
        "asset", "side", F.col("price_c").cast("double").alias("price"), F.col("size").cast("double").alias("size"))
    orders = execution.market_buy_need(orders, levels).withColumn(
        "need", F.when(F.col("notional").isNotNull(), F.col("need")).otherwise(F.col("shares")))
    out = execution.depth_walk(orders, levels)
    return out.select("order_id", r6("filled").alias("filled"), r6("unfilled").alias("unfilled"),
                      r6("vwap").alias("vwap_c"), "status")


# ------------------------------------------------------------------ replay summaries

SUMMARY_SELECT = """count(case when size > 0 then 1 end) as n,
  round(case when count(case when size > 0 then 1 end) > 0 then count(case when size > 0 and exit_kind = 'TAKE_PROFIT' then 1 end) / count(case when size > 0 then 1 end) else 0.0 end, 6) + 0.0::double as tp_rate,
  round(case when count(case when size > 0 then 1 end) > 0 then count(case when size > 0 and exit_kind = 'STOP_LOSS' then 1 end) / count(case when size > 0 then 1 end) else 0.0 end, 6) + 0.0::double as sl_rate,
  round(case when count(case when size > 0 then 1 end) > 0 then count(case when size > 0 and exit_kind in ('TAKE_PROFIT', 'SETTLE_WIN') then 1 end) / count(case when size > 0 then 1 end) else 0.0 end, 6) + 0.0::double as win_rate,
  round(coalesce(avg(case when size > 0 then pnl end), 0), 6) + 0.0::double as pnl_per,
  round(coalesce(sum(case when size > 0 then pnl end), 0), 6) + 0.0::double as pnl,
  round(coalesce(sum(case when size > 0 then fee end), 0), 6) + 0.0::double as fee,
  round(coalesce(avg(case when size > 0 then entry_ask end), 0), 6) + 0.0::double as ask"""
SUMMARY_COLS = "tp_rate sl_rate win_rate pnl_per pnl fee ask".split()


@register("A1_run_summary", f"with {REPLAY_SQL} select series_key, {SUMMARY_SELECT} from res group by series_key")
def a1(spark, sf):
    g = studies.run_summary(replayed(spark, sf), ["series_key"])
    return g.select("series_key", "n", *[r6(c).alias(c) for c in SUMMARY_COLS])
