"""Registered queries: joins (J1-J14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import fixtures as fx
from testbed.fixtures import DAY, SCALE, WINDOW, big, r6
from testbed.q_windows import AGE, LABEL_SQL, no_vol, replayed, sql_asof
from testbed.registry import register
from tickloom.functions import book
from tickloom.functions.numeric import ten_dp
from tickloom.operators import asof, labels, ledger, studies, triggers
from tickloom.params import parameter_grid, series_overrides

NOW = 1706659200  # fixed reference time: 2024-01-31 00:00 UTC


@register("J1_ticks_with_outcome", """
select series_key, t, outcome, round(spot, 6) as spot
from v_clean join v_windows using (series_key, ws) where outcome in ('Up', 'Down')
""")
def j1(spark, sf):
    df = triggers.ticks_with_outcome(fx.clean(spark, sf), fx.windows(spark, sf), WINDOW)
    return df.select("series_key", "t", "outcome", r6("spot").alias("spot"))


@register("J2_asof_value", f"""
select series_key, t, {sql_asof('au', 0)} as au_0, {sql_asof('au', 10)} as au_10, {sql_asof('au', 60)} as au_60 from v_clean
""")
def j2(spark, sf):
    w = asof.ordered(WINDOW)
    return fx.clean(spark, sf).select("series_key", "t", *[
        asof.asof(F.col("au"), w, n * SCALE, AGE).alias(f"au_{n}") for n in (0, 10, 60)])


@register("J3_asof_join", """
with r as (select series_key, t as rt, spot as r_spot, event_id as r_id from v_ticks where event_id % 7 = 0),
l as (select series_key, t, event_id from v_ticks where event_id % 7 <> 0)
select l.series_key, l.t, case when l.t - r.rt <= 7200 then r.rt end as rt_asof,
  case when l.t - r.rt <= 7200 then r.r_spot end as r_spot, case when l.t - r.rt <= 7200 then r.r_id end as r_id
from l asof left join r on r.series_key = l.series_key and r.rt <= l.t
""")
def j3(spark, sf):
    t = fx.ticks(spark, sf)
    right = t.filter("event_id % 7 = 0").select(
        "series_key", F.col("t").alias("rt"), F.col("spot").alias("r_spot"), F.col("event_id").alias("r_id"))
    left = t.filter("event_id % 7 <> 0").select("series_key", "t")
    return asof.asof_join(left, right, ["series_key"], "t", "rt", ["r_spot", "r_id"], max_age=7200)


def _ahead(n):
    lo, hi = n * SCALE - AGE, n * SCALE
    return (f"last_value(mid) over (partition by series_key, ws order by t range between {lo} following "
            f"and {hi} following) as ahead_{n}")


@register("J4_asof_forward", f"""
select series_key, t, {_ahead(30)}, {_ahead(60)} from (
  select *, case when au is not null and bu is not null then round_even((au + bu) / 2, 10) end as mid from v_clean) x
""")
def j4(spark, sf):
    w = asof.ordered(WINDOW)
    df = fx.clean(spark, sf).withColumn("mid", book.midpoint(F.col("au"), F.col("bu")))
    return df.select("series_key", "t", *[
        asof.asof_ahead(F.col("mid"), w, n * SCALE, AGE).alias(f"ahead_{n}") for n in (30, 60)])


@register("J5_future_excursion", f"""
with {LABEL_SQL} select series_key, t, round(maxu - au, 6) + 0.0::double as mfe, round(au - minu, 6) + 0.0::double as mae from lab
""")
def j5(spark, sf):
    live = triggers.ticks_with_outcome(fx.clean(spark, sf), fx.windows(spark, sf), WINDOW)
    bid = F.when(F.col("au").isNotNull(), F.col("bu"))
    mfe, mae = labels.future_excursion(bid, F.col("au"), WINDOW, "t", 60 * SCALE)
    return live.select("series_key", "t", r6(mfe).alias("mfe"), r6(mae).alias("mae"))


@register("J6_side_pair_check", """
select series_key, ws, t, round((au + bu) / 2 + (ad + bd) / 2 - 1 + case when event_id % 3 = 0 then 0.02 else 0 end, 6) + 0.0::double as gap,
  abs(round((au + bu) / 2 + (ad + bd) / 2 - 1 + case when event_id % 3 = 0 then 0.02 else 0 end, 10)) >= 0.01::double as flagged
from v_clean where au is not null and bu is not null and ad is not null and bd is not null
""")
def j6(spark, sf):
    shift = F.when(F.col("event_id") % 3 == 0, F.lit(0.02)).otherwise(F.lit(0.0))
    df = fx.clean(spark, sf).withColumns({"au": F.col("au") + shift, "bu": F.col("bu") + shift})
    long = studies.union_sides(df, [*WINDOW, "t"])
    return studies.side_pair_check(long, [*WINDOW, "t"]).select(
        *WINDOW, "t", r6("gap").alias("gap"), "flagged")


GRID = parameter_grid({"take_profit_price": [0.5, 0.94], "max_entry": [0.25, 0.3]},
                      by_series=series_overrides("max_entry", {"click": 0.28, "view": 0.2}))


@register("J7_param_cross", """
with p as (select * from (values ('g00', 0.5, 0.25), ('g01', 0.5, 0.3), ('g02', 0.94, 0.25), ('g03', 0.94, 0.3)) v(param_id, tp, me))
select param_id, series_key, t, tp::double as take_profit,
  case series_key when 'click' then 0.28 when 'view' then 0.2 else me end::double as max_entry,
  coalesce(cand_ask < case series_key when 'click' then 0.28 when 'view' then 0.2 else me end::double and cand_ask > 0.15::double, false) as in_band
from v_clean, p
""")
def j7(spark, sf):
    df = triggers.param_cross(fx.clean(spark, sf), GRID)
    inside = (F.col("cand_ask") < F.col("p.max_entry")) & (F.col("cand_ask") > F.col("p.min_entry"))
    return df.select("p.param_id", "series_key", "t", F.col("p.take_profit_price").alias("take_profit"),
                     F.col("p.max_entry").alias("max_entry"), F.coalesce(inside, F.lit(False)).alias("in_band"))


def _crosscheck_sql(pick: str) -> str:
    return f"""
with v as (select * from v_windows where outcome in ('Up', 'Down') {pick}),
x as (select outcome, (length(series_key) + ws // 86400) % 5 <> 0 as found,
    case when (length(series_key) + ws // 86400) % 3 = 0 then 'Up' else outcome end as winner from v)
select count(*) as n, count(case when found and winner = outcome then 1 end) as agree,
  count(case when found and winner <> outcome then 1 end) as disagree, count(case when not found then 1 end) as missing,
  round(count(case when found and winner = outcome then 1 end) / count(case when found then 1 end), 6) as accuracy from x
"""


def _crosscheck(spark, sf, sample):
    w = fx.windows(spark, sf)
    day = F.floor(F.col("ws") / DAY)
    truth = w.filter((F.length("series_key") + day) % 5 != 0).select(
        *WINDOW, F.lit(True).alias("found"),
        F.when((F.length("series_key") + day) % 3 == 0, F.lit("Up")).otherwise(F.col("outcome")).alias("winner"))
    return studies.outcome_crosscheck(w, truth, WINDOW, sample).select(
        "n", "agree", "disagree", "missing", r6("accuracy").alias("accuracy"))


@register("J9_outcome_crosscheck", _crosscheck_sql("order by md5(series_key || '|' || ws), series_key, ws limit 30"))
def j9(spark, sf):
    return _crosscheck(spark, sf, 30)


@register("J9_outcome_crosscheck_all", _crosscheck_sql(""))
def j9_all(spark, sf):
    return _crosscheck(spark, sf, None)


def money(spark, sf):
    p = fx.positions(spark, sf)
    return p.withColumns({"cost": F.col("cost_c") / 100, "fee": F.col("fee_c") / 100})


@register("J10_settle_positions", """
select p.position_id, case when winner is null then 'open' else 'settled' end as new_status,
  case when winner = side then 'win' when winner is not null then 'lose' end as settlement,
  round(case when winner = side then filled_size - cost_c / 100 - fee_c / 100 when winner is not null then -(cost_c / 100 + fee_c / 100) end, 6) + 0.0::double as settle_pnl
from v_positions p left join v_winners w using (position_id) where status = 'open'
""")
def j10(spark, sf):
    out = ledger.settle_positions(money(spark, sf), fx.winners(spark, sf), ["position_id"])
    return out.select("position_id", "new_status", "settlement", r6("settle_pnl").alias("settle_pnl"))


@register("J11_redeem_payout", """
select count(*) as n, count(case when price = 1 then 1 end) as n_win, round(sum(balance * price), 6) + 0.0::double as total
from (select p.filled_size % 7 as balance, case when winner is null then null when winner = side then 1 else 0 end as price
      from v_positions p join v_winners w using (position_id)) x where balance > 0 and price is not null
""")
def j11(spark, sf):
    bal = fx.positions(spark, sf).select("position_id", "side", (F.col("filled_size") % 7).alias("balance"))
    prices = fx.positions(spark, sf).select("position_id", "side").join(
        fx.winners(spark, sf), "position_id").select(
        "position_id", (F.col("winner") == F.col("side")).cast("int").alias("settle_price"))
    out = ledger.redeem_payout(bal, prices, ["position_id"])
    return out.agg(F.count("*").alias("n"), F.count_if("is_winner").alias("n_win"),
                   r6(F.sum("payout")).alias("total"))


@register("J12_pending_settlement", """
select position_id, ws from v_positions where status = 'open' and ws + 86400 + 360 <= 900000000
""")
def j12(spark, sf):
    return ledger.pending_settlement(fx.positions(spark, sf), F.lit(900000000), window_len=DAY,
                                     start="ws").select("position_id", "ws")


@register("J13_duplicate_entry", """
select position_id, series_id, ws from v_positions p where position_id % 3 = 0 and exists (
  select 1 from v_positions q where q.status = 'open' and q.series_id = p.series_id and q.ws = p.ws)
""")
def j13(spark, sf):
    p = fx.positions(spark, sf)
    intents = p.filter("position_id % 3 = 0").select("position_id", "series_id", "ws")
    return ledger.duplicate_entry(intents, p, ["series_id", "ws"])


@register("J14_missing_windows", f"""
with k as (select distinct series_key from v_windows), g as (select unnest(generate_series({NOW - 20 * 86400}, {NOW - 86400}, 86400)) as ws)
select series_key, ws from k, g where not exists (select 1 from v_windows w where w.series_key = k.series_key and w.ws = g.ws and w.outcome is not null)
""")
def j14(spark, sf):
    w = fx.windows(spark, sf)
    settled = w.filter("outcome is not null").withColumnRenamed("ws", "window_start")
    out = ledger.missing_windows(settled, w, F.lit(NOW).cast("bigint"), last_n=20, window_len=DAY)
    return out.select("series_key", F.col("window_start").alias("ws"))


@register("J14_missing_windows_since", f"""
with k as (select distinct series_key from v_windows), g as (select unnest(generate_series({NOW - 12 * 86400}, {NOW - 86400}, 86400)) as ws)
select series_key, ws from k, g where not exists (select 1 from v_windows w where w.series_key = k.series_key and w.ws = g.ws and w.outcome is not null)
""")
def j14_since(spark, sf):
    w = fx.windows(spark, sf)
    settled = w.filter("outcome is not null").withColumnRenamed("ws", "window_start")
    since = F.lit(NOW - 12 * DAY + 500).cast("bigint")
    out = ledger.missing_windows(settled, w, F.lit(NOW).cast("bigint"), since=since, window_len=DAY)
    return out.select("series_key", F.col("window_start").alias("ws"))
