"""Registered queries: projections, predicates and scalar rules (P1-P22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import fixtures as fx
from testbed.fixtures import big, r6
from testbed.registry import register
from tickloom.functions import book, decision, markets, numeric, score
from tickloom.operators import ledger, studies, triggers
from tickloom.params import parameter_set
from tickloom.sources import event_log, metadata


@register("P1_tradeable_filter", """
select market_id, condition_id, round(liquidity, 6) + 0.0::double as liquidity from v_meta
where active and not closed and len(tokens) >= 2 and liquidity >= 10000
""")
def p1(spark, sf):
    m = metadata.decode_market_metadata(fx.market_meta(spark, sf))
    return m.filter(markets.is_tradeable() & (F.col("liquidity") >= 10000)).select(
        "market_id", "condition_id", r6("liquidity").alias("liquidity"))


@register("P2_window_align", """
select event_id, cast(floor(epoch(ts)) as bigint) // 300 * 300 as window_start,
  event_type || '-updown-5m-' || (cast(floor(epoch(ts)) as bigint) // 300 * 300) as slug
from events
""")
def p2(spark, sf):
    ev = fx.table(spark, sf, "events")
    known = ("click", "error", "purchase", "signup", "view")
    ws = markets.window_align(fx.seconds(F.col("ts")), 300)
    return ev.select("event_id", ws.alias("window_start"),
                     markets.window_slug(F.col("event_type"), ws, known).alias("slug"))


@register("P3_pair_tokens", """
with pairs as (select market_id, list_zip(outcomes[1:least(len(outcomes), len(tokens))],
                                          tokens[1:least(len(outcomes), len(tokens))]) as z from v_meta)
select market_id,
  coalesce(list_filter(z, lambda x: lower(x[1]) = 'up')[1][2], z[1][2]) as up_token,
  coalesce(list_filter(z, lambda x: lower(x[1]) = 'down')[1][2], z[2][2]) as down_token
from pairs
""")
def p3(spark, sf):
    m = metadata.decode_market_metadata(fx.market_meta(spark, sf))
    up, down = markets.pair_tokens(F.col("outcomes"), F.col("tokens"))
    return m.select("market_id", up.alias("up_token"), down.alias("down_token"))


@register("P4_top_of_book", """
with best as (
  select asset, max(case when side = 'bid' then price_c end) as bid_c,
    min(case when side = 'ask' then price_c end) as ask_c,
    arg_max(case when side = 'bid' then size end, case when side = 'bid' then price_c end) as bid_size,
    arg_min(case when side = 'ask' then size end, case when side = 'ask' then price_c end) as ask_size
  from v_levels group by asset)
select asset, bid_c as best_bid, bid_size, ask_c as best_ask, ask_size, ask_c - bid_c as spread,
  round((ask_c + bid_c) / 2, 6) + 0.0::double as mid from best
""")
def p4(spark, sf):
    top = studies.top_of_book(fx.book_levels(spark, sf), ["asset"], "price_c", "size")
    return top.select("asset", "best_bid", "bid_size", "best_ask", "ask_size",
                      big("spread").alias("spread"), r6("mid").alias("mid"))


@register("P4_top_of_nested_book", """
select line_id, max(case when side = 'bid' then price end) as best_bid, arg_max(case when side = 'bid' then size end, case when side = 'bid' then price end) as bid_size,
  min(case when side = 'ask' then price end) as best_ask, arg_min(case when side = 'ask' then size end, case when side = 'ask' then price end) as ask_size
from v_book where kind = 'book' group by 1
""")
def p4_nested(spark, sf):
    """Best levels of the pushed books as they lie in a log line."""
    log = event_log.decode_event_log(fx.event_log(spark, sf)).filter("kind = 'book'")
    levels = lambda name: F.try_variant_get("record", f"$.event.{name}", "array<struct<price:double,size:double>>")
    best = log.select("line_id", book.best_of_levels(levels("bids"), "bid").alias("b"), book.best_of_levels(levels("asks"), "ask").alias("a"))
    return best.select("line_id", F.col("b.price").alias("best_bid"), F.col("b.size").alias("bid_size"),
                       F.col("a.price").alias("best_ask"), F.col("a.size").alias("ask_size"))


@register("P5_clean_level", """
select l_orderkey, l_linenumber, l_partkey, case when p > 0 then round_even(p, 2) end as price,
  case when q > 0 then cast(floor(q) as bigint) else 0 end as size
from (select l_orderkey, l_linenumber, l_partkey,
        case l_linenumber % 4 when 0 then null when 1 then -l_extendedprice / l_quantity
             else l_extendedprice / l_quantity / 1000 end as p,
        case l_partkey % 5 when 0 then null when 1 then -l_quantity else l_quantity * 1.5 end as q
      from lineitem) x
""")
def p5(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    p = (F.when(F.col("l_linenumber") % 4 == 0, F.lit(None))
         .when(F.col("l_linenumber") % 4 == 1, -unit).otherwise(unit / 1000))
    q = (F.when(F.col("l_partkey") % 5 == 0, F.lit(None))
         .when(F.col("l_partkey") % 5 == 1, -F.col("l_quantity"))
         .otherwise(F.col("l_quantity") * 1.5))
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     book.clean_price(p).alias("price"), book.clean_size(q).alias("size"))


@register("P6_pick_candidate", """
select series_key, t, case when v.ad is null then 'Up' when v.au is not null and v.au <= v.ad then 'Up' else 'Down' end as cand,
  least(v.au, v.ad) as cand_ask,
  case when v.ad is null then 'Up' when v.au is not null and v.au < v.ad then 'Up' else 'Down' end as cand_strict
from (select series_key, t, au, case when event_id % 41 = 0 then null else ad end as ad from v_clean) v
""")
def p6(spark, sf):
    ad = F.when(F.col("event_id") % 41 != 0, F.col("ad"))
    return fx.clean(spark, sf).select(
        "series_key", "t", book.candidate_side(F.col("au"), ad).alias("cand"),
        book.candidate_ask(F.col("au"), ad).alias("cand_ask"),
        book.candidate_side(F.col("au"), ad, tie="Down").alias("cand_strict"))


@register("P7_order_imbalance", """
select series_key, t, round(up, 6) + 0.0::double as obi_up, round(down, 6) + 0.0::double as obi_down,
  round(case when cand = 'Up' then up - down else down - up end, 6) + 0.0::double as relative_obi
from (select *, (su - sau) / (su + sau)::double as up, (sd - sad) / (sd + sad)::double as down from v_clean) x
""")
def p7(spark, sf):
    up = book.order_imbalance(F.col("su"), F.col("sau"))
    down = book.order_imbalance(F.col("sd"), F.col("sad"))
    cand = F.col("cand")
    return fx.clean(spark, sf).select(
        "series_key", "t", r6(up).alias("obi_up"), r6(down).alias("obi_down"),
        r6(book.by_role(cand, up, down) - book.by_role(cand, down, up)).alias("relative_obi"))


@register("P8_depth_ratio", """
select series_key, t, case when cand_ask is not null and cand_ask_size > 0 and fav_bid > 0 and fav_bid_size > 0
  then round(cand_ask * cand_ask_size / (fav_bid * fav_bid_size), 6) + 0.0::double end as depth_ratio from v_clean
""")
def p8(spark, sf):
    return triggers.with_depth_ratio(fx.clean(spark, sf)).select(
        "series_key", "t", r6("depth_ratio").alias("depth_ratio"))


@register("P9_side_spreads", """
select series_key, t, round(cand_ask - cand_bid, 6) + 0.0::double as spread_cand,
  round(fav_ask - fav_bid, 6) + 0.0::double as spread_fav from v_clean
""")
def p9(spark, sf):
    role = book.role_columns()
    return fx.clean(spark, sf).select(
        "series_key", "t", r6(book.spread(role["cand_ask"], role["cand_bid"])).alias("spread_cand"),
        r6(book.spread(role["fav_ask"], role["fav_bid"])).alias("spread_fav"))


@register("P10_taker_fee", """
select series_key, t, case when n <= 0 then 0.0::double else round(n * 0.07::double * ad * (1 - ad), 6) + 0.0::double end as fee,
  round(n * ad, 6) + 0.0::double as cost
from (select series_key, t, ad, (sad - 20) / 4.0::double as n from v_clean) x
""")
def p10(spark, sf):
    shares = (F.col("sad") - 20) / F.lit(4.0)  # fractional shares, and rows without a price
    return fx.clean(spark, sf).select(
        "series_key", "t", r6(numeric.taker_fee(shares, F.col("ad"))).alias("fee"),
        r6(numeric.notional(shares, F.col("ad"))).alias("cost"))


@register("P11_order_size", """
select series_key, t, case when ask_c is not null then greatest(cast(ceil(200.0::double / ask_c) as bigint), 5) end as order_size
from (select series_key, t, cast(round(cand_ask * 100) as bigint) as ask_c from v_clean) x
""")
def p11(spark, sf):
    size = numeric.order_size(F.col("cand_ask"), F.lit(2.0), F.lit(5))
    return fx.clean(spark, sf).select("series_key", "t", size.alias("order_size"))


@register("P12_breakeven_ev", """
with r as (select c.series_key, c.cand_ask as a, w.outcome = c.cand as won
           from v_clean c join v_windows w using (series_key, ws)
           where w.outcome is not null and c.cand_ask is not null)
select series_key, count(*) as n, round(avg(a + 0.07::double * a * (1 - a)), 6) + 0.0::double as mean_breakeven,
  round(avg(case when won then 1.0 else 0.0 end) - (avg(a) + 0.07::double * avg(a) * (1 - avg(a))), 6) + 0.0::double as group_ev,
  round(avg(case when won then 1 - a - 0.07::double * a * (1 - a) else -(a + 0.07::double * a * (1 - a)) end), 6) + 0.0::double as row_ev
from r group by series_key
""")
def p12(spark, sf):
    rows = triggers.ticks_with_outcome(fx.clean(spark, sf), fx.windows(spark, sf), fx.WINDOW)
    rows = rows.filter("cand_ask is not null").withColumn("won", F.col("outcome") == F.col("cand"))
    g = rows.groupBy("series_key").agg(
        F.count("*").alias("n"), F.avg(numeric.breakeven_price(F.col("cand_ask"))).alias("be"),
        studies.group_ev("won", "cand_ask").alias("gev"),
        F.avg(numeric.hold_to_settle_ev(F.col("cand_ask"), F.col("won"))).alias("rev"))
    return g.select("series_key", "n", r6("be").alias("mean_breakeven"),
                    r6("gev").alias("group_ev"), r6("rev").alias("row_ev"))


# a range that is missing on some rows and too high on others
RNG = "case when event_id % 19 = 0 then null else cast(event_id % 37 as double) + 0.5 end"

_BASE = f"""
select *, case when elapsed < 25920 then 'WAIT' when elapsed > 43200 then 'MISSED'
  when cand_ask is null or rng is null then 'ABORT_DATA' when rng >= 30 then 'ABORT_VOL'
  when cand_ask >= 0.3 then 'OBSERVE' when cand_ask <= 0.15 then 'OBSERVE' else 'ENTER' end as action
from (select *, {RNG} as rng from v_clean) x
"""


@register("P13_classify_entry", f"""
select series_key, t, action from ({_BASE}) y
""")
def p13(spark, sf):
    df = fx.clean(spark, sf).withColumn("rng", F.expr(RNG))
    judged = triggers.entry_decisions(df, {"base": parameter_set()}, time_scale=fx.SCALE)
    return judged.select("series_key", "t", "action")


@register("P14_classify_entry_gated", f"""
with b as (select *, case when event_id % 3 = 0 then null else event_id % 7 - 2 end as score,
             case when cand_ask is not null and cand_ask_size > 0 and fav_bid > 0 and fav_bid_size > 0
               then round(cand_ask * cand_ask_size / (fav_bid * fav_bid_size), 10) end as depth from ({_BASE}) y),
p as (select * from (values ('off', null, null), ('score', 2, null), ('depth', null, 0.27::double), ('both', 1, 0.4::double)) t(param_id, ms, md)),
g as (select param_id, series_key, t, case when action = 'ENTER' and ((ms is not null and (score is null or score < ms))
        or (md is not null and (depth is null or depth < md))) then 'OBSERVE' else action end as gated_action from b, p)
select param_id, series_key, t, gated_action from g
""")
def p14(spark, sf):
    df = triggers.with_depth_ratio(fx.clean(spark, sf)).withColumn("rng", F.expr(RNG)).withColumn(
        "score", F.expr("case when event_id % 3 = 0 then null else event_id % 7 - 2 end"))
    sets = {"off": parameter_set(), "score": parameter_set(min_reversal_score=2),
            "depth": parameter_set(min_depth_ratio=0.27),
            "both": parameter_set(min_reversal_score=1, min_depth_ratio=0.4)}
    judged = triggers.entry_decisions(df, sets, score="score", depth="depth_ratio",
                                      time_scale=fx.SCALE)
    return judged.select("p.param_id", "series_key", "t", "gated_action")


@register("P15_exit_flags", """
with p as (select * from (values ('fixed', 0.65::double, null, 0.1::double), ('multiple', 0.99::double, 2.5::double, 0.0::double)) t(param_id, tp, mult, sl)),
x as (select param_id, series_key, t, coalesce(bu >= case when mult is not null and cand_ask is not null
        then least(round(cand_ask * mult, 10), 0.99::double) else tp end, false) as take_profit,
        coalesce(sl > 0 and bu <= sl, false) as stop from v_clean, p)
select param_id, series_key, t, take_profit, stop from x
""")
def p15(spark, sf):
    sets = {"fixed": parameter_set(take_profit_price=0.65, stop_loss_price=0.1),
            "multiple": parameter_set(take_profit_multiple=2.5)}
    p = lambda n: F.col(f"p.{n}")
    df = triggers.param_cross(fx.clean(spark, sf), sets)
    return df.select(
        p("param_id").alias("param_id"), "series_key", "t",
        decision.take_profit_hit(F.col("bu"), F.col("cand_ask"), p).alias("take_profit"),
        decision.stop_hit(F.col("bu"), p).alias("stop"))


@register("P16_would_enter_filter", """
select c.series_key, c.t, c.cand, round(c.cand_ask, 6) as cand_ask, coalesce(w.outcome = c.cand, false) as win_label,
  round(c.cand_ask + 0.07::double * c.cand_ask * (1 - c.cand_ask), 6) as ev_breakeven
from v_clean c join v_windows w using (series_key, ws)
where c.elapsed between 25920 and 43200 and c.cand_ask > 0.2 and c.cand_ask <= 0.3
""")
def p16(spark, sf):
    w = fx.windows(spark, sf).withColumnRenamed("outcome", "final_outcome")
    df = fx.clean(spark, sf).join(w, fx.WINDOW).withColumn("entered", F.lit(True))
    return studies.would_enter(df, time_scale=fx.SCALE).select(
        "series_key", "t", "cand", r6("cand_ask").alias("cand_ask"), "win_label",
        r6("ev_breakeven").alias("ev_breakeven"))


_SCORE_EXPR = {
    "feed_fresh": "event_id % 13 <> 0",
    "slope_60": "case when event_id % 17 = 0 then null else (event_id % 11 - 5) / 10.0 end",
    "slope_15": "case when event_id % 19 = 0 then null else (event_id % 7 - 3) / 10.0 end",
    "slope_30": "(event_id % 5 - 2) / 10.0",
    "ret_30": "case when event_id % 23 = 0 then null else (event_id % 9 - 4) / 100.0 end",
    "ret_15": "(event_id % 6) / 10000.0",
    "ud_ask_delta_30": "case when event_id % 29 = 0 then null else -(event_id % 21) / 100.0 end",
    "dist_low": "(event_id % 8) * 1.0", "dist_high": "(event_id % 10) * 1.0",
    "new_low_count_15": "event_id % 4", "new_high_count_15": "event_id % 3",
    "new_low_count_30": "event_id % 6", "new_high_count_30": "event_id % 5",
    "relative_obi": "(event_id % 14) / 10.0", "momentum_decay": "(event_id % 5) / 10000.0",
    "depth_ratio_underdog": "case when event_id % 31 = 0 then null else (event_id % 12) / 20.0 end",
    "fav_mid_delta_30": "(event_id % 9 - 4) / 100.0",
}
_SCORE_SELECT = {n: e if n == "feed_fresh" or "count" in n else f"cast({e} as double)"
                 for n, e in _SCORE_EXPR.items()}


@register("P17_reversal_score", "with f0 as (select event_id, "
          + ", ".join(f"{e} as {n}" for n, e in _SCORE_SELECT.items()) + " from events), "
          + "f as (select *, sign(slope_60) as d from f0)" + """
select event_id, case when feed_fresh and slope_60 is not null and slope_60 <> 0 then cast(
    case when ud_ask_delta_30 <= -0.15 then 2 when ud_ask_delta_30 <= -0.08 then 1 else 0 end
  + case when sign(slope_15) = -d then 2 else 0 end + case when sign(ret_30) = -d then 1 else 0 end
  + case when case when d < 0 then dist_low else dist_high end <= 3 then 1 else 0 end
  + case when case when d < 0 then new_low_count_15 else new_high_count_15 end = 0 then 1 else 0 end
  + case when relative_obi >= 0.5 then 1 else 0 end + case when momentum_decay <= 0.0001 then 1 else 0 end
  - case when depth_ratio_underdog < 0.27 then 2 else 0 end
  - case when case when d < 0 then new_low_count_30 else new_high_count_30 end >= 3 then 3 else 0 end
  - case when sign(slope_15) = d and sign(slope_30) = d and abs(ret_15) >= 0.0002 then 2 else 0 end
  - case when sign(fav_mid_delta_30) = d and abs(fav_mid_delta_30) >= 0.02 then 2 else 0 end as integer) end as score
from f
""")
def p17(spark, sf):
    df = fx.table(spark, sf, "events").select(
        "event_id", *[F.expr(e).alias(n) for n, e in _SCORE_SELECT.items()])
    return df.select("event_id", score.reversal_score().alias("score"))


@register("P19_parse_winner", """
with z as (select market_id, closed, outcomes as o, prices as p, len(outcomes) as no, len(prices) as np from v_meta),
up as (select *, list_position(list_transform(o[1:least(no, np)], lambda x: lower(x)), 'up') as ui,
  coalesce(list_position(list_transform(p[1:least(no, np)], lambda x: x in ('1', '1.0', '0.999')), true), 0) as mi from z)
select market_id,
  case when closed and no = 2 and np = 2 then case when p[1]::double = 1 and p[2]::double = 0 then o[1]
       when p[2]::double = 1 and p[1]::double = 0 then o[2] end end as strict,
  case when mi > 0 then o[mi] end as member,
  case when ui > 0 then p[ui]::double > 0.5 end as up_won
from up
""")
def p19(spark, sf):
    m = metadata.decode_market_metadata(fx.market_meta(spark, sf))
    o, p = F.col("outcomes"), F.col("prices")
    return m.select("market_id", markets.winner_strict(o, p, F.col("closed")).alias("strict"),
                    markets.winner_member(o, p).alias("member"),
                    markets.up_won_by_price(o, p).alias("up_won"))


@register("P20_order_gate_verdict", """
select intent_id, case when kill_switch then 'KILL_SWITCH' when notional > 5 then 'MAX_NOTIONAL'
  when same_window_open then 'DUP_WINDOW' when invested_today + notional > 20 then 'DAILY_CAP'
  when realized_today <= -10 then 'CIRCUIT_BREAK' when live and balance is null then 'BALANCE_UNKNOWN'
  when live and balance < notional + 1 then 'BALANCE_LOW' else 'PASS' end as verdict
from v_intents
""")
def p20(spark, sf):
    v = decision.order_gate_verdict(F.col("notional"), F.col, decision.GATE_LIMITS)
    return fx.intents(spark, sf).select("intent_id", v.alias("verdict"))


# no sum of cents meets this limit, so rounding decides nothing
DAY_LIMITS = {**decision.GATE_LIMITS, "max_daily_notional": 40.003}


@register("P20_order_gate_in_day", """
with recursive ex as (
  select ws as day_start, round(sum(cost_c / 100), 6) as invested,
    round(coalesce(sum(case when status = 'closed' then (filled_size - 20)::double end), 0) + coalesce(sum(case when status = 'settled' then -fee_c / 100 end), 0), 6) as realized
  from v_positions group by ws),
i as (
  select v.intent_id, v.day_start, v.notional, kill_switch, same_window_open, live, balance, coalesce(ex.invested, 0) as base, coalesce(ex.realized, 0) as done,
    row_number() over (partition by v.day_start order by intent_id) as rn
  from v_intents v left join ex on ex.day_start = v.day_start),
j as (select *, not (kill_switch or notional > 5 or same_window_open or done <= -10 or (live and balance is null) or (live and balance < notional + 1)) as ok from i),
r as (select day_start, rn, base as held from j where rn = 1 union all
  select j.day_start, j.rn, r.held + case when p.ok and r.held + p.notional <= 40.003 then p.notional else 0 end
  from r join j p on p.day_start = r.day_start and p.rn = r.rn join j on j.day_start = r.day_start and j.rn = r.rn + 1)
select intent_id, round(held, 6) as invested_today, case when kill_switch then 'KILL_SWITCH' when notional > 5 then 'MAX_NOTIONAL'
  when same_window_open then 'DUP_WINDOW' when held + notional > 40.003 then 'DAILY_CAP'
  when done <= -10 then 'CIRCUIT_BREAK' when live and balance is null then 'BALANCE_UNKNOWN'
  when live and balance < notional + 1 then 'BALANCE_LOW' else 'PASS' end as verdict
from j join r using (day_start, rn)
""")
def p20_day(spark, sf):
    """The gate with the day's exposure and what it has let pass earlier that day."""
    positions = fx.positions(spark, sf).select(
        F.col("ws").alias("window_start"), (F.col("cost_c") / 100).alias("entry_cost"),
        F.when(F.col("status") == "closed", (F.col("filled_size") - 20).cast("double")).alias("realized_pnl"),
        F.when(F.col("status") == "settled", -F.col("fee_c") / 100).alias("settle_pnl"))
    exposure = ledger.daily_exposure(positions).withColumns({"invested": r6("invested"), "realized": r6("realized")})
    intents = fx.intents(spark, sf).drop("invested_today", "realized_today")
    seen = ledger.order_intents_with_exposure(intents, exposure, seq="intent_id", limits=DAY_LIMITS)
    v = decision.order_gate_verdict(F.col("notional"), F.col, DAY_LIMITS)
    return seen.select("intent_id", r6("invested_today").alias("invested_today"), v.alias("verdict"))


@register("P22_rule_predicates", """
select series_key, ws, c >= o as r_close, (h + l + c) / 3 >= o as r_typ, (o + h + l + c) / 4 >= o as r_ohlc,
  round(abs(c - o) / o, 6) + 0.0::double as flatness from v_candles
""")
def p22(spark, sf):
    rules = studies.candle_rules()
    return fx.candles(spark, sf).select(
        "series_key", "ws", rules["r_close"].alias("r_close"), rules["r_typ"].alias("r_typ"),
        rules["r_ohlc"].alias("r_ohlc"), r6(studies.flatness()).alias("flatness"))
