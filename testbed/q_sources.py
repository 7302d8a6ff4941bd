"""Registered queries: sources and sinks (S1-S15), feed audits, order statistics (K, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import fixtures as fx
from testbed.fixtures import DAY, SCALE, WINDOW, big, r6
from testbed.q_windows import REPLAY_SQL, TP94, replayed
from testbed.registry import register
from tickloom.operators import audits, execution, ledger, studies
from tickloom.params import parameter_set
from tickloom.plans.staging import stage
from tickloom.sources import event_log, frames, judgments, klines, metadata, tables
from tickloom.streaming.session import fresh_folder


@register("S1_read_windows", """
select o_orderkey as condition_id, cast(floor(epoch(o_orderdate)) as bigint) as window_start,
  case o_orderstatus when 'F' then 'Up' when 'O' then 'Down' end as outcome, round(o_totalprice, 6) as volume
from orders
""")
def s1(spark, sf):
    fx.prepare(spark)
    df = tables.read_windows(spark, f"{sf}/orders.parquet", {
        "condition_id": "o_orderkey", "slug": "concat('w-', o_orderkey)", "market_start": "o_orderdate",
        "outcome": "case o_orderstatus when 'F' then 'Up' when 'O' then 'Down' end",
        "volume": "o_totalprice", "liquidity": "cast(null as double)"})
    return df.select("condition_id", "window_start", "outcome", r6("volume").alias("volume"))


@register("S2_read_ticks", """
select event_type as condition_id, cast(floor(epoch(ts)) as bigint) // 86400 as day, count(*) as n_ticks,
  min(cast(floor(epoch(ts)) as bigint)) as first_t, max(cast(floor(epoch(ts)) as bigint)) as last_t
from events group by 1, 2
""")
def s2(spark, sf):
    fx.prepare(spark)
    ticks = tables.read_ticks(spark, f"{sf}/events.parquet", ("condition_id", "t"), {
        "condition_id": "event_type", "t": "unix_seconds(cast(ts as timestamp))"})
    ticks = ticks.withColumn("day", F.floor(F.col("t") / DAY).cast("bigint"))
    return tables.tick_spans(ticks, ["condition_id", "day"])


@register("S3_read_bars", "select cast(floor(epoch(ts)) as bigint) as ts, round(value, 6) as close from events")
def s3(spark, sf):
    fx.prepare(spark)
    bars = tables.read_bars(spark, f"{sf}/events.parquet", source={
        "ts": "unix_seconds(cast(ts as timestamp))", "close": "value"})
    return bars.select("ts", r6("close").alias("close"))


@register("S4_ingest_kline_csv", """
select event_id as line_id, cast(floor(epoch(ts)) as bigint) as ts, round(value, 6) as open, round(value, 6) as high,
  round(value, 6) as low, cast(event_id % 1000 as double) as close
from events where event_id % 50 <> 0 and cast(floor(epoch(ts)) as bigint) >= 1704326400 and cast(floor(epoch(ts)) as bigint) < 1706140800
""")
def s4(spark, sf):
    out = klines.parse_kline_lines(fx.kline_lines(spark, sf), "line", 1704326400, 1706140800, ("line_id",))
    return out.select("line_id", "ts", *[r6(c).alias(c) for c in ("open", "high", "low", "close")])


@register("S5_read_event_log", """
select dt as date, count(*) as n_lines, count(case when kind_no is null then 1 end) as n_bad,
  count(case when kind_no = 4 then 1 end) as n_meta, count(case when kind_no < 4 then 1 end) as n_book
from v_log group by dt
""")
def s5(spark, sf):
    log = event_log.decode_event_log(fx.event_log(spark, sf))
    return log.groupBy("date").agg(
        F.count("*").alias("n_lines"), F.count_if("is_bad").alias("n_bad"),
        F.count_if(F.col("type") == "WindowMeta").alias("n_meta"),
        F.count_if(F.col("kind").isNotNull()).alias("n_book"))


@register("S6_flatten_book_events", """
select line_id, dt as date, epoch_us(ts) as ts_us, kind, asset_id, market, side, round(price, 6) as price, round(size, 6) as size from v_book
""")
def s6(spark, sf):
    book = event_log.flatten_book(event_log.decode_event_log(fx.event_log(spark, sf)), ("line_id",))
    return book.select("line_id", "date", F.unix_micros("ts").alias("ts_us"), "kind", "asset_id", "market",
                       "side", r6("price").alias("price"), r6("size").alias("size"))


@register("S6_flatten_meta_events", """
select line_id, dt as date, 'WindowMeta' as type, '{"window_start":' || line_id || '}' as payload from v_log where kind_no = 4
""")
def s6_meta(spark, sf):
    meta = event_log.flatten_meta(event_log.decode_event_log(fx.event_log(spark, sf)), keep=("line_id",))
    return meta.select("line_id", "date", "type", "payload")


@register("S7_compact_day", """
select dt as date, epoch_us(ts) as ts_us, kind, asset_id, market, side, round(price, 6) as price, round(size, 6) as size, null as payload
from v_book where dt < '2024-01-30'
union all select dt, epoch_us(ts), 'WindowMeta', null, null, null, null, null, '{"window_start":' || line_id || '}' from v_log
where kind_no = 4 and dt < '2024-01-30'
""")
def s7(spark, sf):
    """What lies on disk after two runs, the second with one more sealed day."""
    src, dst = fx.event_log_folder(fx.prepare(spark), sf), fresh_folder(spark, "compact")
    for today in ("2024-01-29", "2024-01-30"):
        event_log.compact_days(spark, src, dst, today)
    stored = lambda name: spark.read.parquet(f"{dst}/{name}").withColumn("date", F.col("date").cast("string"))
    book = stored("book").select("date", F.unix_micros("ts").alias("ts_us"), "kind", "asset_id", "market", "side",
                                 r6("price").alias("price"), r6("size").alias("size"))
    meta = stored("meta").select("date", F.unix_micros("ts").alias("ts_us"), F.col("type").alias("kind"), "payload")
    return book.unionByName(meta, allowMissingColumns=True)


@register("S8_compaction_audit", """
with b as (select dt, count(*) as n from v_book where line_id % 1009 <> 3 group by dt),
full_b as (select dt, count(*) as n from v_book group by dt)
select l.dt as date, count(*) as n_lines, count(case when kind_no is null then 1 end) as n_bad, max(b.n) as book_rows,
  count(case when kind_no = 4 then 1 end) as meta_rows, max(b.n) = max(full_b.n) as verified,
  max(b.n) = max(full_b.n) and count(case when kind_no is null then 1 end) = 0 as deletable
from v_log l left join b on b.dt = l.dt left join full_b on full_b.dt = l.dt group by l.dt
""")
def s8(spark, sf):
    rows = stage(event_log.event_rows(event_log.decode_event_log(fx.event_log(spark, sf)), ("line_id",)))
    book = event_log.book_of(rows, ("line_id",)).filter("line_id % 1009 <> 3")
    audit = event_log.audit_rows(rows, book, event_log.meta_of(rows))
    return audit.select("date", "n_lines", "n_bad", "book_rows", "meta_rows", "verified", "deletable")


_FRAME_SQL = """
with f as (select event_id as line_id, event_id % 7 as m, 'a' || (event_id % 23) as asset_id, (event_id % 89 + 10) / 100.0::double as p,
  (event_id % 500 + 1)::double as s from events where event_id % 101 <> 0)
"""


@register("S9_parse_ws_frames", _FRAME_SQL + """
select line_id, 'book' as kind, asset_id, null as side, null::double as price, null::double as size, 3 as n_levels from f where m = 0
union all select line_id, 'pchange', asset_id, 'BUY', p, 0::double, 0 from f where m in (6, 1)
union all select line_id, 'pchange', asset_id, 'SELL', 0.5::double, s, 0 from f where m in (6, 1)
union all select line_id, 'trade', asset_id, 'SELL', p, 0::double, 0 from f where m in (6, 2)
union all select line_id, 'pchange', asset_id, 'BUY', p, 5::double, 0 from f where m = 3
""")
def s9(spark, sf):
    out = frames.parse_ws_frames(fx.ws_frames(spark, sf), "text", ("line_id",))
    n = F.coalesce(F.size("bids") + F.size("asks"), F.lit(0))
    n = F.when(F.col("kind") == "book", n).otherwise(F.lit(0))
    return out.select("line_id", "kind", "asset_id", "side", r6("price").alias("price"),
                      r6("size").alias("size"), n.cast("int").alias("n_levels"))


@register("S9_frame_counts", """
select cast(sum(case when event_id % 101 <> 0 and event_id % 7 = 6 then 2 else 1 end) as bigint) as messages,
  count(case when event_id % 101 <> 0 and event_id % 7 = 5 then 1 end) as unknown,
  count(case when event_id % 101 = 0 or event_id % 7 in (3, 4) then 1 end) as malformed from events
""")
def s9_counts(spark, sf):
    return frames.frame_counts(fx.ws_frames(spark, sf), "text")


def twap_updates(spark, sf, keep=("line_id", "t")):
    return frames.parse_twap_updates(fx.twap_messages(spark, sf), "text", keep=keep)


@register("S10_parse_twap_updates", """
select line_id, case when broken then null else pair end as pair, case when broken then null else round(price, 6) end as price, broken as is_error
from v_twap_msg where not pong
""")
def s10(spark, sf):
    return twap_updates(spark, sf).select(
        "line_id", F.when(~F.col("is_error"), F.col("pair")).alias("pair"), r6("price").alias("price"), "is_error")


@register("S11_load_market_metadata", """
select market_id, condition_id, neg_risk, round(liquidity, 6) as liquidity, array_to_string(outcomes, '|') as outcomes,
  array_to_string(tokens, '|') as tokens, array_to_string(prices, '|') as prices from v_meta
""")
def s11(spark, sf):
    m = metadata.decode_market_metadata(fx.market_meta(spark, sf))
    return m.select("market_id", "condition_id", "neg_risk", r6("liquidity").alias("liquidity"),
                    *[F.array_join(c, "|").alias(c) for c in ("outcomes", "tokens", "prices")])


@register("S12_write_feature_table", """
select series_key, t, round(spot, 6) as spot, null::double as cand_ask from v_clean where event_id % 2 = 0
union all select series_key, t, null::double, round(cand_ask, 6) from v_clean where event_id % 2 = 1
""")
def s12(spark, sf):
    """Written by series and read back."""
    c, folder = fx.clean(spark, sf), fresh_folder(spark, "features")
    a = c.filter("event_id % 2 = 0").select("series_key", "t", r6("spot").alias("spot"))
    b = c.filter("event_id % 2 = 1").select("series_key", "t", r6("cand_ask").alias("cand_ask"))
    tables.write_feature_table([a, b], folder, ["series_key"])
    return spark.read.schema("t bigint, spot double, cand_ask double, series_key string").parquet(folder)


SPLIT_SQL = """
pos as (select *, row_number() over (partition by series_key order by ws) as position, count(*) over (partition by series_key) as n_windows from res),
sp as (select *, case when position <= cast(floor(n_windows * 0.7::double) as bigint) then 'train' else 'val' end as split from pos)"""


REPORTED = ("click", "error", "purchase", "signup", "view")


@register("S13_write_grid_report", f"with {REPLAY_SQL}, {SPLIT_SQL} select 'base' as param_id, " + ", ".join(
    f"count(case when series_key = '{s}' and split = '{x}' and size > 0 then 1 end) as {s}_{y}_n, "
    f"coalesce(round(avg(case when series_key = '{s}' and split = '{x}' and size > 0 then pnl end), 6) + 0.0::double, 0.0::double) as {s}_{y}_pnl_per"
    for s in REPORTED for x, y in (("train", "tr"), ("val", "va"))) + " from sp")
def s13(spark, sf):
    """The report of every series as it stands in the written file."""
    split = stage(studies.position_split(replayed(spark, sf), ["series_key"], "ws", DAY))
    every = [r.series_key for r in split.select("series_key").distinct().orderBy("series_key").collect()]
    rep, folder = tables.grid_report(split, every, metrics=("n", "pnl_per")), fresh_folder(spark, "report")
    columns = [f"{s}_{x}" for s in REPORTED for x in ("tr", "va")]
    rep = rep.select("param_id", *[f"{c}_n" for c in columns], *[r6(f"{c}_pnl_per").alias(f"{c}_pnl_per") for c in columns])
    tables.write_grid_report(rep, folder)
    return spark.read.schema(rep.schema).option("header", True).csv(folder)


@register("S14_load_judgments", """
select line_id, action, symbol, ws as window_start, len(signals) as n_signals,
  action = 'maybe' or list_contains(signals, 'unregistered') as rejected from v_judge
""")
def s14(spark, sf):
    j = judgments.parse_judgments(fx.judgments(spark, sf), keep=("line_id",))
    return j.select("line_id", "action", "symbol", "window_start",
                    big(F.size("signals")).alias("n_signals"), "rejected")


@register("S15_latest_state", """
with c as (select *, row_number() over (partition by cust order by d, k) as rn from v_changes)
select cust, arg_max(case when list_contains(changed, 'slug') then slug end, case when list_contains(changed, 'slug') then rn end) as slug,
  max(case when list_contains(changed, 'winner') then rn * 10 + coalesce(case winner when 'F' then 1 when 'O' then 2 when 'P' then 3 end, 0) end) % 10 as winner_code,
  arg_max(case when list_contains(changed, 'pnl') then pnl end, case when list_contains(changed, 'pnl') then rn end) as pnl
from c group by cust
""")
def s15(spark, sf):
    out = ledger.latest_state(fx.change_log(spark, sf), ["cust"], "seq", ["slug", "winner", "pnl"])
    supplied = ledger.latest_state(
        fx.change_log(spark, sf).withColumn("winner", F.coalesce("winner", F.lit("null"))),
        ["cust"], "seq", ["winner"]).withColumnRenamed("winner", "w2")
    code = (F.when(F.col("winner") == "F", 1).when(F.col("winner") == "O", 2).when(F.col("winner") == "P", 3)
            .when(F.col("w2") == "null", 0))
    return out.join(supplied, "cust").select("cust", "slug", big(code).alias("winner_code"), "pnl")


# ------------------------------------------------------------------ ledgers, audits, ordering

@register("A19_daily_exposure", """
select ws as day_start, round(sum(cost_c / 100), 6) as invested,
  round(coalesce(sum(case when status = 'closed' then (filled_size - 20)::double end), 0) + coalesce(sum(case when status = 'settled' then -fee_c / 100 end), 0), 6) + 0.0::double as realized
from v_positions group by ws
""")
def a19(spark, sf):
    w = fx.positions(spark, sf).select(
        F.col("ws").alias("window_start"), (F.col("cost_c") / 100).alias("entry_cost"),
        F.when(F.col("status") == "closed", (F.col("filled_size") - 20).cast("double")).alias("realized_pnl"),
        F.when(F.col("status") == "settled", -F.col("fee_c") / 100).alias("settle_pnl"))
    out = ledger.daily_exposure(w)
    return out.select("day_start", r6("invested").alias("invested"), r6("realized").alias("realized"))


@register("A23_tag_frequency", """
select tag, count(*) as n from (select unnest(signals) as tag from v_judge
  where action <> 'maybe' and not list_contains(signals, 'unregistered')) x group by tag
""")
def a23(spark, sf):
    j = judgments.parse_judgments(fx.judgments(spark, sf)).filter("not rejected")
    return judgments.tag_frequency(j)


@register("A23_judgment_totals", """
select count(*) as total, count(case when action = 'enter' then 1 end) as n_enter, count(case when action = 'skip' then 1 end) as n_skip,
  greatest(0, 384 - count(*)) as still_needed from v_judge where action <> 'maybe' and not list_contains(signals, 'unregistered')
""")
def a23_totals(spark, sf):
    return judgments.judgment_totals(judgments.parse_judgments(fx.judgments(spark, sf)).filter("not rejected"))


@register("A24_position_ledger", """
with l as (select token_id, sum(case when side = 'BUY' then size else -size end) as position,
    sum(case when side = 'BUY' then price * size end) as cash_out, sum(case when side = 'SELL' then price * size end) as cash_in,
    sum(case when side = 'BUY' then -price * size else price * size end) as cash from v_fills group by token_id)
select token_id, cast(position as double) as position, round(cash_out::double, 6) as cash_out, round(cash_in::double, 6) as cash_in,
  round((cash + case token_id % 3 when 0 then position when 1 then 0 else 0 end)::double, 6) + 0.0::double as cash_after
from l
""")
def a24(spark, sf):
    book = execution.position_ledger(fx.fills(spark, sf))
    won = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("token_id"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit(True)).when(F.col("p_partkey") % 3 == 1, F.lit(False)).alias("won"))
    settled = execution.settle_ledger(book, won).select("token_id", "cash_after")
    return book.join(settled, "token_id").select(
        "token_id", F.col("position").cast("double").alias("position"), r6("cash_out").alias("cash_out"),
        r6("cash_in").alias("cash_in"), r6("cash_after").alias("cash_after"))


@register("A25_order_fill_state", """
with g as (select order_id, sum(size)::double as f, sum(price * size)::double as amt from v_fills group by 1),
o as (select o_orderkey as order_id, (o_orderkey % 150 + 20)::double as order_size,
        case when o_orderkey % 6 = 0 then null else o_totalprice end as target from orders)
select order_id, coalesce(f, 0.0::double) as filled, amt / f as avg_price, greatest(order_size - coalesce(f, 0), 0) as remaining,
  case when coalesce(f, 0) <= 0 then 'OPEN' when f >= order_size then 'FILLED' else 'PARTIAL' end as state,
  round(case when target > 0 then coalesce(amt, 0) / target end, 6) as fill_ratio
from o left join g using (order_id)
""")
def a25(spark, sf):
    k = F.col("o_orderkey")
    orders = fx.table(spark, sf, "orders").select(
        k.alias("order_id"), (k % 150 + 20).cast("double").alias("order_size"),
        F.when(k % 6 != 0, F.col("o_totalprice")).alias("target_notional"))
    out = execution.order_fill_state(orders, fx.fills(spark, sf))
    return out.select("order_id", "filled", "avg_price", "remaining", "state",
                      r6("fill_ratio").alias("fill_ratio"))


@register("A26_twap_window_stats", """
with g as (select pair, t // 86400 * 86400 as window_start, arg_min(price, t * 1000000 + line_id) as firstv, arg_max(price, t * 1000000 + line_id) as lastv,
    max(price) as high, min(price) as low, count(*) as samples from v_twap group by 1, 2)
select pair, window_start, round(coalesce(lag(lastv) over (partition by pair order by window_start), firstv), 6) as base, round(lastv, 6) as last,
  round(high, 6) as high, round(low, 6) as low, round(high - low, 6) as range, samples from g
""")
def a26(spark, sf):
    up = twap_updates(spark, sf).filter("not is_error")
    s = audits.twap_window_stats(up, "pair", "t", "price", seq="line_id", window_len=DAY)
    return s.select("pair", "window_start", *[r6(c).alias(c) for c in ("base", "last", "high", "low", "range")],
                    "samples")


@register("A27_stream_freshness_audit", """
with names as (select distinct series_key from v_windows union all select 'silent'),
g as (select series_key, max(t) as newest from v_ticks where t <= 1706572800 group by 1)
select n.series_key, newest, 1706572800 - newest as age, case when newest is null then 'no data' when 1706572800 - newest > 600 then 'stalled' else 'ok' end as state
from names n left join g using (series_key)
""")
def a27(spark, sf):
    rows = fx.ticks(spark, sf)
    names = fx.windows(spark, sf).select("series_key").distinct()
    silent = names.select(F.explode(F.array("series_key", F.lit("silent"))).alias("series_key"))
    return audits.stream_freshness_audit(rows, "series_key", "t", F.lit(1706572800).cast("bigint"),
                                         silent, stall=600)


@register("A28_window_coverage", """
with s as (select unnest(['click','error','purchase','signup','view']) as series_key),
x as (select s.series_key, list_contains(found, s.series_key) as ok, partial from v_coverage, s)
select series_key, count(*) as windows, count(case when ok then 1 end) as found, count(case when not ok then 1 end) as missing,
  count(case when ok and partial then 1 end) as partial, round(count(case when ok then 1 end) / count(*), 6) as coverage from x group by 1
""")
def a28(spark, sf):
    c = audits.window_coverage(fx.coverage_meta(spark, sf))
    return c.withColumn("coverage", r6("coverage"))


@register("K1_top_levels", """
select asset, side, level, price_c, size from (select *, row_number() over (partition by asset, side
  order by case when side = 'bid' then -price_c else price_c end) as level from v_levels) x where level <= 3
""")
def k1(spark, sf):
    return studies.top_levels(fx.raw_book_levels(spark, sf), ["asset"], 3, "price_c").select(
        "asset", "side", "level", "price_c", "size")


@register("K2_top_markets", """
select market_id, round(volume24hr, 6) as volume24hr from v_meta where active and not closed and not neg_risk order by volume24hr desc, market_id limit 25
""")
def k2(spark, sf):
    m = metadata.decode_market_metadata(fx.market_meta(spark, sf))
    top = studies.rank_top(m.filter("active and not closed and not neg_risk"), F.col("volume24hr"), 25, ["market_id"])
    return top.select("market_id", r6("volume24hr").alias("volume24hr"))


@register("K3_rank_top", f"""
with {REPLAY_SQL} select series_key, ws, round(pnl, 6) + 0.0::double as pnl from res where size > 0 order by round(pnl, 6) desc, series_key, ws limit 15
""")
def k3(spark, sf):
    r = replayed(spark, sf).filter("size > 0").select("series_key", "ws", r6("pnl").alias("pnl"))
    return studies.rank_top(r, F.col("pnl"), 15, ["series_key", "ws"])


@register("K4_latest_n", """
select line_id, symbol, action from v_judge where action <> 'maybe' and not list_contains(signals, 'unregistered') order by line_id desc limit 20
""")
def k4(spark, sf):
    j = judgments.parse_judgments(fx.judgments(spark, sf), keep=("line_id",)).filter("not rejected")
    return judgments.latest(j, "line_id", 20).select("line_id", "symbol", "action")


@register("U1_union_sides", """
select series_key, t, 'Up' as side, au as ask, bu as bid, sau as ask_size, su as bid_size from v_clean
union all select series_key, t, 'Down', ad, bd, sad, sd from v_clean
""")
def u1(spark, sf):
    return studies.union_sides(fx.clean(spark, sf), ["series_key", "t"])
