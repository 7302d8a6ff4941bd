"""Registered queries: streaming operators (T1-T6), run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testbed import fixtures as fx
from testbed.fixtures import DAY, SCALE, r6
from testbed.q_rules import _BASE, RNG
from testbed.q_windows import (
    COUNT_COLS,
    MIN_SAMPLES,
    SNAP_COLS,
    SNAP_SQL,
    SPOT,
    WINDOW,
    _rounded_sql,
)
from testbed.registry import register
from tickloom.operators import features, triggers
from tickloom.params import parameter_set
from tickloom.sources import event_log, frames
from tickloom.streaming import ingest, lookback, state
from tickloom.streaming.session import fresh_folder, prepare_streaming


def finish(df: DataFrame, mode: str = "append", into: str | None = None) -> DataFrame:
    """Run a stream over everything that is there (and new since the last run) and return what it wrote."""
    spark = df.sparkSession
    folder = into or fresh_folder(spark, "stream")
    (df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
     .option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@register("T1_stream_book_rows", """
select dt as date, kind, side, count(*) as n, round(sum(price), 6) as sum_price, cast(sum(cast(size as bigint)) as bigint) as sum_size from v_book group by 1, 2, 3
union all select dt, 'meta', 'WindowMeta', count(*), null, null from v_log where kind_no = 4 group by dt
""")
def t1(spark, sf):
    src = fx.event_log_folder(prepare_streaming(fx.prepare(spark)), sf)
    folder = fresh_folder(spark, "book")
    ingest.stream_book_rows(ingest.tail_event_log(spark, src, 20), f"{folder}/rows", f"{folder}/log").awaitTermination()
    cents = F.sum(F.col("price").cast("decimal(18,6)")).cast("double")
    book = ingest.tailed(spark, f"{folder}/rows", "book").groupBy("date", "kind", "side").agg(
        F.count("*").alias("n"), r6(cents).alias("sum_price"), F.sum("size").cast("bigint").alias("sum_size"))
    meta = ingest.tailed(spark, f"{folder}/rows", "meta").groupBy(
        "date", F.lit("meta").alias("kind"), F.col("type").alias("side")).agg(F.count("*").alias("n"))
    return book.unionByName(meta, allowMissingColumns=True)


@register("T2_stream_book_state", """
with e as (select line_id, asset_id, epoch_us(ts) as ts, kind_no in (0, 2) as snap from v_log where kind_no in (0, 1, 2)),
se as (select *, max(case when snap then line_id end) over (partition by asset_id order by line_id) as sid from e),
sn as (select asset_id, line_id as sid, lead(line_id) over (partition by asset_id order by line_id) as until from e where snap),
c as (select b.asset_id, b.side, b.price, b.size, b.line_id, se.sid from v_book b join se on se.line_id = b.line_id where b.kind <> 'trade' and se.sid is not null),
i as (select c.*, least(coalesce(lead(c.line_id) over (partition by c.asset_id, c.sid, side, price order by c.line_id), 9223372036854775807),
    coalesce(sn.until, 9223372036854775807)) as gone from c join sn on sn.sid = c.sid),
t as (select se.line_id, max(case when side = 'bid' then price end) as bid, min(case when side = 'ask' then price end) as ask,
    arg_max(case when side = 'bid' then size end, case when side = 'bid' then price end) as bid_size,
    arg_min(case when side = 'ask' then size end, case when side = 'ask' then price end) as ask_size
  from se join i on i.sid = se.sid and i.line_id <= se.line_id and se.line_id < i.gone and i.size > 0 group by 1)
select se.asset_id, se.line_id as seq, se.ts, se.sid is not null as ready, bid as best_bid, bid_size, ask as best_ask, ask_size
from se left join t on t.line_id = se.line_id
""")
def t2(spark, sf):
    """Top of book after every event; the log comes in four files cut in time, so inside every asset."""
    prepare_streaming(fx.prepare(spark))
    log = event_log.decode_event_log(fx.event_log(spark, sf, fx.event_stream(spark, sf, files=4)))
    events = state.book_state_events(log.withColumnRenamed("line_id", "seq"))
    return finish(state.stream_book_state(events, forget=60 * DAY))


@register("T3_stream_twap_stats", """
with g as (select pair, t // 86400 * 86400 as window_start, arg_min(price, t * 1000000 + line_id) as firstv, arg_max(price, t * 1000000 + line_id) as lastv,
    max(price) as high, min(price) as low, count(*) as samples from v_twap group by 1, 2)
select pair, window_start, round(coalesce(lag(lastv) over (partition by pair order by window_start), firstv), 6) as base, round(lastv, 6) as last,
  round(high, 6) as high, round(low, 6) as low, round(high - low, 6) as range, samples from g
""")
def t3(spark, sf):
    """All windows, over files cut inside them; an update 60 days on flushes the last ones."""
    prepare_streaming(fx.prepare(spark))
    ev, folder, into = fx.table(spark, sf, "events"), fresh_folder(spark, "input"), fresh_folder(spark, "stream")
    messages = fx.twap_messages(spark, sf, fx.in_time_order(ev, fx.seconds(F.col("ts")), 4, folder))
    updates = frames.parse_twap_updates(messages, "text", keep=("line_id", "recv_ts")).filter("not is_error")
    stats = ingest.stream_twap_stats(updates, seq="line_id", window="1 day")
    finish(stats, into=into)
    last = ev.filter("event_id % 41 <> 0 and event_id % 43 <> 0").orderBy("event_id").limit(1)
    (last.withColumns({"event_type": F.lit("_end"), "ts": F.col("ts") + F.expr("interval 60 days")})
     .coalesce(1).write.mode("append").parquet(folder))
    out = finish(stats, into=into).filter("pair <> '_end/usd'")
    return out.select("pair", "window_start", *[r6(c).alias(c) for c in ("base", "last", "high", "low", "range")],
                      "samples")


@register("T4_stream_staleness", """
with d as (select distinct event_type as key, cast(floor(epoch(ts)) as bigint) as t from events),
g as (select key, t, lag(t) over w as prev, lead(t) over w as nxt from d window w as (partition by key order by t)),
m as (select cast(floor(max(epoch(ts))) as bigint) as mt from events)
select key, t as "at", 'fresh' as state from g where prev is null or t - prev > 3600
union all select key, t + 3600, 'stale' from g, m where nxt - t > 3600 or (nxt is null and t + 3600 <= mt - 3600)
""")
def t4(spark, sf):
    """Over files cut in time; a last 'stale' comes out when the watermark, an hour behind, has passed it."""
    prepare_streaming(fx.prepare(spark))
    updates = fx.event_stream(spark, sf, files=4).select(
        F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return finish(state.stream_staleness(updates, 3600, delay="1 hour"))


@register("T5_stream_features", f"""
with {SNAP_SQL} select series_key, ws, t, cand, feed_fresh, spot_sample_count_60, score, {_rounded_sql(SNAP_COLS)}, {', '.join(COUNT_COLS)} from snap
""")
def t5(spark, sf):
    prepare_streaming(fx.prepare(spark))

    def compute(ticks: DataFrame) -> DataFrame:
        cleaned = features.clean_ticks(ticks).withColumn("spot", F.expr(SPOT))
        return features.feature_snapshot(cleaned, WINDOW, scale=SCALE, min_samples=MIN_SAMPLES)

    folder = fresh_folder(spark, "features")
    ticks = fx.in_time_order(fx.ticks(spark, sf), F.col("t"), 4)
    lookback.stream_features(ticks, compute, f"{folder}/out", f"{folder}/log", keys=WINDOW, scale=SCALE,
                             window_len=DAY).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "series_key", "ws", "t", "cand", "feed_fresh", "spot_sample_count_60", "score",
        *[r6(c).alias(c) for c in SNAP_COLS], *COUNT_COLS)


SIGNAL_SQL = f"""
select series_key, ws, t, cand, round(cand_ask, 6) as cand_ask from (
  select *, row_number() over (partition by series_key, ws order by t) as rn from ({_BASE}) y where action in ('ENTER', 'ABORT_DATA', 'ABORT_VOL')) z
where rn = 1 and action = 'ENTER'
"""


def judged(ticks: DataFrame) -> DataFrame:
    cleaned = features.clean_ticks(ticks).withColumn("rng", F.expr(RNG))
    return triggers.entry_decisions(cleaned, {"base": parameter_set()}, time_scale=SCALE)


@register("T6_stream_first_signal", SIGNAL_SQL)
def t6(spark, sf):
    prepare_streaming(fx.prepare(spark))
    # files cut inside windows arrive in any order, so the watermark waits for the whole month; a last
    # window, 60 days on, lets it pass
    ticks = fx.ticks(spark, sf)
    ahead = 60 * DAY
    last = ticks.agg(F.max("ws")).first()[0]
    end = ticks.filter(F.col("ws") == last).withColumns({
        "series_key": F.lit("_end"), "ws": F.col("ws") + ahead, "t": F.col("t") + ahead})
    folder = fresh_folder(spark, "input")
    ticks.repartition(4, "t").write.parquet(folder)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    signals = state.stream_first_signal(judged(stream), window_len=DAY, delay="40 days")
    out = fresh_folder(spark, "stream")
    finish(signals, into=out)
    end.select(*ticks.columns).coalesce(1).write.mode("append").parquet(folder)
    out = finish(signals, into=out).filter("series_key <> '_end'")
    return out.select("series_key", "ws", "t", "cand", r6("cand_ask").alias("cand_ask"))


@register("T6_first_signal_batch", SIGNAL_SQL)
def t6_batch(spark, sf):
    out = state.first_signal(judged(fx.ticks(spark, sf)))
    return out.select("series_key", "ws", "t", "cand", r6("cand_ask").alias("cand_ask"))
