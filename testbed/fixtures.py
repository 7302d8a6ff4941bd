"""Library inputs derived from the given tables by exact integer arithmetic.

Each function mirrors one shared oracle view (same name with a ``v_`` prefix). One calendar day
plays one 300-second event window, so times are scaled by 288.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.asof import dedupe_ticks
from tickloom.operators.features import clean_ticks
from tickloom.session import prepare
from tickloom.streaming.session import fresh_folder

SCALE = 288
DAY = 86400
WINDOW = ["series_key", "ws"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def in_time_order(df: DataFrame, time: Column, files: int, folder: str | None = None) -> DataFrame:
    """A table as a stream of files cut in time, whatever series and windows the cuts fall into; one file per batch."""
    folder = folder or fresh_folder(df.sparkSession, "input")
    first, last = df.agg(F.min(time), F.max(time)).first()
    cut = F.least(F.floor((time - F.lit(first)) * files / F.lit(last - first + 1)), F.lit(files - 1))
    for i in range(files):  # one after the other, as the stream takes them by age
        df.filter(cut == i).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream."""
    if files > 1:
        return in_time_order(table(spark, sf_dir, "events"), seconds(F.col("ts")), files)
    schema = table(spark, sf_dir, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf_dir))


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def r6(c: Column | str) -> Column:
    """Six decimals for comparison. The nudge keeps exact ties (averages of cents) from rounding
    up in one engine and down in the other."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(1e-9), 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw two-sided ticks, one per series and second."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_key"), seconds(F.col("ts")).alias("t"),
        "event_id", "value")
    d = dedupe_ticks(ev, ["series_key"], "t", "event_id")
    eid = F.col("event_id")
    vc = F.floor(F.col("value") * 100).cast("bigint")
    c = (vc * 7 + eid) % 91 + 5
    sp = 1 + eid % 3
    gap = eid % 37 == 0
    cents = lambda x: x.cast("double") / 100
    return d.select(
        "series_key", (F.col("t") - F.col("t") % DAY).alias("ws"), "t",
        (F.col("t") % DAY).alias("elapsed"), "event_id", F.col("value").alias("spot"),
        F.when(gap, F.lit(0.0)).otherwise(cents(c)).alias("au"),
        F.when(gap, F.lit(0.0)).otherwise(cents(c - sp)).alias("bu"),
        cents(100 - c + sp).alias("ad"), cents(100 - c).alias("bd"),
        (5 + (eid * 13) % 60).alias("su"), (5 + (eid * 17) % 60).alias("sau"),
        (5 + (eid * 19) % 60).alias("sd"), (5 + (eid * 23) % 60).alias("sad"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_ticks(ticks(spark, sf_dir))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event window with its outcome (Up, Down or NULL)."""
    g = ticks(spark, sf_dir).groupBy("series_key", "ws").agg(
        F.count("*").alias("n"), F.max_by("spot", "t").alias("last"),
        F.min_by("spot", "t").alias("first"))
    unknown = (F.col("n") < 2) | (F.floor(F.col("ws") / DAY) % 11 == 0)
    return g.select("series_key", "ws", F.col("n").alias("n_ticks"),
                    F.when(unknown, F.lit(None)).when(F.col("last") >= F.col("first"), F.lit("Up"))
                    .otherwise(F.lit("Down")).alias("outcome"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly closes per series, standing in for one-second bars."""
    t = ticks(spark, sf_dir)
    return (t.withColumn("ts", F.col("t") - F.col("t") % 3600)
            .groupBy("series_key", "ts").agg(F.max_by("spot", "t").alias("close")))


def raw_book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form order book: asset, side, price in cents, size; a price can come several times."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("asset"),
        F.when(F.col("l_linenumber") % 2 == 1, F.lit("ask")).otherwise(F.lit("bid")).alias("side"),
        F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("bigint").alias("price_c"),
        F.col("l_quantity").cast("bigint").alias("size"))


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form order book: asset, side, price in cents, total size."""
    return raw_book_levels(spark, sf_dir).groupBy("asset", "side", "price_c").agg(F.sum("size").alias("size"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("token_id"),
        F.when(F.col("l_returnflag") == "A", F.lit("BUY")).otherwise(F.lit("SELL")).alias("side"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100)
        .cast("decimal(18,6)").alias("price"),
        F.col("l_quantity").cast("decimal(18,6)").alias("size"),
        F.struct("l_shipdate", "l_suppkey", "l_linenumber").alias("_order"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "O", F.lit("open"))
              .when(F.col("o_orderstatus") == "F", F.lit("settled")).otherwise(F.lit("closed")))
    day = seconds(F.col("o_orderdate"))
    return o.select(
        k.alias("position_id"),
        (F.col("o_custkey") % 50).alias("series_id"), (day - day % DAY).alias("ws"),
        F.when(k % 2 == 0, F.lit("Up")).otherwise(F.lit("Down")).alias("side"),
        status.alias("status"),
        (F.lit(5) + k % 40).alias("filled_size"),
        ((F.lit(16) + k % 14) * (F.lit(5) + k % 40)).cast("double").alias("cost_c"),
        ((k * 7) % 30).alias("fee_c"), F.col("o_custkey").alias("cust"))


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authoritative winner per position's window; a third of them is still unknown."""
    m = F.col("cust") % 3
    return positions(spark, sf_dir).select(
        "position_id",
        F.when(m == 0, F.lit("Up")).when(m == 1, F.lit("Down")).alias("winner"))


def event_log(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    """JSON event lines with the name of the daily file they would sit in."""
    ev = table(spark, sf_dir, "events") if ev is None else ev
    eid = F.col("event_id")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    p = F.format_string("0.%02d", eid % 89 + 10)
    q = F.format_string("0.%02d", eid % 79 + 10)
    s = (eid % 500 + 1).cast("string")
    head = F.format_string('{"recv_ts": "%s", "type": ', iso)
    asset = F.concat(F.lit('"asset_id": "a'), (eid % 23).cast("string"),
                     F.lit('", "market": "m'), (eid % 7).cast("string"), F.lit('"'))
    push = F.concat(
        F.lit('"WsBookEvent", "event": {'), asset,
        F.lit(', "bids": [{"price": "'), p, F.lit('", "size": "'), s,
        F.lit('"}, {"price": "0.05", "size": "7"}], "asks": [{"price": "'), q,
        F.lit('", "size": "'), s, F.lit('"}]}}'))
    delta = F.concat(
        F.lit('"WsPriceChange", "event": {'), asset, F.lit(', "side": "'),
        F.when(F.floor(eid / 5) % 2 == 0, F.lit("BUY")).otherwise(F.lit("SELL")),
        F.lit('", "price": "'), p, F.lit('", "size": "'),
        F.when(eid % 15 == 1, F.lit("0")).otherwise(s), F.lit('"}}'))
    rest = F.concat(
        F.lit('"RestBook", "event": {'), asset, F.lit(', "bids": {"'), p, F.lit('": "'), s,
        F.lit('"}, "asks": {"0.96": "'), s, F.lit('", "0.97": "3"}}}'))
    trade = F.concat(
        F.lit('"WsLastTrade", "event": {'), asset, F.lit(', "side": "BUY", "price": "'), p,
        F.lit('", "size": "'), s, F.lit('"}}'))
    meta = F.concat(F.lit('"WindowMeta", "window_start": '), eid.cast("string"), F.lit("}"))
    body = (F.when(eid % 5 == 0, push).when(eid % 5 == 1, delta).when(eid % 5 == 2, rest)
            .when(eid % 5 == 3, trade).otherwise(meta))
    line = F.concat(head, body)
    line = F.when(eid % 97 == 0, F.substring(line, 1, 30)).otherwise(line)
    name = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), F.lit("_market.jsonl"))
    return ev.select(eid.alias("line_id"), line.alias("line"), name.alias("file_name"))


def event_log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The lines as text files in folders of a day."""
    folder = fresh_folder(spark, "log")
    lines = event_log(spark, sf_dir)
    (lines.select(F.col("line").alias("value"), F.split_part("file_name", F.lit("_"), F.lit(1)).alias("date"))
     .repartition("date").write.partitionBy("date").text(folder))
    return folder


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgment log lines as JSON text; some carry a bad action or an unregistered tag."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    vocab = F.array(*[F.lit(v) for v in JUDGMENT_VOCAB])
    tag = F.element_at(vocab, (eid % len(JUDGMENT_VOCAB) + 1).cast("int"))
    second = F.when(eid % 31 == 0, F.lit("unregistered")).otherwise(
        F.element_at(vocab, (F.floor(eid / 3) % len(JUDGMENT_VOCAB) + 1).cast("int")))
    action = (F.when(eid % 53 == 0, F.lit("maybe")).when(eid % 2 == 0, F.lit("enter"))
              .otherwise(F.lit("skip")))
    t = seconds(F.col("ts"))
    with_tags = F.concat(F.lit(', "signals": ["'), tag, F.lit('", "'), second, F.lit('"]'))
    return ev.select(eid.alias("line_id"), F.concat(
        F.lit('{"action": "'), action, F.lit('", "symbol": "'), F.col("event_type"),
        F.lit('", "window_start": '), (t - t % DAY).cast("string"),
        F.when(eid % 4 == 0, F.lit("")).otherwise(with_tags), F.lit("}")).alias("line"))


# The registered judgment tags.
JUDGMENT_VOCAB = ("vol_low", "vol_high", "trend_favor", "feed_slow", "spread_wide", "depth_thin",
                  "cross_coin", "streak", "session", "intuition", "news")


def market_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market metadata with JSON-encoded list strings, as a JSON text per market."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    outcomes = (F.when(k % 7 == 6, F.lit("not json"))
                .when(k % 7 == 5, F.lit('["Yes","No"]'))
                .when(k % 7 == 4, F.lit('["DOWN","UP"]')).otherwise(F.lit('["Up","Down"]')))
    tokens = (F.when(k % 11 == 10, F.concat(F.lit('["'), ks, F.lit('0"]')))
              .otherwise(F.concat(F.lit('["'), ks, F.lit('0","'), ks, F.lit('1"]'))))
    prices = (F.when(k % 5 == 0, F.lit('["1","0"]')).when(k % 5 == 1, F.lit('["0","1"]'))
              .when(k % 5 == 2, F.lit('["0.999","0.001"]'))
              .when(k % 5 == 3, F.lit('["0.45","0.55"]')).otherwise(F.lit("oops")))
    return o.select(
        k.alias("market_id"), outcomes.alias("outcomes"), tokens.alias("clobTokenIds"),
        prices.alias("outcomePrices"), (k % 13 != 0).alias("active"), (k % 3 == 0).alias("closed"),
        (k % 4 == 0).alias("negRisk"), F.concat(F.lit("c"), ks).alias("conditionId"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("liquidityNum"),
        (F.col("o_totalprice") * 2).alias("volume24hr"))


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily open/high/low/close per series and whether Up won."""
    t = ticks(spark, sf_dir)
    return t.groupBy("series_key", "ws").agg(
        F.min_by("spot", "t").alias("o"), F.max("spot").alias("h"), F.min("spot").alias("l"),
        F.max_by("spot", "t").alias("c"),
        F.sum(F.floor(F.col("spot") * 100 + F.lit(0.5)).cast("bigint")).alias("_s"),
        F.count("*").alias("_n")).select(
        "series_key", "ws", "o", "h", "l", "c",
        (F.col("_s") >= F.floor(F.col("o") * 100 + F.lit(0.5)).cast("bigint") * F.col("_n"))
        .alias("up_won"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert log: which columns each write supplies, with explicit NULL writes."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    supplied = (F.when(k % 3 == 0, F.array(F.lit("slug"), F.lit("winner")))
                .when(k % 3 == 1, F.array(F.lit("pnl"))).otherwise(F.array(F.lit("winner"), F.lit("pnl"))))
    return o.select(
        F.col("o_custkey").alias("cust"),
        F.struct(seconds(F.col("o_orderdate")).alias("d"), k.alias("k")).alias("seq"),
        supplied.alias("changed"), F.concat(F.lit("s"), k.cast("string")).alias("slug"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("winner"),
        (k % 1000 - 500).alias("pnl"))


def twap_messages(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    ev = table(spark, sf_dir, "events") if ev is None else ev
    eid = F.col("event_id")
    cents = F.floor(F.col("value") * 100).cast("bigint").cast("string")
    fixed = F.concat(F.lit(', "full_accuracy_value": "'), cents, F.lit('0000000000000000"'))
    shown = F.concat(F.lit(', "value": '), F.col("value").cast("decimal(18,2)").cast("string"))
    body = F.concat(
        F.lit('{"payload": {"symbol": "'), F.col("event_type"), F.lit('/usd"'),
        F.when(eid % 7 == 3, F.lit("")).otherwise(shown),
        F.when((eid % 3 == 0) | (eid % 7 == 3), fixed).otherwise(F.lit("")), F.lit("}}"))
    text = (F.when(eid % 41 == 0, F.lit("PONG")).when(eid % 43 == 0, F.substring(body, 1, 20))
            .otherwise(body))
    return ev.select(eid.alias("line_id"), seconds(F.col("ts")).alias("t"),
                     F.col("ts").cast("timestamp").alias("recv_ts"), text.alias("text"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("intent_id"), (seconds(F.col("o_orderdate")) - seconds(F.col("o_orderdate")) % DAY).alias("day_start"),
        (k % 60).cast("double").alias("n_dime"),
        ((k % 60).cast("double") / 10).alias("notional"), (k % 29 == 0).alias("kill_switch"),
        (k % 13 == 0).alias("same_window_open"), (k % 20).cast("double").alias("invested_today"),
        (k % 23 - 12).cast("double").alias("realized_today"), (k % 2 == 0).alias("live"),
        F.when(k % 8 == 0, F.lit(None)).otherwise(k % 9).cast("double").alias("balance"))


def coverage_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window: which series were found, which are missing, partial flag."""
    w = windows(spark, sf_dir)
    day = F.floor(F.col("ws") / DAY)
    found = w.filter((F.length("series_key") + day) % 4 != 0).groupBy("ws").agg(
        F.sort_array(F.collect_set("series_key")).alias("found"))
    every = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    return found.select("ws", "found", F.array_except(every, "found").alias("missing"),
                        (F.floor(F.col("ws") / DAY) % 5 == 0).alias("partial"))


def ws_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Push frames: books, changes, trades, arrays of two, unknown types, malformed messages."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    p = F.format_string("0.%02d", eid % 89 + 10)
    s = (eid % 500 + 1).cast("string")
    asset = F.concat(F.lit('"asset_id": "a'), (eid % 23).cast("string"), F.lit('", "market": "m"'))
    book = F.concat(F.lit('{"event_type": "book", '), asset, F.lit(', "bids": [{"price": "'), p,
                    F.lit('", "size": "'), s, F.lit('"}], "asks": [{"price": "0.99", "size": "1"}, '
                                                    '{"price": "1.00", "size": "2"}]}'))
    change = F.concat(F.lit('{"event_type": "price_change", '), asset,
                      F.lit(', "changes": [{"side": "BUY", "price": "'), p, F.lit('", "size": "0"}, '
                            '{"side": "SELL", "price": "0.5", "size": "'), s, F.lit('"}]}'))
    trade = F.concat(F.lit('{"event_type": "last_trade_price", '), asset, F.lit(', "price": "'), p,
                     F.lit('", "side": "SELL"}'))
    half = F.concat(F.lit('{"event_type": "price_change", '), asset,
                    F.lit(', "changes": [{"side": "BUY", "price": "'), p, F.lit('", "size": "5"}, '
                          '{"side": "SELL", "size": "5"}, {"side": "BUY", "price": "0.4", "size": "1"}]}'))
    nameless = F.lit('{"event_type": "last_trade_price", "price": "0.5"}')
    other = F.lit('{"event_type": "tick_size_change", "asset_id": "a1"}')
    two = F.concat(F.lit("["), trade, F.lit(", "), change, F.lit("]"))
    m = eid % 7
    text = (F.when(m == 0, book).when(m == 1, change).when(m == 2, trade).when(m == 3, half)
            .when(m == 4, nameless).when(m == 5, other).otherwise(two))
    text = F.when(eid % 101 == 0, F.lit("{broken")).otherwise(text)
    return ev.select(eid.alias("line_id"), text.alias("text"))


def kline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV candle lines, milliseconds and microseconds mixed, some header lines in between."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    t = seconds(F.col("ts"))
    stamp = F.when(eid % 2 == 0, t * 1000 + eid % 1000).otherwise(t * 1000000 + eid % 1000000)
    v = F.col("value").cast("string")
    line = F.concat_ws(",", stamp.cast("string"), v, v, v, (eid % 1000).cast("string"), F.lit("extra"))
    line = F.when(eid % 50 == 0, F.lit("open_time,open,high,low,close")).otherwise(line)
    return ev.select(eid.alias("line_id"), line.alias("line"))
