"""Streams fed file by file give what the batch operators give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tickloom.operators import audits, features, triggers
from tickloom.params import parameter_set
from tickloom.sources import event_log
from tickloom.streaming import ingest, lookback, state
from tickloom.streaming.session import prepare_streaming

W = ["series_key", "ws"]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    prepare_streaming(spark).conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _feed(spark, tmp_path, parts):
    """One file per part, in order, read one per micro-batch."""
    folder = tmp_path / "in"
    for i, df in enumerate(parts):
        df.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1 if i + 1 < len(parts) else 0)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _finish(df, tmp_path, name="out"):
    (df.writeStream.format("parquet").option("path", str(tmp_path / name))
     .option("checkpointLocation", str(tmp_path / f"{name}-log")).trigger(availableNow=True)
     .start().awaitTermination())
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


def test_book_state(spark, rows, tmp_path):
    schema = ("asset_id string, ts bigint, seq bigint, kind string, bids array<struct<price:double,size:double>>, "
              "asks array<struct<price:double,size:double>>, side string, price double, size double")
    snap = lambda ts: ("a", ts, ts, "snapshot", [(.60, 10.), (.59, 20.)], [(.62, 5.), (.63, 6.)], None, None, None)
    delta = lambda ts, side, p, s: ("a", ts, ts, "delta", [], [], side, p, s)
    parts = [
        rows([delta(1, "bid", .61, 9.), snap(2), delta(3, "bid", .61, 50.)], schema),
        rows([delta(4, "ask", .62, 0.), delta(5, "bid", .61, 0.), ("a", 6, 6, "disconnect", [], [], None, None, None)], schema),
        rows([delta(7, "bid", .70, 1.), snap(8)], schema)]
    out = _finish(state.stream_book_state(_feed(spark, tmp_path, parts)), tmp_path).orderBy("ts").collect()
    got = [(r.ready, r.best_bid, r.bid_size, r.best_ask) for r in out]
    assert got == [
        (False, None, None, None), (True, .60, 10., .62), (True, .61, 50., .62), (True, .61, 50., .63),
        (True, .60, 10., .63), (False, None, None, None), (False, None, None, None), (True, .60, 10., .62)]


BOOK = ("asset_id string, ts bigint, seq bigint, kind string, bids array<struct<price:double,size:double>>, "
        "asks array<struct<price:double,size:double>>, side string, price double, size double")


def test_a_forgotten_book_waits_for_a_snapshot(spark, rows, tmp_path):
    hour = 3_600_000_000
    snap = lambda asset, ts: (asset, ts, ts, "snapshot", [(.4, 7.)], [(.6, 8.)], None, None, None)
    delta = lambda asset, ts: (asset, ts, ts, "delta", [], [], "bid", .45, 3.)
    parts = [rows([snap("a", hour), snap("b", hour)], BOOK), rows([delta("b", 2 * hour)], BOOK),
             rows([snap("c", 5 * hour)], BOOK), rows([snap("c", 6 * hour)], BOOK),  # time passes
             rows([delta("a", 6 * hour + 1), delta("b", 6 * hour + 2)], BOOK)]
    out = _finish(state.stream_book_state(_feed(spark, tmp_path, parts), delay="1 second", forget=3600), tmp_path).collect()
    got = {(r.asset_id, r.ts): (r.ready, r.best_bid) for r in out}
    assert got["b", 2 * hour] == (True, .45) and got["a", 6 * hour + 1] == (False, None) and got["b", 6 * hour + 2] == (False, None)


def test_a_book_follows_a_plain_one(spark, rows, tmp_path):
    rnd = random.Random(8)
    price = lambda: rnd.randint(1, 12) / 100
    events, levels, ready, want = [], {"bid": {}, "ask": {}}, False, []
    for i in range(240):
        kind = rnd.choice(["delta"] * 12 + ["snapshot", "disconnect"])
        if kind == "snapshot":
            new = {s: {price(): float(i + j) for j in range(4)} for s in levels}
            events.append(("a", i + 1, i, kind, list(new["bid"].items()), list(new["ask"].items()), None, None, None))
            levels, ready = new, True
        elif kind == "disconnect":
            events.append(("a", i + 1, i, kind, [], [], None, None, None))
            ready = False
        else:
            side, p, size = rnd.choice(["bid", "ask"]), price(), rnd.choice([0., 0., float(i)])
            events.append(("a", i + 1, i, kind, [], [], side, p, size))
            if ready:
                levels[side].pop(p, None)
                if size:
                    levels[side][p] = size
        bid, ask = (max(levels["bid"], default=None), min(levels["ask"], default=None)) if ready else (None, None)
        want.append((i, ready, bid, levels["bid"].get(bid), ask, levels["ask"].get(ask)))
    parts = [rows(events[i: i + 80], BOOK) for i in (0, 80, 160)]
    out = _finish(state.stream_book_state(_feed(spark, tmp_path, parts)), tmp_path).orderBy("seq").collect()
    assert [(r.seq, r.ready, r.best_bid, r.bid_size, r.best_ask, r.ask_size) for r in out] == want


def test_a_lost_connection_invalidates_books(spark, rows):
    lines = ['{"recv_ts": "2031-03-04T10:00:00+00:00", "type": "WsDisconnected", "event": {"asset_id": "a"}}',
             '{"recv_ts": "2031-03-04T10:00:01+00:00", "type": "WsIdleTimeout"}', '{"recv_ts": "2031-03-04T10:00:02+00:00", "type": "Other"}']
    log = event_log.decode_event_log(rows([(i, x, "2031-03-04_m.jsonl") for i, x in enumerate(lines)], "seq int, line string, file_name string"))
    got = [(r.seq, r.asset_id, r.kind) for r in state.book_state_events(log, assets=["a", "b"]).orderBy("seq", "asset_id").collect()]
    assert got == [(0, "a", "disconnect"), (1, "a", "disconnect"), (1, "b", "disconnect")]


def test_staleness(spark, rows, tmp_path):
    data = [("a", 0), ("a", 5), ("b", 3), ("a", 40), ("b", 41), ("b", 100)]
    start = 1000
    df = rows(data, "key string, t bigint").select("key", F.timestamp_seconds(F.col("t") + start).alias("ts"))
    at = F.unix_seconds("ts") - start
    parts = [df.filter(at < 10), df.filter(at.between(10, 50)), df.filter(at > 50)]
    out = _finish(state.stream_staleness(_feed(spark, tmp_path, parts), 10, delay="0 seconds"), tmp_path).collect()
    assert sorted((r.key, r.at - start, r.state) for r in out) == [
        ("a", 0, "fresh"), ("a", 15, "stale"), ("a", 40, "fresh"), ("a", 50, "stale"),
        ("b", 3, "fresh"), ("b", 13, "stale"), ("b", 41, "fresh"), ("b", 51, "stale"), ("b", 100, "fresh")]


def test_late_rows_are_counted(spark, rows, tmp_path):
    stamp = lambda data: rows(data, "key string, t bigint").select("key", F.timestamp_seconds("t").alias("ts"))
    parts = [stamp([("b", 100_000)]), stamp([("b", 100_001)]), stamp([("a", 10), ("a", 20), ("b", 100_002)])]
    query = (state.stream_staleness(_feed(spark, tmp_path, parts), 10, delay="5 seconds").writeStream.format("parquet")
             .option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert state.late_rows(query.recentProgress) == 2
    assert {r.key for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {"b"}


def test_a_trailing_key_is_not_late_by_default(spark, rows, tmp_path):
    fast = rows([("b", t) for t in range(1000, 2000, 5)], "key string, t bigint")
    slow = rows([("a", t) for t in range(1000, 1400, 5)], "key string, t bigint")
    stamp = lambda df: df.select("key", F.timestamp_seconds("t").alias("ts"))
    out = _finish(state.stream_staleness(_feed(spark, tmp_path, [stamp(fast), stamp(slow)]), 10), tmp_path).collect()
    assert sorted((r.key, r.at, r.state) for r in out) == [("a", 1000, "fresh"), ("b", 1000, "fresh")]


def test_look_back_is_kept_per_series(spark, rows, tmp_path):
    ticks = _ticks(rows)
    slow = ticks.withColumn("series_key", F.lit("slow"))
    ahead = ticks.withColumn("ws", F.lit(90_000)).withColumn("t", F.col("t") + 90_000)
    compute = lambda df: features.feature_snapshot(features.clean_ticks(df), W)
    parts = [slow.filter("t < 140").unionByName(ahead), slow.filter("t >= 140")]
    lookback.stream_features(_feed(spark, tmp_path, parts), compute, str(tmp_path / "f"), str(tmp_path / "ck"),
                             window_len=0, forget=10**6).awaitTermination()
    pick = lambda df: df.filter("series_key = 'slow'").select("t", F.round("ret_120", 6), F.round("slope_60", 6)).orderBy("t").collect()
    assert pick(spark.read.parquet(str(tmp_path / "f"))) == pick(compute(slow))


def test_a_series_resumes_after_it_was_forgotten(spark, rows, tmp_path):
    ticks = _ticks(rows)
    later = ticks.withColumns({"ws": F.lit(172_800), "t": F.col("t") + 172_800})
    other = ticks.withColumns({"series_key": F.lit("other"), "ws": F.lit(86_400), "t": F.col("t") + 86_400})
    compute = lambda df: features.feature_snapshot(features.clean_ticks(df), W)
    parts = [ticks.filter("t < 140"), ticks.filter("t >= 140"), other, later.filter(F.col("t") < 172_900), later.filter(F.col("t") >= 172_900)]
    lookback.stream_features(_feed(spark, tmp_path, parts), compute, str(tmp_path / "f"), str(tmp_path / "ck"),
                             window_len=0, forget=3600).awaitTermination()
    cols = ["series_key", "t", "spot_sample_count_60", *[F.round(c, 6).alias(c) for c in ("ret_120", "slope_60", "dist_high")]]
    pick = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert pick(spark.read.parquet(str(tmp_path / "f"))) == pick(compute(ticks.unionByName(other).unionByName(later)))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_first_signal_across_batches(spark, rows, tmp_path, order):
    schema = "series_key string, ws bigint, t bigint, gated_action string, cand string, cand_ask double"
    first = rows([("a", 0, 1, "OBSERVE", "Up", .4), ("b", 0, 2, "ABORT_VOL", "Up", .2), ("c", 0, 3, "WAIT", "Up", .2)], schema)
    second = rows([("a", 0, 10, "ENTER", "Up", .25), ("b", 0, 11, "ENTER", "Up", .2), ("c", 0, 12, "ENTER", "Down", .3)], schema)
    third = rows([("a", 0, 20, "ENTER", "Up", .26)], schema)
    end = rows([("z", 900, 1000, "ABORT_VOL", "Up", .2)], schema)  # moves the watermark past all of them
    parts = [[first, second, third][i] for i in order]
    out = _finish(state.stream_first_signal(_feed(spark, tmp_path, [*parts, end])), tmp_path)
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("a", 0, 10, "Up", .25), ("c", 0, 12, "Down", .3)]
    batch = state.first_signal(first.unionByName(second).unionByName(third))
    assert sorted(tuple(r) for r in batch.collect()) == got


def _ticks(rows, n=280):
    rnd = random.Random(2)
    data = []
    price = 65000.0
    for off in range(n):
        price += rnd.uniform(-3, 3)
        a, d = rnd.randint(15, 40) / 100, rnd.randint(60, 85) / 100
        data.append(("k", 0, off, off, None if rnd.random() < .05 else price, a, a - .02, d, d - .02,
                     float(rnd.randint(0, 60)), float(rnd.randint(1, 60)), float(rnd.randint(1, 60)), float(rnd.randint(1, 60))))
    return rows(data, "series_key string, ws bigint, t bigint, elapsed bigint, spot double, au double, bu double, ad double, "
                      "bd double, su double, sau double, sd double, sad double")


def test_features_on_a_stream_equal_the_batch(spark, rows, tmp_path):
    ticks = _ticks(rows)
    compute = lambda df: features.feature_snapshot(features.clean_ticks(df), W)
    parts = [ticks.filter((F.col("t") >= lo) & (F.col("t") < lo + 70)) for lo in range(0, 280, 70)]
    stream = _feed(spark, tmp_path, parts)
    lookback.stream_features(stream, compute, str(tmp_path / "f"), str(tmp_path / "ck"), window_len=0).awaitTermination()
    cols = ["t", "score", "feed_fresh", "spot_sample_count_60", *features.FEATURES]
    pick = lambda df: df.select(*[F.round(F.col(c), 6).alias(c) if c in features.FEATURES else c for c in cols]).orderBy("t").collect()
    got, want = pick(spark.read.parquet(str(tmp_path / "f"))), pick(compute(ticks))
    assert len(got) == 280 and got == want
    assert any(r.score is not None for r in want)


@pytest.mark.parametrize("carry", [True, False])
def test_twap_stats_equal_the_batch(spark, rows, tmp_path, carry):
    rnd = random.Random(4)
    data = [(rnd.choice(["btc/usd", "eth/usd"]), t, rnd.randint(1, 999) / 10) for t in range(0, 3000, 7)]
    df = rows(data, "pair string, t bigint, price double").withColumn("recv_ts", F.timestamp_seconds("t"))
    stream = _feed(spark, tmp_path, [df.filter("t < 1500"), df.filter("t >= 1500")])
    out = _finish(ingest.stream_twap_stats(stream, delay="10 seconds", carry_base=carry), tmp_path)
    batch = audits.twap_window_stats(df, "pair", "t", "price", carry_base=carry)
    key = lambda d: sorted((r.pair, r.window_start, r.base, r.last, r.high, r.low, r.samples) for r in d.collect())
    assert key(out) == [x for x in key(batch) if x[1] + 300 <= 2996 - 10]


def test_entry_decisions_feed_the_signal(spark, rows):
    ticks = features.clean_ticks(_ticks(rows)).withColumn("rng", F.lit(0.0))
    judged = triggers.entry_decisions(ticks, {"base": parameter_set()})
    assert set(r[0] for r in judged.select("gated_action").distinct().collect()) <= {
        "WAIT", "MISSED", "ABORT_DATA", "ABORT_VOL", "OBSERVE", "ENTER"}
    assert state.first_signal(judged).count() == 1
