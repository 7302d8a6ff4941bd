"""Event log decoding, compaction, frames, judgments, ledgers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import decision, markets
from tickloom.operators import execution, ledger
from tickloom.sources import event_log, frames, judgments, klines, metadata
from tickloom.streaming import ingest

DAY = "2031-03-0{}"


def _ladder(seed, n):
    """n price levels (price, size) of an own rule, as the decimal strings a log holds."""
    return [(f"{(seed * 37 + 11 * i) % 97 / 100 + 0.01:.2f}", f"{seed + 2 * i + 1}.5") for i in range(n)]


def _event(kind, second, body, day=4, **top):
    record = {"recv_ts": f"{DAY.format(day)}T10:00:{second:02d}.25+00:00", "type": kind, **top}
    return record if body is None else {**record, "event": body}


def _snapshot(asset, seed, day=4):
    levels = [{"price": p, "size": q} for p, q in _ladder(seed, 4)]
    return _event("WsBookEvent", seed, {"asset_id": asset, "market": f"m-{asset}", "bids": levels[:1], "asks": levels[1:]}, day)


def _polled(asset, seed, day=4):
    bids, asks = _ladder(seed, 2), _ladder(seed + 1, 1)
    return _event("RestBook", seed, {"asset_id": asset, "bids": dict(bids), "asks": dict(asks)}, day)


def _step(kind, asset, seed, side):
    price, size = _ladder(seed, 1)[0]
    return _event(kind, seed, {"asset_id": asset, "market": f"m-{asset}", "side": side, "price": price, "size": size})


def _window(second, day=4, **fields):
    return _event("WindowMeta", second, None, day, **fields)


def _expected(kind, asset, market, side, levels):
    return [(kind, asset, market, side, float(p), float(q)) for p, q in levels]


def _log(rows, *events):
    lines = [e if isinstance(e, str) else json.dumps(e) for e in events]
    return event_log.decode_event_log(rows([(x, f"{DAY.format(4)}_market.jsonl") for x in lines], "line string, file_name string"))


def test_flatten_all_shapes(rows):
    log = _log(rows, _snapshot("north", 3), _step("WsPriceChange", "north", 8, "SELL"), _polled("south", 5),
               _step("WsLastTrade", "south", 9, "SELL"), _window(2, window_start=1930000200, partial=True),
               '{"recv_ts": ', _event("Later", 6, None, extra={"k": "v"}))
    book = sorted(tuple(r) for r in event_log.flatten_book(log).select("kind", "asset_id", "market", "side", "price", "size").collect())
    assert book == sorted([
        *_expected("book", "north", "m-north", "bid", _ladder(3, 4)[:1]), *_expected("book", "north", "m-north", "ask", _ladder(3, 4)[1:]),
        *_expected("pchange", "north", "m-north", "ask", _ladder(8, 1)), *_expected("restbook", "south", "", "bid", _ladder(5, 2)),
        *_expected("restbook", "south", "", "ask", _ladder(6, 1)), *_expected("trade", "south", "m-south", "SELL", _ladder(9, 1))])
    meta = {r.type: json.loads(r.payload) for r in event_log.flatten_meta(log).collect()}
    assert meta == {"WindowMeta": {"window_start": 1930000200, "partial": True}, "Later": {"extra": {"k": "v"}}}
    assert log.filter("is_bad").count() == 1


def test_compaction_end_to_end(spark, tmp_path, monkeypatch):
    src, dst = tmp_path / "log", str(tmp_path / "tables")
    src.mkdir()

    def write(day, *events):
        text = "".join((e if isinstance(e, str) else json.dumps(e)) + "\n" for e in events)
        (src / f"{DAY.format(day)}_market.jsonl").write_text(text)

    def stored():
        return {str(r.date): r["count"] for r in spark.read.parquet(f"{dst}/book").groupBy("date").count().collect()}

    write(1, _snapshot("north", 3, 1), _polled("south", 5, 1), _window(4, 1, window_start=1929700000))
    write(2, _polled("north", 7, 2), '{"recv_ts": ')
    write(3, _snapshot("south", 2, 3))
    audit = {str(r.date): r for r in event_log.compact_days(spark, str(src), dst, DAY.format(3)).collect()}
    assert set(audit) == {DAY.format(1), DAY.format(2)}, "the running day is not sealed"
    assert audit[DAY.format(1)].verified and audit[DAY.format(1)].deletable
    assert audit[DAY.format(2)].verified and not audit[DAY.format(2)].deletable and audit[DAY.format(2)].n_bad == 1
    assert stored() == {DAY.format(1): 7, DAY.format(2): 3}
    # a second run opens the files of the new day alone
    opened = []
    monkeypatch.setattr(event_log, "read_event_log", lambda spark, paths, read=event_log.read_event_log: opened.extend(paths) or read(spark, paths))
    (src / f"{DAY.format(1)}_market.jsonl").write_text("{ changed")
    again = event_log.compact_days(spark, str(src), dst, DAY.format(4))
    assert [p.rsplit("/", 1)[1] for p in opened] == [f"{DAY.format(3)}_market.jsonl"] and again.count() == 3
    assert stored() == {DAY.format(1): 7, DAY.format(2): 3, DAY.format(3): 4}
    event_log.compact_days(spark, str(src), dst, DAY.format(4))
    assert len(opened) == 1, "nothing is new"


def test_a_line_is_decoded_once(spark, rows):
    log = _log(rows, _snapshot("north", 3)).repartition(2)  # so that the rows are not folded into the plan
    log = event_log.decode_event_log(log.select("line", "file_name"))
    for table in (event_log.flatten_book(log), event_log.flatten_meta(log), event_log.event_rows(log)):
        assert table._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_log_dates():
    from pyspark.sql import SparkSession
    names = ["2031-03-04_market.jsonl", "s3://b/2031-03-05_x.jsonl", "/a/date=2031-03-06/part-0.txt", "/a/other.txt"]
    frame = SparkSession.getActiveSession().createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in frame.select(event_log.log_date(F.col("n"))).collect()] == ["2031-03-04", "2031-03-05", "2031-03-06", ""]


def test_a_killed_batch_repeats_nothing(spark, tmp_path):
    src, dst, marks = tmp_path / "log", str(tmp_path / "rows"), tmp_path / "marks"
    src.mkdir()

    def run():
        ingest.stream_book_rows(ingest.tail_event_log(spark, str(src), 1), dst, str(marks)).awaitTermination()
        return sorted(map(str, ingest.tailed(spark, dst, "book").collect())), sorted(map(str, ingest.tailed(spark, dst, "meta").collect()))

    for day in (1, 2):
        (src / f"{DAY.format(day)}_market.jsonl").write_text("\n".join(json.dumps(e) for e in (
            _snapshot("north", 3, day), _polled("south", 5, day), _window(4, day, window_start=day))) + "\n{")
    book, meta = run()
    assert len(book) == 14 and len(meta) == 2
    for mark in (marks / "commits").glob("*1*"):  # the second batch was written, but its end not noted
        mark.unlink()
    assert run() == (book, meta)


def test_frames(rows):
    texts = [json.dumps({"event_type": "price_change", "asset_id": "a", "changes": [
        {"side": "BUY", "price": "0.5", "size": "1"}, {"side": "SELL", "price": "x", "size": "1"}, {"side": "BUY", "price": "0.4", "size": "1"}]}),
        json.dumps([{"event_type": "last_trade_price", "asset_id": "a", "price": "0.3"}, {"event_type": "other"}]),
        json.dumps({"event_type": "book", "bids": [], "asks": []}), "not json"]
    df = rows([(t,) for t in texts], "text string")
    out = frames.parse_ws_frames(df, "text").select("kind", "side", F.col("price").cast("double"), F.col("size").cast("double"))
    assert sorted(map(tuple, out.collect())) == [("pchange", "BUY", .5, 1.), ("trade", "", .3, 0.)]
    assert tuple(frames.frame_counts(df, "text").first()) == (5, 1, 3)


def test_twap_fixed_point_wins(rows):
    def update(pair, value, exact=None):
        body = {"symbol": pair, "value": value}
        return json.dumps({"payload": body if exact is None else {**body, "full_accuracy_value": str(exact * 10**15)}})

    texts = [update("sol/usd", 7, 141_375), update("sol/usd", 142.5), update("xrp/usd", 3), update("xrp/usd", "bad"),
             update("sol/usd", "worse"), "PING", '{"payload": ']
    frame = rows([(t,) for t in texts], "text string")
    df = frames.parse_twap_updates(frame, "text", "sol/usd")
    assert sorted(float(r.price) for r in df.filter("not is_error").collect()) == [141.375, 142.5]
    assert df.filter("is_error").count() == 2, "the other pair's bad value does not count"
    assert frames.parse_twap_updates(frame, "text").filter("is_error").count() == 3


def test_judgment_vocabulary(rows):
    lines = ['{"action": "enter", "symbol": "btc", "window_start": 300, "signals": ["news"]}',
             '{"action": "hold", "symbol": "btc", "window_start": 300}',
             '{"action": "skip", "symbol": "btc", "window_start": 300, "signals": ["astrology"]}', " "]
    got = judgments.parse_judgments(rows([(x,) for x in lines], "line string")).collect()
    assert [r.rejected for r in got] == [False, True, True] and got[0].notes == ""


def test_kline_ingest(spark, tmp_path):
    csv, out = tmp_path / "k.csv", str(tmp_path / "bars")
    csv.write_text("open_time,open,high,low,close\n2000,1,2,0.5,1.5,9\n1000000000000000,3,3,3,3,9\n999,1,1,1,1,9\n")
    klines.ingest_klines(spark, str(csv), out, 1, 2_000_000_000)
    assert [(r.ts, r.close) for r in spark.read.parquet(out).orderBy("ts").collect()] == [(2, 1.5), (1_000_000_000, 3.0)]


def test_token_pairing_and_winners(rows):
    raw = rows([("1", '["Down","Up"]', '["a","b"]', '["0","1"]', True), ("2", '["Yes","No"]', '["c","d"]', '["0.999","0.001"]', True),
                ("3", "junk", '["e"]', '["1","0"]', False)],
               "id string, outcomes string, clobTokenIds string, outcomePrices string, closed boolean")
    m = metadata.decode_market_metadata(raw)
    up, down = markets.pair_tokens(F.col("outcomes"), F.col("tokens"))
    o, p = F.col("outcomes"), F.col("prices")
    got = {r.id: r for r in m.select("id", up.alias("u"), down.alias("d"), markets.winner_strict(o, p, F.col("closed")).alias("s"),
                                     markets.winner_member(o, p).alias("w"), markets.up_won_by_price(o, p).alias("x")).collect()}
    assert (got["1"].u, got["1"].d, got["1"].s, got["1"].w, got["1"].x) == ("b", "a", "Up", "Up", True)
    assert (got["2"].u, got["2"].d, got["2"].s, got["2"].w, got["2"].x) == ("c", "d", None, "Yes", None)
    assert (got["3"].s, got["3"].w) == (None, None)


def test_unknown_series_key_fails(rows):
    df = rows([("nope", 300)], "k string, ws bigint").select(markets.window_slug(F.col("k"), F.col("ws"), ["btc"]))
    with pytest.raises(Exception, match="unknown series key"):
        df.collect()


def test_depth_walk(rows):
    levels = rows([("w", "ask", .33, 7.), ("w", "ask", .35, 11.), ("w", "ask", .41, 2.), ("w", "bid", .29, 4.), ("w", "bid", .25, 30.)],
                  "asset string, side string, price double, size double")
    orders = rows([("part", "w", "BUY", 16., "FAK", .36), ("whole", "w", "BUY", 19., "FOK", .36), ("below", "w", "BUY", 1., "FOK", .32),
                   ("deep", "w", "SELL", 40., "GTC", None), ("none", "v", "BUY", 1., "FAK", None), ("rest", "w", "BUY", 19., "FAK", .36)],
                  "order_id string, asset string, side string, need double, order_type string, limit_price double")
    got = {r.order_id: r for r in execution.depth_walk(orders, levels).collect()}
    assert got["part"].filled == 16 and got["part"].vwap == pytest.approx((7 * .33 + 9 * .35) / 16)
    assert {k: r.status for k, r in got.items()} == {
        "part": "FILLED", "whole": "CANCELED", "below": "OPEN", "deep": "PARTIAL", "none": "FAILED", "rest": "CANCELED"}
    assert got["whole"].filled == 0 and got["rest"].unfilled == 1 and got["deep"].filled == 34


def test_depth_walk_equals_a_plain_walk_for_hot_assets(rows, monkeypatch):
    monkeypatch.setattr(execution, "HOT_ORDERS", 30)
    rnd = random.Random(11)
    made = [(a, side, rnd.randint(1, 40) / 100, float(rnd.randint(1, 30))) for a in "pq" for side in ("bid", "ask") for _ in range(25)]
    asked = [(i, rnd.choice("ppppq"), rnd.choice(["BUY", "SELL"]), float(rnd.randint(1, 500)), rnd.choice(["FAK", "FOK", "GTC"]),
              rnd.choice([None, rnd.randint(1, 40) / 100])) for i in range(150)]
    out = execution.depth_walk(rows(asked, "order_id int, asset string, side string, need double, order_type string, limit_price double"),
                               rows(made, "asset string, side string, price double, size double")).collect()
    assert len(out) == len(asked)
    for r in out:
        sign, opposite = (1, "ask") if r.side == "BUY" else (-1, "bid")
        left, paid = r.need, 0.0
        for _, _, price, size in sorted((x for x in made if x[0] == r.asset and x[1] == opposite), key=lambda x: sign * x[2]):
            if r.limit_price is None or sign * price <= sign * r.limit_price:
                paid, left = paid + min(left, size) * price, left - min(left, size)
        if r.order_type == "FOK" and left:
            left = r.need
        assert r.filled == r.need - left and (r.vwap is None if not r.filled else r.vwap == pytest.approx(paid / r.filled))


def test_latest_state_merges_columns(rows):
    log = rows([(1, 1, ["slug"], "a", None), (1, 2, ["winner"], None, "Up"), (1, 3, ["winner"], None, None)],
               "k int, seq int, changed array<string>, slug string, winner string")
    r = ledger.latest_state(log, ["k"], "seq", ["slug", "winner"]).first()
    assert r.slug == "a" and r.winner is None, "an explicit NULL is a write"


@pytest.mark.parametrize("change,want", [
    ({}, "PASS"), ({"kill_switch": True, "notional": 9.}, "KILL_SWITCH"), ({"notional": 5.01}, "MAX_NOTIONAL"),
    ({"notional": 5.}, "PASS"), ({"same_window_open": True}, "DUP_WINDOW"), ({"invested_today": 18.01}, "DAILY_CAP"),
    ({"realized_today": -10.}, "CIRCUIT_BREAK"), ({"live": True, "balance": None}, "BALANCE_UNKNOWN"),
    ({"live": True, "balance": 2.9}, "BALANCE_LOW"), ({"live": True, "balance": 3.}, "PASS")])
def test_order_gate(rows, change, want):
    base = dict(notional=2., kill_switch=False, same_window_open=False, invested_today=18., realized_today=0., live=False, balance=9.)
    x = {**base, **change}
    if x["notional"] == 5.:
        x["invested_today"] = 15.
    df = rows([tuple(x.values())], "notional double, kill_switch boolean, same_window_open boolean, invested_today double, "
                                   "realized_today double, live boolean, balance double")
    assert df.select(decision.order_gate_verdict(F.col("notional"), F.col, decision.GATE_LIMITS)).first()[0] == want
