"""Keyed state: order books, staleness, and one entry signal per event window.

Rows of one key inside a micro-batch are ordered by (time, seq) before they are applied. How
many can meet there is set by the source's admission limit (maxFilesPerTrigger or
maxOffsetsPerTrigger), not by the size of the stream.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# ship the processors with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOOK_OUTPUT = ("asset_id string, ts bigint, seq bigint, ready boolean, best_bid double, "
               "bid_size double, best_ask double, ask_size double")


class _Side:
    """One side of a book during a batch: the best level is known, the others are read when it goes away."""

    def __init__(self, stored, sign: int, best: tuple | None) -> None:
        self.stored, self.sign, self.best = stored, sign, best
        self.pending: dict[float, float | None] = {}
        self.cleared = False
        self.prices: list[float] | None = None  # signed, best first, once read
        self.sizes: dict[float, float] = {}

    def _read(self) -> None:
        if self.prices is None:
            self.sizes = {} if self.cleared else {k[0]: v[0] for k, v in self.stored.iterator()}
            for price, size in self.pending.items():
                if size is None:
                    self.sizes.pop(price, None)
                else:
                    self.sizes[price] = size
            self.prices = sorted(self.sign * p for p in self.sizes)

    def replace(self, levels) -> None:
        self.cleared, self.prices, self.sizes = True, None, {}
        self.pending = {x["price"]: x["size"] for x in levels if x["price"] is not None}
        first = min(self.pending, key=lambda p: self.sign * p, default=None)
        self.best = None if first is None else (first, self.pending[first])

    def set(self, price: float, size: float) -> None:
        self.pending[price] = size
        if self.prices is not None:
            if price not in self.sizes:
                bisect.insort(self.prices, self.sign * price)
            self.sizes[price] = size
        if self.best is None or self.sign * price <= self.sign * self.best[0]:
            self.best = (price, size)

    def remove(self, price: float) -> None:
        self.pending[price] = None
        if self.prices is not None and self.sizes.pop(price, None) is not None:
            del self.prices[bisect.bisect_left(self.prices, self.sign * price)]
        if self.best is not None and self.best[0] == price:
            self._read()
            first = self.sign * self.prices[0] if self.prices else None
            self.best = None if first is None else (first, self.sizes[first])

    def write(self) -> None:
        if self.cleared:
            self.stored.clear()
        for price, size in self.pending.items():
            if size is not None:
                self.stored.updateValue((price,), (size,))
            elif not self.cleared and self.stored.containsKey((price,)):
                self.stored.removeKey((price,))


class BookState(StatefulProcessor):
    """Level-2 book per asset: a snapshot replaces, a delta sets or removes one level.

    A batch touches the levels that change; the whole side is read only when its best level is removed. A
    book without events for ``forget`` seconds of event time is removed by a timer.
    """

    def __init__(self, forget: int) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = {s: handle.getMapState(f"{s}s", "price double", "size double") for s in ("bid", "ask")}
        self.top = handle.getValueState(
            "top", "ready boolean, bid double, bid_size double, ask double, ask_size double, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ready, bid, bid_size, ask, ask_size, due = self.top.get() if self.top.exists() else (False, *[None] * 5)
        sides = {"bid": _Side(self.stored["bid"], -1, None if bid is None else (bid, bid_size)),
                 "ask": _Side(self.stored["ask"], 1, None if ask is None else (ask, ask_size))}
        last = 0
        for r in sorted(rows, key=lambda x: (x.ts, x.seq)):
            last = r.ts
            if r.kind == "snapshot":
                sides["bid"].replace(r.bids)
                sides["ask"].replace(r.asks)
                ready = True
            elif r.kind == "disconnect":
                ready = False
            elif ready and r.price is not None:
                if r.size == 0:
                    sides[r.side].remove(r.price)
                else:
                    sides[r.side].set(r.price, r.size)
            best = [sides[s].best or (None, None) if ready else (None, None) for s in ("bid", "ask")]
            yield Row(asset_id=key[0], ts=r.ts, seq=r.seq, ready=ready, best_bid=best[0][0], bid_size=best[0][1],
                      best_ask=best[1][0], ask_size=best[1][1])
        for side in sides.values():
            side.write()
        if due is not None:
            self.handle.deleteTimer(due)
        due = max(last // 1000 + self.forget * 1000, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(due)
        kept = [sides[s].best or (None, None) for s in ("bid", "ask")]
        self.top.update((ready, *kept[0], *kept[1], due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.top.exists() and self.top.get()[5] <= expiredTimerInfo.getExpiryTimeInMs():
            self.top.clear()
            for stored in self.stored.values():
                stored.clear()
        return iter(())


def stream_book_state(events: DataFrame, *, delay: str = "1 hour", forget: int = 86400) -> DataFrame:
    """Top of book after every event.

    ``events``: asset_id, ts (microseconds), seq, kind (snapshot, delta, disconnect), bids and asks
    (array<struct<price double, size double>>), side (bid or ask), price, size. A book that had no event for
    ``forget`` seconds is dropped and waits for a snapshot again; events more than ``delay`` behind the newest are late.
    """
    rows = events.withColumn("_at", F.timestamp_micros("ts")).withWatermark("_at", delay)
    return rows.groupBy("asset_id").transformWithState(
        statefulProcessor=BookState(forget), outputStructType=BOOK_OUTPUT, outputMode="Append",
        timeMode="EventTime")


# Event types after which a feed's books are no longer valid.
LOST_TYPES = ("WsDisconnected", "WsIdleTimeout")


def book_state_events(log: DataFrame, keep: tuple[str, ...] = ("seq",), assets: Sequence[str] = ()) -> DataFrame:
    """Decoded event log to the input of :func:`stream_book_state`.

    A lost connection invalidates every book of its feed: the event's own asset if it names one, else all ``assets``.
    """
    kind, record = F.col("kind"), F.col("record")
    field = lambda path, as_type="string": F.try_variant_get(record, f"$.event.{path}", as_type)

    def number(x):
        return x.try_cast("double")

    def levels(name: str):
        push = F.transform(field(name, "array<struct<price:string,size:string>>"), lambda x: F.struct(
            number(x["price"]).alias("price"), number(x["size"]).alias("size")))
        rest = F.transform(F.map_entries(field(name, "map<string,string>")), lambda x: F.struct(
            number(x["key"]).alias("price"), number(x["value"]).alias("size")))
        return F.coalesce(push, rest, F.array().cast("array<struct<price:double,size:double>>"))

    side = F.when(F.upper(field("side")) == "BUY", F.lit("bid")).otherwise(F.lit("ask"))
    snapshot, lost = kind.isin("book", "restbook"), F.col("type").isin(*LOST_TYPES)

    def row(asset, what):
        return F.struct(
            asset.alias("asset_id"), F.unix_micros("ts").alias("ts"), what.alias("kind"),
            levels("bids").alias("bids"), levels("asks").alias("asks"), side.alias("side"),
            number(field("price")).alias("price"), number(field("size")).alias("size"))

    named = field("asset_id")
    hit = F.when(named.isNotNull(), F.array(named)).otherwise(F.array(*[F.lit(a) for a in assets]).cast("array<string>"))
    rows = (F.when(snapshot, F.array(row(named, F.lit("snapshot")))).when(kind == "pchange", F.array(row(named, F.lit("delta"))))
            .when(lost, F.transform(hit, lambda a: row(a, F.lit("disconnect")))))
    return log.select(*keep, F.inline(rows))


STALE_OUTPUT = "key string, at bigint, state string"


class Staleness(StatefulProcessor):
    """Emits 'stale' when a key had no update for max_age seconds and 'fresh' on recovery.

    A stale key keeps its last time for ``forget`` seconds of event time; then its state is removed, and
    an update after that starts the key anew, with 'fresh' as well.
    """

    def __init__(self, max_age: int, forget: int) -> None:
        self.max_age, self.forget = max_age, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint, stale boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, stale = self.seen.get() if self.seen.exists() else (None, True)
        armed = last
        for at in sorted(r.at for r in rows):
            if last is not None and at <= last:
                continue
            if last is not None and not stale and at - last > self.max_age:
                yield Row(key=key[0], at=last + self.max_age, state="stale")
                stale = True
            if stale:
                yield Row(key=key[0], at=at, state="fresh")
            last, stale = at, False
        if armed is not None:
            self.handle.deleteTimer((armed + self.max_age) * 1000)
        self.handle.registerTimer((last + self.max_age) * 1000)
        self.seen.update((last, stale))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.seen.exists():
            return
        last, stale = self.seen.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if not stale and due == (last + self.max_age) * 1000:
            self.seen.update((last, True))
            self.handle.registerTimer((last + self.max_age + self.forget) * 1000)
            yield Row(key=key[0], at=last + self.max_age, state="stale")
        elif stale and due >= (last + self.max_age + self.forget) * 1000:
            self.seen.clear()


def stream_staleness(updates: DataFrame, max_age: int, *, key: str = "key", time: str = "ts",
                     delay: str = "1 hour", forget: int = 86400) -> DataFrame:
    """Freshness transitions per key from event time; ``time`` is a timestamp column.

    ``delay`` is how far the slowest key may trail the fastest one before its rows count as late; a
    'stale' by timer comes out that much later. Rows beyond it are dropped by the watermark and counted
    by Spark as ``numRowsDroppedByWatermark`` of the query's progress (see :func:`late_rows`).
    """
    rows = updates.withWatermark(time, delay).select(
        F.col(key).cast("string").alias("key"), F.unix_seconds(time).alias("at"), time)
    return rows.groupBy("key").transformWithState(
        statefulProcessor=Staleness(max_age, forget), outputStructType=STALE_OUTPUT, outputMode="Append",
        timeMode="EventTime")


def late_rows(progress) -> int:
    """Rows the watermark dropped, over all operators and batches of a query's ``recentProgress``."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in p["stateOperators"])


FINAL_ACTIONS = ("ENTER", "ABORT_DATA", "ABORT_VOL")
SIGNAL_OUTPUT = "series_key string, ws bigint, t bigint, cand string, cand_ask double"


class FirstSignal(StatefulProcessor):
    """At most one entry signal per window; an abort closes the window, a band miss may retry.

    The earliest final verdict decides, whatever order rows and batches come in: it is held until the
    watermark has passed its time, when nothing earlier can arrive any more.
    """

    def __init__(self, window_len: int) -> None:
        self.window_len = window_len

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "t bigint, action string, cand string, cand_ask double, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.first.get() if self.first.exists() else None
        if held is None:
            self.handle.registerTimer((key[1] + self.window_len) * 1000)
        elif held[4]:
            return
        first = min(rows, key=lambda r: r.t)
        if held is None or first.t < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0] * 1000)
            self.handle.registerTimer(first.t * 1000)
            self.first.update((first.t, first.gated_action, first.cand, first.cand_ask, False))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.first.exists():
            return
        t, action, cand, ask, told = self.first.get()
        if not told:
            self.first.update((t, action, cand, ask, True))
            if action == "ENTER":
                yield Row(series_key=key[0], ws=key[1], t=t, cand=cand, cand_ask=ask)
        if expiredTimerInfo.getExpiryTimeInMs() >= (key[1] + self.window_len) * 1000:
            self.first.clear()  # the watermark passed the window's end


def stream_first_signal(judged: DataFrame, *, window_len: int = 300, delay: str = "300 seconds"
                        ) -> DataFrame:
    """First ENTER per (series_key, ws) from judged ticks; state is dropped with the window."""
    rows = (judged.filter(F.col("gated_action").isin(*FINAL_ACTIONS))
            .withColumn("at", F.timestamp_seconds("t")).withWatermark("at", delay)
            .select("series_key", "ws", "t", "at", "gated_action", "cand", "cand_ask"))
    return rows.groupBy("series_key", "ws").transformWithState(
        statefulProcessor=FirstSignal(window_len), outputStructType=SIGNAL_OUTPUT,
        outputMode="Append", timeMode="EventTime")


def first_signal(judged: DataFrame) -> DataFrame:
    """The batch form: the first final verdict of each window, kept when it is ENTER."""
    best = F.min_by(F.struct("gated_action", "t", "cand", "cand_ask"), "t").alias("b")
    return (judged.filter(F.col("gated_action").isin(*FINAL_ACTIONS))
            .groupBy("series_key", "ws").agg(best).select("series_key", "ws", "b.*")
            .filter(F.col("gated_action") == "ENTER").drop("gated_action"))
