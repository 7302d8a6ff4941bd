"""Features on a tick stream: each micro-batch plus a bounded look-back through the batch code."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickloom.operators.features import MAX_AGE, SPOT_MEMORY

# ship the processor with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Added to times, as a stream takes nothing at or before 1970-01-01 00:00:00 in.
SHIFT = 1 << 31


class Ring(StatefulProcessor):
    """Keeps the rows of a key that later rows can still reach, and hands them on before the new ones."""

    def __init__(self, schema: T.StructType, time: str, reach: int, forget: int) -> None:
        self.schema, self.time, self.reach, self.forget = schema, time, reach, forget
        self.at = schema.names.index(time)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.schema.names
        old = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        new = [tuple(r[n] for n in names) for r in rows]
        for row in old:
            yield Row(*names, "_new")(*row, False)
        for row in new:
            yield Row(*names, "_new")(*row, True)
        newest = max(r[self.at] for r in [*old, *new])
        self.rows.put([r for r in [*old, *new] if r[self.at] >= newest - self.reach])
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        due = max((newest + SHIFT + self.forget) * 1000, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(due)
        self.due.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.due.exists() and self.due.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.rows.clear()
            self.due.clear()
        return iter(())


def stream_features(ticks: DataFrame, compute: Callable[[DataFrame], DataFrame], dst: str,
                    checkpoint: str, *, time: str = "t", keys: Sequence[str] = ("series_key",), scale: int = 1,
                    window_len: int = 300, forget: int = 86400, available_now: bool = True) -> StreamingQuery:
    """Append ``compute`` output for every new tick to ``dst`` (one folder per batch).

    The look-back is the spot memory plus the as-of age, which is all any feature frame can
    reach; one window length is allowed for ticks that arrive late. It is keyed state: a batch reads and writes the
    rows of the keys it has, nothing else. ``keys`` are those ``compute`` partitions by, or fewer.

    A key whose newest tick is ``forget`` (times scale, seconds, not less than the look-back) behind the watermark is
    removed by a timer. The watermark trails the newest tick of all by as much, and ticks behind it are dropped and counted as
    late. So what a tick can reach is always there: a tick that comes in time after its key was removed is too far from
    the removed rows to reach them. Running a batch again overwrites its folder with the same rows.
    """
    reach = (SPOT_MEMORY + MAX_AGE) * scale + window_len
    trail = max(forget * scale, reach)
    schema = T.StructType([*ticks.schema.fields])
    out_schema = T.StructType([*schema.fields, T.StructField("_new", T.BooleanType())])
    marked = ticks.withColumn("_at", F.timestamp_seconds(F.col(time) + F.lit(SHIFT).cast("bigint"))).withWatermark("_at", f"{trail} seconds")
    both = marked.groupBy(*keys).transformWithState(
        statefulProcessor=Ring(schema, time, reach, trail), outputStructType=out_schema, outputMode="Append", timeMode="EventTime")

    def handle(batch: DataFrame, batch_id: int) -> None:
        compute(batch).filter("_new").drop("_new").write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")

    writer = both.writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
