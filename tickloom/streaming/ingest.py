"""Event-log stream to book and meta tables, and TWAP window statistics."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickloom.sources.event_log import decode_event_log, event_rows

# ship the processor with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tail_event_log(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of decoded lines from day-sliced JSON files, or folders of a day, as they appear."""
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files)
             .option("recursiveFileLookup", "true").load(path)
             .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_name")))
    return decode_event_log(lines)


def stream_book_rows(log: DataFrame, dst: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Append book and meta rows; the same flattening as the batch job. Read them with :func:`tailed`.

    A batch decodes its lines once and writes both tables in one job, into folders of its own number. A batch that was
    killed and runs again replaces its folders, so nothing is lost or repeated.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = event_rows(batch)
        book = F.transform("rows", lambda x: F.struct(
            F.lit("book").alias("table"), x["kind"].alias("kind"), F.col("asset_id").alias("asset_id"), F.col("market").alias("market"),
            x["side"].alias("side"), x["price"].alias("price"), x["size"].alias("size"),
            F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("payload")))
        nothing = {c: F.lit(None).cast("string").alias(c) for c in ("kind", "asset_id", "market", "side")}
        meta = F.array(F.struct(
            F.lit("meta").alias("table"), *nothing.values(), *[F.lit(None).cast("double").alias(c) for c in ("price", "size")],
            F.col("type").alias("type"), F.col("payload").alias("payload")))
        both = rows.select("date", "ts", F.inline(F.when(F.col("payload").isNotNull(), meta).otherwise(book)))
        (both.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("table", "date", "batch").parquet(dst))

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def tailed(spark: SparkSession, dst: str, table: str) -> DataFrame:
    """The ``book`` or ``meta`` rows :func:`stream_book_rows` has written."""
    columns = {"book": ("kind", "asset_id", "market", "side", "price", "size"), "meta": ("type", "payload")}[table]
    return (spark.read.parquet(dst).filter(F.col("table") == table)
            .select(F.col("date").cast("string").alias("date"), "ts", *columns))


class CarriedBase(StatefulProcessor):
    """Hands the last value of a key's window on to its next one as base."""

    def __init__(self, value_type: T.DataType) -> None:
        self.state = T.StructType([T.StructField("last", value_type)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda x: x.window_start):
            yield Row(**{**r.asDict(), "base": r.base if before is None else before})
            before = r.last
        self.last.update((before,))


def stream_twap_stats(updates: DataFrame, *, key: str = "pair", time: str = "recv_ts",
                      value: str = "price", seq: str | None = None, window: str = "300 seconds",
                      delay: str = "300 seconds", carry_base: bool = True) -> DataFrame:
    """Tumbling statistics per key: base, last, high, low, range, samples.

    The base is the last value of the key's previous window that had one, its own first value if there was none or without
    ``carry_base``. State is one small buffer per open window and key, and updates are combined before the
    shuffle, so a busy key does not concentrate its rows in one task; the carried value is one more row per key, and
    sees one row per window. A window comes out when the watermark has passed it: an update far enough ahead
    of any key flushes the last ones.
    """
    order = F.struct(time, seq) if seq else F.col(time)
    g = (updates.withWatermark(time, delay)
         .groupBy(F.window(time, window).alias("w"), key)
         .agg(F.min_by(value, order).alias("base"), F.max_by(value, order).alias("last"),
              F.max(value).alias("high"), F.min(value).alias("low"), F.count(value).alias("samples")))
    stats = g.select(key, F.unix_seconds("w.start").alias("window_start"), "base", "last", "high", "low",
                     (F.col("high") - F.col("low")).alias("range"), "samples")
    if not carry_base:
        return stats
    return stats.groupBy(key).transformWithState(
        statefulProcessor=CarriedBase(stats.schema["last"].dataType), outputStructType=stats.schema, outputMode="Append", timeMode="None")
