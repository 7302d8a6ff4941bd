"""One-second candle archives in CSV text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "open_time bigint, open double, high double, low double, close double"
MICROSECOND_FLOOR = 10 ** 14


def parse_kline_lines(lines: DataFrame, column: str, lo: int, hi: int,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """CSV lines to (ts, open, high, low, close) with ts in [lo, hi).

    A header line has a letter first and is skipped; open_time is milliseconds, or
    microseconds in newer archives.
    """
    text = F.trim(F.col(column))
    parsed = lines.filter(~text.rlike("^[A-Za-z]") & (text != "")).select(
        *keep, F.from_csv(text, _SCHEMA).alias("k"))
    ms = F.when(F.col("k.open_time") > MICROSECOND_FLOOR,
                F.floor(F.col("k.open_time") / 1000)).otherwise(F.col("k.open_time"))
    ts = F.floor(ms / 1000).cast("bigint")
    return parsed.select(*keep, ts.alias("ts"), "k.open", "k.high", "k.low", "k.close").filter(
        (F.col("ts") >= lo) & (F.col("ts") < hi))


def ingest_klines(spark: SparkSession, csv_path: str, out_path: str, lo: int, hi: int) -> None:
    """Archive files to time-sorted Parquet; ranges of time become files."""
    bars = parse_kline_lines(spark.read.text(csv_path), "value", lo, hi)
    (bars.repartitionByRange("ts").sortWithinPartitions("ts")
     .write.mode("overwrite").option("compression", "zstd").parquet(out_path))
