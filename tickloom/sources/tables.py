"""Readers for windows, ticks and bars, and the feature and grid writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.studies import run_summary

WINDOW_COLUMNS = ("condition_id", "slug", "market_start", "outcome", "volume", "liquidity")
TICK_COLUMNS = ("condition_id", "t", "bu", "au", "bd", "ad", "su", "sd", "sau", "sad", "du", "dd")
BAR_COLUMNS = ("ts", "close")


def read_columns(spark: SparkSession, path: str, columns: Sequence[str],
                 source: Mapping[str, str] | None = None) -> DataFrame:
    """Read only the named columns; ``source`` maps a name to a SQL expression of the file."""
    source = source or {}
    return spark.read.parquet(path).select(
        *[F.expr(source.get(c, f"`{c}`")).alias(c) for c in columns])


def read_windows(spark: SparkSession, path: str, source: Mapping[str, str] | None = None
                 ) -> DataFrame:
    """Window dimension: start as epoch seconds, unknown outcomes kept as NULL."""
    df = read_columns(spark, path, WINDOW_COLUMNS, source)
    start = F.unix_seconds(F.col("market_start").cast("timestamp"))
    return df.withColumn("window_start", start).drop("market_start")


def read_ticks(spark: SparkSession, path: str, columns: Sequence[str] = TICK_COLUMNS,
               source: Mapping[str, str] | None = None) -> DataFrame:
    return read_columns(spark, path, columns, source)


def tick_spans(ticks: DataFrame, window: Sequence[str], time: str = "t") -> DataFrame:
    """Tick count and time span per window."""
    return ticks.groupBy(*window).agg(
        F.count("*").alias("n_ticks"), F.min(time).alias("first_t"), F.max(time).alias("last_t"))


def read_bars(spark: SparkSession, path: str, columns: Sequence[str] = BAR_COLUMNS,
              source: Mapping[str, str] | None = None) -> DataFrame:
    return read_columns(spark, path, columns, source)


def union_feature_sets(parts: Sequence[DataFrame]) -> DataFrame:
    """Feature tables with differing columns as one; a column a part lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_feature_table(parts: Sequence[DataFrame], path: str, partition_by: Sequence[str] = ()
                        ) -> None:
    writer = union_feature_sets(parts).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def grid_report(results: DataFrame, series: Sequence[str], series_col: str = "series_key",
                split_col: str = "split", metrics: Sequence[str] = ("n", "win_rate", "sl_rate", "pnl_per")
                ) -> DataFrame:
    """One row per parameter set with wide metric columns per series and split.

    The summary is aggregated first (a few rows per set), so the pivot moves almost nothing.
    """
    stats = run_summary(results, ["param_id", series_col, split_col])
    tag = F.concat_ws("_", series_col, F.when(F.col(split_col) == "train", F.lit("tr")).otherwise(F.lit("va")))
    columns = [f"{s}_{x}" for s in series for x in ("tr", "va")]
    return (stats.withColumn("_tag", tag).groupBy("param_id").pivot("_tag", columns)
            .agg(*[F.coalesce(F.first(m), F.lit(0)).alias(m) for m in metrics]))


def write_grid_report(report: DataFrame, path: str) -> None:
    """The report has one row per parameter set (bounded), so one file is enough."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
