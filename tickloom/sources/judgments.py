"""Judgment logs: defaults for missing fields, unknown actions and tags set aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The registered tags and actions.
SIGNAL_TAGS = ("vol_low", "vol_high", "trend_favor", "feed_slow", "spread_wide", "depth_thin",
               "cross_coin", "streak", "session", "intuition", "news")
ACTIONS = ("enter", "skip")
TARGET_SAMPLE = 384

_SCHEMA = ("action string, symbol string, window_start bigint, signals array<string>, notes string, "
           "ts string")


def parse_judgments(lines: DataFrame, line: str = "line", vocabulary: Sequence[str] = SIGNAL_TAGS,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed judgments with ``rejected`` set for an unknown action or an unregistered tag."""
    text = F.trim(F.col(line))
    rows = lines.filter(text != "").select(*keep, F.from_json(text, _SCHEMA).alias("j")).select(*keep, "j.*")
    rows = rows.withColumns({
        "signals": F.coalesce("signals", F.array().cast("array<string>")),
        "notes": F.coalesce("notes", F.lit("")), "ts": F.coalesce("ts", F.lit(""))})
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    unknown = F.size(F.array_except("signals", vocab)) > 0
    bad_action = ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    return rows.withColumn("rejected", bad_action | unknown)


def load_judgments(spark, path: str) -> DataFrame:
    """Accepted judgments of a JSON-lines path."""
    return parse_judgments(spark.read.text(path), "value").filter(~F.col("rejected")).drop("rejected")


def tag_frequency(judgments: DataFrame) -> DataFrame:
    """Counts per tag, most frequent first."""
    return (judgments.select(F.explode("signals").alias("tag")).groupBy("tag")
            .agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag"))


def judgment_totals(judgments: DataFrame) -> DataFrame:
    """Total, enter, skip, and how many more are needed for an analysis sample."""
    n = F.count("*")
    return judgments.agg(
        n.alias("total"), F.count_if(F.col("action") == "enter").alias("n_enter"),
        F.count_if(F.col("action") == "skip").alias("n_skip"),
        F.greatest(F.lit(0), F.lit(TARGET_SAMPLE) - n).cast("bigint").alias("still_needed"))


def latest(judgments: DataFrame, order: str, n: int) -> DataFrame:
    """Last n records in log order."""
    return judgments.orderBy(F.col(order).desc()).limit(n)
