"""Feed audits: TWAP window statistics, stream freshness, window coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALL_SECONDS = 45


def twap_window_stats(updates: DataFrame, key: str, time: str, value: str, *, seq: str | None = None,
                      window_len: int = 300, carry_base: bool = True) -> DataFrame:
    """Per (key, window): base, last, high, low, range and sample count.

    With ``carry_base`` the base is the last value of the previous window that had one. That
    step runs on one row per window, whose number grows with time and not with traffic.
    """
    start = (F.col(time) - F.pmod(F.col(time), F.lit(window_len))).cast("bigint")
    order = F.struct(time, seq) if seq else F.col(time)
    g = updates.groupBy(key, start.alias("window_start")).agg(
        F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"),
        F.max(value).alias("high"), F.min(value).alias("low"), F.count(value).alias("samples"))
    g = g.withColumn("range", F.col("high") - F.col("low"))
    base = F.col("first")
    if carry_base:
        prior = F.lag("last").over(Window.partitionBy(key).orderBy("window_start"))
        base = F.coalesce(prior, base)
    return g.withColumn("base", base).drop("first")


def stream_freshness_audit(rows: DataFrame, stream: str, time: str, now: Column,
                           names: DataFrame | None = None, stall: int = STALL_SECONDS) -> DataFrame:
    """Newest row per stream up to a given time: ok, stalled, or no data."""
    g = rows.filter(F.col(time) <= now).groupBy(stream).agg(F.max(time).alias("newest"))
    if names is not None:
        g = names.select(stream).distinct().join(g, stream, "left")
    age = now - F.col("newest")
    state = (F.when(F.col("newest").isNull(), F.lit("no data"))
             .when(age > stall, F.lit("stalled")).otherwise(F.lit("ok")))
    return g.select(stream, "newest", age.alias("age"), state.alias("state"))


def window_coverage(meta: DataFrame, keys: Sequence[str] = ("found", "missing")) -> DataFrame:
    """Windows found and missing per series, and how many found windows were partial."""
    found, missing = keys
    seen = F.transform(F.col(found), lambda s: F.struct(s.alias("series_key"), F.lit(True).alias("ok")))
    gone = F.transform(F.col(missing), lambda s: F.struct(s.alias("series_key"), F.lit(False).alias("ok")))
    long = meta.select("partial", F.inline(F.concat(seen, gone)))
    n = F.count("*")
    hit = F.count_if("ok")
    return long.groupBy("series_key").agg(
        n.alias("windows"), hit.alias("found"), (n - hit).alias("missing"),
        F.count_if(F.col("ok") & F.col("partial")).alias("partial"),
        (hit / n).alias("coverage"))
