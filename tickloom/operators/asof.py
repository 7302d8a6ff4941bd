"""As-of lookups: within one series (range frames) and across two tables (chunked carry).

Times are bigint (seconds). Inside an event window a de-duplicated series has at most one
row per second, so a partition of (series, window) never exceeds the window length; nothing
here partitions by series alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def dedupe_ticks(df: DataFrame, keys: Sequence[str], time: str, seq: str) -> DataFrame:
    """Keep the last row per (keys, time) by a unique sequence; combines before the shuffle.

    One max_by per column instead of one over a struct: with fixed-width columns that is a hash
    aggregation, which needs no sort of the input.
    """
    rest = [c for c in df.columns if c not in (*keys, time, seq)]
    return df.groupBy(*keys, time).agg(
        F.max(seq).alias(seq), *[F.max_by(c, seq).alias(c) for c in rest])


def ordered(keys: Sequence[str], time: str = "t") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def backwards(keys: Sequence[str], time: str = "t") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.desc(time))


def _until(w: WindowSpec, ahead: int) -> WindowSpec:
    """Everything up to t+ahead. Spark extends such a frame row by row; one with two moving ends it reads anew."""
    return w.rangeBetween(Window.unboundedPreceding, ahead)


def _any(value: Column, w: WindowSpec, ahead: int, max_age: int) -> Column:
    return F.count(value).over(_until(w, ahead)) > F.count(value).over(_until(w, ahead - max_age - 1))


def asof(value: Column, w: WindowSpec, lag: int = 0, max_age: int = 5) -> Column:
    """Last non-null value at or before t-lag, at most max_age old (inclusive)."""
    return F.when(_any(value, w, -lag, max_age), F.last(value, ignorenulls=True).over(_until(w, -lag)))


def asof_ahead(value: Column, w: WindowSpec, ahead: int, max_age: int = 5) -> Column:
    """Value of the latest row at or before t+ahead; an invalid latest row gives NULL."""
    return F.when(_any(F.lit(1), w, ahead, max_age), F.last(value, ignorenulls=False).over(_until(w, ahead)))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str,
              right_time: str, right_cols: Sequence[str], max_age: int | None = None,
              chunk: int = 86400) -> DataFrame:
    """Attach the latest right row at or before each left row.

    Both sides are merged in time order. A long or hot series is cut into time chunks so that no task holds a
    whole series. With ``max_age`` a right row also goes to the later chunks it can reach by arithmetic; without, the last
    right row of a chunk is repeated in all chunks up to the next one that has right rows, and right rows are dealt
    by (keys, chunk) once, for the merge and for those ends. ``<right_time>_asof`` and the right columns are added.
    """
    stamp = f"{right_time}_asof"
    place = F.floor(F.col("_t") / chunk)
    rows_l = left.withColumn("_t", F.col(left_time)).withColumns({"_chunk": place, "_side": F.lit(1)})
    rows_r = right.select(*keys, F.col(right_time).alias("_t"), *[F.col(c).alias(f"_r_{c}") for c in right_cols])
    if max_age is not None:
        served = F.sequence(place, F.floor((F.col("_t") + max_age) / chunk))
        parts = [rows_r.withColumn("_chunk", F.explode(served))]
    else:
        dealt = rows_r.withColumn("_chunk", place).repartition(*keys, "_chunk")
        ends = dealt.groupBy(*keys, "_chunk").agg(
            F.max("_t").alias("_t"), *[F.max_by(f"_r_{c}", "_t").alias(f"_r_{c}") for c in right_cols])
        following = F.lead("_chunk").over(Window.partitionBy(*keys).orderBy("_chunk"))
        last = F.lit(rows_l.agg(F.max("_chunk")).first()[0]).cast("bigint")
        ends = ends.withColumn("_until", F.coalesce(following, F.greatest("_chunk", last)))
        later = F.when(F.col("_until") > F.col("_chunk"), F.sequence(F.col("_chunk") + 1, F.col("_until")))
        parts = [dealt, ends.withColumn("_chunk", F.explode(later)).drop("_until").repartition(*keys, "_chunk")]
        rows_l = rows_l.repartition(*keys, "_chunk")

    def seen(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, "_t", "_chunk", F.lit(0).alias("_side"),
                           F.struct(F.col("_t").alias(stamp), *[F.col(f"_r_{c}").alias(c) for c in right_cols]).alias("_r"))

    both = rows_l
    for part in parts:
        both = both.unionByName(seen(part), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_t", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    matched = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(inside)).filter(F.col("_side") == 1)
    if max_age is not None:
        fresh = F.col("_t") - F.col(f"_hit.{stamp}") <= max_age
        matched = matched.withColumn("_hit", F.when(fresh, F.col("_hit")))
    return matched.select(*left.columns, F.col(f"_hit.{stamp}").alias(stamp),
                          *[F.col(f"_hit.{c}").alias(c) for c in right_cols])
