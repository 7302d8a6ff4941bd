"""The next row in id order, for tables too large for one sorted task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.staging import stage

RANGE_ROWS = 20_000


def next_ids(rows: DataFrame, key: str = "doc_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """All columns of ``rows`` (give narrow ones; ``key`` unique, nulls first) plus ``next_<key>``.

    The row after the last is the first; a single row is its own neighbour. Rows are range-partitioned and
    staged with their range number; each range looks ahead by itself and its last row takes the first
    key of the next range, of which there is one row per range.
    """
    rows = stage(rows)
    parts = max(1, -(-rows.count() // range_rows))
    ranged = stage(rows.repartitionByRange(parts, F.col(key).asc_nulls_first())
                   .withColumn("__range", F.spark_partition_id()))
    firsts = ranged.groupBy("__range").agg(F.min(F.struct(F.col(key).isNotNull(), F.col(key))).alias("__first"))
    order = Window.orderBy("__range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("__range", F.coalesce(F.lead("__first").over(order), F.first("__first").over(whole)).getField(key).alias("__after"))
    inside = Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_first())
    last = F.lead(F.lit(1)).over(inside).isNull()
    return (ranged.withColumn(f"next_{key}", F.lead(key).over(inside)).withColumn("__last", last)
            .join(firsts, "__range")
            .withColumn(f"next_{key}", F.when(F.col("__last"), F.col("__after")).otherwise(F.col(f"next_{key}")))
            .drop("__range", "__last", "__after"))
