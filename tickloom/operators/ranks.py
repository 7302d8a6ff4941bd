"""Exact positions and order statistics without a single-task sort.

A global row number needs a global order. Both helpers cut the order into chunks that are a
monotone function of the sort key, number the rows inside each chunk, and add the number of
rows in all earlier chunks (from a small per-chunk count). Equal values are first collapsed to
one counted row, so a value shared by a third of the table is one row, not one hot task.

For values the chunks are ranges between sampled quantiles: a range with too many distinct values is cut again
at quantiles of its own, until none is over-full. So ranges are even for every distribution of values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.staging import stage

#: Distinct values a range may hold, ranges an over-full one is cut into, and the error of their quantiles (1 / ACCURACY).
RANGE_ROWS = 200_000
WAYS = 256
ACCURACY = 10_000


def row_number_by_chunk(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                        chunk: Column, out: str) -> DataFrame:
    """1-based row number per keys; ``chunk`` must be monotone in the order columns."""
    tagged = df.withColumn("_chunk", chunk)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
               .drop("_n"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (tagged.withColumn("_pos", F.row_number().over(inside))
            .join(offsets, [*keys, "_chunk"])
            .withColumn(out, (F.col("_before") + F.col("_pos")).cast("bigint"))
            .drop("_chunk", "_pos", "_before"))


def even_ranges(counted: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Number of a range of values per keys, monotone in ``value``, in ``out``; ``counted`` (written) has a row per value.

    Ranges of more than RANGE_ROWS rows are cut at WAYS - 1 approximate quantiles, as often as needed. The splitters are
    written before they are used, so all readers and retried tasks see the same ranges; they take a small
    part of a byte per row.
    """
    ways = F.array(*[F.lit(i / WAYS) for i in range(1, WAYS)])
    ranged = counted.withColumn(out, F.lit(0).cast("bigint"))
    if counted.count() <= RANGE_ROWS:  # read from the files' footers: no key can be over-full
        return ranged
    while True:
        full = stage(ranged.groupBy(*keys, out).agg(F.count("*").alias("_m"), F.percentile_approx(value, ways, ACCURACY).alias("_s"))
                     .where(F.col("_m") > RANGE_ROWS).drop("_m"))
        if full.isEmpty():
            return ranged
        ranged = ranged.join(full, [*keys, out], "left").withColumn("_at", F.lit(0))
        step = WAYS // 2
        while step:  # binary search: how many splitters are not above the value
            above = F.col(value) >= F.get("_s", F.col("_at") + (step - 1))
            ranged = ranged.withColumn("_at", F.col("_at") + F.when(above, F.lit(step)).otherwise(F.lit(0)))
            step //= 2
        ranged = stage(ranged.withColumn(out, F.col(out) * WAYS + F.col("_at")).drop("_s", "_at"))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str,
                extra: Mapping[str, Column] | None = None, bucket: Column | None = None,
                carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct non-null value: its count, rows strictly below, and the total.

    ``extra`` adds aggregates per distinct value (for example a count per class); each also
    gets a ``<name>_below`` cumulative column and a ``<name>_total``. ``bucket`` gives a monotone
    bucket of the value (coarse time for epoch seconds) where one is known to be even; otherwise
    the values are cut into even ranges. ``carry`` adds plain aggregates per distinct value from the same pass.
    """
    extra, carry = dict(extra or {}), dict(carry or {})
    names = ["n", *extra]
    counted = (df.filter(F.col(value).isNotNull())
               .groupBy(*keys, value)
               .agg(F.count("*").alias("n"), *[a.alias(n) for n, a in {**extra, **carry}.items()]))
    # the values are read for their ranges, for the ranges' sums and for the ranks
    counted = even_ranges(stage(counted), keys, value, "_b") if bucket is None else counted.withColumn("_b", bucket)

    per_bucket = counted.groupBy(*keys, "_b").agg(*[F.sum(n).alias(f"_s_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys, "_b",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_s_{n}").over(whole).alias(_total(n)) for n in names])

    below = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = counted.select(
        "*", *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"_i_{n}") for n in names])
    return (ranked.join(offsets, [*keys, "_b"])
            .select(*keys, value, *names, *carry,
                    *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(_below(n)) for n in names],
                    *[_total(n) for n in names]))


def _below(name: str) -> str:
    return "below" if name == "n" else f"{name}_below"


def _total(name: str) -> str:
    return "total" if name == "n" else f"{name}_total"


def at_position(value: str, position: Column, n: str = "n", below: str = "below") -> Column:
    """Aggregate over ranks: the value at a 0-based position of the sorted column."""
    here = (F.col(below) <= position) & (position < F.col(below) + F.col(n))
    return F.max(F.when(here, F.col(value)))


def order_statistics(ranks: DataFrame, keys: Sequence[str], value: str,
                     positions: Mapping[str, Column], *, n: str = "n", below: str = "below",
                     total: str = "total") -> DataFrame:
    """Values at given 0-based positions of the sorted column, one output column each.

    ``positions`` maps an output name to an expression of the total count; ``ranks`` is the
    result of :func:`value_ranks`. One row per key comes out.
    """
    return ranks.groupBy(*keys).agg(F.max(total).alias("total"), *[
        at_position(value, position, n, below).alias(name) for name, position in positions.items()])


def at_fraction(q: float, total: str = "total") -> Column:
    """Position int(n*q), as used by the report and threshold studies."""
    return F.floor(F.col(total) * F.lit(float(q))).cast("bigint")


def median_of(value: str, name: str = "n") -> Column:
    """Aggregate over ranks: exact median of the rows that ``name`` counts; the mean of the two middle values if even."""
    t, cut = F.col(_total(name)), {"n": name, "below": _below(name)}
    low = at_position(value, F.floor((t - 1) / 2).cast("bigint"), **cut)
    return (low + at_position(value, F.floor(t / 2).cast("bigint"), **cut)) / 2


def median(ranks: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per key, with the number of rows as ``total``."""
    return ranks.groupBy(*keys).agg(median_of(value).alias(out), F.max("total").alias("total"))
