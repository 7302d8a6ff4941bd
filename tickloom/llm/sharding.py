"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows sit in source partitions. A matrix says how many rows of each partition go to each shard; its
row sums are the partition counts and its column sums the shard sizes, and it is drawn from the
multivariate hypergeometric law. Rows are permuted inside their partition, dealt out by the
matrix, and permuted again inside their shard, which makes the whole arrangement a uniform
permutation with shard sizes that never differ by more than one.

The matrix is drawn in two levels: the driver splits the shard sizes among groups of at most
``GROUP`` partitions, tasks split each group's share among its partitions. Ranks inside a shard
are taken in blocks of bounded size with offsets from the block counts, so no task holds a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.staging import stage

#: Partitions whose shares one task draws.
GROUP = 1024
#: numpy draws exactly up to this population; beyond it a rounded normal draw is used.
EXACT_POPULATION = 1_000_000_000


def _draw(rng, good: int, rest: int, sample: int) -> int:
    if sample == 0 or good == 0:
        return 0
    total = good + rest
    if total < EXACT_POPULATION:
        return int(rng.hypergeometric(good, rest, sample))
    share = good / total
    spread = np.sqrt(sample * share * (1 - share) * (total - sample) / max(total - 1, 1))
    return int(min(max(round(rng.normal(sample * share, spread)), sample - rest, 0), good, sample))


def split_counts(rng, colours: np.ndarray, samples: list[int]) -> np.ndarray:
    """Rows: one per sample, how many of each colour it takes; all colours are used up in the end."""
    left = colours.astype(np.int64).copy()
    out = np.zeros((len(samples), len(left)), dtype=np.int64)
    for i, sample in enumerate(samples):
        rest = int(left.sum())
        for s in range(len(left)):
            rest -= int(left[s])
            take = _draw(rng, int(left[s]), rest, sample)
            out[i, s] = take
            sample -= take
        left -= out[i]
    return out


def uniform_shards(rows: DataFrame, shards: int, seed: int = 17, block_rows: int = 16384) -> DataFrame:
    """All rows and columns of ``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0).

    Shard sizes differ by one at most. Repeated rows are separate rows; nulls are carried along; no
    rows give an empty result; input columns called ``shard`` or ``slot`` are replaced. Row numbers
    are fixed by a staged copy first, so a lost executor cannot change a draw. Give only the
    columns that must travel (identifiers, sizes): ``write_shards`` moves whole rows.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "__uid")
    base = stage(rows.withColumn("__uid", F.monotonically_increasing_id()))
    n = base.count()
    parts = max(1, -(-n // block_rows))
    base = base.withColumn("__part", F.pmod(F.xxhash64("__uid", F.lit(seed)), F.lit(parts)))

    counts = (base.groupBy("__part").agg(F.count("*").alias("__n"))
              .withColumn("__group", F.floor(F.col("__part") / GROUP)))
    groups = counts.groupBy("__group").agg(F.sum("__n").alias("n")).orderBy("__group").collect()
    sizes = np.full(shards, n // shards, dtype=np.int64)
    sizes[: n % shards] += 1
    matrix = split_counts(np.random.default_rng(seed), sizes, [r.n for r in groups])
    shares = spark.createDataFrame(
        [(r["__group"], [int(x) for x in take]) for r, take in zip(groups, matrix)],
        "__group bigint, __share array<bigint>")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__part")
        rng = np.random.default_rng([seed, int(pdf["__group"].iloc[0]) + 1])
        take = split_counts(rng, np.asarray(pdf["__share"].iloc[0]), [int(x) for x in pdf["__n"]])
        return pd.DataFrame({"__part": pdf["__part"].to_numpy(), "__bounds": list(take.cumsum(axis=1))})

    bounds = (counts.join(shares, "__group").groupBy("__group")
              .applyInPandas(deal, "__part bigint, __bounds array<bigint>"))

    local = Window.partitionBy("__part").orderBy(F.xxhash64("__uid", F.lit(seed + 1)), "__uid")
    placed = stage(base.withColumn("__rn", F.row_number().over(local)).join(bounds, "__part")
                   .withColumn("shard", F.expr("cast(size(filter(__bounds, b -> b < __rn)) as int)"))
                   .drop("__part", "__rn", "__bounds"))

    blocks = max(1, -(-n // (shards * block_rows)))
    key = F.xxhash64("__uid", F.lit(seed + 2))
    placed = placed.withColumn("__block", F.pmod(key, F.lit(blocks)))
    per_block = placed.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("shard", "__block",
                               F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("shard", "__block").orderBy(key, "__uid")
    return (placed.withColumn("__rn", F.row_number().over(inside)).join(offsets, ["shard", "__block"])
            .withColumn("slot", (F.col("__off") + F.col("__rn") - 1).cast("bigint"))
            .drop("__block", "__rn", "__off", "__uid"))


def write_shards(rows: DataFrame, plan: DataFrame, key: str, path: str, rows_per_file: int = 100_000) -> None:
    """Write whole rows, shard by shard in slot order; ``key`` must be unique in both tables."""
    file_no = F.floor(F.col("slot") / rows_per_file)
    (rows.join(plan.select(key, "shard", "slot"), key)
     .repartition("shard", file_no).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
