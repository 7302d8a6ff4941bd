"""Joins whose key is coarse (a series, a feature) while one key may hold much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
                how: str = "inner", salts: int | None = None) -> DataFrame:
    """Join rows to a per-key summary with every key cut into ``salts`` parts.

    By default as many as there are shuffle partitions, so one key can use every task.

    The summary (a few rows per key) is repeated once per salt, and each big row picks one salt
    from a hash of ``spread_by``; a deterministic salt survives task retries. Nothing is
    broadcast by hint: adaptive execution does so when the summary turns out small.
    """
    if salts is None:
        salts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")
