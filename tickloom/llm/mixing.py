"""Mix sources to target weights over a tree domain, language, source.

Budgets go down the tree. Every node can use at most ``max_epochs`` times the tokens below it; at
each parent the budget is dealt to the children by weight, and what a child cannot use is dealt
to its brothers by their weights, until they are full too. Because a parent never gets more than
its subtree can use, a shortage reaches the brothers first and an ancestor's brothers only when
the whole subtree is full.

A leaf whose budget is ``e`` whole epochs and a rest takes every document ``e`` times, and once
more the documents of the next seeded epoch order whose running token sum stays within the rest.

All arithmetic is on whole tokens. The tree has one row per (domain, language, source); running
sums inside a leaf are taken in hash ranges of bounded size with offsets from range totals, so a
source with a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.staging import stage

LEVELS = ("domain", "lang", "source")


def _weight(level: str, weights: dict) -> Column:
    given = weights.get(level, {})
    out = F.lit(1).cast("bigint")
    for name, value in given.items():
        out = F.when(F.col(level) == name, F.lit(value).cast("bigint")).otherwise(out)
    return out


def fill_children(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Deal ``budget`` of a parent to its children by ``weight``, none above its ``cap``.

    Children are taken by cap per weight; a child is full if its share of what is left exceeds its
    cap. Shares are rounded down, so a budget is missed by less than one token a child.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ranked = (nodes.withColumn("__left", left).withColumn("__w", F.sum("weight").over(after))
              .withColumn("__full", F.expr("cap * __w <= weight * __left")))
    # full children come first; the first one that is not full fixes the level for the rest
    whole = Window.partitionBy(*parent)
    level = F.min(F.when(~F.col("__full"), F.struct(F.col("cap") / F.col("weight"), F.col(name), "__left", "__w"))).over(whole)
    return (ranked.withColumn("__level", level)
            .withColumn("__got", F.expr("case when __full then cap else weight * __level.__left div __level.__w end")))


def leaf_budgets(leaves: DataFrame, weights: dict, total: Column, max_epochs: int) -> DataFrame:
    """``leaves``: domain, lang, source, supply (tokens). Adds ``budget``, the leaf's tokens."""
    caps = leaves.withColumn("cap", F.col("supply") * F.lit(max_epochs).cast("bigint"))
    got = caps.agg(F.sum("cap").alias("__cap"), F.sum("supply").alias("supply"))
    got = got.select(F.lit(0).alias("root"), F.least(F.col("__cap"), total.cast("bigint")).alias("budget"))
    parent: list[str] = ["root"]
    for depth, name in enumerate(LEVELS):
        keys = ["root", *LEVELS[: depth + 1]]
        nodes = (caps.withColumn("root", F.lit(0)).groupBy(*keys).agg(F.sum("cap").alias("cap"))
                 .withColumn("weight", _weight(name, weights)).join(got, parent))
        got = fill_children(nodes, parent, name).select(*keys, F.col("__got").alias("budget"))
        parent = keys
    return leaves.join(got.drop("root"), list(LEVELS))


def mix(docs: DataFrame, weights: dict, share: tuple[int, int] = (3, 5), max_epochs: int = 2, seed: int = 11,
        range_rows: int = 16384) -> DataFrame:
    """Columns of ``docs`` plus ``leaf_tokens``, ``leaf_budget`` and ``copies`` (0 to max_epochs).

    ``docs`` has doc_id, domain, lang, source and n_tokens. The total budget is share[0]/share[1] of
    all tokens. Weights are whole numbers by level and name, 1 where none is given. Null names form a
    node '?', null token counts are 0, null doc_ids sort as ''. A leaf without tokens has budget 0 and
    copies 0. Repeated rows are separate documents. Other columns are carried along; input
    columns named like a result are replaced.
    """
    docs = docs.drop("leaf_tokens", "leaf_budget", "copies")
    for name in LEVELS:
        docs = docs.withColumn(f"__{name}", F.coalesce(F.col(name), F.lit("?")))
    docs = (docs.withColumn("__tok", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint"))
            .withColumn("__key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))))
    tree = (docs.groupBy(*[F.col(f"__{n}").alias(n) for n in LEVELS])
            .agg(F.sum("__tok").alias("supply"), F.count("*").alias("rows")))
    tree = stage(leaf_budgets(tree, weights, F.expr(f"supply * {share[0]} div {share[1]}"), max_epochs)
                 .select(*[F.col(n).alias(f"__{n}") for n in LEVELS], F.col("supply").alias("leaf_tokens"),
                         F.col("budget").alias("leaf_budget"),
                         F.ceil(F.col("rows") / range_rows).alias("__ranges")))
    leaf = [f"__{n}" for n in LEVELS]
    keyed = (docs.join(tree, leaf)
             .withColumn("__range", F.expr("cast(conv(substr(__key, 1, 8), 16, 10) as bigint) * __ranges div 4294967296")))
    totals = keyed.groupBy(*leaf, "__range").agg(F.sum("__tok").alias("__sum"))
    before = Window.partitionBy(*leaf).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*leaf, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"))
    run = (Window.partitionBy(*leaf, "__range").orderBy("__key", "doc_id", "__tok")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    epochs = F.expr("case when leaf_tokens = 0 then 0 else leaf_budget div leaf_tokens end")
    rest = F.expr("case when leaf_tokens = 0 then -1 else leaf_budget % leaf_tokens end")
    return (keyed.withColumn("__run", F.sum("__tok").over(run)).join(totals, [*leaf, "__range"])
            .withColumn("copies", (epochs + F.when((F.col("__off") + F.col("__run") <= rest) & (epochs < max_epochs), 1).otherwise(0)).cast("int"))
            .drop(*leaf, "__tok", "__key", "__ranges", "__range", "__off", "__run"))
