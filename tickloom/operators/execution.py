"""Order execution against one book snapshot, and what follows from fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.staging import stage


#: Orders of one asset that go to one task.
HOT_ORDERS = 1_000_000


def not_above(values: Column, x: Column) -> Column:
    """How many of the ascending ``values`` are at most ``x``, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    fits = lambda at, step: (at + step <= F.size(values)) & (F.get(values, at + step - 1) <= x)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def book_depth(levels: DataFrame, asset: str = "asset") -> DataFrame:
    """One row per book side: ``toward`` (prices from the best on, bids negated), ``depth`` and ``paid`` running sums."""
    toward = F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))
    merged = levels.withColumn("_toward", toward).groupBy(asset, "side", "_toward").agg(F.sum("size").alias("_size"))
    upto = Window.partitionBy(asset, "side").orderBy("_toward").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = merged.select(asset, "side", F.struct(
        F.col("_toward").alias("toward"), F.sum("_size").over(upto).alias("depth"),
        F.sum(F.col("_size") * F.abs("_toward")).over(upto).alias("paid")).alias("_l"))
    rows = sums.groupBy(asset, "side").agg(F.array_sort(F.collect_list("_l")).alias("_l"))
    return rows.select(asset, "side", *[F.col(f"_l.{c}").alias(c) for c in ("toward", "depth", "paid")])


def depth_walk(orders: DataFrame, levels: DataFrame, *, order_id: str = "order_id",
               asset: str = "asset") -> DataFrame:
    """Fill each order from the best level on; levels hold (asset, side, price, size).

    ``orders`` carries side, need (shares), order_type and an optional limit_price; a market buy
    states its need as notional over the best ask. Every order sees the full snapshot.
    FOK fills completely or not at all. A limit FAK cancels the rest; a market order (no
    limit_price) that runs out of depth stays PARTIAL. Without any level on the other side a market
    order fails, and a limit order that crosses nothing stays open.

    A book side is one row of running sums, in which an order finds its limit and its end by binary search, so an
    order stays one row. The orders of an asset with more than HOT_ORDERS of them are dealt to several copies of its book.
    """
    hot = stage(orders.groupBy(asset).agg(F.ceil(F.count("*") / HOT_ORDERS).cast("int").alias("_parts")).filter("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1))
    buy = F.col("side") == "BUY"
    wanted = orders.join(hot, asset, "left").withColumns({
        "_part": F.pmod(F.xxhash64(order_id), parts).cast("int"), "_book_side": F.when(buy, F.lit("ask")).otherwise(F.lit("bid"))})
    books = (book_depth(levels, asset).withColumnRenamed("side", "_book_side").join(hot, asset, "left")
             .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))))
    met = wanted.drop("_parts").join(books.drop("_parts"), [asset, "_book_side", "_part"], "left")

    sum_of = lambda sums, n: F.when(n > 0, F.get(sums, n - 1)).otherwise(F.lit(0.0))
    limit = F.when(buy, F.col("limit_price")).otherwise(-F.col("limit_price"))
    seen = F.col("depth").isNotNull()
    met = met.withColumn("_crossed", F.when(limit.isNull(), F.size("depth")).otherwise(not_above(F.col("toward"), limit)))
    crossed = F.when(seen, F.col("_crossed")).otherwise(F.lit(0))
    available = sum_of(F.col("depth"), crossed)
    refused = (F.col("order_type") == "FOK") & (available < F.col("need"))
    filled = F.when(refused | (crossed == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.col("need"), available)))
    met = met.withColumns({"_crossed": crossed, "_filled": filled})
    met = met.withColumn("_full", F.when(F.col("_filled") > 0, F.least(not_above(F.col("depth"), F.col("_filled")), F.col("_crossed"))))
    rest = F.col("_filled") - sum_of(F.col("depth"), F.col("_full"))
    paid = sum_of(F.col("paid"), F.col("_full")) + F.when(
        rest > 0, rest * F.abs(F.get("toward", F.col("_full")))).otherwise(F.lit(0.0))
    filled = F.col("_filled")
    status = (
        F.when(~seen & F.col("limit_price").isNull(), F.lit("FAILED"))
        .when(F.col("_crossed") == 0, F.lit("OPEN"))
        .when(filled >= F.col("need"), F.lit("FILLED"))
        .when((F.col("order_type") == "FOK")
              | ((F.col("order_type") == "FAK") & F.col("limit_price").isNotNull()), F.lit("CANCELED"))
        .otherwise(F.lit("PARTIAL")))
    return met.select(*orders.columns, filled.alias("filled"), (F.col("need") - filled).alias("unfilled"),
                      F.when(filled > 0, paid / filled).alias("vwap"), status.alias("status"))


def market_buy_need(orders: DataFrame, levels: DataFrame, asset: str = "asset") -> DataFrame:
    """Shares a market buy of ``notional`` asks for: notional over the best ask (NULL without one)."""
    best = levels.filter("side = 'ask'").groupBy(asset).agg(F.min("price").alias("_best"))
    return (orders.join(best, asset, "left")
            .withColumn("need", F.col("notional") / F.col("_best")).drop("_best"))


def position_ledger(fills: DataFrame, keys: Sequence[str] = ("token_id",)) -> DataFrame:
    """Signed size and cash per token: buys add shares and cost cash, sells the reverse."""
    buy = F.col("side") == "BUY"
    amount = (F.col("price") * F.col("size")).cast("decimal(28,10)")
    return fills.groupBy(*keys).agg(
        F.sum(F.when(buy, F.col("size")).otherwise(-F.col("size"))).alias("position"),
        F.sum(F.when(buy, amount)).alias("cash_out"), F.sum(F.when(~buy, amount)).alias("cash_in"),
        F.sum(F.when(buy, -amount).otherwise(amount)).alias("cash"))


def settle_ledger(ledger: DataFrame, won: DataFrame, keys: Sequence[str] = ("token_id",)) -> DataFrame:
    """Winners pay one per share; positions end flat. Tokens without a result keep their position."""
    j = ledger.join(won, list(keys), "left")
    payout = F.when(F.col("won"), F.col("position")).when(~F.col("won"), F.lit(0))
    return j.select(*keys, "position", F.col("cash").alias("cash_before"), payout.alias("payout"),
                    (F.col("cash") + F.coalesce(payout, F.lit(0))).alias("cash_after"))


def order_fill_state(orders: DataFrame, fills: DataFrame, order_id: str = "order_id") -> DataFrame:
    """Filled size, volume-weighted price, remaining size, state and fill ratio per order."""
    useful = fills.filter(F.col("size") > 0)
    g = useful.groupBy(order_id).agg(
        F.sum("size").alias("_f"), F.sum((F.col("size") * F.col("price")).cast("decimal(28,10)")).alias("_amt"))
    j = orders.join(g, order_id, "left")
    filled = F.coalesce(F.col("_f").cast("double"), F.lit(0.0))
    amount = F.coalesce(F.col("_amt").cast("double"), F.lit(0.0))
    ratio = F.when(F.col("target_notional") > 0, amount / F.col("target_notional"))
    return j.select(
        *orders.columns, filled.alias("filled"), F.when(filled > 0, amount / filled).alias("avg_price"),
        F.greatest(F.col("order_size") - filled, F.lit(0.0)).alias("remaining"),
        F.when(filled <= 0, F.lit("OPEN")).when(filled >= F.col("order_size"), F.lit("FILLED"))
        .otherwise(F.lit("PARTIAL")).alias("state"), ratio.alias("fill_ratio"))
