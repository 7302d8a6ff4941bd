"""Aggregations and statistics over replay results and candidate rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import breakeven_price, hold_to_settle_ev
from tickloom.operators.ranks import at_fraction, at_position, median, median_of, order_statistics, row_number_by_chunk, value_ranks
from tickloom.operators.skew import salted_join
from tickloom.params import MIN_SAMPLE, STUDY_BAND, STUDY_SECONDS, TRAIN_FRACTION
from tickloom.plans.staging import stage

WINS = ("TAKE_PROFIT", "SETTLE_WIN")
EXIT_KINDS = ("NO_ENTRY", "NO_ENTRY_DEPTH", "TAKE_PROFIT", "STOP_LOSS", "SETTLE_WIN", "SETTLE_LOSE")
LABELS = ("future_return_30", "future_return_60", "future_return_120", "mfe_60", "mae_60")


def _share(part: Column, whole: Column) -> Column:
    """part/whole as double, zero when the whole is empty."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


# ---------------------------------------------------------------- books and candidate rows

def top_of_book(levels: DataFrame, keys: Sequence[str], price: str = "price", size: str = "size"
                ) -> DataFrame:
    """Best bid and ask with sizes, spread and mid from long-form levels; one aggregation."""
    bid = F.when(F.col("side") == "bid", F.col(price))
    ask = F.when(F.col("side") == "ask", F.col(price))
    g = levels.groupBy(*keys).agg(
        F.max(bid).alias("best_bid"), F.max_by(F.when(bid.isNotNull(), F.col(size)), bid).alias("bid_size"),
        F.min(ask).alias("best_ask"), F.min_by(F.when(ask.isNotNull(), F.col(size)), ask).alias("ask_size"))
    return g.withColumn("spread", F.col("best_ask") - F.col("best_bid")).withColumn(
        "mid", (F.col("best_ask") + F.col("best_bid")) / 2)


def top_levels(levels: DataFrame, keys: Sequence[str], n: int, price: str = "price",
               size: str = "size") -> DataFrame:
    """First n levels per side: bids from the highest price, asks from the lowest.

    Levels of one price are merged, so a book side holds one row per price step. All comes from one sort by
    price; prices beyond the n best are dropped before the shuffle already, and nothing is hashed.
    """
    toward = F.when(F.col("side") == "bid", -F.col(price)).otherwise(F.col(price))
    w = Window.partitionBy(*keys, "side").orderBy("_toward")
    same = w.rangeBetween(Window.currentRow, Window.currentRow)
    best = (levels.select(*keys, "side", price, size, toward.alias("_toward"))
            .withColumn("level", F.dense_rank().over(w).cast("bigint")).filter(F.col("level") <= n))
    merged = best.withColumns({size: F.sum(size).over(same), "_first": F.row_number().over(w) == F.rank().over(w)})
    return merged.filter("_first").select(*keys, "side", price, size, "level")


def side_pair_check(ticks: DataFrame, keys: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """mid(Up)+mid(Down)-1 per (window, t) from long-form sides; flag large gaps."""
    mid = F.when(F.col("ask").isNotNull() & F.col("bid").isNotNull(), (F.col("ask") + F.col("bid")) / 2)
    g = ticks.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "Up", mid)).alias("_u"),
        F.max(F.when(F.col("side") == "Down", mid)).alias("_d"))
    gap = F.rint((F.col("_u") + F.col("_d") - 1) * 1e10) / 1e10
    return (g.filter(F.col("_u").isNotNull() & F.col("_d").isNotNull())
            .select(*keys, gap.alias("gap"), (F.abs(gap) >= tolerance).alias("flagged")))


def union_sides(ticks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Wide Up/Down ticks to one row per side; a single scan."""
    def side(name: str, ask: str, bid: str, ask_size: str, bid_size: str) -> Column:
        return F.struct(F.lit(name).alias("side"), F.col(ask).alias("ask"), F.col(bid).alias("bid"),
                        F.col(ask_size).alias("ask_size"), F.col(bid_size).alias("bid_size"))
    both = F.array(side("Up", "au", "bu", "sau", "su"), side("Down", "ad", "bd", "sad", "sd"))
    return ticks.select(*keep, F.inline(both))


def would_enter(features: DataFrame, *, elapsed: str = "elapsed", time_scale: int = 1,
                seconds: tuple = STUDY_SECONDS, band: tuple = STUDY_BAND) -> DataFrame:
    """Candidate orders: entry seconds (inclusive), ask in (lo, hi], with label and break-even."""
    s = F.col(elapsed) / time_scale
    kept = features.filter(
        (s >= seconds[0]) & (s <= seconds[1])
        & (F.col("cand_ask") > band[0]) & (F.col("cand_ask") <= band[1]))
    return kept.withColumns({
        "win_label": F.coalesce(F.col("final_outcome") == F.col("cand"), F.lit(False)),
        "ev_breakeven": breakeven_price(F.col("cand_ask"))}).drop("entered")


def group_ev(won: str, ask: str) -> Column:
    """Win rate of a group minus the break-even at its mean ask."""
    rate = F.avg(F.col(won).cast("int").cast("double"))
    return rate - breakeven_price(F.avg(ask))


def candle_rules(o="o", h="h", l="l", c="c") -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in (o, h, l, c))
    return {"r_close": c >= o, "r_typ": (h + l + c) / 3 >= o, "r_ohlc": (o + h + l + c) / 4 >= o}


def flatness(o: str = "o", c: str = "c") -> Column:
    return F.abs(F.col(c) - F.col(o)) / F.col(o)


# ---------------------------------------------------------------- replay summaries

def run_summary(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entered count, rates, result and fee sums, mean ask per group; empty groups give zeros."""
    entered = F.col("size") > 0
    kind = F.col("exit_kind")
    g = results.groupBy(*by).agg(
        F.count_if(entered).alias("n"),
        F.count_if(entered & (kind == "TAKE_PROFIT")).alias("_tp"),
        F.count_if(entered & (kind == "STOP_LOSS")).alias("_sl"),
        F.count_if(entered & kind.isin(*WINS)).alias("_win"),
        F.sum(F.when(entered, F.col("pnl"))).alias("_pnl"),
        F.sum(F.when(entered, F.col("fee"))).alias("_fee"),
        F.avg(F.when(entered, F.col("entry_ask"))).alias("_ask"))
    n, zero = F.col("n"), F.lit(0.0)
    pnl = F.coalesce(F.col("_pnl").cast("double"), zero)
    return g.select(
        *by, "n", _share(F.col("_tp"), n).alias("tp_rate"), _share(F.col("_sl"), n).alias("sl_rate"),
        _share(F.col("_win"), n).alias("win_rate"), _share(pnl, n).alias("pnl_per"),
        pnl.alias("pnl"), F.coalesce(F.col("_fee").cast("double"), zero).alias("fee"),
        F.coalesce("_ask", zero).alias("ask"))


REPORT_QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


def run_report(results: DataFrame, windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per exit kind, skipped windows, win rates and exact result quantiles per group."""
    entered = F.col("size") > 0
    kinds = [F.count_if(F.col("exit_kind") == k).alias(k.lower()) for k in EXIT_KINDS]
    counts = results.groupBy(*by).agg(
        F.count("*").alias("windows"), F.count_if(entered).alias("entered"), *kinds,
        F.sum("pnl").cast("double").alias("total_pnl"), F.sum("fee").cast("double").alias("total_fee"))
    skipped = windows.groupBy(*by).agg(
        F.count_if(F.coalesce(~F.col("outcome").isin("Up", "Down"), F.lit(True))).alias("skipped"))
    ranks = value_ranks(results.filter(entered), by, "pnl")
    quant = order_statistics(ranks, by, "pnl", {n: at_fraction(q) for n, q in REPORT_QUANTILES.items()})
    settled = F.col("settle_win") + F.col("settle_lose")
    return (counts.join(skipped, list(by), "left").join(quant.drop("total"), list(by), "left")
            .withColumn("settled_win_rate", F.when(settled > 0, F.col("settle_win") / settled))
            .withColumn("nominal_win_rate", F.when(
                F.col("entered") > 0, (F.col("settle_win") + F.col("take_profit")) / F.col("entered"))))


def entry_distribution(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entries by side and by price in cents."""
    return (results.filter(F.col("size") > 0)
            .groupBy(*by, "cand", F.rint(F.col("entry_ask") * 100).cast("bigint").alias("price_c"))
            .agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- splits and folds

def _time_span(window_len: int) -> int:
    return window_len * 4096


def window_cut(df: DataFrame, keys: Sequence[str], window: str, window_len: int = 300,
               fraction: float = TRAIN_FRACTION) -> DataFrame:
    """First validation window per key: distinct sorted windows at int(n*fraction)."""
    distinct = df.select(*keys, window).distinct()
    ranks = value_ranks(distinct, keys, window, bucket=F.floor(F.col(window) / _time_span(window_len)))
    cut = order_statistics(ranks, keys, window, {"cut": at_fraction(fraction)})
    return cut.select(*keys, "cut", F.col("total").alias("n_windows"))


def walk_forward_split(df: DataFrame, keys: Sequence[str], window: str, window_len: int = 300,
                       fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Tag rows train or val by whole windows: train < cut <= val."""
    cut = window_cut(df, keys, window, window_len, fraction).drop("n_windows")
    side = F.when(F.col(window) < F.col("cut"), F.lit("train")).otherwise(F.lit("val"))
    return salted_join(df, cut, keys, [window]).withColumn("split", side).drop("cut")


def number_windows(df: DataFrame, keys: Sequence[str], window: str, window_len: int = 300
                   ) -> DataFrame:
    """Distinct windows with 1-based position and count per key."""
    distinct = df.select(*keys, window).distinct()
    chunk = F.floor(F.col(window) / _time_span(window_len))
    numbered = row_number_by_chunk(distinct, keys, [F.col(window)], chunk, "position")
    totals = distinct.groupBy(*keys).agg(F.count("*").alias("n_windows"))
    return salted_join(numbered, totals, keys, [window])


def position_split(results: DataFrame, keys: Sequence[str], window: str, window_len: int = 300,
                   fraction: float = TRAIN_FRACTION, windows: DataFrame | None = None) -> DataFrame:
    """Run form of the split: the first int(n*fraction) windows of a run are train.

    ``windows``, if given, holds the same windows once each, so that they can be numbered without a
    pass over the results of every parameter set.
    """
    pos = number_windows(results if windows is None else windows, keys, window, window_len)
    cut = F.floor(F.col("n_windows") * F.lit(fraction))
    tagged = pos.withColumn("split", F.when(F.col("position") <= cut, F.lit("train")).otherwise(F.lit("val")))
    return results.join(tagged.select(*keys, window, "split"), [*keys, window])


def rule_folds(df: DataFrame, keys: Sequence[str], window: str, folds: int = 5,
               window_len: int = 300) -> DataFrame:
    """Rule form: fold bounds every max(1, n//folds) windows, the remainder joins the last fold."""
    pos = number_windows(df, keys, window, window_len)
    size = F.greatest(F.lit(1), F.floor(F.col("n_windows") / folds))
    fold = F.least(F.floor((F.col("position") - 1) / size), F.lit(folds - 1)).cast("bigint") + 1
    return df.join(pos.withColumn("fold", fold).select(*keys, window, "fold"), [*keys, window])


def run_folds(df: DataFrame, keys: Sequence[str], window: str, folds: int = 5,
              window_len: int = 300, windows: DataFrame | None = None) -> DataFrame:
    """Run form: folds of n//folds windows; the remainder belongs to no fold (NULL). ``windows`` as in :func:`position_split`."""
    pos = number_windows(df if windows is None else windows, keys, window, window_len)
    size = F.greatest(F.lit(1), F.floor(F.col("n_windows") / folds))
    fold = F.floor((F.col("position") - 1) / size).cast("bigint") + 1
    fold = F.when(fold <= folds, fold)
    return df.join(pos.withColumn("fold", fold).select(*keys, window, "fold"), [*keys, window])


def rule_fold_stats(rows: DataFrame, keys: Sequence[str], rule: Column) -> DataFrame:
    """Per fold: hits, win rate, row EV, mean ask of the hits, and recall of all winners."""
    hit = F.coalesce(rule, F.lit(False))
    won = F.col("win_label")
    g = rows.groupBy(*keys, "fold").agg(
        F.count_if(hit).alias("n"), F.count_if(hit & won).alias("_wh"), F.count_if(won).alias("_w"),
        F.avg(F.when(hit, hold_to_settle_ev(F.col("cand_ask"), won))).alias("_ev"),
        F.avg(F.when(hit, F.col("cand_ask"))).alias("_ask"))
    zero = F.lit(0.0)
    return g.select(*keys, "fold", "n", _share(F.col("_wh"), F.col("n")).alias("win_rate"),
                    F.coalesce("_ev", zero).alias("ev"), F.coalesce("_ask", zero).alias("ask"),
                    _share(F.col("_wh"), F.col("_w")).alias("recall"))


def significance_verdict(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean result against its standard error (population variance) and positive folds.

    ``results`` carries a ``fold`` column from :func:`run_folds`; NULL folds count in the total.
    """
    entered = F.col("size") > 0
    pnl = F.when(entered, F.col("pnl").cast("double"))
    per_fold = results.groupBy(*keys, "fold").agg(
        F.count(pnl).alias("n"), F.avg(pnl).alias("m"))
    # a fold counts as positive by its mean rounded to four decimals
    positive = F.col("fold").isNotNull() & (F.rint(F.col("m") * 1e4) > 0)
    total = per_fold.groupBy(*keys).agg(
        F.count_if(F.coalesce(positive, F.lit(False))).alias("positive_folds"))
    spread = results.groupBy(*keys).agg(F.count(pnl).alias("n"), F.avg(pnl).alias("_mean"), F.stddev_pop(pnl).alias("_sd"))
    n = F.col("n")
    out = (total.join(spread, list(keys)).withColumn("mean_pnl", F.when(n > 0, F.rint(F.col("_mean") * 1e4) / 1e4))
           .withColumn("se", F.when(n > 0, F.rint(F.col("_sd") / F.sqrt(n) * 1e4) / 1e4)))
    verdict = (F.when(n == 0, F.lit("no sample"))
               .when(F.col("mean_pnl") > F.col("se"), F.lit("above")).otherwise(F.lit("not above")))
    return out.select(*keys, "n", "mean_pnl", "se", "positive_folds", verdict.alias("verdict"))


# ---------------------------------------------------------------- buckets and crosstabs

def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form: one row per (row, feature) with a non-null double value."""
    long = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(keep), list(features), "feature", "value")
    return long.filter(F.col("value").isNotNull())


def _label_sums() -> dict[str, Column]:
    sums = {"wins": F.sum(_flag(F.col("final_outcome") == F.col("cand"))),
            "entries": F.sum(_flag(F.col("entered")))}
    for name in LABELS:
        sums[f"s_{name}"] = F.sum(name)
        sums[f"c_{name}"] = F.count(name)
    return sums


def equal_frequency_buckets(long: DataFrame, keys: Sequence[str], tie: Sequence[str],
                            tie_chunk: Column, buckets: int = 5) -> DataFrame:
    """Slices [b*k//buckets, (b+1)*k//buckets) of the sorted values, with label statistics.

    Statistics are first summed per distinct value. Only the values cut by a slice edge (at most
    buckets-1 per key) need their rows ordered by ``tie``; the rest never leave the aggregate.
    A key with fewer rows than buckets comes out as one row without bucket and with n = 0.
    """
    sums = _label_sums()
    ranks = stage(value_ranks(long, keys, "value", carry=sums))
    enough = F.col("total") >= buckets

    def slot(pos: Column, total: Column) -> Column:
        # bucket b starts at b*total//buckets, so pos lies in (buckets*(pos+1)-1)//total
        return F.floor((F.lit(buckets) * (pos + 1) - 1) / total).cast("bigint")

    placed = ranks.withColumns({
        "b_lo": F.when(enough, slot(F.col("below"), F.col("total"))),
        "b_hi": F.when(enough, slot(F.col("below") + F.col("n") - 1, F.col("total")))})
    # keys with too few rows keep a null bucket
    whole = placed.filter("b_lo <=> b_hi").select(*keys, F.col("b_lo").alias("bucket"), "value", "n", *sums)
    edge = placed.filter("b_lo < b_hi").select(*keys, "value", "below", "total")
    edge_rows = salted_join(long, stage(edge), [*keys, "value"], list(tie))
    numbered = row_number_by_chunk(edge_rows, [*keys, "value"], [F.col(c) for c in tie], tie_chunk, "_rn")
    split = (numbered.withColumn("bucket", slot(F.col("below") + F.col("_rn") - 1, F.col("total")))
             .groupBy(*keys, "bucket", "value")
             .agg(F.count("*").alias("n"), *[c.alias(n) for n, c in sums.items()]))
    g = whole.unionByName(split).groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        *[F.sum(c).alias(c) for c in sums])
    held = F.col("bucket").isNotNull()
    n = F.when(held, F.col("n")).otherwise(F.lit(0)).cast("bigint")
    return g.select(
        *keys, (F.col("bucket") + 1).alias("bucket"), n.alias("n"), *[F.when(held, F.col(c)).alias(c) for c in ("low", "high")],
        F.when(held, _share(F.col("entries"), n)).alias("entry_rate"), F.when(held, _share(F.col("wins"), n)).alias("win_rate"),
        *[F.when(held & (F.col(f"c_{x}") > 0), F.col(f"s_{x}") / F.col(f"c_{x}")).alias(x) for x in LABELS],
        (n < MIN_SAMPLE).alias("small"))


def null_counts(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows without a value per feature, in long form."""
    g = df.groupBy(*keys).agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features])
    return g.unpivot(list(keys), list(features), "feature", "n_null")


def monotonicity_rho(buckets: DataFrame, keys: Sequence[str], label: str = "future_return_60"
                     ) -> DataFrame:
    """Spearman correlation of bucket means with bucket order; ties keep bucket order."""
    by_mean = Window.partitionBy(*keys).orderBy(F.coalesce(label, F.lit(0.0)), "bucket")
    by_place = Window.partitionBy(*keys).orderBy("bucket")
    d = F.col("_i") - F.col("_r")
    g = (buckets.filter("n > 0").withColumn("_r", F.row_number().over(by_mean))
         .withColumn("_i", F.row_number().over(by_place))
         .groupBy(*keys).agg(F.sum(d * d).alias("_d2"), F.count("*").alias("_n")))
    n = F.col("_n")
    rho = F.when(n < 2, F.lit(0.0)).otherwise(F.lit(1.0) - F.lit(6.0) * F.col("_d2") / (n * (n * n - 1)))
    return g.select(*keys, rho.alias("rho"))


def bucket_edges(df: DataFrame, keys: Sequence[str], values: Sequence[str], buckets: int = 5) -> DataFrame:
    """Edges sorted[min(i*k//buckets, k-1)] for i = 0..buckets of every value column, as arrays e_<column>; one pass for all."""
    long = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(keys), list(values), "feature", "value")
    t, by = F.col("total"), [*keys, "feature"]
    edges = value_ranks(long, by, "value").groupBy(*by).agg(F.array(*[
        at_position("value", F.least(F.floor(F.lit(i) * t / buckets), t - 1).cast("bigint")) for i in range(buckets + 1)]).alias("e"))
    return edges.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == v, F.col("e"))).alias(f"e_{v}") for v in values])


def crosstab_2d(df: DataFrame, keys: Sequence[str], x: str, y: str, spread_by: Sequence[str],
                buckets: int = 5) -> DataFrame:
    """n, win rate and mean 60 s return per cell; bucket = last edge not above the value."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    placed = salted_join(both, stage(bucket_edges(both, keys, [x, y], buckets)), keys, spread_by)

    def slot(v: str) -> Column:
        hit = F.lit(0)
        for i in range(1, buckets):
            hit = F.when(F.col(v) >= F.get(F.col(f"e_{v}"), F.lit(i)), F.lit(i)).otherwise(hit)
        return hit.cast("bigint")

    g = (placed.groupBy(*keys, slot(x).alias("x_bucket"), slot(y).alias("y_bucket"))
         .agg(F.count("*").alias("n"),
              F.sum(_flag(F.col("final_outcome") == F.col("cand"))).alias("_w"),
              F.avg("future_return_60").alias("ret60")))
    return g.select(*keys, "x_bucket", "y_bucket", "n",
                    _share(F.col("_w"), F.col("n")).alias("win_rate"), "ret60",
                    (F.col("n") < MIN_SAMPLE).alias("small"))


def _matching(named: Mapping[str, Column]) -> Column:
    """Names of all predicates a row satisfies (they may overlap); NULL operands do not match."""
    hits = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named.items()])
    return F.filter(hits, lambda h: h.isNotNull())


def condition_stats(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, str]) -> DataFrame:
    """n, entry rate, win rate and label means for each named SQL predicate, in one pass."""
    named = {n: F.expr(sql) for n, sql in conditions.items()}
    hit = df.withColumn("condition", F.explode(_matching(named)))
    g = hit.groupBy(*keys, "condition").agg(
        F.count("*").alias("n"), F.sum(_flag(F.col("final_outcome") == F.col("cand"))).alias("_w"),
        F.sum(_flag(F.col("entered"))).alias("_e"), F.avg("future_return_60").alias("ret60"),
        F.avg("mfe_60").alias("mfe60"), F.avg("mae_60").alias("mae60"))
    names = F.array(*[F.lit(n) for n in conditions])
    grid = df.select(*keys).distinct().withColumn("condition", F.explode(names))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return grid.join(g, [*keys, "condition"], "left").select(
        *keys, "condition", n.alias("n"),
        F.when(n > 0, F.col("_e") / n).alias("entry_rate"),
        F.when(n > 0, F.col("_w") / n).alias("win_rate"), "ret60", "mfe60", "mae60",
        (n < MIN_SAMPLE).alias("small"))


# ---------------------------------------------------------------- separation of winners and losers

def cohens_d(value: Column, positive: Column) -> Column:
    """Mean difference over pooled spread (sample variances); NaN below two rows per class."""
    pos, neg = F.when(positive, value), F.when(~positive, value)
    spread = F.sqrt((F.var_samp(pos) + F.var_samp(neg)) / 2)
    d = F.when(spread > 0, (F.avg(pos) - F.avg(neg)) / spread).otherwise(F.lit(0.0))
    return F.when((F.count(pos) < 2) | (F.count(neg) < 2), F.lit(float("nan"))).otherwise(d)


def class_ranks(long: DataFrame, keys: Sequence[str], value: str, positive: Column) -> DataFrame:
    return value_ranks(long, keys, value, {
        "pos": F.sum(_flag(positive)), "neg": F.sum(_flag(~positive))})


def _auc(aggregates: DataFrame, *columns: str | Column) -> DataFrame:
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return aggregates.select(*columns, F.when(pairs > 0, F.col("_u") / pairs).otherwise(F.lit(float("nan"))).alias("auc"))


def _auc_aggregates() -> list[Column]:
    wins = F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2)
    return [F.sum(wins).alias("_u"), F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg")]


def auc_mann_whitney(ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-averaged rank AUC from distinct values: ties count one half."""
    return _auc(ranks.groupBy(*keys).agg(*_auc_aggregates()), *keys, "n_pos", "n_neg")


def separation_profile(df: DataFrame, keys: Sequence[str], features: Sequence[str], positive: str,
                       min_class: int = 30, extra: Sequence[str] = ()) -> DataFrame:
    """Medians per class, effect size and AUC for each feature with enough rows per class."""
    long = unpivot_features(df, features, [*keys, positive])
    by = [*keys, "feature"]
    per_feature = class_ranks(long, by, "value", F.col(positive)).groupBy(*by).agg(
        *_auc_aggregates(), median_of("value", "pos").alias("median_pos"), median_of("value", "neg").alias("median_neg"))
    effect = long.groupBy(*by).agg(cohens_d(F.col("value"), F.col(positive)).alias("d"))
    enough = per_feature.filter((F.col("n_pos") >= min_class) & (F.col("n_neg") >= min_class))
    return _auc(enough, *by, "n_pos", "n_neg", "median_pos", "median_neg").join(effect, by)


def rank_top(df: DataFrame, metric: Column, n: int, tie: Sequence[str]) -> DataFrame:
    """First n rows by a metric, highest first, with a unique tie-break."""
    return df.orderBy(metric.desc(), *[F.col(c) for c in tie]).limit(n)


def rank_top_per_key(df: DataFrame, keys: Sequence[str], metric: Column, n: int,
                     tie: Sequence[str]) -> DataFrame:
    """Same per key, for small summary tables (one row per feature or parameter set)."""
    w = Window.partitionBy(*keys).orderBy(metric.desc(), *[F.col(c) for c in tie])
    return df.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= n)


THRESHOLD_FRACTIONS = (0.25, 0.5, 0.75)


def _threshold_sums(rows: DataFrame, keys: Sequence[str], features: Sequence[str], profile: DataFrame,
                    min_rows: int) -> DataFrame:
    """What each quantile threshold keeps of the judged rows: keep_n, keep_won, keep_known, keep_ask.

    ``rows`` have flags ``learn`` (thresholds are sorted[int(n*q)] of these) and ``judge``, and ``won``, ``known``.
    Running sums along the ranks of all values hold the answer at the threshold's own row, so a threshold is
    one lookup and no value meets the thresholds. The direction is the sign of the profile's effect.
    """
    long = unpivot_features(rows.withColumn("ask_paid", F.col("cand_ask")), features,
                            [*keys, "learn", "judge", "ask_paid", "won", "known"])
    by = [*keys, "feature"]
    judged = lambda c: F.coalesce(F.sum(F.when(F.col("judge"), c)), F.lit(0))
    sums = {"keep_n": judged(F.lit(1)), "keep_won": judged(_flag(F.col("won"))), "keep_known": judged(_flag(F.col("known"))),
            "keep_ask": judged(F.col("ask_paid"))}
    ranks = stage(value_ranks(long, by, "value", {"learnt": F.sum(_flag(F.col("learn"))), **sums}))
    total = F.col("learnt_total")
    stats = ranks.groupBy(*by).agg(F.max(total).alias("_learnt"), *[
        at_position("value", F.floor(total * F.lit(q)).cast("bigint"), "learnt", "learnt_below").alias(f"t{i}")
        for i, q in enumerate(THRESHOLD_FRACTIONS)])
    cuts = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"t{i}").alias("value")) for i, q in enumerate(THRESHOLD_FRACTIONS)])
    rules = (stats.filter(F.col("_learnt") >= min_rows).select(*by, F.inline(cuts))
             .join(profile.select(*by, "d"), by))
    at = ranks.join(stage(rules), [*by, "value"])
    from_here = {c: F.when(F.col("d") > 0, F.col(f"{c}_total") - F.col(f"{c}_below")).otherwise(F.col(f"{c}_below") + F.col(c))
                 for c in sums}
    return at.select(*by, "q", F.col("value").alias("threshold"), "d", *[e.alias(c) for c, e in from_here.items()])


def rule_threshold_sweep(train: DataFrame, val: DataFrame, keys: Sequence[str],
                         profile: DataFrame, features: Sequence[str], *, min_train: int = 500,
                         min_keep: int = 200) -> DataFrame:
    """Thresholds from train, direction from the profile's effect sign, judged on val."""
    def narrow(rows: DataFrame, learn: bool) -> DataFrame:
        return rows.select(*keys, *features, F.col("cand_ask").alias("_ask"), F.col("win_label").alias("won"),
                           F.lit(True).alias("known"), F.lit(learn).alias("learn"), F.lit(not learn).alias("judge"))

    both = narrow(train, True).unionByName(narrow(val, False))
    if "cand_ask" not in features:
        both = both.withColumnRenamed("_ask", "cand_ask")
    kept = _threshold_sums(both, keys, features, profile, min_train)
    base = val.groupBy(*keys).agg(F.count_if(F.col("win_label")).alias("_pos"),
                                  F.count_if(~F.col("win_label")).alias("_neg"))
    n, win = F.col("keep_n"), F.col("keep_won")
    rate = win / n
    ask = F.col("keep_ask") / n
    return (kept.filter((n > 0) & (n >= min_keep)).join(base, list(keys)).select(
        *keys, "feature", "q", "threshold", F.signum("d").cast("int").alias("direction"),
        n.alias("n"), rate.alias("win_rate"), (rate - breakeven_price(ask)).alias("ev"),
        rate.alias("precision"), _share(win, F.col("_pos")).alias("recall"),
        F.when(F.col("_neg") > 0, 1 - (n - win) / F.col("_neg")).alias("fp_cut")))


def filter_tradeoff(rows: DataFrame, keys: Sequence[str], profile: DataFrame,
                    features: Sequence[str], *, min_rows: int = 100, min_keep: int = 100
                    ) -> DataFrame:
    """Both sides of each threshold: kept and dropped counts, win rates, and winners lost.

    ``killed_rate`` divides by all rows with a known outcome, as published;
    ``killed_of_winners`` divides by the winners. A missing value is dropped.
    """
    r = rows.withColumns({
        "won": F.coalesce(F.col("final_outcome") == F.col("cand"), F.lit(False)),
        "known": F.col("final_outcome").isNotNull(), "learn": F.lit(True), "judge": F.lit(True)})
    kept = _threshold_sums(r, keys, features, profile, min_rows)
    base = r.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if("won").alias("_won"),
                                F.count_if("known").alias("_known"))
    n = F.col("keep_n")
    drop_n, killed = F.col("_n") - n, F.col("_won") - F.col("keep_won")
    drop_known = F.col("_known") - F.col("keep_known")
    keep_win = F.when(F.col("keep_known") > 0, F.col("keep_won") / F.col("keep_known"))
    return (kept.join(base, list(keys)).filter((n >= min_keep) & (drop_n > 0)).select(
        *keys, "feature", "q", "threshold", F.signum("d").cast("int").alias("direction"),
        n.alias("keep_n"), keep_win.alias("keep_win"),
        (keep_win - breakeven_price(F.col("keep_ask") / n)).alias("keep_ev"),
        drop_n.alias("drop_n"), F.when(drop_known > 0, killed / drop_known).alias("drop_win"),
        killed.alias("killed"), _share(killed, F.col("_known")).alias("killed_rate"),
        _share(killed, F.col("_won")).alias("killed_of_winners")))


def hard_negative_profile(val: DataFrame, keys: Sequence[str], features: Sequence[str], *,
                          min_score: int = 2, min_rows: int = 50) -> DataFrame:
    """Losers with a high score: how many, their share of losers, medians against winners."""
    hard = ~F.col("win_label") & (F.col("score") >= min_score)
    tagged = val.withColumn("_hard", F.coalesce(hard, F.lit(False)))
    base = tagged.groupBy(*keys).agg(F.count_if("_hard").alias("n_hard"),
                                     F.count_if(~F.col("win_label")).alias("_neg"))
    long = unpivot_features(tagged.filter(F.col("_hard") | F.col("win_label")), features, [*keys, "_hard"])
    by = [*keys, "feature"]
    medians = class_ranks(long, by, "value", F.col("_hard")).groupBy(*by).agg(
        F.max("pos_total").alias("n_values"), median_of("value", "pos").alias("median_hard"),
        median_of("value", "neg").alias("median_winner"))
    return (medians.filter(F.col("n_values") >= min_rows).join(base, list(keys))
            .select(*by, "n_hard", _share(F.col("n_hard"), F.col("_neg")).alias("share_of_losers"),
                    "n_values", "median_hard", "median_winner"))


def block_audit(df: DataFrame, keys: Sequence[str], blocks: Mapping[str, Column],
                min_known: int = 50) -> DataFrame:
    """Named, possibly overlapping row blocks: n, win rate, mean ask, break-even, EV."""
    won = F.col("final_outcome") == F.col("cand")
    hit = df.withColumn("block", F.explode(_matching(blocks)))
    g = hit.groupBy(*keys, "block").agg(
        F.count("final_outcome").alias("n"), F.sum(_flag(won)).alias("_w"),
        F.avg("cand_ask").alias("mean_ask"))
    enough = F.col("n") >= min_known
    rate = F.when(enough, F.col("_w") / F.col("n"))
    ask = F.when(enough, F.col("mean_ask"))
    return g.select(*keys, "block", "n", rate.alias("win_rate"), ask.alias("mean_ask"),
                    breakeven_price(ask).alias("breakeven"), (rate - breakeven_price(ask)).alias("ev"))


def threshold_grid(df: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[float]
                   ) -> DataFrame:
    """Rows below and at-or-above each cut: n, win rate, EV, share of winners lost."""
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    thin = df.groupBy(*keys, value).agg(
        F.count("*").alias("c"), F.sum(F.col("won").cast("bigint")).alias("w"),
        F.sum("cand_ask").alias("a"))
    g = (thin.withColumn("threshold", F.explode(cuts))
         .withColumn("_side", F.when(F.col(value) < F.col("threshold"), F.lit("b")).otherwise(F.lit("a")))
         .groupBy(*keys, "threshold").agg(
             *[F.sum(F.when(F.col("_side") == s, F.col(c))).alias(f"{c}_{s}")
               for s in ("b", "a") for c in ("c", "w", "a")]))
    both = F.col("c_b").isNotNull() & F.col("c_a").isNotNull()

    def ev(s: str) -> Column:
        return F.col(f"w_{s}") / F.col(f"c_{s}") - breakeven_price(F.col(f"a_{s}") / F.col(f"c_{s}"))

    return g.filter(both).select(
        *keys, "threshold", F.col("c_b").alias("below_n"), (F.col("w_b") / F.col("c_b")).alias("below_win"),
        ev("b").alias("below_ev"), F.col("c_a").alias("above_n"),
        (F.col("w_a") / F.col("c_a")).alias("above_win"), ev("a").alias("above_ev"),
        _share(F.col("w_b"), F.col("w_b") + F.col("w_a")).alias("winners_lost"))


def inclusive_quintiles(df: DataFrame, keys: Sequence[str], value: str, exclusive: bool = False,
                        parts: int = 5) -> DataFrame:
    """Fifths by [lo, hi] with both edges inclusive, so a tied edge value counts twice.

    This is the published form; ``exclusive`` gives half-open fifths whose counts add up.
    """
    ranks = stage(value_ranks(df, keys, value, {"w": F.sum(F.col("won").cast("bigint")), "a": F.sum("cand_ask")}))
    t, last = F.col("total"), parts - 1

    def at(share: float, back: int) -> Column:
        return at_position(value, F.floor(t * F.lit(share)).cast("bigint") - back)

    edges = ranks.groupBy(*keys).agg(*[at(i / parts, 0).alias(f"lo{i}") for i in range(parts)],
                                     *[at((i + 1) / parts, 0 if exclusive else 1).alias(f"hi{i}") for i in range(last)])
    # sums up to an edge stand at the edge's own row; the last fifth ends with the totals
    bounds = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("bucket"), F.lit(end).alias("_end"), F.col(f"{end}{i}").alias(value))
                       for i in range(parts) for end in ("lo", "hi") if (end, i) != ("hi", last)])
    met = ranks.join(stage(edges).select(*keys, F.inline(bounds)), [*keys, value])
    lower, names = F.col("_end") == "lo", {"n": "", "w": "w_", "a": "a_"}
    upto = {n: F.col(f"{b}below") + (F.lit(0) if exclusive else F.col(n)) for n, b in names.items()}
    g = met.groupBy(*keys, "bucket").agg(
        F.max(F.when(lower, F.col(value))).alias("lo"), F.max(F.when(~lower, F.col(value))).alias("hi"),
        *[F.max(F.when(lower, F.col(f"{b}below"))).alias(f"_from_{n}") for n, b in names.items()],
        *[F.coalesce(F.max(F.when(~lower, upto[n])), F.max(f"{b}total")).alias(f"_to_{n}") for n, b in names.items()])
    g = g.select(*keys, "bucket", "lo", "hi", *[(F.col(f"_to_{n}") - F.col(f"_from_{n}")).alias(n) for n in names]).filter(
        (F.col("n") > 0) & ((F.col("bucket") == parts) | F.col("hi").isNotNull()))
    win, ask = F.col("w") / F.col("n"), F.col("a") / F.col("n")
    return g.select(*keys, "bucket", "lo", "hi", "n", win.alias("win_rate"), ask.alias("mean_ask"),
                    (win - breakeven_price(ask)).alias("ev"))


def depth_study_rows(ticks: DataFrame, window: Sequence[str], *, time: str = "t",
                     time_scale: int = 1, seconds: tuple = STUDY_SECONDS,
                     band: tuple = STUDY_BAND) -> DataFrame:
    """Would-enter rows of the depth study: elapsed from the first tick, both asks present,
    a tie goes to Down, depth from the raw notional. Needs ``outcome`` on the ticks."""
    first = F.min(time).over(Window.partitionBy(*window))
    up = F.col("au") < F.col("ad")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    rows = ticks.withColumn("_el", (F.col(time) - first) / time_scale).filter(
        F.col("au").isNotNull() & F.col("ad").isNotNull()).select(
        *window, time, "outcome", "_el", F.when(up, F.lit("Up")).otherwise(F.lit("Down")).alias("cand"),
        pick("au", "ad").alias("cand_ask"), pick("sau", "sad").alias("_us"),
        pick("sd", "su").alias("_fs"), pick("bd", "bu").alias("_fb"))
    kept = rows.filter((F.col("_el") >= seconds[0]) & (F.col("_el") <= seconds[1])
                       & (F.col("cand_ask") > band[0]) & (F.col("cand_ask") <= band[1])
                       & (F.col("_us") > 0) & (F.col("_fs") > 0) & (F.col("_fb") > 0))
    depth = F.rint(F.col("_us") * F.col("cand_ask") / (F.col("_fs") * F.col("_fb")) * 1e10) / 1e10
    return kept.select(*window, time, "cand", "cand_ask", depth.alias("depth"),
                       (F.col("outcome") == F.col("cand")).alias("won"))


# ---------------------------------------------------------------- settlement study

# Flatness bands.
FLATNESS_BANDS = (0.0, 0.0002, 0.0005, 0.001, 0.005, 1.0)


def agreement_by_flatness(candles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of candles whose close rule agrees with the outcome, overall and per band."""
    flat = flatness()
    band = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(FLATNESS_BANDS, FLATNESS_BANDS[1:])):
        band = F.when((flat >= lo) & (flat < hi), F.lit(i)).otherwise(band)
    rules = candle_rules()
    rows = candles.withColumn("band", band).withColumns(
        {f"_{n}": _flag(c == F.col("up_won")) for n, c in rules.items()})
    aggs = [F.count("*").alias("n")] + [F.avg(F.col(f"_{n}").cast("double")).alias(f"{n}_rate") for n in rules]
    overall = rows.groupBy(*by).agg(*aggs).withColumn("band", F.lit(-1))
    banded = rows.filter(F.col("band").isNotNull()).groupBy(*by, "band").agg(*aggs)
    return overall.unionByName(banded)


def first_disagreements(candles: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return (candles.filter(candle_rules()["r_close"] != F.col("up_won"))
            .orderBy(*order).limit(n))


def outcome_crosscheck(windows: DataFrame, truth: DataFrame, keys: Sequence[str],
                       sample: int | None) -> DataFrame:
    """Stable sample of decided windows against authoritative winners; None checks them all.

    The sample is the first ``sample`` windows in hash order: the same on every run and on any
    partitioning, though not the sample another random generator would draw.
    """
    picks = windows.filter(F.col("outcome").isin("Up", "Down"))
    if sample is not None:
        mixed = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
        picks = picks.orderBy(mixed, *keys).limit(sample)
    j = picks.join(truth, list(keys), "left")
    has = F.col("found")
    agree = F.count_if(F.coalesce(has & (F.col("winner") == F.col("outcome")), F.lit(False)))
    missing = F.count_if(~F.coalesce(has, F.lit(False)))
    g = j.agg(F.count("*").alias("n"), agree.alias("agree"), missing.alias("missing"))
    matched = F.col("n") - F.col("missing")
    return g.select("n", "agree", (matched - F.col("agree")).alias("disagree"), "missing",
                    F.when(matched > 0, F.col("agree") / matched).alias("accuracy"))
