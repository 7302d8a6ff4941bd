"""Registered queries: aggregations and statistics (A2-A22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import fixtures as fx
from testbed.fixtures import DAY, SCALE, WINDOW, big, r6
from testbed.q_sources import SPLIT_SQL
from testbed.q_windows import (
    BOOK_COLS,
    LABEL_COLS,
    LABEL_SQL,
    REPLAY_SQL,
    SUMMARY_COLS,
    SUMMARY_SELECT,
    _delta_sql,
    _r10,
    no_vol,
    replayed,
)
from testbed.registry import register
from tickloom.operators import features, labels, studies, triggers
from tickloom.params import parameter_grid, parameter_set
from tickloom.plans import grid as grid_plan
from tickloom.plans.staging import stage

S = ["series_key"]

# ------------------------------------------------------------------ replay reports

@register("A2_run_report", f"""
with {REPLAY_SQL},
e as (select *, row_number() over (partition by series_key order by pnl, ws) - 1 as rn, count(*) over (partition by series_key) as n from res where size > 0),
q as (select series_key, {', '.join(f"max(case when rn = cast(floor(n * {q}::double) as bigint) then pnl end) as q{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))} from e group by 1),
k as (select series_key, count(*) as windows, count(case when size > 0 then 1 end) as entered,
  {', '.join(f"count(case when exit_kind = '{x}' then 1 end) as {x.lower()}" for x in studies.EXIT_KINDS)}, sum(pnl) as total_pnl, sum(fee) as total_fee from res group by 1),
s as (select series_key, count(case when outcome is null then 1 end) as skipped from v_windows group by 1)
select series_key, windows, entered, {', '.join(x.lower() for x in studies.EXIT_KINDS)}, skipped,
  {', '.join(f'round({c}, 6) + 0.0::double as {c}' for c in ('total_pnl', 'total_fee', 'q05', 'q25', 'q50', 'q75', 'q95'))},
  round(settle_win / nullif(settle_win + settle_lose, 0), 6) as settled_win_rate, round((settle_win + take_profit) / nullif(entered, 0), 6) as nominal_win_rate
from k join s using (series_key) left join q using (series_key)
""")
def a2(spark, sf):
    rep = studies.run_report(stage(replayed(spark, sf)), fx.windows(spark, sf), S)
    floats = ("total_pnl", "total_fee", "q05", "q25", "q50", "q75", "q95", "settled_win_rate", "nominal_win_rate")
    return rep.select("series_key", "windows", "entered", *[x.lower() for x in studies.EXIT_KINDS], "skipped",
                      *[r6(c).alias(c) for c in floats])


@register("A2_entry_distribution", f"""
with {REPLAY_SQL} select series_key, cand, cast(round(entry_ask * 100) as bigint) as price_c, count(*) as n from res where size > 0 group by 1, 2, 3
""")
def a2_dist(spark, sf):
    return studies.entry_distribution(replayed(spark, sf), S)


def param_replay_sql(rows: str, score: str = "null::integer") -> str:
    """Replay over a parameter table (param_id, ea, eu, mn, mx, tp, mult, sl, ms, md)."""
    return f"""
prm as (select param_id, ea, eu, mn::double as mn, mx::double as mx, tp::double as tp, mult::double as mult, sl::double as sl, ms::integer as ms, md::double as md
  from (values {rows}) t(param_id, ea, eu, mn, mx, tp, mult, sl, ms, md)),
ptk as (select v.*, w.outcome, {score} as score, case when cand_ask is not null and cand_ask_size > 0 and fav_bid > 0 and fav_bid_size > 0
    then round_even(cand_ask * cand_ask_size / (fav_bid * fav_bid_size), 10) end as depth from v_clean v join v_windows w using (series_key, ws) where w.outcome in ('Up', 'Down')),
pent0 as (select param_id, ptk.*, prm.tp, prm.mult, prm.sl, greatest(cast(ceil(round(200.0::double / round(cand_ask * 100), 9)) as bigint), 5) as size,
    row_number() over (partition by param_id, series_key, ws order by t) as rn
  from ptk, prm where elapsed between ea * 288 and eu * 288 and cand_ask < mx and cand_ask > mn
    and (ms is null or (score is not null and score >= ms)) and (md is null or (depth is not null and depth >= md))),
pent as (select *, cand_ask_size >= size as depth_ok from pent0 where rn = 1),
pex as (select param_id, series_key, ws, exit_t, bid as exit_bid, kind from (select *, row_number() over (partition by param_id, series_key, ws order by exit_t) as rk from (
    select e.param_id, e.series_key, e.ws, k.t as exit_t, case when e.cand = 'Up' then k.bu else k.bd end as bid,
      case when case when e.cand = 'Up' then k.bu else k.bd end >= case when e.mult is not null then least(round_even(e.cand_ask * e.mult, 10), 0.99::double) else e.tp end then 'TAKE_PROFIT'
           when e.sl > 0 and case when e.cand = 'Up' then k.bu else k.bd end <= e.sl then 'STOP_LOSS' end as kind
    from pent e join v_clean k using (series_key, ws) where e.depth_ok and k.t > e.t and case when e.cand = 'Up' then k.su else k.sd end >= e.size) a where kind is not null) b where rk = 1),
pall as (select w.series_key, w.ws, w.outcome, prm.param_id from v_windows w, prm where w.outcome in ('Up', 'Down')),
pfee as (select a.*, e.t as entry_t, e.cand, e.cand_ask as entry_ask, e.size as want, e.depth_ok, x.exit_t, x.exit_bid, x.kind,
    e.size * 0.07::double * e.cand_ask * (1 - e.cand_ask) as f1, e.size * 0.07::double * x.exit_bid * (1 - x.exit_bid) as f2
  from pall a left join pent e using (param_id, series_key, ws) left join pex x using (param_id, series_key, ws)),
pres as (select param_id, series_key, ws, outcome, entry_ask, case when depth_ok then want else 0 end as size,
    case when entry_t is null then 'NO_ENTRY' when not depth_ok then 'NO_ENTRY_DEPTH' when kind is not null then kind when outcome = cand then 'SETTLE_WIN' else 'SETTLE_LOSE' end as exit_kind,
    case when entry_t is null or not depth_ok then 0.0::double when kind is not null then want * exit_bid - f2 - want * entry_ask - f1
         when outcome = cand then want - want * entry_ask - f1 else -(want * entry_ask + f1) end as pnl,
    case when entry_t is null or not depth_ok then 0.0::double when kind is not null then f1 + f2 else f1 end as fee from pfee)"""


SWEEP = {
    "baseline": parameter_set(take_profit_price=0.94),
    "tp045": parameter_set(take_profit_price=0.45),
    "tp055": parameter_set(take_profit_price=0.55),
    "tp075": parameter_set(take_profit_price=0.75),
    "band15_25": parameter_set(take_profit_price=0.94, max_entry=0.25),
    "band20_30": parameter_set(take_profit_price=0.94, min_entry=0.20),
    "wide_window": parameter_set(take_profit_price=0.94, entry_after=60, entry_until=180),
    "short_window": parameter_set(take_profit_price=0.94, entry_until=100),
}


def _param_rows(sets) -> str:
    def lit(v):
        return "null" if v is None else str(v)
    return ", ".join(
        f"('{pid}', {p['entry_after']}, {p['entry_until']}, {p['min_entry']}, {p['max_entry']}, {p['take_profit_price']}, "
        f"{lit(p['take_profit_multiple'])}, {p['stop_loss_price']}, {lit(p['min_reversal_score'])}, {lit(p['min_depth_ratio'])})"
        for pid, p in sets.items())


MARGINAL = {"loose": parameter_set(take_profit_price=0.94, stop_loss_price=0.06),
            "tight": parameter_set(take_profit_price=0.94, stop_loss_price=0.06, max_entry=0.22)}


@register("J8_marginal_split", f"""
with {param_replay_sql(_param_rows(MARGINAL))},
tight as (select series_key, ws from pres where param_id = 'tight' and size > 0),
tagged as (select case when param_id = 'tight' then 'kept' else 'filtered' end as split_group, pres.* from pres
  where size > 0 and (param_id = 'tight' or (series_key, ws) not in (select (series_key, ws) from tight)))
select split_group, series_key, {SUMMARY_SELECT} from tagged group by 1, 2
""")
def j8(spark, sf):
    results = triggers.replay(no_vol(fx.clean(spark, sf)), fx.windows(spark, sf), MARGINAL, WINDOW, time_scale=SCALE)
    split = studies.run_summary(triggers.marginal_split(results, "loose", "tight", WINDOW), ["split_group", "series_key"])
    return split.select("split_group", "series_key", "n", *[r6(c).alias(c) for c in SUMMARY_COLS])


@register("A3_param_sweep", f"with {param_replay_sql(_param_rows(SWEEP))} select param_id, series_key, {SUMMARY_SELECT} from pres group by 1, 2")
def a3(spark, sf):
    out = grid_plan.param_sweep(no_vol(fx.clean(spark, sf)), fx.windows(spark, sf), SWEEP, WINDOW,
                                series="series_key", time_scale=SCALE)
    return out.select("param_id", "series_key", "n", *[r6(c).alias(c) for c in SUMMARY_COLS])


GRID = parameter_grid({"min_reversal_score": [None, 1, 2], "take_profit_multiple": [None, 1.5, 2.0, 2.5, 3.0]},
                      take_profit_price=0.99, min_entry=0.20, max_entry=0.30, entry_until=100)
SCORE_SQL = "case when event_id % 5 = 0 then null else cast(event_id % 7 - 2 as integer) end"


@register("A4_param_grid", f"""
with {param_replay_sql(_param_rows(GRID), SCORE_SQL)},
ppos as (select *, row_number() over (partition by param_id, series_key order by ws) as position, count(*) over (partition by param_id, series_key) as nw from pres),
st as (select param_id, series_key, case when position <= cast(floor(nw * 0.7::double) as bigint) then 'train' else 'val' end as split,
    count(case when size > 0 then 1 end) as n, round(coalesce(avg(case when size > 0 then pnl end), 0), 4) as pnl_per from ppos group by 1, 2, 3),
tot as (select param_id, sum(case when split = 'train' then n end)::bigint as train_n, sum(case when split = 'val' then n end)::bigint as val_n,
    round(sum(case when split = 'val' then pnl_per end), 6) + 0.0::double as val_per from st group by 1)
select * from (select row_number() over (order by val_per desc, param_id) as place, * from tot) x where place <= 15
""")
def a4(spark, sf):
    ticks = no_vol(fx.clean(spark, sf)).withColumn("score", F.expr(SCORE_SQL))
    top = grid_plan.param_grid_ranking(ticks, fx.windows(spark, sf), GRID, WINDOW, series="series_key",
                                       window_len=DAY, time_scale=SCALE, score="score", top=15)
    return top.select("place", "param_id", "train_n", "val_n", r6("val_per").alias("val_per"))


# ------------------------------------------------------------------ the study table

FEATS = ["relative_obi", "depth_ratio_underdog", "ud_ask_delta_30", "ud_mid_delta_60", "fav_mid_delta_30", "cand_ask"]
STUDY_SQL = f"""
base as (select * from v_clean), {_delta_sql()}, {LABEL_SQL},
st0 as (select *, {_r10('(su - sau) / (su + sau)::double')} as obi_up, {_r10('(sd - sad) / (sd + sad)::double')} as obi_down,
  case when cand_ask is not null and cand_ask_size > 0 and fav_bid > 0 and fav_bid_size > 0
    then {_r10('cand_ask * cand_ask_size / (fav_bid * fav_bid_size)')} end as depth_ratio_underdog from deltas),
study as (select st0.*, {_r10("case when st0.cand = 'Up' then obi_up - obi_down else obi_down - obi_up end")} as relative_obi,
    lab.final_outcome, {', '.join('lab.' + c for c in LABEL_COLS)}, st0.event_id % 3 = 0 as entered,
    cast(st0.event_id % 7 - 2 as integer) as score
  from st0 join lab on lab.series_key = st0.series_key and lab.t = st0.t where st0.cand_ask is not null)"""
ORDERS_SQL = f"""
{STUDY_SQL},
orders_ as (select *, coalesce(final_outcome = cand, false) as win_label from study where elapsed between 25920 and 43200 and cand_ask > 0.1 and cand_ask <= 0.45)"""
BAND = (0.10, 0.45)


def study(spark, sf):
    """The study table, staged once because the statistics read it several times."""
    return stage(study_rows(spark, sf))


def study_rows(spark, sf):
    live = triggers.ticks_with_outcome(fx.clean(spark, sf), fx.windows(spark, sf), WINDOW)
    df = features.book_delta_features(features.book_features(live), WINDOW, scale=SCALE)
    df = labels.label_columns(df, WINDOW, scale=SCALE).filter("cand_ask is not null")
    return df.withColumns({"entered": F.col("event_id") % 3 == 0,
                           "score": (F.col("event_id") % 7 - 2).cast("int")})


def candidate_orders(spark, sf):
    return stage(studies.would_enter(study_rows(spark, sf), time_scale=SCALE, band=BAND))


def long_sql(source: str, cols, keep: str) -> str:
    return " union all ".join(
        f"select {keep}, '{c}' as feature, cast({c} as double) as value from {source} where {c} is not null" for c in cols)


BUCKET_KEEP = "series_key, t, cand, final_outcome, entered, " + ", ".join(LABEL_COLS)
BUCKET_SQL = f"""
{STUDY_SQL}, lg as ({long_sql('study', FEATS, BUCKET_KEEP)}),
rk as (select *, row_number() over (partition by series_key, feature order by value, t) as rn, count(*) over (partition by series_key, feature) as k from lg),
bk as (select series_key, feature, cast(ceil(5.0::double * rn / k) as bigint) as bucket, count(*) as n, min(value) as low, max(value) as high,
    count(case when entered then 1 end) / count(*) as entry_rate, count(case when final_outcome = cand then 1 end) / count(*) as win_rate,
    {', '.join(f'avg({c}) as {c}' for c in LABEL_COLS)}, count(*) < 384 as small from rk where k >= 5 group by 1, 2, 3)"""


def buckets(spark, sf):
    keep = ["series_key", "t", "cand", "final_outcome", "entered", *LABEL_COLS]
    long = studies.unpivot_features(study(spark, sf), FEATS, keep)
    return studies.equal_frequency_buckets(long, ["series_key", "feature"], ["t"], F.floor(F.col("t") / DAY))


@register("A5_equal_frequency_buckets", f"""
with {BUCKET_SQL} select series_key, feature, bucket, n, small, {', '.join(f'round({c}, 6) + 0.0::double as {c}' for c in ('low', 'high', 'entry_rate', 'win_rate', *LABEL_COLS))} from bk
""")
def a5(spark, sf):
    return buckets(spark, sf).select(
        "series_key", "feature", "bucket", "n", "small",
        *[r6(c).alias(c) for c in ("low", "high", "entry_rate", "win_rate", *LABEL_COLS)])


@register("A5_null_counts", f"""
with {STUDY_SQL} {' union all '.join(f"select series_key, '{c}' as feature, count(case when {c} is null then 1 end) as n_null from study group by 1" for c in FEATS)}
""")
def a5_nulls(spark, sf):
    return studies.null_counts(study_rows(spark, sf), S, FEATS)


@register("A6_monotonicity_rho", f"""
with {BUCKET_SQL},
r as (select *, row_number() over (partition by series_key, feature order by coalesce(round(future_return_60, 9), 0), bucket) as rk, row_number() over (partition by series_key, feature order by bucket) as i from bk)
select series_key, feature, round(1 - 6.0 * sum((i - rk) * (i - rk)) / (count(*) * (count(*) * count(*) - 1)), 6) + 0.0::double as rho from r group by 1, 2
""")
def a6(spark, sf):
    b = buckets(spark, sf).withColumn("future_return_60", F.round("future_return_60", 9))
    return studies.monotonicity_rho(b, ["series_key", "feature"]).select(
        "series_key", "feature", r6("rho").alias("rho"))


def _edge(c, i):
    return f"max(case when rn_{c} = least(cast(floor({i} * k / 5.0::double) as bigint), k - 1) then {c} end) as {c}_{i}"


def _slot(c):
    return "case " + " ".join(f"when b.{c} >= e.{c}_{i} then {i}" for i in (4, 3, 2, 1)) + " else 0 end"


X, Y = "ud_ask_delta_30", "relative_obi"


@register("A7_crosstab_2d", f"""
with {STUDY_SQL}, b as (select series_key, cand, final_outcome, future_return_60, {X}, {Y} from study where {X} is not null and {Y} is not null),
n as (select *, row_number() over (partition by series_key order by {X}) - 1 as rn_{X}, row_number() over (partition by series_key order by {Y}) - 1 as rn_{Y},
    count(*) over (partition by series_key) as k from b),
e as (select series_key, {', '.join(_edge(c, i) for c in (X, Y) for i in range(5))} from n group by 1)
select b.series_key, cast({_slot(X)} as bigint) as x_bucket, cast({_slot(Y)} as bigint) as y_bucket, count(*) as n,
  round(count(case when final_outcome = cand then 1 end) / count(*), 6) as win_rate, round(avg(future_return_60), 6) + 0.0::double as ret60, count(*) < 384 as small
from b join e using (series_key) group by 1, 2, 3
""")
def a7(spark, sf):
    out = studies.crosstab_2d(study(spark, sf), S, X, Y, ["t"])
    return out.select("series_key", "x_bucket", "y_bucket", "n", r6("win_rate").alias("win_rate"),
                      r6("ret60").alias("ret60"), "small")


CONDITIONS = {
    "all": "true", "drop": "ud_ask_delta_30 < -0.08", "deep_drop": "ud_ask_delta_30 < -0.15",
    "bid_pressure": "relative_obi > 0.53", "deep_book": "depth_ratio_underdog > 0.45",
    "thin_book": "depth_ratio_underdog < 0.27",
    "three_way": "ud_ask_delta_30 < -0.08 and relative_obi > 0.53 and depth_ratio_underdog > 0.45",
    "never": "relative_obi > 3",
}


@register("A8_condition_stats", f"""
with {STUDY_SQL}, h as ({' union all '.join(f"select series_key, '{n}' as condition, cand, final_outcome, entered, future_return_60, mfe_60, mae_60, coalesce({c.replace('0.08', '0.08::double').replace('0.15', '0.15::double').replace('0.53', '0.53::double').replace('0.45', '0.45::double').replace('0.27', '0.27::double')}, false) as hit from study" for n, c in CONDITIONS.items())})
select series_key, condition, count(case when hit then 1 end) as n,
  round(count(case when hit and entered then 1 end) / nullif(count(case when hit then 1 end), 0), 6) as entry_rate,
  round(count(case when hit and final_outcome = cand then 1 end) / nullif(count(case when hit then 1 end), 0), 6) as win_rate,
  round(avg(case when hit then future_return_60 end), 6) + 0.0::double as ret60, round(avg(case when hit then mfe_60 end), 6) + 0.0::double as mfe60,
  round(avg(case when hit then mae_60 end), 6) + 0.0::double as mae60, count(case when hit then 1 end) < 384 as small
from h group by 1, 2
""")
def a8(spark, sf):
    out = studies.condition_stats(study_rows(spark, sf), S, CONDITIONS)
    return out.select("series_key", "condition", "n", "small",
                      *[r6(c).alias(c) for c in ("entry_rate", "win_rate", "ret60", "mfe60", "mae60")])


# ------------------------------------------------------------------ separation of classes

CLASS_SQL = """
cls as (select d.doc_id, d.lang, l.quality = 1 as good, d.n_chars, length(d.text) as n_text, len(string_split(d.text, ' ')) as n_words, l.toxic
  from documents d join labels l using (doc_id))"""
CLASS_FEATS = ["n_chars", "n_text", "n_words", "toxic"]


def classes(spark, sf):
    d = fx.table(spark, sf, "documents").select(
        "doc_id", "lang", "n_chars", F.length("text").alias("n_text"),
        F.size(F.split("text", " ")).alias("n_words"))
    lab = fx.table(spark, sf, "labels")
    return d.join(lab, "doc_id").withColumn("good", F.col("quality") == 1).withColumn("all", F.lit("all"))


PROFILE_SQL = f"""
{CLASS_SQL}, lg as ({long_sql('cls', CLASS_FEATS, 'good')}),
rk as (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0::double as avg_rank from lg),
ag as (select feature, count(case when good then 1 end) as n_pos, count(case when not good then 1 end) as n_neg,
    (sum(case when good then avg_rank end) - count(case when good then 1 end) * (count(case when good then 1 end) + 1) / 2.0::double)
      / (count(case when good then 1 end)::double * count(case when not good then 1 end)) as auc,
    median(case when good then value end) as median_pos, median(case when not good then value end) as median_neg,
    case when sqrt((var_samp(case when good then value end) + var_samp(case when not good then value end)) / 2) > 0
      then (avg(case when good then value end) - avg(case when not good then value end)) / sqrt((var_samp(case when good then value end) + var_samp(case when not good then value end)) / 2) else 0.0 end as d
  from rk group by feature)"""


@register("A9_cohens_d", f"with {PROFILE_SQL} select feature, round(d, 6) + 0.0::double as d from ag")
def a9(spark, sf):
    long = studies.unpivot_features(classes(spark, sf), CLASS_FEATS, ["good"])
    return long.groupBy("feature").agg(r6(studies.cohens_d(F.col("value"), F.col("good"))).alias("d"))


@register("A10_auc_mann_whitney", f"with {PROFILE_SQL} select feature, n_pos, n_neg, round(auc, 6) as auc from ag")
def a10(spark, sf):
    long = studies.unpivot_features(classes(spark, sf), CLASS_FEATS, ["good"])
    ranks = studies.class_ranks(long, ["feature"], "value", F.col("good"))
    return studies.auc_mann_whitney(ranks, ["feature"]).select("feature", "n_pos", "n_neg", r6("auc").alias("auc"))


@register("A11_group_median", """
select series_key, round(median(spot), 6) as median_spot, count(*) as total from v_ticks group by 1
""")
def a11(spark, sf):
    ranks = studies.value_ranks(fx.ticks(spark, sf), S, "spot")
    return studies.median(ranks, S, "spot", "m").select("series_key", r6("m").alias("median_spot"), "total")


@register("A12_separation_profile", f"""
with {PROFILE_SQL} select feature, n_pos, n_neg, round(median_pos, 6) as median_pos, round(median_neg, 6) as median_neg, round(d, 6) + 0.0::double as d, round(auc, 6) as auc
from ag where n_pos >= 30 and n_neg >= 30 order by abs(round(auc, 9) - 0.5) desc, feature limit 20
""")
def a12(spark, sf):
    prof = studies.separation_profile(classes(spark, sf), ["all"], CLASS_FEATS, "good", min_class=30)
    top = studies.rank_top(prof, F.abs(F.round("auc", 9) - 0.5), 20, ["feature"])
    return top.select("feature", "n_pos", "n_neg", *[r6(c).alias(c) for c in ("median_pos", "median_neg", "d", "auc")])


CUT_SQL = """
dw as (select distinct series_key, ws from orders_),
dn as (select *, row_number() over (partition by series_key order by ws) - 1 as i, count(*) over (partition by series_key) as nw from dw),
cut as (select series_key, nw as n_windows, max(case when i = cast(floor(nw * 0.7::double) as bigint) then ws end) as cut from dn group by 1, 2),
osp as (select o.*, case when o.ws < c.cut then 'train' else 'val' end as split from orders_ o join cut c using (series_key))"""


@register("A13_walk_forward_split", f"""
with {ORDERS_SQL}, {CUT_SQL} select series_key, split, count(*) as n, min(ws) as first_ws, max(ws) as last_ws from osp group by 1, 2
""")
def a13(spark, sf):
    sp = studies.walk_forward_split(candidate_orders(spark, sf), S, "ws", DAY)
    return sp.groupBy("series_key", "split").agg(
        F.count("*").alias("n"), F.min("ws").alias("first_ws"), F.max("ws").alias("last_ws"))


def run_windows(spark, sf):
    """The windows a replay decides, without replaying."""
    ticks, windows = fx.clean(spark, sf), fx.windows(spark, sf).filter(F.col("outcome").isin("Up", "Down"))
    return windows.select(*WINDOW).join(ticks.select(*WINDOW).distinct(), WINDOW, "left_semi")


@register("A13_position_split", f"with {REPLAY_SQL}, {SPLIT_SQL} select series_key, split, count(*) as n, max(ws) as last_ws from sp group by 1, 2")
def a13_position(spark, sf):
    sp = studies.position_split(replayed(spark, sf), S, "ws", DAY, windows=run_windows(spark, sf))
    return sp.groupBy("series_key", "split").agg(F.count("*").alias("n"), F.max("ws").alias("last_ws"))


MIN = 10  # class and row minimum of the small test tables


def _effect_sql(source: str) -> str:
    return f"""
lgd as ({long_sql(source, FEATS, 'series_key, win_label')}),
eff as (select series_key, feature, case when sqrt((var_samp(case when win_label then value end) + var_samp(case when not win_label then value end)) / 2) > 0 then
    (avg(case when win_label then value end) - avg(case when not win_label then value end)) / sqrt((var_samp(case when win_label then value end) + var_samp(case when not win_label then value end)) / 2) else 0.0 end as d
  from lgd group by 1, 2 having count(case when win_label then 1 end) >= {MIN} and count(case when not win_label then 1 end) >= {MIN})"""


def _threshold_sql(source: str) -> str:
    return f"""
lgt as ({long_sql(source, FEATS, 'series_key')}),
rkt as (select *, row_number() over (partition by series_key, feature order by value) - 1 as rn, count(*) over (partition by series_key, feature) as k from lgt),
qs as (select unnest([0.25::double, 0.5::double, 0.75::double]) as q),
thr as (select series_key, feature, q, max(value) as threshold from rkt, qs where k >= {MIN} and rn = cast(floor(k * q) as bigint) group by 1, 2, 3),
rules as (select thr.*, eff.d from thr join eff using (series_key, feature))"""


@register("A14_rule_threshold_sweep", f"""
with {ORDERS_SQL}, {CUT_SQL}, tr as (select * from osp where split = 'train'), va as (select * from osp where split = 'val'),
{_effect_sql('va')}, {_threshold_sql('tr')}, lgv as ({long_sql('va', FEATS, 'series_key, win_label, cand_ask as ask')}),
kp as (select r.series_key, r.feature, r.q, r.threshold, r.d, count(*) as n, count(case when win_label then 1 end) as w, avg(ask) as a
  from rules r join lgv v using (series_key, feature) where case when d > 0 then value >= threshold else value <= threshold end group by 1, 2, 3, 4, 5),
bs as (select series_key, count(case when win_label then 1 end) as pos, count(case when not win_label then 1 end) as neg from va group by 1)
select series_key, feature, q, round(threshold, 6) + 0.0::double as threshold, n, round(w / n, 6) as win_rate, round(w / n - a - 0.07::double * a * (1 - a), 6) + 0.0::double as ev,
  round(case when pos > 0 then w / pos else 0 end, 6) as recall, round(1 - (n - w) / nullif(neg, 0), 6) as fp_cut
from kp join bs using (series_key) where n >= {MIN}
""")
def a14(spark, sf):
    sp = stage(studies.walk_forward_split(candidate_orders(spark, sf), S, "ws", DAY))
    train, val = sp.filter("split = 'train'"), sp.filter("split = 'val'")
    prof = stage(studies.separation_profile(val, S, FEATS, "win_label", min_class=MIN))
    out = studies.rule_threshold_sweep(train, val, S, prof, FEATS, min_train=MIN, min_keep=MIN)
    return out.select("series_key", "feature", "q", r6("threshold").alias("threshold"), "n",
                      *[r6(c).alias(c) for c in ("win_rate", "ev", "recall", "fp_cut")])


@register("A15_filter_tradeoff", f"""
with {ORDERS_SQL}, {_effect_sql('orders_')}, {_threshold_sql('orders_')},
lgv as ({long_sql('orders_', FEATS, 'series_key, win_label, final_outcome, cand_ask as ask')}),
kp as (select r.series_key, r.feature, r.q, r.threshold, r.d, count(*) as n, count(case when win_label then 1 end) as w, count(final_outcome) as kn, avg(ask) as a
  from rules r join lgv v using (series_key, feature) where case when d > 0 then value >= threshold else value <= threshold end group by 1, 2, 3, 4, 5),
bs as (select series_key, count(*) as nn, count(case when win_label then 1 end) as won, count(final_outcome) as known from orders_ group by 1)
select series_key, feature, q, round(threshold, 6) + 0.0::double as threshold, n as keep_n, round(w / kn, 6) as keep_win,
  round(w / kn - a - 0.07::double * a * (1 - a), 6) + 0.0::double as keep_ev, nn - n as drop_n, round((won - w) / nullif(known - kn, 0), 6) as drop_win,
  won - w as killed, round((won - w) / known, 6) as killed_rate, round(case when won > 0 then (won - w) / won else 0 end, 6) as killed_of_winners
from kp join bs using (series_key) where n >= {MIN} and nn - n > 0
""")
def a15(spark, sf):
    rows = candidate_orders(spark, sf)
    prof = stage(studies.separation_profile(rows, S, FEATS, "win_label", min_class=MIN))
    out = studies.filter_tradeoff(rows, S, prof, FEATS, min_rows=MIN, min_keep=MIN)
    return out.select("series_key", "feature", "q", r6("threshold").alias("threshold"), "keep_n", "drop_n", "killed",
                      *[r6(c).alias(c) for c in ("keep_win", "keep_ev", "drop_win", "killed_rate", "killed_of_winners")])


@register("A16_hard_negative_profile", f"""
with {ORDERS_SQL}, {CUT_SQL}, va as (select *, not win_label and score >= 2 as hard from osp where split = 'val'),
bs as (select series_key, count(case when hard then 1 end) as n_hard, count(case when not win_label then 1 end) as neg from va group by 1),
lgv as ({long_sql('va', FEATS, 'series_key, win_label, hard')})
select series_key, feature, max(n_hard) as n_hard, round(max(n_hard) / max(neg), 6) as share_of_losers, count(case when hard then 1 end) as n_values,
  round(median(case when hard then value end), 6) + 0.0::double as median_hard, round(median(case when win_label then value end), 6) + 0.0::double as median_winner
from lgv join bs using (series_key) group by 1, 2 having count(case when hard then 1 end) >= 3
""")
def a16(spark, sf):
    val = stage(studies.walk_forward_split(candidate_orders(spark, sf), S, "ws", DAY).filter("split = 'val'"))
    out = studies.hard_negative_profile(val, S, FEATS, min_rows=3)
    return out.select("series_key", "feature", "n_hard", "n_values",
                      *[r6(c).alias(c) for c in ("share_of_losers", "median_hard", "median_winner")])


def _blocks():
    s, ask = F.col("elapsed") / SCALE, F.col("cand_ask")
    inside = (s >= 90) & (s <= 150)
    band = (ask > 0.2) & (ask <= 0.3)
    return {"cold": inside & (ask > 0.1) & (ask <= 0.15), "low": inside & (ask > 0.15) & (ask <= 0.2),
            "high": inside & (ask > 0.3) & (ask <= 0.4), "early": (s >= 40) & (s < 90) & band,
            "late": (s > 150) & band, "cheap": ask <= 0.2, "before": s < 90}


_BLOCK_SQL = {"cold": "elapsed between 25920 and 43200 and cand_ask > 0.1 and cand_ask <= 0.15",
              "low": "elapsed between 25920 and 43200 and cand_ask > 0.15 and cand_ask <= 0.2",
              "high": "elapsed between 25920 and 43200 and cand_ask > 0.3 and cand_ask <= 0.4",
              "early": "elapsed >= 40 * 288 and elapsed < 90 * 288 and cand_ask > 0.2 and cand_ask <= 0.3",
              "late": "elapsed > 43200 and cand_ask > 0.2 and cand_ask <= 0.3",
              "cheap": "cand_ask <= 0.2", "before": "elapsed < 25920"}


@register("A17_block_audit", f"""
with {STUDY_SQL}, h as ({' union all '.join(f"select series_key, '{n}' as block, cand, final_outcome, cand_ask from study where {c}" for n, c in _BLOCK_SQL.items())}),
g as (select series_key, block, count(final_outcome) as n, count(case when final_outcome = cand then 1 end) as w, avg(cand_ask) as a from h group by 1, 2)
select series_key, block, n, round(case when n >= 50 then w / n end, 6) as win_rate, round(case when n >= 50 then a end, 6) as mean_ask,
  round(case when n >= 50 then a + 0.07::double * a * (1 - a) end, 6) as breakeven, round(case when n >= 50 then w / n - a - 0.07::double * a * (1 - a) end, 6) + 0.0::double as ev from g
""")
def a17(spark, sf):
    out = studies.block_audit(study_rows(spark, sf), S, _blocks())
    return out.select("series_key", "block", "n",
                      *[r6(c).alias(c) for c in ("win_rate", "mean_ask", "breakeven", "ev")])


DEPTH_SQL = """
dr as (select series_key, ws, t, cand_ask, outcome = cand as won, round_even(us * cand_ask / (fs * fb), 10) as depth from (
  select series_key, ws, t, outcome, case when au < ad then 'Up' else 'Down' end as cand, case when au < ad then au else ad end as cand_ask,
    case when au < ad then sau else sad end as us, case when au < ad then sd else su end as fs, case when au < ad then bd else bu end as fb, t - t0 as el
  from (select v.*, w.outcome, min(t) over (partition by v.series_key, v.ws) as t0 from v_clean v join v_windows w using (series_key, ws) where w.outcome in ('Up', 'Down')) a
  where au is not null and ad is not null) b
  where el between 25920 and 43200 and cand_ask > 0.1 and cand_ask <= 0.45 and us > 0 and fs > 0 and fb > 0)"""


def depth_rows(spark, sf):
    live = triggers.ticks_with_outcome(fx.clean(spark, sf), fx.windows(spark, sf), WINDOW)
    return studies.depth_study_rows(live, WINDOW, time_scale=SCALE, band=BAND)


THRESHOLDS = (0.20, 0.23, 0.27, 0.31, 0.35, 0.40)


@register("A18_threshold_grid", f"""
with {DEPTH_SQL}, th as (select unnest([{', '.join(f'{t}::double' for t in THRESHOLDS)}]) as threshold),
g as (select series_key, threshold, count(case when depth < threshold then 1 end) as nb, count(case when depth < threshold and won then 1 end) as wb, avg(case when depth < threshold then cand_ask end) as ab,
   count(case when depth >= threshold then 1 end) as na, count(case when depth >= threshold and won then 1 end) as wa, avg(case when depth >= threshold then cand_ask end) as aa from dr, th group by 1, 2)
select series_key, threshold, nb as below_n, round(wb / nb, 6) as below_win, round(wb / nb - ab - 0.07::double * ab * (1 - ab), 6) + 0.0::double as below_ev, na as above_n, round(wa / na, 6) as above_win,
  round(wa / na - aa - 0.07::double * aa * (1 - aa), 6) + 0.0::double as above_ev, round(case when wa + wb > 0 then wb / (wa + wb) else 0 end, 6) as winners_lost
from g where nb > 0 and na > 0
""")
def a18(spark, sf):
    out = studies.threshold_grid(depth_rows(spark, sf), S, "depth", THRESHOLDS)
    return out.select("series_key", "threshold", "below_n", "above_n",
                      *[r6(c).alias(c) for c in ("below_win", "below_ev", "above_win", "above_ev", "winners_lost")])


def _quintile_sql(exclusive: bool) -> str:
    off = 0 if exclusive else 1
    op = "<" if exclusive else "<="
    return f"""
with {DEPTH_SQL}, nn as (select *, row_number() over (partition by series_key order by depth) - 1 as rn, count(*) over (partition by series_key) as k from dr),
i5 as (select unnest([0, 1, 2, 3, 4]) as i),
ed as (select series_key, i, max(case when rn = cast(floor(k * (i / 5.0::double)) as bigint) then depth end) as lo, case when i < 4 then max(case when rn = cast(floor(k * ((i + 1) / 5.0::double)) as bigint) - {off} then depth end) end as hi from nn, i5 group by 1, 2)
select ed.series_key, cast(i + 1 as bigint) as bucket, round(lo, 6) as lo, round(hi, 6) as hi, count(*) as n, round(count(case when won then 1 end) / count(*), 6) as win_rate, round(avg(cand_ask), 6) as mean_ask,
  round(count(case when won then 1 end) / count(*) - avg(cand_ask) - 0.07::double * avg(cand_ask) * (1 - avg(cand_ask)), 6) + 0.0::double as ev
from ed join dr on dr.series_key = ed.series_key and dr.depth >= lo and (hi is null or dr.depth {op} hi) group by 1, 2, 3, 4
"""


def _quintiles(spark, sf, exclusive):
    out = studies.inclusive_quintiles(depth_rows(spark, sf), S, "depth", exclusive=exclusive)
    return out.select("series_key", "bucket", "n", *[r6(c).alias(c) for c in ("lo", "hi", "win_rate", "mean_ask", "ev")])


@register("A18_inclusive_quintiles", _quintile_sql(False))
def a18_quintiles(spark, sf):
    return _quintiles(spark, sf, False)


@register("A18_exclusive_quintiles", _quintile_sql(True))
def a18_exclusive(spark, sf):
    return _quintiles(spark, sf, True)


@register("A20_rolling_folds_rule", f"""
with {ORDERS_SQL}, dw as (select distinct series_key, ws from orders_),
dn as (select *, row_number() over (partition by series_key order by ws) - 1 as i, count(*) over (partition by series_key) as nw from dw),
f as (select series_key, ws, least(i // greatest(1, nw // 5), 4) + 1 as fold from dn),
r as (select o.*, f.fold, coalesce(relative_obi >= 0.2, false) as hit, case when win_label then 1 - cand_ask - 0.07::double * cand_ask * (1 - cand_ask) else -(cand_ask + 0.07::double * cand_ask * (1 - cand_ask)) end as e from orders_ o join f using (series_key, ws))
select series_key, fold, count(case when hit then 1 end) as n, round(coalesce(count(case when hit and win_label then 1 end) / nullif(count(case when hit then 1 end), 0), 0), 6) as win_rate,
  round(coalesce(avg(case when hit then e end), 0), 6) + 0.0::double as ev, round(coalesce(avg(case when hit then cand_ask end), 0), 6) as ask,
  round(coalesce(count(case when hit and win_label then 1 end) / nullif(count(case when win_label then 1 end), 0), 0), 6) as recall from r group by 1, 2
""")
def a20(spark, sf):
    rows = studies.rule_folds(candidate_orders(spark, sf), S, "ws", 5, DAY)
    out = studies.rule_fold_stats(rows, S, F.col("relative_obi") >= 0.2)
    return out.select("series_key", "fold", "n", *[r6(c).alias(c) for c in ("win_rate", "ev", "ask", "recall")])


RUN_FOLD_SQL = """
rn0 as (select *, row_number() over (partition by series_key order by ws) - 1 as i, count(*) over (partition by series_key) as nw from res),
rf as (select *, case when i // greatest(1, nw // 5) < 5 then i // greatest(1, nw // 5) + 1 end as fold from rn0)"""


@register("A20_rolling_folds_run", f"with {REPLAY_SQL}, {RUN_FOLD_SQL} select series_key, fold, {SUMMARY_SELECT} from rf where fold is not null group by 1, 2")
def a20_run(spark, sf):
    rows = studies.run_folds(replayed(spark, sf), S, "ws", 5, DAY, run_windows(spark, sf)).filter("fold is not null")
    g = studies.run_summary(rows, ["series_key", "fold"])
    return g.select("series_key", "fold", "n", *[r6(c).alias(c) for c in SUMMARY_COLS])


@register("A21_significance_verdict", f"""
with {REPLAY_SQL}, {RUN_FOLD_SQL},
pf as (select series_key, count(*) as positive_folds from (select series_key, fold from rf where fold is not null and size > 0 group by 1, 2 having round(avg(pnl), 4) > 0) x group by 1),
g as (select series_key, count(case when size > 0 then 1 end) as n, round(avg(case when size > 0 then pnl end), 4) + 0.0::double as mean_pnl,
    round(stddev_pop(case when size > 0 then pnl end) / sqrt(count(case when size > 0 then 1 end)), 4) as se from res group by 1)
select g.series_key, n, mean_pnl, se, coalesce(positive_folds, 0) as positive_folds, case when n = 0 then 'no sample' when mean_pnl > se then 'above' else 'not above' end as verdict
from g left join pf using (series_key)
""")
def a21(spark, sf):
    rows = studies.run_folds(replayed(spark, sf), S, "ws", 5, DAY, run_windows(spark, sf))
    return studies.significance_verdict(rows, S)


BAND_SQL = "case when f >= 0 and f < 0.0002 then 0 when f >= 0.0002 and f < 0.0005 then 1 when f >= 0.0005 and f < 0.001 then 2 when f >= 0.001 and f < 0.005 then 3 when f >= 0.005 and f < 1 then 4 end"


@register("A22_agreement_by_flatness", f"""
with x as (select *, abs(c - o) / o as f, (c >= o) = up_won as a1, ((h + l + c) / 3 >= o) = up_won as a2, ((o + h + l + c) / 4 >= o) = up_won as a3 from v_candles),
y as (select *, {BAND_SQL} as band from x)
select -1 as band, count(*) as n, round(avg(a1::int), 6) as r_close_rate, round(avg(a2::int), 6) as r_typ_rate, round(avg(a3::int), 6) as r_ohlc_rate from y
union all select band, count(*), round(avg(a1::int), 6), round(avg(a2::int), 6), round(avg(a3::int), 6) from y where band is not null group by band
""")
def a22(spark, sf):
    out = studies.agreement_by_flatness(fx.candles(spark, sf))
    return out.select("band", "n", *[r6(f"{r}_rate").alias(f"{r}_rate") for r in ("r_close", "r_typ", "r_ohlc")])


@register("A22_first_disagreements", """
select series_key, ws, o, c, up_won from v_candles where (c >= o) <> up_won order by series_key, ws limit 10
""")
def a22_first(spark, sf):
    return studies.first_disagreements(fx.candles(spark, sf), ["series_key", "ws"]).select(
        "series_key", "ws", "o", "c", "up_won")
