"""The composed jobs run end to end on the smallest tables and agree with the operators."""

from pyspark.sql import functions as F

from testbed import fixtures as fx
from testbed.fixtures import DAY, SCALE, WINDOW
from testbed.registry import QUERIES
import testbed.registered  # noqa: F401
from tickloom.params import parameter_set
from tickloom.plans import backtest, grid, study

SF = "/root/testdata/sf0.001"
TP = {"take_profit_price": 0.94, "stop_loss_price": 0.06}


def test_feature_study(spark):
    ticks = backtest.prepare_ticks(fx.ticks(spark, SF))
    captured = study.capture_features(ticks, fx.windows(spark, SF), TP, spot="spot", time_scale=SCALE, min_samples=3)
    want = QUERIES["W15_capture_rows"](spark, SF)
    key = lambda df: sorted(tuple(r) for r in df.select("series_key", "t", "entered").collect())
    assert key(captured) == key(want)
    orders = study.candidate_orders(captured, time_scale=SCALE)
    assert {"win_label", "ev_breakeven", "score"} <= set(orders.columns) and "entered" not in orders.columns
    out = study.profile_candidates(orders, ["relative_obi", "depth_ratio_underdog"], window_len=DAY, min_class=1,
                                   min_train=1, min_keep=1)
    assert set(out) == {"profile", "rules", "hard_negatives"}
    assert out["profile"].count() > 0 and out["rules"].count() > 0


def test_backtest_report_and_grid(spark):
    raw, windows = fx.ticks(spark, SF), fx.windows(spark, SF)
    results = backtest.run_backtest(raw, windows, TP, time_scale=SCALE)
    report, entries = backtest.backtest_report(results, windows)
    rows = report.collect()
    assert sum(r.windows for r in rows) == windows.filter("outcome is not null").count()
    assert sum(r.entered for r in rows) == entries.agg(F.sum("n")).first()[0]
    sets = {"loose": parameter_set(**TP), "tight": parameter_set(**TP, max_entry=0.22)}
    out = grid.marginal_report(backtest.prepare_ticks(raw), windows, sets, "loose", "tight", WINDOW,
                               series="series_key", window_len=DAY, time_scale=SCALE)
    assert {r.split_group for r in out.collect()} == {"filtered", "kept"}


def test_score_gate_uses_features(spark):
    ticks = backtest.prepare_ticks(fx.ticks(spark, SF))
    scored = backtest.with_score(ticks, spot="spot", scale=SCALE, min_samples=3)
    assert scored.filter("score is not null").count() > 0
    assert scored.count() == ticks.count()
