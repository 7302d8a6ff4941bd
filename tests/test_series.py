"""As-of, rolling and label operators on hand-computed rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickloom.operators import asof, labels, ranks, rolling, studies


def _series(rows, points):
    return rows([("k", t, float(v) if v is not None else None) for t, v in points],
                "k string, t bigint, v double")


def _at(df, t):
    return df.filter(F.col("t") == t).first()


def test_asof_age_is_inclusive_and_nulls_are_skipped(rows):
    df = _series(rows, [(10, 5), (40, 7), (42, None), (45, None), (46, None), (50, None)])
    w = asof.ordered(["k"])
    out = df.withColumn("a", asof.asof(F.col("v"), w, 0, 5))
    assert _at(out, 42).a == 7 and _at(out, 45).a == 7
    assert _at(out, 46).a is None and _at(out, 50).a is None


def test_asof_ahead_does_not_fall_back(rows):
    df = _series(rows, [(0, 1), (28, 5), (29, None), (57, 9)])
    out = df.withColumn("a", asof.asof_ahead(F.col("v"), asof.ordered(["k"]), 30, 5))
    assert _at(out, 0).a is None
    assert _at(out, 28).a == 9


def test_count_window_is_half_open(rows):
    df = _series(rows, [(0, 1), (5, 1), (10, 1), (11, 1), (20, 1)])
    w = asof.ordered(["k"])
    out = df.withColumn("n10", rolling.rolling_count(F.col("v"), w, 10)).withColumn(
        "n100", rolling.rolling_count(F.col("v"), w, 100))
    assert _at(out, 20).n10 == 2 and _at(out, 20).n100 == 5


def test_slope_of_a_line_and_too_few_samples(rows):
    df = _series(rows, [(t, 65000 + 0.5 * t) for t in range(0, 30)])
    out = rolling.add_rolling_slopes(df, asof.ordered(["k"]), "v", "t", {"s": 15})
    assert _at(out, 1).s is None
    assert _at(out, 20).s == pytest.approx(0.5, abs=1e-9)


def test_new_extremes_and_memory(rows):
    df = _series(rows, [(0, 5), (1, 6), (2, 6), (3, 7), (4, 4), (5, 3), (6, None)])
    w = asof.ordered(["k"])
    out = df.withColumn("p", rolling.recent_values(F.col("v"), w, 10)).withColumn(
        "c", rolling.new_extreme_counts(F.col("p"))).withColumns(
        rolling.memory_extremes(F.col("v"), F.col("t"), w, 3))
    assert (_at(out, 5).c.highs, _at(out, 5).c.lows) == (2, 2)
    assert (_at(out, 0).c.highs, _at(out, 0).c.lows) == (0, 0)
    assert _at(out, 2).t_high == 1, "the earliest of tied highs counts"
    assert _at(out, 5).high == 7 and _at(out, 5).t_low == 5
    assert _at(out, 6).high is None, "no value, no trimming"


@pytest.mark.parametrize("chunk", [4, 50, 10_000])
def test_rolling_mean_is_over_rows_and_chunks_do_not_matter(rows, chunk):
    rnd = random.Random(3)
    points = [(t * rnd.randint(1, 3) + t, rnd.randint(0, 1000) / 10) for t in range(300)]
    points = sorted({t: v for t, v in points}.items())
    df = _series(rows, points)
    got = {r.t: r.m for r in rolling.rolling_mean_rows(
        df, ["k"], "t", "v", "m", rows=6, chunk=chunk).collect()}
    assert len(got) == len(points)
    for i, (t, _) in enumerate(points):
        window = [v for _, v in points[max(0, i - 5):i + 1]]
        assert got[t] == pytest.approx(sum(window) / len(window), abs=2e-6)


@pytest.mark.parametrize("max_age", [30, None])
@pytest.mark.parametrize("chunk", [3, 17, 1000])
def test_asof_join_equals_brute_force_for_any_chunk(rows, chunk, max_age):
    rnd = random.Random(7)
    left = sorted({(rnd.choice("ab"), rnd.randint(0, 200)) for _ in range(120)})
    right = sorted({(rnd.choice("ab"), rnd.randint(-40, 200)) for _ in range(25)})
    out = asof.asof_join(
        rows(left, "k string, t bigint"), rows([(k, t, t * 10) for k, t in right], "k string, rt bigint, v bigint"),
        ["k"], "t", "rt", ["v"], max_age=max_age, chunk=chunk)
    got = {(r.k, r.t): r.v for r in out.collect()}
    assert len(got) == len(left)
    for k, t in left:
        best = max((rt for rk, rt in right if rk == k and rt <= t), default=None)
        want = None if best is None or max_age is not None and t - best > max_age else best * 10
        assert got[(k, t)] == want


# making the inputs (a row per second, bars per hour) takes two of J3's shuffles and three of W9's
@pytest.mark.parametrize("name, shuffles", [("J3_asof_join", 3), ("W9_running_range", 7)])
def test_tables_are_read_and_dealt_once(spark, name, shuffles):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    steps = [line for line in plan.splitlines() if "ReusedExchange" not in line]
    assert sum("FileScan" in line for line in steps) == 2
    assert sum("Exchange hashpartitioning" in line for line in steps) == shuffles


def test_value_ranks_with_a_hot_value(rows):
    rnd = random.Random(5)
    data = [0.25] * 400 + [round(rnd.uniform(-3, 3), 3) for _ in range(600)]
    df = rows([("k", v) for v in data], "k string, v double")
    ordered = sorted(data)
    for r in ranks.value_ranks(df, ["k"], "v").collect():
        assert r.below == ordered.index(r.v) and r.n == data.count(r.v) and r.total == 1000
    med = ranks.median(ranks.value_ranks(df, ["k"], "v"), ["k"], "v", "m").first().m
    assert med == (ordered[499] + ordered[500]) / 2


def test_close_values_are_cut_into_even_ranges(spark):
    values = spark.range(1_000_000).selectExpr("1 as k", "65000 + id * 0.0005D as v", "1L as n")
    sizes = [r.c for r in ranks.even_ranges(values, ["k"], "v", "b").groupBy("b").agg(F.count("*").alias("c")).collect()]
    assert sum(sizes) == 1_000_000 and len(sizes) == ranks.WAYS and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_full_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 40)
    monkeypatch.setattr(ranks, "WAYS", 4)
    # most values close together, some far, one key small, one value in a third of the rows
    made = [(i % 9 == 0, v) for i, v in enumerate([1 + i * 1e-9 for i in range(3000)] + [10.0 ** i for i in range(-9, 9)] + [7.0] * 1500)]
    df = spark.createDataFrame([("a", p, v) for p, v in made] + [("b", True, 2.0), ("b", False, None)], "k string, p boolean, v double")
    got = {(r.k, r.v): r for r in ranks.value_ranks(df, ["k"], "v", {"pos": F.count_if("p")}).collect()}
    values = sorted({v for _, v in made})
    assert len(got) == len(values) + 1 and got["b", 2.0].total == 1
    below = pos = 0
    counts, hits = Counter(v for _, v in made), Counter(v for p, v in made if p)
    for v in values:
        r = got["a", v]
        assert (r.n, r.below, r.pos, r.pos_below, r.total) == (counts[v], below, hits[v], pos, len(made))
        below, pos = below + counts[v], pos + hits[v]
    largest = (ranks.even_ranges(df.where("v is not null").groupBy("k", "v").count(), ["k"], "v", "b")
               .groupBy("k", "b").count().agg(F.max("count")).first()[0])
    assert largest <= 40


def test_row_number_by_chunk(rows):
    ts = random.Random(1).sample(range(10_000), 500)
    df = rows([("k", t) for t in ts], "k string, t bigint")
    out = ranks.row_number_by_chunk(df, ["k"], [F.col("t")], F.floor(F.col("t") / 97), "rn")
    want = {t: i + 1 for i, t in enumerate(sorted(ts))}
    assert {r.t: r.rn for r in out.collect()} == want


def test_equal_frequency_slices_cut_ties_by_position(rows):
    """Slices [b*k//5, (b+1)*k//5) of the sorted rows, ties in tie-key order."""
    rnd = random.Random(11)
    data = [(i, 1.0 if i % 3 == 0 else round(rnd.uniform(0, 2), 1)) for i in range(103)]
    df = rows([("k", i, v, "Up" if i % 2 else "Down", "Up", i % 4 == 0, v, None, v, v, v) for i, v in data],
              "k string, t bigint, value double, cand string, final_outcome string, entered boolean, "
              "future_return_30 double, future_return_60 double, future_return_120 double, mfe_60 double, mae_60 double")
    got = {r.bucket: r for r in studies.equal_frequency_buckets(
        df, ["k"], ["t"], F.floor(F.col("t") / 10)).collect()}
    ordered = sorted(data, key=lambda x: (x[1], x[0]))
    for b in range(5):
        seg = ordered[b * 103 // 5:(b + 1) * 103 // 5]
        r = got[b + 1]
        assert (r.n, r.low, r.high) == (len(seg), seg[0][1], seg[-1][1])
        assert r.win_rate == pytest.approx(sum(i % 2 for i, _ in seg) / len(seg))
        assert r.entry_rate == pytest.approx(sum(i % 4 == 0 for i, _ in seg) / len(seg))
        assert r.future_return_60 is None and r.small


def test_labels_on_a_short_window(rows):
    base = dict(ad=0.80, bd=0.78)
    ticks = [(0, 0.21, 0.19), (30, 0.21, 0.19), (45, None, None), (60, 0.26, 0.24), (120, 0.31, 0.29)]
    df = rows([("w", t, au, bu, base["ad"], base["bd"], "Up", 0.21, "Up") for t, au, bu in ticks],
              "w string, t bigint, au double, bu double, ad double, bd double, cand string, cand_ask double, outcome string")
    r = _at(labels.label_columns(df, ["w"]), 0)
    assert r.future_return_30 == 0
    assert r.future_return_60 == pytest.approx(0.25)
    assert r.future_return_120 == pytest.approx(0.5)
    assert r.mfe_60 == pytest.approx(0.03) and r.mae_60 == pytest.approx(0.02)


@pytest.mark.parametrize("case,want", [("flat", True), ("half", False), ("late", False), ("one_percent", True)])
def test_coverage_gate(rows, case, want):
    ws = 1200
    keep = {"flat": lambda t: True, "half": lambda t: t % 2 == 0, "late": lambda t: t >= ws - 50,
            "one_percent": lambda t: t % 100 != 7}[case]
    bars = rows([("k", t, 1.0) for t in range(1000, 1500) if keep(t)], "k string, ts bigint, close double")
    ticks = rows([("k", ws, t) for t in range(ws, ws + 300)], "k string, ws bigint, t bigint")
    g = rolling.window_coverage_gate(ticks, bars, ["k", "ws"], "k", "ws", "t", "ts").first()
    assert g.covered is want


@pytest.mark.parametrize("lo,hi", [(-7, 0), (1, 9), (-3, 4), (0, 0)])
def test_sliding_extremes_equal_a_scan_of_every_frame(rows, lo, hi):
    rnd = random.Random(hi)
    points = [(t, rnd.choice([None, 0, 1, 2, 3, 9])) for t in sorted(rnd.sample(range(-200, 200), 150))]
    w, back = asof.ordered(["k"]), asof.backwards(["k"])
    frame = (F.col("v"), F.col("t"), w, back, lo, hi)
    out = _series(rows, points).select("t", rolling.sliding_extreme(*frame).alias("hi"),
                                       rolling.sliding_extreme(*frame, lowest=True).alias("lo"))
    for r in out.collect():
        seen = [v for t, v in points if r.t + lo <= t <= r.t + hi and v is not None]
        assert (r.hi, r.lo) == ((max(seen), min(seen)) if seen else (None, None))


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "odd"])
def test_new_extreme_counts_equal_the_fold_over_the_list(rows, kind):
    rnd = random.Random(5)
    value = {"random": lambda t: rnd.choice([None, rnd.randint(0, 9)]), "rising": lambda t: t, "falling": lambda t: -t,
             "odd": lambda t: rnd.choice([float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1.5, None])}[kind]
    data = [(k, t, None if (v := value(t)) is None else float(v)) for k in ("a", "b") for t in rnd.sample(range(400), 250)]
    df, w = rows(data, "k string, t bigint, v double"), asof.ordered(["k"])
    want = df
    for n in (1, 10, 60):
        c = rolling.new_extreme_counts(rolling.recent_values(F.col("v"), w, n))
        want = want.withColumns({f"h{n}": c["highs"], f"l{n}": c["lows"]})
    got = rolling.add_new_extreme_counts(df, ["k"], "v", "t", {n: (f"h{n}", f"l{n}") for n in (1, 10, 60)})
    assert got.columns == want.columns
    key = lambda r: (r.k, r.t, *r[3:])
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str)


@pytest.mark.parametrize("name", ["W4_new_extreme_count", "A8_condition_stats", "W19_label_columns", "W12_book_delta_features",
                                  "J5_future_excursion", "W14_feature_snapshot", "W5_running_extremes"])
def test_no_frame_is_read_anew_for_every_row(spark, name):
    """A frame with two moving ends costs its length per row; one that only grows does not, and no list of it is kept."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+), ([^)]+)", plan)
    assert frames and all(start.startswith("unboundedpreceding") for _, start, _ in frames)
    assert "collect_list" not in plan


def test_top_levels_come_from_one_sort_and_drop_the_rest_before_the_shuffle(spark, rows):
    levels = rows([("x", "bid", 3, 1), ("x", "bid", 5, 2), ("x", "bid", 5, 4), ("x", "bid", 4, 1), ("x", "ask", 7, 1),
                   ("x", "ask", 6, 2), ("x", "ask", 8, 2), ("x", "ask", 6, 3), ("y", "bid", 1, 9)],
                  "asset string, side string, price bigint, size bigint")
    got = {(r.asset, r.side, r.level): (r.price, r.size) for r in studies.top_levels(levels, ["asset"], 2).collect()}
    assert got == {("x", "bid", 1): (5, 6), ("x", "bid", 2): (4, 1), ("x", "ask", 1): (6, 5), ("x", "ask", 2): (7, 1),
                   ("y", "bid", 1): (1, 9)}
    plan = entry.queries()["K1_top_levels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange") == 1
    assert "WindowGroupLimit" in plan and "3, Partial" in plan
