"""Known values of the statistics, and brute-force checks on small samples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwise.functions import intervals, tails
from epochwise.operators import inference, models, multiplicity, ranks


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("level,z", [(0.95, 1.959964), (0.99, 2.575829), (0.90, 1.644854)])
def test_z_values(level, z):
    assert intervals.z_value(level) == pytest.approx(z, abs=1e-6)


@pytest.mark.parametrize("t,df,p", [(1.0, 4, 0.37390), (2.776445, 4, 0.05), (0.0, 7, 1.0), (12.706205, 1, 0.05), (1.959964, 1e9, 0.05), (30.0, 50, 5.9e-34)])
def test_t_tail(t, df, p):
    assert tails.t_tail_value(t, df) == pytest.approx(p, rel=2e-2 if p < 1e-9 else 1e-4)


@pytest.mark.parametrize("table,p", [((3, 1, 1, 3), 0.4857143), ((10, 0, 0, 10), 1.0825e-5), ((0, 0, 0, 0), 1.0), ((5, 5, 5, 5), 1.0)])
def test_fisher(table, p):
    assert tails.fisher_value(*table) == pytest.approx(p, rel=1e-4)


def test_fisher_matches_enumeration():
    rng = random.Random(1)
    for _ in range(200):
        a, b, c, d = (rng.randrange(0, 25) for _ in range(4))
        n, row, col = a + b + c + d, a + b, a + c
        if n == 0:
            continue
        weight = {x: math.comb(row, x) * math.comb(n - row, col - x) for x in range(max(0, col - n + row), min(row, col) + 1)}
        want = sum(w for w in weight.values() if w <= weight[a] * (1 + 1e-9)) / sum(weight.values())
        assert tails.fisher_value(a, b, c, d) == pytest.approx(want, rel=1e-9)


def test_fisher_of_huge_tables_is_fast_and_near_the_z_test():
    a, n, c, m = 400_300_000, 1_000_000_000, 400_250_000, 1_000_000_000
    pool = (a + c) / (n + m)
    z = (a / n - c / m) / math.sqrt(pool * (1 - pool) * 2 / n)
    assert tails.fisher_value(a, n - a, c, m - c) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-3)


def test_wilson_and_newcombe(spark):
    low, high = intervals.wilson(F.lit(0), F.lit(10))
    low10, high10 = intervals.wilson(F.lit(10), F.lit(10))
    low0, high0 = intervals.wilson(F.lit(0), F.lit(0))
    nl, nh = intervals.newcombe(F.lit(8), F.lit(40), F.lit(4), F.lit(40))
    el, eh = intervals.newcombe(F.lit(8), F.lit(40), F.lit(0), F.lit(0))
    names = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"]
    r = one(spark, *[c.alias(n) for n, c in zip(names, [low, high, low10, high10, low0, high0, nl, nh, el, eh])])
    assert r.a == 0.0 and 0 < r.b < 0.4 and 0.6 < r.c < 1 and r.d == 1.0
    assert (r.e, r.f) == (0.0, 1.0) and r.g < 0.1 < r.h and (r.i, r.j) == (-1.0, 1.0)


def test_two_proportions(spark):
    df = spark.createDataFrame([(20, 100, 10, 100), (0, 10, 0, 10), (1, 0, 2, 3)], "hits int, n int, control_hits int, control_n int")
    rows = inference.z_test(df).collect()
    assert rows[0].z == pytest.approx(1.9803, abs=1e-4) and rows[0].p_value == pytest.approx(0.0477, abs=1e-4)
    assert rows[1].z == 0.0 and rows[1].p_value == 1.0
    assert rows[2].z is None and rows[2].p_value is None


def test_welch_edges(spark):
    data = [("t", 1.0), ("t", 1.0), ("c", 1.0), ("c", 1.0)]
    m = inference.moments(spark.createDataFrame(data, "arm string, value double"), ["arm"])
    row = inference.welch(inference.against_control(m, "c", [])).first()
    assert (row.t, row.p_value) == (0.0, 1.0)
    single = inference.moments(spark.createDataFrame([("t", 1.0), ("c", 1.0), ("c", 2.0)], "arm string, value double"), ["arm"])
    row = inference.welch(inference.against_control(single, "c", [])).first()
    assert row.t is None and row.p_value is None


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_mann_whitney_against_pairs(spark, coalesced):
    """All values in one range, and in as many as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    rng = random.Random(3)
    data = [("g1", a, float(rng.randrange(12))) for a in ("c", "t", "u") for _ in range(40)] + [("g2", a, rng.random()) for a in ("c", "t") for _ in range(30)]
    df = spark.createDataFrame(data, "g string, arm string, value double")
    got = {(r.g, r.arm): r for r in inference.mann_whitney(df, "c", ["g"]).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {("g1", "t"), ("g1", "u"), ("g2", "t")}
    for (g, arm), row in got.items():
        a = [x for gg, aa, x in data if gg == g and aa == arm]
        b = [x for gg, aa, x in data if gg == g and aa == "c"]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        ties = sum(k**3 - k for k in np.unique(a + b, return_counts=True)[1])
        n, m = len(a), len(b)
        var = n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1)))
        assert row.u == pytest.approx(u)
        assert row.z == pytest.approx((u - n * m / 2) / math.sqrt(var))


def test_mann_whitney_extremes(spark):
    df = spark.createDataFrame([("t", float(i)) for i in range(1, 6)] + [("c", float(i)) for i in range(6, 11)], "arm string, value double")
    row = inference.mann_whitney(df, "c", []).first()
    assert row.u == 0.0 and row.p_value < 0.02
    same = spark.createDataFrame([(a, 1.0) for a in "ttcc"], "arm string, value double")
    assert inference.mann_whitney(same, "c", []).first().p_value > 0.9


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)] + [("f", 99, None), ("g", 1, 0.5)], "f string, i int, p double")
    got = {(r.f, r.i): r.q_value for r in multiplicity.benjamini_hochberg(df, "p", ["f"], ["i"]).collect()}
    assert got[("f", 0)] == pytest.approx(0.01) and got[("f", 99)] is None and got[("g", 1)] == 0.5
    want = [min(x * 10 / (j + 1) for j, x in enumerate(p) if j >= i) for i in range(10)]
    assert [got[("f", i)] for i in range(10)] == pytest.approx(want)


def test_order_statistics_match_sorting(spark):
    rng = random.Random(5)
    data = [("a", float(rng.randrange(30))) for _ in range(500)] + [("b", rng.random()) for _ in range(301)] + [("c", 4.0)] * 60 + [("c", 1.0), ("c", 9.0)] * 15 + [("a", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    want = {"n1": lambda n: 1, "mid": lambda n: round(0.5 * (n - 1)) + 1, "p95": lambda n: round(0.95 * (n - 1)) + 1}
    cols = {"n1": F.lit(1), "mid": ranks.nearest_rank(0.5), "p95": ranks.nearest_rank(0.95)}
    got = {r.g: r for r in ranks.order_statistics(df, "v", cols, ["g"]).collect()}
    for g in "abc":
        values = sorted(v for gg, v in data if gg == g and v is not None)
        for name, k in want.items():
            assert got[g][name] == values[k(len(values)) - 1], (g, name)
    overall = ranks.order_statistics(df, "v", {"m": ranks.nearest_rank(0.5)}, []).first().m
    every = sorted(v for _, v in data if v is not None)
    assert overall == every[round(0.5 * (len(every) - 1))]


def test_order_statistics_of_odd_values(spark):
    """Signs, zeros, infinities, NaN last, values that differ in the last bit, a null group, groups that look alike as text."""
    inf = float("inf")
    values = [-inf, -1e300, -2.0, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 7.0, 7.0, 7.0, 1e300, inf]
    data = [(g, v) for g in ("a", None, "null") for v in values] + [("nan", float("nan")), ("nan", inf), ("nan", -inf)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    cols = {f"r{k}": F.lit(k) for k in range(1, len(values) + 1)}
    got = {r.g: r for r in ranks.order_statistics(df, "v", cols, ["g"]).collect()}
    for g in ("a", None, "null"):
        assert [got[g][c] for c in cols] == values
    assert got["nan"].r1 == -inf and got["nan"].r2 == inf and got["nan"].r3 != got["nan"].r3 and got["nan"].r4 is None


def test_median_of_even_and_odd_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 7.0), ("b", 6.0)], "g string, v double")
    assert {r.g: r.median for r in ranks.median(df, "v", ["g"]).collect()} == {"a": 1.5, "b": 6.0}


def test_percentile_of_nothing_is_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ranks.median(df, "v", ["g"]).count() == 0


def test_bootstrap_covers_the_difference(spark):
    rng = random.Random(9)
    rows = [("t", i, 1.0 + rng.gauss(0, 1)) for i in range(400)] + [("c", 1000 + i, rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "arm string, subject int, value double")
    b = inference.bootstrap_difference(df, "c", [], "1", resamples=300).first()
    again = inference.bootstrap_difference(df.repartition(3), "c", [], "1", resamples=300).first()
    diff = np.mean([v for a, _, v in rows if a == "t"]) - np.mean([v for a, _, v in rows if a == "c"])
    half = 1.96 * math.sqrt(2 / 400)
    assert b.ci_low < diff < b.ci_high
    assert b.ci_high - b.ci_low == pytest.approx(2 * half, rel=0.25)
    assert (b.ci_low, b.ci_high) == pytest.approx((again.ci_low, again.ci_high))


def test_poisson_weights():
    steps = inference.poisson_steps()
    assert len(steps) > 15 and all(a < b for a, b in zip(steps, steps[1:]))
    w = inference.poisson_weights(np.arange(500, dtype=np.int64) * 0x1234567890123, 400)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2


def test_bootstrap_keeps_groups_apart(spark):
    rows = [(g, a, i, float(i % 7) + (a == "t")) for g in ("x", None) for a in ("t", "c") for i in range(50)]
    df = spark.createDataFrame([*rows, ("x", "t", None, None)], "g string, arm string, subject int, value double")
    got = {r.g: (r.ci_low, r.ci_high) for r in inference.bootstrap_difference(df, "c", ["g"], "1", resamples=200).collect()}
    assert got["x"] == pytest.approx((1.0, 1.0))  # the same subjects and weights on both sides
    assert inference.bootstrap_difference(df.limit(0), "c", ["g"], "1", resamples=5).count() == 0


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 3))])
    y = x @ [1.0, 2.0, -1.0, 0.5] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([tuple(map(float, [*a, b])) for a, b in zip(x, y)], "f0 double, f1 double, f2 double, f3 double, y double").repartition(4)
    penalty = np.diag([0.0, 1.0, 1.0, 1.0])
    want = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    assert models.ridge_fit(df, ["f0", "f1", "f2", "f3"], "y", 1.0) == pytest.approx(list(want))


def test_ridge_of_nearly_collinear_columns(spark):
    """Columns that differ by 1e-7: products would lose all digits, the triangle does not; bad rows are counted."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=400)
    x = np.column_stack([np.ones(400), a, a + 1e-7 * rng.normal(size=400)])
    y = x @ [1.0, 2.0, 3.0]
    rows = [tuple(map(float, [*p, q])) for p, q in zip(x, y)] + [(1.0, None, 2.0, 3.0), (1.0, 2.0, float("nan"), 3.0), (1.0, 2.0, 3.0, float("inf"))]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 double, y double").repartition(5)
    found = models.triangle(df, ["f0", "f1", "f2"], "y").first()
    assert (found.used, found.dropped) == (400, 3)
    assert models.ridge_solution(found.r, 3, 0.0) == pytest.approx([1.0, 2.0, 3.0], abs=1e-5)
    names = ["f0", "f1", "f2"]
    assert models.ridge_fit(df.limit(0), names, "y") == pytest.approx([0.0] * 3)
    one = spark.createDataFrame([(1.0, 0.0, 0.0, 7.0)], "f0 double, f1 double, f2 double, y double")
    assert models.ridge_fit(one, names, "y") == pytest.approx([7.0, 0.0, 0.0])


def test_calibration_band(spark):
    risks = spark.createDataFrame([("a", s, "t", 0.5) for s in (1, 2) for _ in range(2)], "arm string, subject int, term string, p double")
    events = spark.createDataFrame([("a", 1, "t")], "arm string, subject int, term string")
    row = inference.calibration(risks, events).first()
    assert row.predicted == pytest.approx(0.75) and row.observed == 0.5 and row.within_band


def test_comparisons_without_resampling_keep_all_but_the_continuous_intervals(spark):
    rows = [(k, "ctl" if k % 2 else "a", float(k * k % 17 + 3 * (k % 2)), k % 3 == 0) for k in range(60)]
    eot = spark.createDataFrame(rows, "subject long, arm string, change double, responder boolean")
    ends = [inference.Endpoint("change", "change", "continuous", "decrease", 1.0, True), inference.Endpoint("rate", "responder", "binary", "increase", 0.1, False)]
    full = {(r.endpoint, r.arm): r.asDict() for r in inference.compare_endpoints(eot, ends, "ctl", "s", 200).collect()}
    plain = inference.compare_endpoints(eot, ends, "ctl", "s", resampled=False)
    got = {(r.endpoint, r.arm): r.asDict() for r in plain.collect()}
    assert got.keys() == full.keys() == {("change", "a"), ("rate", "a")}
    assert full["change", "a"]["ci_low"] < full["change", "a"]["effect"] < full["change", "a"]["ci_high"]
    full["change", "a"] |= {"ci_low": None, "ci_high": None}
    assert got == full


def test_exposure_has_the_course_of_doses(spark):
    """Before the first dose, after a pause, and the highest and lowest dose per kg so far."""
    rows = spark.createDataFrame([(1, e, x, 50.0) for e, x in ((0, 0.0), (1, 100.0), (2, 0.0), (4, 50.0))], "subject long, epoch int, dose double, weight double")
    got = models.exposure_course(models.exposure_features(rows)).orderBy("epoch").collect()
    assert [(r.n_dosed, r.peak_dose_per_kg, r.trough_dose_per_kg, r.since_dose) for r in got] == [(0, 0.0, 0.0, -1), (1, 2.0, 2.0, 0), (1, 2.0, 2.0, 1), (2, 2.0, 1.0, 0)]
    assert [r.cumulative_dose for r in got] == [0.0, 100.0, 100.0, 150.0]


def test_every_row_has_its_dose_effect(spark):
    """Subjects without undosed or without dosed epochs keep their rows; the lower of two equally good doses is best."""
    rows = [(1, 0, 0.0, 10.0), (1, 1, 50.0, 13.0), (1, 2, 50.0, 15.0), (1, 3, 100.0, 14.0), (2, 0, 50.0, 9.0), (3, 0, 0.0, 5.0), (3, 1, 0.0, 7.0)]
    got = models.level_effects(spark.createDataFrame(rows, "subject long, epoch int, dose double, x double"), "x").orderBy("subject", "epoch").collect()
    assert [(r.subject, r.epoch, r.effect, r.best_dose, r.best_effect) for r in got] == [
        (1, 0, 0.0, 50.0, 4.0), (1, 1, 4.0, 50.0, 4.0), (1, 2, 4.0, 50.0, 4.0), (1, 3, 4.0, 50.0, 4.0), (2, 0, None, 50.0, None), (3, 0, 0.0, None, None), (3, 1, 0.0, None, None)]


def test_score_parts_keep_rows_without_a_baseline(spark):
    """Harm counts above a limit only; a missing baseline or value counts as no change, a zero baseline as the least one."""
    rows = spark.createDataFrame([(1, 12.0, 4.0), (2, 2.0, 0.0), (3, 8.0, None), (4, None, 4.0), (5, 3.0, 4.0)], "i int, y double, b double")
    rise, high = models.rise_over(F.col("y"), F.col("b"), 1.0), models.above(F.col("y"), 10.0)
    got = rows.select("i", models.weighted_score([(rise, -0.5, 1.0), (high, -1.0, 2.0)]).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [-2.0, -0.5, 0.0, 0.0, 0.0]


def test_calibration_of_terms_shuffles_subjects_not_terms(spark):
    """The general form's figures; a sure event predicts one; no exchange carries rows of subject and term."""
    rows = spark.createDataFrame([("ab"[s % 2], s, e, 1 + (s + e) % 3) for s in range(12) for e in range(s % 4 + 1)], "arm string, subject int, epoch int, n long")
    events = spark.createDataFrame([("ab"[s % 2], s, t) for s in range(0, 12, 3) for t in ("t1", "t2") for _ in range(2)] + [("z", 99, "t1")], "arm string, subject int, term string")
    bases = {"t1": 0.1, "t2": 0.3, "sure": 0.7}
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(b).alias("base")) for t, b in bases.items()])
    risk = lambda n, t: t["base"] + n / 10.0
    found = inference.calibration_of_terms(rows.where("n = 1 OR subject > 3"), events, terms, "n", risk)
    long = rows.where("n = 1 OR subject > 3").select("arm", "subject", "n", F.explode(terms).alias("t")).select("arm", "subject", "t.term", F.least(risk(F.col("n"), F.col("t")), F.lit(1 - 1e-15)).alias("p"))
    want = {(r.arm, r.term): r for r in inference.calibration(long, events).collect()}
    got = {(r.arm, r.term): r for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k, r in got.items():
        assert (r.n, r.observed, r.within_band) == (want[k].n, want[k].observed, want[k].within_band)
        assert r.predicted == pytest.approx(want[k].predicted)
    from epochwise.plans import statistics

    plan = statistics.calibrated(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.replace("JoinHint", "")
