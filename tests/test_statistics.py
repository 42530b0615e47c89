"""Tails of distributions against sums of their densities, reports and tests against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspan.functions import distributions as d
from voxelspan.operators import conformal as cp
from voxelspan.operators import metrics as m
from voxelspan.operators import ranking as rk
from voxelspan.operators import significance as sg


def plain_tail(t, df):
    """Two-sided tail of Student's t by Simpson's rule over arctan, where the density is smooth and bounded."""
    a = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 200_001)
    log = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    f = np.exp(log + (df - 1) * np.log(np.maximum(np.cos(a), 1e-300)))
    w = np.ones(len(a))
    w[1:-1:2], w[2:-1:2] = 4, 2
    return 2 * float((f * w).sum()) * (a[1] - a[0]) / 3


CASES = [(0.0, 5.0), (1.0, 1.0), (2.5, 3.7), (-2.5, 3.7), (12.706204736, 1.0), (2.228138852, 10.0), (1.96, 999.0), (1.96, 1001.0), (3.5, 50_000.0), (8.0, 25.0), (0.3, 400.5), (40.0, 6.0)]


def test_student_tail(spark):
    rows = spark.createDataFrame(CASES, "t double, df double").withColumn("p", d.student_sf2(F.col("t"), F.col("df"))).collect()
    for r in rows:
        assert r.p == pytest.approx(plain_tail(r.t, r.df), rel=2e-6, abs=1e-12)
    table = {(12.706204736, 1.0): 0.05, (2.228138852, 10.0): 0.05, (1.0, 1.0): 0.5}
    assert all(abs(r.p - table[r.t, r.df]) < 1e-8 for r in rows if (r.t, r.df) in table)
    odd = spark.createDataFrame([(1.0, 0.0), (float("inf"), 4.0), (None, 4.0)], "t double, df double").select(d.student_sf2(F.col("t"), F.col("df"))).collect()
    assert [r[0] for r in odd] == [None, 0.0, None]


def test_incomplete_beta(spark):
    cases = [(0.3, 2.0, 5.0), (0.9, 2.0, 5.0), (0.5, 0.5, 0.5), (0.01, 30.0, 0.5), (0.0, 2.0, 2.0), (1.0, 2.0, 2.0)]
    found = [r[0] for r in spark.createDataFrame(cases, "x double, a double, b double").select(d.incomplete_beta(F.col("x"), F.col("a"), F.col("b"))).collect()]
    for (x, a, b), v in zip(cases, found, strict=True):
        u = np.sin(np.linspace(0, math.asin(math.sqrt(x)), 400_001)) ** 2  # x = sin^2 takes the poles away
        t = np.linspace(0, math.asin(math.sqrt(x)), 400_001)
        f = 2 * np.power(u, a - 0.5) * np.power(1 - u, b - 0.5)
        whole = math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        assert v == pytest.approx(float(np.trapezoid(f, t)) / whole, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("n1, n0", [(1, 1), (2, 3), (4, 4), (1, 7)])
def test_rank_sum_counts(n1, n0):
    held = np.zeros(n1 * n0 + 1)
    for places in itertools.combinations(range(n1 + n0), n1):
        held[sum(places) - n1 * (n1 - 1) // 2] += 1
    assert np.allclose(d.rank_sum_counts(n1, n0), held / held.sum(), atol=1e-12)


def test_exact_rank_sum(spark):
    df = spark.createDataFrame([("a", 1, v) for v in (1.0, 2.0, 9.0)] + [("a", 0, v) for v in (3.0, 4.0, 5.0, 6.0)] + [("tied", 1, 1.0), ("tied", 0, 1.0), ("one", 1, 2.0)], "g string, k int, v double")
    found = {r.g: r for r in rk.rank_sum(df, "v", "k", ["g"]).collect()}
    counts = np.cumsum(d.rank_sum_counts(3, 4))
    assert found["a"].u == 4 and found["a"].p_exact == pytest.approx(min(1, 2 * counts[4]))
    assert found["tied"].p_exact is None and found["one"].p_exact is None
    shift = {r.g: r["shift"] for r in rk.rank_sum_shift(df, "v", "k", "g").collect()}
    assert shift == {"a": float(np.median(np.subtract.outer([1, 2, 9], [3, 4, 5, 6]))), "tied": 0.0, "one": None}


def test_welch(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(3, 1, 40), rng.normal(2.2, 3, 25)
    df = spark.createDataFrame([("x", False, float(v)) for v in a] + [("x", True, float(v)) for v in b] + [("x", None, 1.0), ("x", True, None), ("none", False, 1.0), ("flat", True, 1.0), ("flat", False, 1.0)], "g string, ref boolean, v double")
    rows = {r.g: r for r in m.reference_group_compare(df, "v", "ref", "g").collect()}
    va, vb = a.var(ddof=1) / 40, b.var(ddof=1) / 25
    t, free = (a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / 39 + vb**2 / 24)
    assert rows["x"].welch_t == pytest.approx(t) and rows["x"].welch_p == pytest.approx(plain_tail(t, free), rel=1e-6)
    assert set(rows) == {"x", "flat"} and rows["flat"].welch_p is None


def test_report_averages(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (3, 1), (None, 1)], "t int, p int")
    rows = {r["class"]: r for r in m.class_report_averages(df, "t", "p").collect()}
    assert rows["macro"].precision == pytest.approx((0.5 + 2 / 3 + 0) / 3) and rows["macro"].recall == pytest.approx((0.5 + 1 + 0) / 3)
    assert rows["weighted"].recall == pytest.approx(3 / 5) and rows["weighted"].accuracy == pytest.approx(3 / 5)
    assert m.class_report_averages(df.limit(0), "t", "p").count() == 0


def test_macro_row_is_outside_holm(spark):
    rows = [(c, t, t if (c + t) % 3 else 0, t if (c * t) % 2 else 1) for c in range(12) for t in (0, 1, 2) for _ in range(3)]
    out = sg.cell_paired_tests(spark.createDataFrame(rows, "cell int, t int, a int, b int"), "t", "a", "b", "cell", 2, macro=True).collect()
    assert [r.macro for r in out].count(True) == 1 and all((r.p_holm is None) == (r.macro or r.p is None) for r in out)


def test_coverage_of_all_methods(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), int(v), int(y), int(y - 5 + e), int(y + e), int(y + 6 + e)) for g, v, y, e in zip(rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.integers(50, 90, 400), rng.integers(-9, 9, 400), strict=True)]
    df = spark.createDataFrame(rows, "g int, level int, y int, lo int, mid int, hi int")
    offsets = cp.fit_all_offsets(df, cp.METHODS, ["g", "level"], "y", "lo", "mid", "hi", 0.1)
    report = cp.coverage_by_method(cp.calibrate_all(df, offsets, cp.METHODS, ["g", "level"], "lo", "mid", "hi"), "g", "level", "y", "lo", "hi")
    held = report.collect()
    assert len(held) == 6 * 2 * 4 and all(r.cal_coverage >= 0.9 for r in held)
    for r in (r for r in held if r.all_groups):
        own = [x for x in held if not x.all_groups and (x.method, x.level) == (r.method, r.level)]
        assert r.n == sum(x.n for x in own) and r.cal_width == pytest.approx(sum(x.n * x.cal_width for x in own) / r.n)
    one = cp.calibrate(df, cp.fit_offsets(df, "se_m", ["g", "level"], "y", "lo", "mid", "hi", 0.1), "se_m", ["g", "level"], "lo", "mid", "hi")
    assert cp.coverage_report(one, ["g", "level"], "y", "lo", "hi").agg(F.sum("cal_width")).first()[0] == pytest.approx(sum(r.cal_width for r in held if r.method == "se_m" and not r.all_groups))
    assert cp.coverage_pivot(report, "g", "level", cp.METHODS).count() == 8
