"""Least squares from sums of products, its bootstrap, the residual ladder and the calibration against plain fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspan.operators import gram as gr
from voxelspan.operators.regression import fold_of
from voxelspan.operators.resampling import PRIME


def plain_draw(r, d, n):
    x = (r * 1000003 + d * 7919 + 104729) % PRIME
    for _ in range(3):
        x = (x * 48271 + 12345) % PRIME
    return x % n


def fit(y, *xs):
    a = np.column_stack([np.ones(len(y)), *xs])
    return np.linalg.lstsq(a, y, rcond=None)[0]


def residual(y, *xs):
    b = fit(y, *xs)
    return y - b[0] - sum(k * x for k, x in zip(b[1:], xs, strict=True))


def data(seed, n, curved=0.0):
    rng = np.random.default_rng(seed)
    tile = rng.integers(0, 12, n)
    top = rng.uniform(2, 40, n)
    signal = rng.normal(0, 3, n) + rng.normal(0, 1, 12)[tile]
    held = {"tile": tile}
    for s, gain in (("ref", 1.0), ("a", 0.4), ("b", 0.8)):
        t = top + rng.normal(0, 1, n)
        held[f"top_{s}"], held[f"low_{s}"] = t, 0.3 * t + curved * t**2 + gain * signal + rng.normal(0, 1, n)
    return held


def frame(spark, held):
    return spark.createDataFrame([tuple(x.tolist()) for x in np.column_stack(list(held.values()))], ", ".join(f"{c} double" for c in held)).withColumn("tile", F.col("tile").cast("int"))


def test_ols_on_three_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 5, (200, 3))
    g = rng.integers(0, 2, 200)
    y = x @ [1.5, -2.0, 0.3] + g * 7 + rng.normal(0, 1, 200)
    rows = [(int(k), float(v), *map(float, r)) for k, v, r in zip(g, y, x, strict=True)] + [(0, None, 1.0, 1.0, 1.0), (5, 1.0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g int, y double, a double, b double, c double")
    found = {(r.g, r.term): r for r in gr.ols(df, "y", ["a", "b", "c"], ["g"]).collect()}
    for k in (0, 1):
        z = x[g == k] - 1e6
        design = np.column_stack([np.ones(len(z)), z])
        b = np.linalg.lstsq(design, y[g == k], rcond=None)[0]
        res = y[g == k] - design @ b
        se = np.sqrt(res @ res / (len(z) - 4) * np.diag(np.linalg.inv(design.T @ design)))
        for j, name in enumerate("abc"):
            assert found[k, name].coef == pytest.approx(b[j + 1], rel=1e-6) and found[k, name].se == pytest.approx(se[j + 1], rel=1e-5)
    assert found[5, "a"].coef is None and found[5, "a"].n == 1
    left = gr.fitted_residual(df, "y", ["a", "b", "c"], ["g"]).where("g < 5 and y is not null").agg(F.max(F.abs("residual"))).first()[0]
    assert left == pytest.approx(max(np.abs(residual(y[g == k], *(x[g == k] - 1e6).T)).max() for k in (0, 1)), rel=1e-5)


def test_bootstrap_refits_whole_blocks(spark):
    held = data(3, 300)
    df = frame(spark, held)
    rows = {r.term: r for r in gr.bootstrap_ols(df, "low_a", ["top_a", "low_ref"], "tile", 20).collect()}
    names = sorted(set(held["tile"].tolist()))
    every = []
    for r in range(20):
        at = np.concatenate([np.flatnonzero(held["tile"] == names[plain_draw(r, d, len(names))]) for d in range(len(names))])
        every.append(fit(held["low_a"][at], held["top_a"][at], held["low_ref"][at]))
    for k, term in enumerate(("intercept", "top_a", "low_ref")):
        low, high = np.quantile([b[k] for b in every], [0.025, 0.975])
        assert rows[term].coef == pytest.approx(fit(held["low_a"], held["top_a"], held["low_ref"])[k])
        assert (rows[term].low, rows[term].high) == (pytest.approx(low), pytest.approx(high))


def basis(x, knots):
    cube = lambda k: np.maximum((x - k) / (knots[-1] - knots[0]), 0) ** 3
    ratio = lambda k: (cube(k) - cube(knots[-1])) / ((knots[-1] - k) / (knots[-1] - knots[0]))
    return [x, *(ratio(k) - ratio(knots[-2]) for k in knots[:-2])]


def test_spline_is_straight_outside_its_knots(spark):
    x = np.linspace(-5, 15, 41)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", *(c.alias(f"n{k}") for k, c in enumerate(gr.spline(F.col("x"), [0.0, 3.0, 7.0, 10.0]))))
    rows = np.asarray(df.collect())
    assert np.allclose(rows.T, basis(x, [0.0, 3.0, 7.0, 10.0]))
    for k in (1, 2):
        assert np.allclose(np.diff(rows[x >= 10][:, k], 2), 0, atol=1e-9) and np.allclose(rows[x <= 0][:, k], 0)


def test_ladder_against_fits_of_every_fold(spark):
    held = data(5, 240, curved=0.02)
    df = frame(spark, held)
    fold = {r.tile: r.f for r in df.select("tile", fold_of("tile", 3).alias("f")).distinct().collect()}
    f = np.asarray([fold[t] for t in held["tile"].tolist()])
    rows = {r.rung: r for r in gr.residual_ladder(df, ("low_a", "low_b"), ["top_a", "top_ref"], "tile", 3, 30, ("linear", "spline", "trees"), 4).collect()}
    for rung in ("linear", "spline"):
        xs = [held["top_a"], held["top_ref"]]
        if rung == "spline":
            xs = [c for x in xs for c in basis(x, np.quantile(x, [0, 1 / 3, 2 / 3, 1]))]
        out = {}
        for y in ("low_a", "low_b"):
            out[y] = np.empty(240)
            for k in range(3):
                b = fit(held[y][f != k], *(x[f != k] for x in xs))
                out[y][f == k] = held[y][f == k] - b[0] - sum(c * x[f == k] for c, x in zip(b[1:], xs, strict=True))
        a, b = out["low_a"], out["low_b"]
        rank = lambda v: np.argsort(np.argsort(v))
        assert rows[rung].n == 240 and rows[rung].pearson == pytest.approx(np.corrcoef(a, b)[0, 1], rel=1e-6)
        assert rows[rung].spearman == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1], rel=1e-6)
        assert rows[rung].pearson_low < rows[rung].pearson < rows[rung].pearson_high and rows[rung].pearson_p == pytest.approx(1 / 30)
    assert rows["trees"].n == 240 and -1 <= rows["trees"].pearson_low <= rows["trees"].pearson_high <= 1
    anchor = gr.residual_ladder(df, ("low_a", "top_a"), ["top_a"], "tile", 3, 5).collect()
    assert [(r.n, r.pearson, r.spearman_p) for r in anchor] == [(240, None, None)] * 3


@pytest.mark.parametrize("curved", [0.0, 0.05])
def test_calibration_against_plain_refits(spark, curved):
    held = data(7, 402, curved)  # no edge of a bin is a row
    df = frame(spark, held).union(spark.createDataFrame([(1, None, *[1.0] * 5)], "tile int, a double, b double, c double, d double, e double, f double").selectExpr("tile", "b", "a", "c", "d", "e", "f"))
    cal = gr.Calibration(df, "tile", 6, 15)
    assert cal.kind == ("spline" if curved else "linear")
    for s in gr.SENSORS:
        r = residual(held[f"low_{s}"], held[f"top_{s}"])
        assert cal.curvature[s] == pytest.approx(np.corrcoef(r, held[f"top_{s}"] ** 2)[0, 1], abs=1e-6)
    knots = {s: np.quantile(held[f"top_{s}"], [0, 1 / 3, 2 / 3, 1]) for s in gr.SENSORS}

    def residuals(at, strict=False):
        out = {}
        for s in gr.SENSORS:
            x = held[f"top_{s}"]
            xs = [c[at] for c in (basis(x, knots[s]) if curved else [x])]
            out[s] = residual(held[f"low_{s}"][at], *xs, *([held["top_ref"][at]] if strict and s != "ref" else []))
        return out

    def recovery(r):
        a, b = (fit(r[s], r["ref"])[1] for s in ("a", "b"))
        return a, b, a / b

    names = sorted(set(held["tile"].tolist()))
    draws = [np.concatenate([np.flatnonzero(held["tile"] == names[plain_draw(r, d, len(names))]) for d in range(len(names))]) for r in range(15)]
    every = np.arange(402)
    rows = {r.control: r for r in cal.summary().collect()}
    for strict, name in ((False, "own"), (True, "strict")):
        a, b, ratio = recovery(residuals(every, strict))
        low, high = np.quantile([recovery(residuals(at, strict))[2] for at in draws], [0.025, 0.975])
        r = rows[name]
        assert [r.slope_a, r.slope_b, r.recovery, r.low, r.high] == pytest.approx([a, b, ratio, low, high], rel=1e-6) and r.n == 402
    own = residuals(every)
    edges = np.unique(np.quantile(own["ref"], np.linspace(0, 1, 7)))

    def means(at, r):
        label = np.digitize(r["ref"], edges[1:-1])
        return {k: (int((label == k).sum()), *(float(v[label == k].mean()) for v in (r["ref"], held["top_ref"][at], r["a"], r["b"]))) for k in range(6) if (label == k).any()}

    whole, reps = means(every, own), [means(at, residuals(at)) for at in draws]
    found = {r.bin: r for r in cal.curve().collect()}
    assert set(found) == set(whole)
    for k, r in found.items():
        assert [r.n, r.x, r.top_ref, r.y_a, r.y_b] == pytest.approx(whole[k], rel=1e-6, abs=1e-9)
        for at, low, high in ((3, r.y_a_low, r.y_a_high), (4, r.y_b_low, r.y_b_high)):
            assert [low, high] == pytest.approx(np.quantile([x[k][at] for x in reps if k in x], [0.025, 0.975]).tolist(), rel=1e-6, abs=1e-9)


def test_calibration_of_no_rows(spark):
    cal = gr.Calibration(frame(spark, data(1, 20)).limit(0), "tile", 5, 5)
    assert cal.summary().count() == 0 and cal.curve().count() == 0
