"""Steps whose memory or time grew faster than the table: few groups, many groups, repeated passes."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxelspan.operators import conformal as cp
from voxelspan.operators import curation as cu
from voxelspan.operators import gram as gr
from voxelspan.operators import matching as ma
from voxelspan.operators import metrics as m
from voxelspan.operators import order
from voxelspan.operators import ranking as rk
from voxelspan.operators import regression as re_


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def kept(monkeypatch):
    """Plans of the tables that a module stores, as they are before they run."""
    seen = []

    def watch(module):
        plain = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name="table": (seen.append((name, plan(df))), plain(df, name))[1])
        return seen

    return watch


def labelled(spark, n=240):
    rng = np.random.default_rng(1)
    rows = [(k, k % 4, k % 3, float(q), float(s), int(q + s + e > 10)) for k, (q, s, e) in enumerate(zip(rng.integers(0, 9, n), rng.integers(0, 9, n), rng.normal(0, 3, n), strict=True))]
    return spark.createDataFrame(rows, "id long, tile int, bin int, q double, s double, g int")


def test_f10_rows_are_not_shuffled_by_the_tile_left_out(spark, kept):
    seen = kept(re_)
    re_.cross_validated(labelled(spark), ["q", "s"], "g", "tile", None)
    assert [("BroadcastHashJoin" in p, "SortMergeJoin" in p) for name, p in seen if name == "assembled"] == [(True, False)]


def test_f15_ranks_of_few_values_are_broadcast(spark):
    df = spark.createDataFrame([(float(k % 3),) for k in range(30)] + [(None,)], "v double")
    got = rk.global_avg_rank(df, "v")
    assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got)
    assert {(r["v"], r["rank"]) for r in got.collect()} == {(0.0, 5.5), (1.0, 15.5), (2.0, 25.5), (None, None)}


def test_f20_rows_are_not_shuffled_by_the_group_of_an_offset(spark):
    df = spark.createDataFrame([(k % 3, 10 + k, 20 + k, 30 + k) for k in range(9)], "g int, lo int, mid int, hi int")
    off = df.where("g < 2").groupBy("g").agg(F.lit(2.0).alias("c_lo"), F.lit(3.0).alias("c_hi"), F.lit(1.0).alias("q_lo"), F.lit(1.0).alias("q_hi"))
    for got in (cp.apply_offsets(df, off, ["g"], "lo", "mid", "hi"), cp.calibrate(df, off, "cqr", ["g"], "lo", "mid", "hi")):
        assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got)
    assert sorted(r["new_lo"] for r in cp.apply_offsets(df, off, ["g"], "lo", "mid", "hi").where("g = 2").collect()) == [12, 15, 18]


def test_f22_rows_are_not_shuffled_by_the_fit(spark):
    got = re_.random_intercept_fit(labelled(spark), "s", ["q"], "bin", ["tile"])
    assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got) and got.count() == 4


def test_f24_edges_of_a_winsorized_table_are_no_list_of_its_values(spark):
    values = [float(x) for x in np.random.default_rng(2).normal(0, 9, 20_000)]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "v double")
    got = cu.winsorize(df, "v", 0.05, 0.95)
    assert "percentile(" not in got._jdf.queryExecution().analyzed().toString()
    low, high = np.quantile(values, [0.05, 0.95])
    held = [r["v"] for r in got.collect()]
    assert held.count(None) == 1 and sum(x for x in held if x is not None) == pytest.approx(np.clip(values, low, high).sum())
    assert [r["v"] for r in cu.winsorize(df.where("v is null"), "v", 0.05, 0.95).collect()] == [None]


def test_f26_groups_of_few_rows_are_sorted_once(spark, kept):
    seen = kept(order)
    rng = np.random.default_rng(3)
    rows = [(g, float(x)) for g, n in ((1, 30), (2, 1), (3, 700), (None, 40), (4, 0)) for x in rng.integers(0, 50, n)] + [(1, None), (4, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    ranks = [lambda n: F.floor(n / 2), lambda n: n - 1, lambda n: n + 5, lambda n: F.lit(-1)]

    def check(got):
        want = {g: sorted(x for k, x in rows if k == g and x is not None) for g in (1, 2, 3, None)}
        held = {r["g"]: r for r in got.collect()}
        assert set(held) == set(want)
        for g, v in want.items():
            n = len(v)
            assert held[g]["n"] == n and held[g]["at"] == [v[n // 2], v[-1], None, None] and held[g]["after"] == [v[min(n // 2 + 1, n - 1)], v[-1], None, None]

    check(order.order_statistics(df, "v", ["g"], ranks, small=5_000))
    assert not any("percentile_approx" in p or "Generate" in p for _, p in seen)  # no sketch per group, no row per rank
    check(order.order_statistics(df, "v", ["g"], ranks, small=512))
    assert any("percentile_approx" in p for _, p in seen)
    assert m.bias_stats(df, "v", ["g"], 10).count() == 3


def test_f12_f16_scores_of_all_methods_share_their_passes(spark, kept):
    seen = kept(order)
    rng = np.random.default_rng(4)
    n = 24_000
    rows = list(zip(*(x.tolist() for x in (rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(500, 900, n))), strict=True))
    rows = [(g if k else None, v, y, y - 30 + int(e), y + int(e), y + 40 + int(e)) for k, ((g, v, y), e) in enumerate(zip(rows, rng.integers(-60, 60, n), strict=True))] + [(1, 1, None, 1, 2, 3), (7, 0, None, 1, 2, 3)]
    df = spark.createDataFrame([(0, *r[1:]) if r[0] == 0 else r for r in rows], "g int, level int, y int, lo int, mid int, hi int")
    df = df.withColumn("g", F.when(F.col("level") == 0, 0).otherwise(F.col("g")))
    offsets = cp.fit_all_offsets(df, cp.METHODS, ["g"], "y", "lo", "mid", "hi", 0.1)
    assert not any("Generate" in p for name, p in seen if name == "sketches")  # rows were copied for every method and side
    held, own = offsets.collect(), [r for r in df.collect() if r["y"] is not None]
    assert len(held) == 6 * len({r["g"] for r in own})
    for r in held:
        mine, scale = [x for x in own if x["g"] == r["g"]], (lambda x, kind=r["method"][-2:]: {"_r": (x["hi"] - x["lo"],) * 2, "_m": (x["mid"] - x["lo"], x["hi"] - x["mid"])}.get(kind, (1, 1)))
        low, high = (np.asarray([f(x) / scale(x)[k] for x in mine]) for k, f in enumerate((lambda x: x["lo"] - x["y"], lambda x: x["y"] - x["hi"])))
        if not r["method"].startswith("se"):
            low = high = np.maximum(low, high)
        at = int(np.ceil((len(mine) + 1) * (0.95 if r["method"].startswith("se") else 0.9))) - 1
        value = lambda v: float(np.sort(v)[at]) if at < len(v) else None
        assert r["n_cal"] == len(mine) and (r["q_lo"], r["q_hi"]) == (value(low), value(high))
    key = ["method", "g"]
    one = cp.coverage_of_methods(df, offsets, cp.METHODS, ["g"], "y", "lo", "mid", "hi").orderBy(*key).select(*key, "n", "coverage", "cal_coverage", "width", "cal_width").collect()
    two = cp.coverage_report(cp.calibrate_all(df, offsets, cp.METHODS, ["g"], "lo", "mid", "hi"), key, "y", "lo", "hi").orderBy(*key).select(*one[0].asDict()).collect()
    assert len(one) == len(two) and all(a[:3] == b[:3] and [x or 0 for x in a[3:]] == pytest.approx([x or 0 for x in b[3:]]) for a, b in zip(one, two, strict=True))


def test_f18_rows_of_the_calibration_are_read_once_for_all_replicates(spark, kept):
    seen = kept(gr)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k % 7, *map(float, rng.normal(0, 1, 6))) for k in range(200)], "tile int, low_ref double, top_ref double, low_a double, top_a double, low_b double, top_b double")
    got = gr.Calibration(df, "tile", 4, 5).curve()
    assert "MapInArrow" not in plan(got) and [name for name, p in seen if "MapInArrow" in p] == ["bins"] and got.count() == 4


def test_f13_f17_f25_folds_are_stored_once(spark, kept):
    seen = kept(re_)
    df = labelled(spark).withColumn("y", F.col("q") + F.col("s"))
    both = re_.oof_residual_corr(df, ("y", "s"), "q", "tile", 2)
    assert "md5" not in both._jdf.queryExecution().optimizedPlan().toString() and {(r["model"], r["n"]) for r in both.collect()} == {("linear", 240), ("trees", 240)}
    base = re_.shape_baselines(df, "y", "q", "tile", 2)
    assert "md5" not in base._jdf.queryExecution().optimizedPlan().toString() and {r["n"] for r in base.collect()} == {240}
    re_.class_sets_report(df.withColumn("other", F.lit(1)), {"q": ["q"]}, "g", "tile", 2, "boosted")
    assert [name for name, _ in seen] == ["folds", "folds", "folds", "predictions"]


def test_f14_a_table_is_read_once_for_all_folds(spark, monkeypatch):
    plans, plain = [], re_.auc
    monkeypatch.setattr(re_, "auc", lambda df, *rest: (plans.append(plan(df)), plain(df, *rest))[1])
    got = re_.permutation_importance(labelled(spark), ["q", "s"], "g", "tile", 3, "p", "id")
    held = {r["feature"]: r for r in got.collect()}
    assert set(held) == {"q", "s"} and all(r["loss"] > 0.02 for r in held.values())
    assert "UDF" not in plans[0]  # a model and a read for each fold of each table


def test_f23_scores_hold_no_other_columns(spark, monkeypatch):
    seen, plain = [], re_.stored
    monkeypatch.setattr(re_, "stored", lambda df, name="table": (seen.append((name, df.columns)), plain(df, name))[1])
    re_.classify_report(labelled(spark).withColumn("other", F.lit("x")), {"q": ["q"]}, "g", "tile", "bin", 2)
    assert [set(c) - {"fold", "_x", "_label", "score"} for name, c in seen] == [{"q", "g", "tile", "bin"}] * 2


def test_pipeline_open_levels_of_the_packing_search_hold_few_tables(monkeypatch):
    import gc

    from voxelspan.llm import packing

    most, plain = [0], packing.Sums.table

    def table(self):
        fresh = self.reach is None
        got = plain(self)
        if fresh and self.kept is not None and len(most) < 400:
            most.append(sum(type(x) is list and len(x) == size and x[0] == 1 for x in gc.get_objects()) if (size := len(got[1])) else 0)
        return got

    counts = {x: 3 for x in range(150, 400)}
    left = [0] * 4097
    for x, n in counts.items():
        left[x] = n
    want = packing.complete(left, 4096, packing.dive(left, 4096, packing.best_fit), 1, 3_000)
    monkeypatch.setattr(packing, "KEPT_SUMS", 2)
    monkeypatch.setattr(packing.Sums, "table", table)
    assert packing.complete(left, 4096, packing.dive(left, 4096, packing.best_fit), 1, 3_000) == want and 1 < len(most) and max(most) <= 4


def test_op7_places_of_plain_words_need_no_second_look(monkeypatch):
    from voxelspan.llm import langid

    rng = np.random.default_rng(6)
    s = -rng.integers(0, 13, (300, 4)) / 2.0
    s[:150, 1] += 4.0
    v, came = s[0].copy(), []
    for row in s[1:]:
        moved = v.max() - 3.0 > v
        came.append(np.where(moved, v.argmax(), np.arange(4)))
        v = np.where(moved, v.max() - 3.0, v) + row
    want = [int(v.argmax())]
    for c in reversed(came):
        want.append(int(c[want[-1]]))
    assert langid.viterbi(s, 3.0).tolist() == want[::-1] and len(set(want)) > 1
    seen, plain = [], langid.letters_of
    monkeypatch.setattr(langid, "letters_of", lambda run: (seen.append(run), plain(run))[1])
    assert langid.starts_of("ab c\u00bdd  ef") == [0, 3, 5, 8] and seen == ["c\u00bdd"]


def test_f21_runs_of_numbers_take_one_shuffle(spark):
    df = spark.createDataFrame([(g, k) for g in (1, 2, None) for k in (3, 4, 4, 5, 9, 9, None, 10 + (g or 0))], "g int, k long")
    got = cu.number_ranges(df, ["g"], "k")
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((g, *x)) for g in (1, 2, None) for x in ((3, 5), (9, 10) if g is None else (9, 9) if g == 2 else (9, 9), *(((10 + g, 10 + g),) if g else ()), (None, None)))


def test_stretches_of_a_match_are_matched_once(spark, kept):
    """stretches that start below their border need no second pass, and the source is grouped once; those that do not agree are matched again."""
    rng = np.random.default_rng(5)

    def table(n, share, step):
        rows = [(int(b) if b else None, f"r{k}", float(h) * step, int(u < share)) for k, (b, h, u) in enumerate(zip(rng.integers(0, 2, n), rng.integers(0, 4000, n), rng.random(n), strict=True))]
        return spark.createDataFrame(rows, "bin int, id string, height double, high int").groupBy("bin", "id", "high").agg(F.max("height").alias("height"))

    seen = kept(ma)

    def match(df, size):
        seen.clear()
        return sorted(((r["bin"] or 0, r["high_id"], r["low_id"], r["distance"]) for r in ma.greedy_match(df, "bin", "id", "height", "high", 1.0, size).collect()))

    plain = table(4000, 0.25, 0.25)
    got = match(plain, 400)
    assert sum(name == "again" for name, _ in seen) == 1  # borders touch every stretch: before, each was matched twice
    assert [name for name, p in seen if "max(height" in p] == ["rows"]  # before, each pass grouped the source again
    assert got == match(plain, 10**9) and len(got) > 700
    even = table(1000, 0.5, 0.25)
    got = match(even, 1)
    assert sum(name == "again" for name, _ in seen) > 1 and got == match(even, 10**9)  # taken lows reach over many borders


def test_f1_scenes_meet_points_in_blocks(spark, monkeypatch):
    """Files hold rows in few bytes where a scene stands beside a whole block of points; before, no two rows in a row had one scene, and all points of a tile and day were one task's."""
    from voxelspan.operators import joins as jo

    monkeypatch.setattr(jo, "BLOCK", 8, raising=False)
    points = spark.createDataFrame([(k, k % 2, "x") for k in range(300)] + [(900, None, "x"), (901, 5, "x")], "id long, tile int, other string").withColumn("want", F.when(F.col("id") != 3, F.expr("date'2020-03-01'")))
    scenes = spark.range(40).selectExpr("id as scene", "cast(id % 2 as int) as tile", "date_add(date'2020-03-01', cast(id - 12 as int)) as day")
    got = jo.expanding_window(points, scenes, "id", "tile", "want", "scene", "day", 5)
    assert got.columns == ["tile", "want", "id", "other", "scene", "day", "gap", "level"] and "_block" in next(x for x in plan(got).splitlines() if "SortMergeJoin" in x)
    rows = [(r["id"], r["scene"], r["level"]) for r in got.collect()]
    assert sorted(rows) == sorted((i, s, 1) for i in range(300) if i != 3 for s in range(40) if s % 2 == i % 2 and abs(s - 12) <= 5)
    assert sum(a[1] != b[1] for a, b in zip(rows, rows[1:], strict=False)) < len(rows) / 6


def test_f3_boosted_classes_are_fitted_on_counted_rows(spark, monkeypatch):
    """Equal rows are one row with a weight, before each fit read all rows; the report is that of a fit on the rows."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(8)
    n = 6_000
    rows = [(int(t), float(q), float(s), int(c)) for t, q, s, c in zip(rng.integers(0, 40, n), rng.integers(0, 50, n), rng.integers(0, 4, n), rng.integers(0, 3, n), strict=True)]
    rows = [(t, q, s, int((q > 17) + (q > 33)) if k % 2 else c) for k, (t, q, s, c) in enumerate(rows)] + [(1, None, 1.0, 1), (2, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "tile int, q double, s double, g int")
    sizes, stored = [], re_.stored
    monkeypatch.setattr(re_, "stored", lambda df, name="table": (held := stored(df, name), sizes.append((name, held.count())))[0])
    got = {r["class"]: r for r in re_.class_sets_report(df, {"both": ["q", "s"]}, "g", "tile", 2, "boosted").collect()}
    assert [x for x in sizes if x[0] == "folds"][0][1] <= 2 * 50 * 4 * 3
    plain = VectorAssembler(inputCols=["q", "s"], outputCol="_x").transform(df.dropna().withColumn("f", re_.fold_of("tile", 2))).withColumn("y", F.col("g").cast("double"))
    make = lambda: OneVsRest(classifier=GBTClassifier(featuresCol="_x", labelCol="y", maxIter=5, maxDepth=3, seed=1), featuresCol="_x", labelCol="y")
    found = [(int(r["y"]), int(r["prediction"])) for k in range(2) for r in make().fit(plain.where(F.col("f") != k)).transform(plain.where(F.col("f") == k)).select("y", "prediction").collect()]
    assert len(found) == n
    for c in range(3):
        tp, said, own = (sum(x) for x in zip(*((a == b == c, b == c, a == c) for a, b in found), strict=True))
        assert (got[str(c)]["support"], got[str(c)]["precision"], got[str(c)]["recall"]) == (own, pytest.approx(tp / said), pytest.approx(tp / own))
        assert got[str(c)]["accuracy"] == pytest.approx(sum((a == c) == (b == c) for a, b in found) / n)
    assert got["macro"]["support"] == n and got["macro"]["accuracy"] == pytest.approx(sum(a == b for a, b in found) / n)


def test_f2_a_ladder_reads_its_rows_twice(spark, kept, monkeypatch):
    """Fits and knots come from cells of equal controls; before, every tree level and quantile read all rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    seen, rng = kept(gr), np.random.default_rng(9)
    n = 3_000
    rows = [(int(t), float(q), float(s), float(e + q * s / 9), float(d - q)) for t, q, s, e, d in zip(rng.integers(0, 30, n), rng.integers(0, 20, n), rng.integers(0, 5, n), rng.normal(0, 3, n), rng.integers(0, 9, n), strict=True)]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 1.0, 1.0), (2, 1.0, 1.0, float("inf"), 1.0)], "tile int, q double, s double, y double, z double")
    got = {r["rung"]: r for r in gr.residual_ladder(df, ("y", "z"), ["q", "s"], "tile", 3, 5).collect()}
    assert [name for name, _ in seen] == ["cells", "fits", "residuals", *["blocks"] * 3]
    assert not any("SortAggregate" in p for _, p in seen)  # an array in the aggregate sorted all rows by tile
    plain = VectorAssembler(inputCols=["q", "s"], outputCol="_x").transform(df.where("q is not null and y < 1e9").withColumn("f", re_.fold_of("tile", 3)))
    held = []
    for k in range(3):
        part = plain.where(F.col("f") == k)
        for y in ("y", "z"):
            part = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol=f"p_{y}", maxIter=5, seed=1).fit(plain.where(F.col("f") != k)).transform(part)
        held += [(r["y"] - r["p_y"], r["z"] - r["p_z"]) for r in part.collect()]
    assert got["trees"]["n"] == n and got["trees"]["pearson"] == pytest.approx(np.corrcoef(np.asarray(held).T)[0, 1], abs=1e-9)
    cells = df.where("q is not null").groupBy("q").agg(F.count("*").alias("c"))
    assert gr.counted_knots(cells, "q", "c", 5) == gr.knots_of(df, "q", 5) and gr.counted_knots(cells.limit(0), "q", "c", 5) == []
