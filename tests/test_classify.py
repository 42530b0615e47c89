"""AUC, cross-validated scores, importances and reports against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspan.operators import order
from voxelspan.operators import regression as re_


def plain_auc(score, label):
    a, b = score[label == 1], score[label == 0]
    return float((np.greater.outer(a, b) + 0.5 * np.equal.outer(a, b)).mean()) if len(a) and len(b) else None


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    tile, x, z = rng.integers(0, 6, n), rng.normal(size=n), rng.normal(size=n)
    g = (2 * x + 0.2 * z + rng.normal(size=n) > 0.5).astype(int)
    return [(k, int(t), float(a), float(b), int(c), int(k % 3)) for k, (t, a, b, c) in enumerate(zip(tile, x, z, g, strict=True))]


SCHEMA = "id int, tile int, x double, z double, g int, bin int"


@pytest.mark.parametrize("parts", ["1", "5"])
def test_running_sums_and_auc(spark, parts):
    rng = np.random.default_rng(1)
    rows = [(None if k == 0 else int(k), float(s), int(y)) for k, s, y in zip(rng.integers(0, 4, 500), rng.integers(0, 20, 500), rng.integers(0, 2, 500), strict=True)]
    df = spark.createDataFrame([*rows, (9, 1.0, 1), (9, None, 0)], "k int, s double, y int")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = {r.k: (r.n, r.auc) for r in re_.auc(df, "s", "y", ["k"]).collect()}
        for k in (None, 1, 2, 3):
            own = np.asarray([r[1:] for r in rows if r[0] == k])
            assert found[k] == (len(own), pytest.approx(plain_auc(own[:, 0], own[:, 1])))
        assert found[9] == (1, None)
        sums = order.running_sums(df.where("s is not null").groupBy("s").count(), [], "s", ["count"]).orderBy("s").collect()
        assert [r.before_count for r in sums] == [sum(x["count"] for x in sums[:k]) for k in range(len(sums))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("folds", [2, None])
def test_report_of_out_of_fold_scores(spark, folds):
    rows = sample(240)
    df = spark.createDataFrame([*rows, (999, None, 1.0, 1.0, 1, 0), (998, 1, None, 1.0, 1, 0)], SCHEMA)
    p, weights = re_.cross_validated(df, ["x", "z"], "g", "tile", folds)
    held = p.collect()
    assert len(held) == 240 and len({r.tile: r.fold for r in held}) == 6 and len({(r.tile, r.fold) for r in held}) == 6
    assert len(weights) == len({r.fold for r in held}) and all(w[0] > w[1] for _, w in weights)
    report = re_.classify_report(df, {"both": ["x", "z"]}, "g", "tile", "bin", folds).collect()
    of = lambda keep: (np.asarray([r.score for r in held if keep(r)]), np.asarray([r.g for r in held if keep(r)]))
    for r in report:
        if r.part in ("fold", "bin", "pooled"):
            s, y = of(lambda h, r=r: r.part == "pooled" or str(h.fold if r.part == "fold" else h.bin) == r.name)
            hit = s >= 0.5
            tp, recall0 = (hit & (y == 1)).sum(), (~hit & (y == 0)).sum() / (y == 0).sum()
            assert r.n == len(s) and r.auc == pytest.approx(plain_auc(s, y), abs=1e-6)
            assert r.balanced_accuracy == pytest.approx((tp / (y == 1).sum() + recall0) / 2) and r.f1 == pytest.approx(2 * tp / (hit.sum() + (y == 1).sum()))
    mean = next(r for r in report if r.part == "mean")
    assert mean.auc == pytest.approx(np.mean([r.auc for r in report if r.part == "fold"]))
    assert {r.name: r.importance for r in report if r.part == "importance"} == {f: pytest.approx(np.mean([w[k] for _, w in weights])) for k, f in enumerate(["x", "z"])}


def test_a_fold_without_a_class_to_learn_is_left_out(spark):
    rows = [(k, k % 2, float(k), 1.0, k % 2, 0) for k in range(20)]
    p, weights = re_.cross_validated(spark.createDataFrame(rows, SCHEMA), ["x"], "g", "tile", None)
    assert p.count() == 0 and weights == []


def test_permutation_loses_what_the_feature_tells(spark):
    df = spark.createDataFrame(sample(300, 3), SCHEMA)
    rows = {r.feature: r for r in re_.permutation_importance(df, ["x", "z"], "g", "tile", 3, "s", "id").collect()}
    assert rows["x"].loss > 0.2 > abs(rows["z"].loss) and rows["x"].auc == rows["z"].auc
    again = {r.feature: r.loss for r in re_.permutation_importance(df.repartition(7), ["x", "z"], "g", "tile", 3, "s", "id").collect()}
    assert again == {f: pytest.approx(r.loss, abs=1e-3) for f, r in rows.items()}


@pytest.mark.parametrize("kind", ["logit", "boosted"])
def test_reports_per_feature_set(spark, kind):
    rows = [(k, int(k % 5), float(k % 3) + 0.01 * (k % 7), float(k % 2), int(k % 3), 0) for k in range(150)]
    out = re_.class_sets_report(spark.createDataFrame(rows, SCHEMA), {"tells": ["x"], "noise": ["z"]}, "g", "tile", 2, kind).collect()
    of = {(r.features, r["class"]): r for r in out}
    assert {c for f, c in of if f == "tells"} == {"0", "1", "2", "macro", "weighted"}
    assert of["tells", "macro"].f1 == pytest.approx(1.0) and of["noise", "macro"].f1 < 0.7


def test_interaction_p(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(s), float((1 + 2 * g) * s + rng.normal())) for g, s in zip(rng.integers(0, 2, 60), rng.uniform(0, 3, 60), strict=True)]
    r = re_.interaction_test(spark.createDataFrame(rows, "g int, s double, y double"), "y", "s", "g").first()
    assert r.p < 1e-6 and r.interaction == pytest.approx(2, abs=0.8)
    height = spark.createDataFrame([(float(k), 2.0 * k, k % 2 == 0) for k in range(40)], "h double, y double, ref boolean")
    fit = re_.height_model_residual(height, F.col("ref"), "h", "y", "spline", [10.0, 20.0, 30.0])
    assert fit.count() == 40 and fit.agg(F.max(F.abs("residual"))).first()[0] < 0.05  # straight lines are splines
