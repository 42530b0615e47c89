"""Whitening by polarisation against dense matrices."""

from fractions import Fraction

import numpy as np
import pytest

from voxelspan.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, component string"


def usable(rows):
    return [(name, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for name, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def check(spark, rows, parts=3):
    out = whitening.whitened_components(spark.createDataFrame([(a, v, 1, "c") for a, v in rows], SCHEMA).repartition(parts), "vec_id", "embedding")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held = usable(rows)
    fit = np.asarray(sorted({tuple(x) for _, x in held}), dtype=object)
    n, size = len(fit), len(fit[0])
    s = fit.sum(0)
    u = fit * n - s
    v = np.asarray([[float(Fraction(int((u[:, i] * u[:, j]).sum()), n**3)) for j in range(size)] for i in range(size)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = out.toPandas()
    assert len(found) == len(held) * min(16, size) and set(found["n"]) == {n}
    wanted = sorted((-1 if a is None else a, int((((np.asarray(x, object) * n) - s) ** 2).sum()), *x) for a, x in held)
    first = found[found.component == 1].fillna({"vec_id": -1})
    assert sorted(zip(first.vec_id.astype(int), first.deviation)) == [w[:2] for w in wanted]
    kept = [k for k in range(min(16, size)) if values[k] > values[0] * size * 2.0**-52]
    for k in kept:
        part = found[found.component == k + 1]
        assert np.allclose(part.explained, values[k] / np.trace(v), rtol=1e-6)
        both = {}
        for name, x in held:
            z = np.asarray([float(Fraction(int(n * e - t), n)) for e, t in zip(x, s)])
            both.setdefault(name, []).append(float(z @ vectors[:, k]) / np.sqrt(values[k]))
        mine = {name: sorted(g.whitened) for name, g in part.groupby("vec_id", dropna=False)}
        flat = lambda d, sign: np.concatenate([np.sort(np.asarray(d[x]) * sign) for x in sorted(d, key=str)])
        theirs = {(np.nan if a is None else a): w for a, w in both.items()}
        mine = {("n" if a != a else a): w for a, w in mine.items()}
        theirs = {("n" if a != a else a): w for a, w in theirs.items()}
        assert any(np.allclose(flat(mine, 1), flat(theirs, sign), atol=1e-8) for sign in (1, -1)), k
    if kept:
        assert found.identity_error.max() < 1e-9
    assert found[~found.component.isin([k + 1 for k in kept])].whitened.isna().all()


def vectors(seed, n, size):
    rng = np.random.default_rng(seed)
    mixing = rng.normal(size=(size, size)) * np.geomspace(1, 0.1, size)
    return [[float(c) for c in v] for v in rng.normal(size=(n, size)) @ mixing]


def test_against_dense_matrices(spark):
    v = vectors(1, 200, 20)
    rows = list(enumerate(v))
    odd = [(900, None), (901, [None] * 20), (902, [float("nan")] + v[0][1:]), (903, [float("inf")] + v[0][1:]), (None, v[3]), (5, v[5]), (5, v[5])]
    check(spark, rows + odd + [(1000 + k, v[0]) for k in range(150)])


@pytest.mark.parametrize("scale", [1e5, 1e9])
def test_large_entries_stay_exact(spark, scale):
    check_rows = [(k, [c * scale for c in v]) for k, v in enumerate(vectors(2, 60, 5))]
    if scale == 1e5:
        check(spark, check_rows)
    else:  # deviations leave a long
        out = whitening.whitened_components(spark.createDataFrame([(a, v, 1, "c") for a, v in check_rows], SCHEMA), "vec_id", "embedding")
        assert out.where("deviation is null").count() > 0 and out.selectExpr("max(identity_error)").first()[0] < 1e-6


def test_few_rows_have_few_components(spark):
    check(spark, list(enumerate(vectors(3, 3, 6))))


def test_without_variance(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    out = whitening.whitened_components(spark.createDataFrame([(a, v, 1, "c") for a, v in rows], SCHEMA), "vec_id", "embedding").collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(out)] == [(a, k, 1, 0, None, None, None) for a in (1, 2) for k in (1, 2)]


def test_empty_and_odd_lengths(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened_components(spark.createDataFrame([(a, v, 1, "c") for a, v in rows], SCHEMA), "vec_id", "embedding").count() == 0
    v = vectors(4, 30, 4)
    rows = [*enumerate(v), (50, v[0][:3]), (51, [])]
    out = whitening.whitened_components(spark.createDataFrame([(a, x, 1, "c") for a, x in rows], SCHEMA), "vec_id", "embedding")
    assert out.count() == 120 and out.where("vec_id >= 50").count() == 0


def test_covariance_comes_from_squares_of_sums(spark):
    x = np.asarray([[3, 1, 7], [2, 8, 2], [9, 4, 4], [1, 1, 1]])
    points = spark.createDataFrame([(list(map(int, r)),) for r in x], "x array<bigint>")
    q = whitening.squares(points, [1, 2, 3])
    d = x - [1, 2, 3]
    assert q == {(i, j): int(((d[:, i] + d[:, j]) ** 2).sum() if i != j else (d[:, i] ** 2).sum()) for i in range(3) for j in range(i, 3)}
    assert np.allclose(whitening.fit(points).covariance, np.cov(x.T, bias=True))
