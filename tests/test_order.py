"""Exact order statistics per group and of all pairs against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspan.operators import matching, order


def groups(seed, sizes):
    rng = np.random.default_rng(seed)
    kinds = [lambda n: rng.normal(size=n), lambda n: rng.integers(0, 5, n).astype(float), lambda n: np.exp(rng.normal(0, 8, n)), lambda n: np.full(n, 2.5)]
    return {g: kinds[g % 4](n) for g, n in enumerate(sizes)}


def table(spark, held):
    rows = [(None if g == 0 else g, float(v)) for g, vs in held.items() for v in vs] + [(1, None), (77, None)]
    return spark.createDataFrame(rows, "g int, v double")


@pytest.mark.parametrize("small, most", [(600, 100), (600, 1_000_000), (4096, 1_000_000)])
def test_quantiles_per_group(spark, small, most):
    held = groups(1, [60_000, 40_000, 50_000, 2000, 1, 2, 7])
    df = table(spark, held)
    shares = [0.0, 0.025, 0.1, 0.5, 0.9, 1.0]
    ranks = [lambda n, s=s: F.floor((n - 1) * F.lit(s)) for s in shares]
    found = {r.g: r for r in order.order_statistics(df, "v", ["g"], ranks, small, most).collect()}
    assert len(found) == len(held)
    for g, v in held.items():
        row, x = found[g or None], np.sort(v)
        at = [int((len(v) - 1) * s) for s in shares]
        assert row.n == len(v) and row["at"] == x[at].tolist() and row.after == x[np.minimum(np.add(at, 1), len(v) - 1)].tolist()
    q = {r.g: r.q for r in order.quantiles(df, "v", ["g"], shares).collect()}
    for g, v in held.items():
        assert np.allclose(q[g or None], np.quantile(v, shares), rtol=1e-12)


def test_ranks_outside_and_no_groups(spark):
    df = spark.createDataFrame([(5,), (1,), (3,)], "v int")
    row = order.order_statistics(df, "v", [], [lambda n: n, lambda n: n - 1, lambda n: F.lit(0)]).first()
    assert (row.n, row["at"], row.after) == (3, [None, 5, 1], [None, 5, 3])
    assert order.quantiles(df.where("false"), "v", [], [0.5]).count() == 0


def walsh(v):
    i, j = np.triu_indices(len(v))
    return float(np.median((v[i] + v[j]) / 2))


@pytest.mark.parametrize("pairs", [50, 250_000])
def test_pair_medians(spark, pairs, monkeypatch):
    monkeypatch.setattr(order, "SMALL", 32)  # many cells
    held, other = groups(2, [200, 150, 300, 30, 2, 1]), groups(3, [100, 221, 90, 41, 3, 1])
    a, b = table(spark, held), table(spark, other).union(spark.createDataFrame([(9, 1.0)], "g int, v double"))
    found = {r.g: (r.shift, r.pairs) for r in matching.hodges_lehmann(a, b, "v", "g", pairs).collect()}
    assert found == {g or None: (float(np.median(np.subtract.outer(held[g], other[g]))), len(held[g]) * len(other[g])) for g in held}
    found = {r.g: (r.pseudomedian, r.pairs) for r in matching.pseudomedian(a, "v", "g", pairs).collect()}
    assert found == {g or None: (walsh(v), len(v) * (len(v) + 1) // 2) for g, v in held.items()}


def test_pair_median_of_a_large_group(spark):
    """100,000 values a side, far more pairs than could be rows."""
    rng = np.random.default_rng(7)
    x, y = np.round(rng.normal(3, 2, 100_000), 3), rng.gamma(2, 5, 100_000)
    a, b = (spark.createDataFrame([(1, float(v)) for v in w], "g int, v double") for w in (x, y))
    row = matching.hodges_lehmann(a, b, "v", "g").first()
    y = np.sort(y)
    ranks = np.array([5 * 10**9 - 1, 5 * 10**9])
    middle = []
    for rank in ranks:
        low, high = float(x.min() - y[-1]), float(x.max() - y[0])
        while np.nextafter(low, high) < high:  # least value that more than ``rank`` differences are at or below
            t = low + (high - low) / 2
            n = int((len(y) - order.first_at_most(x, y, t)).sum())
            low, high = (low, t) if n > rank else (t, high)
        middle.append(high)
    assert row.pairs == 10**10 and row["shift"] == sum(middle) / 2


def test_no_pairs(spark):
    none = spark.createDataFrame([], "g string, v double")
    one = spark.createDataFrame([("x", 1.0), ("y", None)], "g string, v double")
    assert matching.hodges_lehmann(none, one, "v", "g").count() == 0
    assert [tuple(r) for r in matching.pseudomedian(one, "v", "g").collect()] == [("x", 1.0, 1)]
