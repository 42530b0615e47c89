"""Least squares on several columns from sums of products: per group, per fold and per bootstrap replicate without reading rows again.

``moments`` sums the columns and their products about the group's means, so the sums of blocks add up and can be subtracted
without cancellation; the small systems are solved with a row per group, fold or replicate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import student_sf2
from ..sources.scratch import stored
from .order import beside, quantiles, running_sums
from .ranking import BROADCAST, global_avg_rank
from .regression import _assembled, fold_of
from .resampling import multiplicities, replicate_sums


class Sums:
    """Names of the sums of k columns: ``n``, ``s0`` .., and ``p0_0``, ``p0_1`` .. of the products."""

    def __init__(self, k: int):
        self.k = k
        self.pairs = [(i, j) for i in range(k) for j in range(i, k)]
        self.first = [f"s{i}" for i in range(k)]
        self.second = [f"p{i}_{j}" for i, j in self.pairs]
        self.all = ["n", *self.first, *self.second]

    def arrays(self) -> list[Column]:
        return [F.col("n"), F.array(*self.first), F.array(*self.second)]

    def matrix(self, n: np.ndarray, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the means (about the given ones) and the products about them."""
        full = np.zeros((len(n), self.k, self.k))
        for at, (i, j) in enumerate(self.pairs):
            full[:, i, j] = full[:, j, i] = p[:, at]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = s / n[:, None]
        return mean, full - mean[:, :, None] * s[:, None, :]


def spline(x: Column, knots: Sequence[float]) -> list[Column]:
    """Columns besides x that make a natural cubic spline with these knots, the outer ones included; they are scaled to the knots' range."""
    last, before, range_ = knots[-1], knots[-2], knots[-1] - knots[0]
    cube = lambda k: F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)) / float(range_), F.lit(3.0))
    ratio = lambda k: (cube(k) - cube(last)) / float((last - k) / range_)
    return [ratio(k) - ratio(before) for k in knots[:-2]]


def knots_of(df: DataFrame, x: str, count: int) -> list[float]:
    """Distinct quantiles of x, the least and greatest value included; fewer than three for a column without spread."""
    row = quantiles(df, x, [], [k / (count - 1) for k in range(count)]).first()
    return sorted(set(row["q"])) if row else []


def counted_knots(df: DataFrame, x: str, times: str, count: int) -> list[float]:
    """``knots_of`` of rows that each stand for ``times`` rows: running sums over the distinct values tell which of them hold the wanted ranks."""
    n = df.agg(F.sum(times)).first()[0]
    if not n:
        return []
    places = [(n - 1) * (k / (count - 1)) for k in range(count)]
    ranks = sorted({min(int(p) + d, n - 1) for p in places for d in (0, 1)})
    run = running_sums(df.groupBy(F.col(x).cast("double").alias("_v")).agg(F.sum(times).alias("_c")), [], "_v", ["_c"])
    inside = lambda r: (F.col("before__c") <= r) & (F.col("before__c") + F.col("_c") > r)
    held = run.where(reduce(lambda a, b: a | b, map(inside, ranks))).collect()  # two per knot at most
    at = {r: next(h["_v"] for h in held if h["before__c"] <= r < h["before__c"] + h["_c"]) for r in ranks}
    return sorted({at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in places})


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), block: Sequence[str] = (), times: str | None = None, means: DataFrame | None = None) -> DataFrame:
    """(*by, *block, n, sums, m): sums of complete rows about the group's means ``m`` of the columns. times: how many rows a row stands for; means: numbers near the means, where they are known, so that rows are read once."""
    by, block, t = list(by), list(block), Sums(len(columns))
    rows = df.dropna(subset=list(dict.fromkeys(columns))).select(*by, *block, (F.col(times).cast("double") if times else F.lit(1.0)).alias("_w"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)))
    mean = lambda c: F.sum(F.col("_w") * F.col(c)) / F.sum("_w") if times else F.avg(c)
    if means is None:
        means = rows.groupBy(*by).agg(F.array(*(mean(f"_x{i}") for i in range(t.k))).alias("m"))
    rows = beside(rows, means, by)
    rows = rows.withColumns({f"_x{i}": F.col(f"_x{i}") - F.get("m", F.lit(i)) for i in range(t.k)})
    one = lambda x: F.sum(F.col("_w") * x if times else x)
    sums = [one(F.col(f"_x{i}")).alias(s) for i, s in enumerate(t.first)] + [one(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(p) for (i, j), p in zip(t.pairs, t.second, strict=True)]
    held = [f"_m{i}" for i in range(t.k)]  # numbers, since rows are sorted for an aggregate that holds an array
    found = rows.groupBy(*by, *block).agg((F.sum("_w") if times else F.count("*").cast("double")).alias("n"), *(F.first(F.get("m", F.lit(i))).alias(c) for i, c in enumerate(held)), *sums)
    return found.select(*by, *block, "n", F.array(*held).alias("m"), *t.first, *t.second)


def least_squares(cov: np.ndarray, y: int, xs: Sequence[int]) -> np.ndarray:
    """Slopes of column y on columns xs from products about the mean; of equal solutions the shortest."""
    a, b = cov[np.ix_(xs, xs)], cov[xs, y]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale


def solved(t: Sums, y: int, xs: Sequence[int]) -> Column:
    """Struct of intercept and slopes, their standard errors, and R2, from the sums and means of a row."""
    xs = list(xs)

    @F.pandas_udf("struct<coef: array<double>, se: array<double>, r2: double>")
    def solve(n: pd.Series, s: pd.Series, p: pd.Series, m: pd.Series) -> pd.DataFrame:
        n = n.to_numpy(float)
        s, p, m = (np.asarray(x.tolist(), float).reshape(len(n), -1) for x in (s, p, m))
        mean, cov = t.matrix(n, s, p)
        mean = mean + m
        out = []
        for k in range(len(n)):
            if not n[k] > len(xs) or not np.isfinite(cov[k]).all():
                out.append((None, None, None))
                continue
            b = least_squares(cov[k], y, xs)
            rss = float(cov[k][y, y] - 2 * b @ cov[k][xs, y] + b @ cov[k][np.ix_(xs, xs)] @ b)
            free = n[k] - len(xs) - 1
            inverse = np.linalg.pinv(cov[k][np.ix_(xs, xs)], rcond=1e-14, hermitian=True)
            variance = max(rss, 0.0) / free if free > 0 else np.nan
            slope_se = np.sqrt(np.maximum(variance * np.diag(inverse), 0.0))
            first_se = np.sqrt(variance * (1 / n[k] + mean[k][xs] @ inverse @ mean[k][xs]))
            r2 = 1 - rss / cov[k][y, y] if cov[k][y, y] > 0 else None
            none = lambda v: [float(x) if np.isfinite(x) else None for x in v]
            out.append(([float(mean[k][y] - b @ mean[k][xs]), *map(float, b)], none([first_se, *slope_se]), r2))
        return pd.DataFrame(out, columns=["coef", "se", "r2"])

    return solve(*t.arrays(), F.col("m"))


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, term, coef, se, t, p, n, r2): least squares of y on several columns per group; complete rows count. Groups of no more rows than terms have null coefficients."""
    t = Sums(len(xs) + 1)
    fits = moments(df, [y, *xs], by).withColumn("_f", solved(t, 0, range(1, len(xs) + 1)))
    terms = F.explode(F.array(*(F.struct(F.lit(name).alias("term"), F.get("_f.coef", F.lit(k)).alias("coef"), F.get("_f.se", F.lit(k)).alias("se")) for k, name in enumerate(["intercept", *xs]))))
    long = fits.select(*by, F.col("n").cast("long").alias("n"), F.col("_f.r2").alias("r2"), terms.alias("_t")).select(*by, "_t.*", "n", "r2")
    return long.withColumn("t", F.try_divide("coef", "se")).withColumn("p", student_sf2(F.col("t"), F.col("n") - len(xs) - 1))


def fitted_residual(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), out: str = "residual") -> DataFrame:
    """y less its fit on several columns within groups; null where a column or the fit is."""
    fits = moments(df, [y, *xs], by).select(*by, solved(Sums(len(xs) + 1), 0, range(1, len(xs) + 1))["coef"].alias("_b"))
    fit = sum((F.get("_b", F.lit(k + 1)) * F.col(x) for k, x in enumerate(xs)), F.get("_b", F.lit(0)))
    return beside(df, fits, by, "left" if by else "inner").withColumn(out, F.col(y) - fit).drop("_b")


def bootstrap_ols(df: DataFrame, y: str, xs: Sequence[str], block: str, replicates: int = 200, level: float = 0.05) -> DataFrame:
    """(term, coef, low, high): the regression refitted on every replicate of whole blocks, from the blocks' sums; percentile intervals."""
    t, at = Sums(len(xs) + 1), range(1, len(xs) + 1)
    blocks = stored(moments(df, [y, *xs], (), [block]), "blocks")
    m = blocks.select("m").limit(1)
    whole = blocks.agg(*(F.sum(c).alias(c) for c in t.all)).crossJoin(F.broadcast(m)).select(solved(t, 0, at)["coef"].alias("_b"))  # one row each
    reps = replicate_sums(blocks, block, t.all, replicates).crossJoin(F.broadcast(m)).select(solved(t, 0, at)["coef"].alias("_b"))
    named = lambda d: d.select(F.posexplode("_b").alias("_k", "coef")).select(F.get(F.array(*map(F.lit, ["intercept", *xs])), F.col("_k")).alias("term"), "coef")
    q = F.percentile("coef", F.array(F.lit(level / 2), F.lit(1 - level / 2)))
    ends = named(reps).groupBy("term").agg(q.alias("_q")).select("term", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))
    return named(whole).join(ends, "term")


def out_of_fold_fits(df: DataFrame, targets: Sequence[str], xs: Sequence[str], fold: str, times: str | None = None) -> DataFrame:
    """``df`` with ``fit_<target>``, a linear fit on the rows of all other folds: the total's sums less the fold's, one pass for all folds. times: how many rows a row stands for, their mean targets in its targets."""
    columns = [*targets, *xs]
    t, nt = Sums(len(columns)), len(targets)
    per = moments(df, columns, (), [fold], times)
    total = per.agg(*(F.sum(c).alias(f"_all_{c}") for c in t.all))
    rest = per.crossJoin(F.broadcast(total)).select(fold, "m", *((F.col(f"_all_{c}") - F.col(c)).alias(c) for c in t.all))  # a row per fold
    fits = rest.select(fold, *(solved(t, k, range(nt, len(columns)))["coef"].alias(f"_b{k}") for k in range(nt)))
    rows = beside(df, fits, [fold])
    for k, y in enumerate(targets):
        rows = rows.withColumn(f"fit_{y}", sum((F.get(f"_b{k}", F.lit(i + 1)) * F.col(x) for i, x in enumerate(xs)), F.get(f"_b{k}", F.lit(0))))
    return rows.drop(*(f"_b{k}" for k in range(nt)))


def out_of_fold_trees(cells: DataFrame, targets: Sequence[str], xs: Sequence[str], fold: str, folds: int, times: str) -> DataFrame:
    """``cells`` with ``fit_<target>``, boosted trees of all other folds. Cells of equal xs with their mean targets make the trees that their rows make: a split is told by sums of targets."""
    from pyspark.ml.regression import GBTRegressor

    rows, out = _assembled(cells, xs), None
    for k in range(folds):
        part = rows.where(F.col(fold) == k)
        for y in targets:
            part = GBTRegressor(featuresCol="_x", labelCol=y, weightCol=times, predictionCol=f"fit_{y}", maxIter=5, seed=1).fit(rows.where(F.col(fold) != k)).transform(part)
        out = part.drop("_x") if out is None else out.unionByName(part.drop("_x"))
    return out


def correlation_intervals(rows: DataFrame, pairs: dict[str, tuple[str, str]], block: str, replicates: int, level: float = 0.05, means: DataFrame | None = None) -> DataFrame:
    """One row: n, and per named pair of columns the correlation ``<name>``, its <name>_low and _high, and <name>_p (two-sided, at least 1 / replicates), by whole blocks, the same draws for all pairs; null for fewer than 10 rows or a column without spread. See ``moments`` for the means, of the columns in the order of the pairs."""
    columns = [c for pair in pairs.values() for c in pair]
    t = Sums(len(columns))
    blocks = stored(moments(rows, columns, (), [block], None, means), "blocks")

    def r(k: int) -> Column:
        c = lambda i, j: F.col(f"p{2 * k + i}_{2 * k + j}") - F.col(f"s{2 * k + i}") * F.col(f"s{2 * k + j}") / F.col("n")
        return F.when((F.col("n") >= 10) & (c(0, 0) > 1e-18 * F.col("n")) & (c(1, 1) > 1e-18 * F.col("n")), c(0, 1) / F.sqrt(c(0, 0) * c(1, 1)))

    whole = blocks.agg(*(F.sum(c).alias(c) for c in t.all)).select(F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"), *(r(k).alias(name) for k, name in enumerate(pairs)))
    reps = replicate_sums(blocks, block, t.all, replicates).select(*(r(k).alias(f"_{name}") for k, name in enumerate(pairs)))
    ends = []
    for name in pairs:
        side = F.least(F.avg((F.col(f"_{name}") <= 0).cast("double")), F.avg((F.col(f"_{name}") >= 0).cast("double")))
        ends += [F.percentile(f"_{name}", F.array(F.lit(level / 2), F.lit(1 - level / 2))).alias(f"_q_{name}"), F.greatest(F.least(2 * side, F.lit(1.0)), F.lit(1.0 / replicates)).alias(f"_p_{name}")]
    ok = lambda name, x: F.when(F.col(name).isNotNull(), x)
    of = lambda name: [F.col(name), ok(name, F.col(f"_q_{name}")[0]).alias(f"{name}_low"), ok(name, F.col(f"_q_{name}")[1]).alias(f"{name}_high"), ok(name, F.col(f"_p_{name}")).alias(f"{name}_p")]
    return whole.crossJoin(reps.agg(*ends)).select("n", *(x for name in pairs for x in of(name)))  # one row each


def residual_ladder(df: DataFrame, targets: tuple[str, str], controls: Sequence[str], tile: str, folds: int, replicates: int = 200, rungs: Sequence[str] = ("linear", "spline", "trees"), knots: int = 5) -> DataFrame:
    """(rung, n, pearson, its low, high and p_boot, spearman, its low, high and p_boot): correlation of two targets' out-of-fold residuals on the controls, for ever more flexible models.

    linear and spline (natural cubic in every control, knots at quantiles of all rows) are solved for all folds from one pass; trees
    are boosted and fitted once per fold. A fit depends on the controls alone, so all fits and knots come from cells, the rows of a fold with equal
    controls, with their number and mean targets; rows meet the fits of their cell once. Folds and the blocks of the intervals are whole tiles; Spearman is the correlation
    of ranks over all rows. A target that is itself a control (the anchor) leaves nothing to correlate: its rungs have nulls.
    Rows with a null or infinite value in a target or control don't count.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")) for c in dict.fromkeys([*targets, *controls])]
    given = df.where(reduce(lambda a, b: a & b, finite)).select(F.col(tile).alias("_tile"), *dict.fromkeys([*targets, *controls]))
    given = given.withColumns({c: F.col(c).cast("double") for c in dict.fromkeys([*targets, *controls])})
    spark = df.sparkSession
    schema = "rung string, n long, pearson double, pearson_low double, pearson_high double, pearson_p double, spearman double, spearman_low double, spearman_high double, spearman_p double"
    if set(targets) & set(controls):
        n = given.count()
        return spark.createDataFrame([(r, n, *[None] * 8) for r in rungs], schema)
    given = given.withColumn("_fold", fold_of("_tile", folds))
    key = [*controls, "_fold"]
    cells = stored(given.groupBy(*key).agg(F.count("*").alias("_times"), *(F.avg(y).alias(y) for y in targets)), "cells")
    few = cells.count() <= BROADCAST  # from the files' footers
    told, fits = cells.select(*key), [f"fit_{y}" for y in targets]
    for rung in rungs:
        if rung == "trees":
            one = out_of_fold_trees(cells, targets, controls, "_fold", folds, "_times")
        else:
            wide, names = cells, list(controls)
            for k, c in enumerate(controls if rung == "spline" else ()):
                at = counted_knots(cells, c, "_times", knots)
                extra = {f"_n{k}_{i}": x for i, x in enumerate(spline(F.col(c), at) if len(at) > 2 else [])}
                wide, names = wide.withColumns(extra) if extra else wide, [*names, *extra]
            one = out_of_fold_fits(wide, targets, names, "_fold", "_times")
        told = told.join(one.select(*key, *(F.col(f).alias(f"_{rung}_{k}") for k, f in enumerate(fits))), key)
    told = stored(told, "fits")
    residuals = {rung: [(F.col(y) - F.col(f"_{rung}_{k}")).alias(f"{rung}_{k}") for k, y in enumerate(targets)] for rung in rungs}
    every = given.join(told.hint("broadcast" if few else "merge"), key).select("_tile", *(c for pair in residuals.values() for c in pair))
    every = stored(every, "residuals")
    out = spark.createDataFrame([], schema)
    for rung in rungs:
        a, b = f"{rung}_0", f"{rung}_1"
        rows = every.select("_tile", a, b).dropna(subset=[a, b])
        middle = (F.count("*") + 1) / 2  # of ranks
        means = rows.agg(F.array(F.avg(a), F.avg(b), middle, middle).alias("m"))
        ranks = global_avg_rank(global_avg_rank(rows, b, "_rb"), a, "_ra")
        found = correlation_intervals(ranks, {"pearson": (a, b), "spearman": ("_ra", "_rb")}, "_tile", replicates, means=means)
        out = out.unionByName(found.withColumn("rung", F.lit(rung)))
    return out


# calibration of two instruments' residual signal against a third's

SENSORS = ("ref", "a", "b")


class Calibration:
    """Fits of each sensor's low level on its own top height, and what follows from them.

    df: columns ``low_<s>``, ``top_<s>`` for the sensors ref, a and b, and a tile. The fits are linear, or natural cubic splines with four knots
    where a residual of the linear fit correlates with the squared height by more than ``tolerance``. All slopes, also those of
    replicates of whole tiles, come from sums of products per tile; only the bin means of replicates read the rows again, once for all of them.
    """

    def __init__(self, df: DataFrame, tile: str, bins: int, replicates: int = 200, tolerance: float = 0.1, level: float = 0.05):
        self.bins, self.replicates, self.level = bins, replicates, level
        self.names = [f"{x}_{s}" for s in SENSORS for x in ("low", "top")]
        rows = df.dropna(subset=self.names).select(F.col(tile).alias("_tile"), *(F.col(c).cast("double").alias(c) for c in self.names))
        self.rows = stored(rows.withColumns({f"square_{s}": F.col(f"top_{s}") * F.col(f"top_{s}") for s in SENSORS}), "calibration")
        self.columns = [*self.names, *(f"square_{s}" for s in SENSORS)]
        self.extra: dict[str, list[str]] = {s: [] for s in SENSORS}
        self._sum_up()
        self.curvature = self._curvature() if self.n > 0 else {}
        self.kind = "linear"
        if any(abs(r) > tolerance for r in self.curvature.values() if r == r):
            self.kind = "spline"
            for s in SENSORS:
                at = knots_of(self.rows, f"top_{s}", 4)
                if len(at) > 2:
                    terms = {f"n{i}_{s}": x for i, x in enumerate(spline(F.col(f"top_{s}"), at))}
                    self.rows, self.extra[s] = self.rows.withColumns(terms), list(terms)
                    self.columns += terms
            self._sum_up()

    def _sum_up(self) -> None:
        self.t = Sums(len(self.columns))
        self.blocks = stored(moments(self.rows, self.columns, (), ["_tile"]), "tiles")
        held = self.blocks.agg(F.first("m").alias("m"), *(F.sum(c).alias(c) for c in self.t.all)).first()
        self.n, self.m = held["n"] or 0.0, np.asarray(held["m"] or [np.nan] * self.t.k, float)
        self.whole = self._read(pd.DataFrame([held.asDict()]))

    def _read(self, sums: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Means and products about them, per row of sums. As many rows as replicates."""
        n, s, p = sums["n"].to_numpy(float), sums[self.t.first].to_numpy(float), sums[self.t.second].to_numpy(float)
        mean, cov = self.t.matrix(n, s, p)
        return mean + self.m, cov

    def _residual(self, mean: np.ndarray, cov: np.ndarray, s: str, strict: bool = False) -> np.ndarray:
        """Weights of the columns, and last the constant, that make the residual of a sensor; strict: the reference's height is a regressor too."""
        at = self.columns.index
        xs = list(dict.fromkeys([at(f"top_{s}"), *map(at, self.extra[s]), *([at("top_ref")] if strict and s != "ref" else [])]))
        out = np.zeros(len(self.columns) + 1)
        y = at(f"low_{s}")
        out[xs], out[y] = -least_squares(cov, y, xs), 1.0
        out[-1] = -out[:-1] @ mean
        return out

    def _curvature(self) -> dict[str, float]:
        """Correlation of each linear fit's residual with the squared height."""
        mean, cov = self.whole[0][0], self.whole[1][0]
        out = {}
        for s in SENSORS:
            w, k = self._residual(mean, cov, s)[:-1], self.columns.index(f"square_{s}")
            spread = (w @ cov @ w) * cov[k, k]
            out[s] = float(w @ cov[:, k] / np.sqrt(spread)) if spread > 0 else float("nan")
        return out

    def slopes(self, mean: np.ndarray, cov: np.ndarray, strict: bool = False) -> tuple[float, float, float]:
        """Slopes of the residuals of a and b on the reference's, and their ratio (the recovery)."""
        w = {s: self._residual(mean, cov, s, strict)[:-1] for s in SENSORS}
        ref = w["ref"] @ cov @ w["ref"]
        if not ref > 0:
            return (float("nan"),) * 3
        a, b = (float(w[s] @ cov @ w["ref"] / ref) for s in ("a", "b"))
        return a, b, a / b if abs(b) > 1e-12 else float("nan")

    def _replicates(self) -> pd.DataFrame:
        return replicate_sums(self.blocks, "_tile", self.t.all, self.replicates).toPandas().sort_values("replicate")

    def _ends(self, values: Sequence[float]) -> tuple[float | None, float | None]:
        v = np.asarray([x for x in values if x == x])
        return tuple(map(float, np.quantile(v, [self.level / 2, 1 - self.level / 2]))) if len(v) else (None, None)

    def summary(self) -> DataFrame:
        """(control, slope_a, slope_b, recovery, low, high, fit, n, curvature): own heights alone, and strictly the reference's height too."""
        spark, found = self.rows.sparkSession, []
        if self.n > 0:
            reps = self._read(self._replicates())
            for strict in (False, True):
                a, b, ratio = self.slopes(self.whole[0][0], self.whole[1][0], strict)
                low, high = self._ends([self.slopes(m, c, strict)[2] for m, c in zip(*reps, strict=True)])
                none = lambda x: x if x == x else None
                found.append(("strict" if strict else "own", none(a), none(b), none(ratio), low, high, self.kind, int(self.n), max((abs(r) for r in self.curvature.values() if r == r), default=None)))
        return spark.createDataFrame(found, "control string, slope_a double, slope_b double, recovery double, low double, high double, fit string, n long, curvature double")

    def curve(self) -> DataFrame:
        """(bin, n, x, top_ref, y_a, y_a_low, y_a_high, y_b, y_b_low, y_b_high): bins of equal count of the reference's residual; equal edges make one.

        The intervals refit every replicate and put its residuals into the bins of the whole table.
        """
        schema = "bin int, n long, x double, top_ref double, y_a double, y_a_low double, y_a_high double, y_b double, y_b_low double, y_b_high double"
        if not self.n > 0:
            return self.rows.sparkSession.createDataFrame([], schema)
        reps = self._replicates()
        weights = [self._weights(*(x[0] for x in self.whole)), *(self._weights(m, c) for m, c in zip(*self._read(reps), strict=True))]
        names, size = self.columns, len(weights)
        given = self.rows.select("_tile", *names)
        whole = weights[0]
        res = sum((F.lit(float(w)) * F.col(c) for w, c in zip(whole["ref"], names, strict=False)), F.lit(float(whole["ref"][-1])))
        shares = [k / self.bins for k in range(self.bins + 1)]
        given = given.withColumn("_r", res)
        edges = np.unique(quantiles(given, "_r", [], shares).first()["q"])
        inner, count = edges[1:-1], max(len(edges) - 1, 1)
        draws = self._draws()
        rows = beside(given, draws, ["_tile"])
        stack = np.stack([np.stack([w[s] for s in SENSORS]) for w in weights])  # replicate, sensor, column
        top = names.index("top_ref")

        def run(batches):
            total = np.zeros((size, count, 5))
            for batch in batches:
                x = np.column_stack([batch.column(c).to_numpy() for c in names])
                k = batch.column("_k").flatten().to_numpy().reshape(len(x), size - 1).T
                v = np.einsum("rsc,nc->srn", stack[:, :, :-1], x, optimize=True) + stack[:, :, -1].T[:, :, None]
                v[0, 0] = batch.column("_r").to_numpy()  # rounded as the edges are
                for r in range(size):
                    at = np.searchsorted(inner, v[0, r], "right")
                    if r == 0:
                        ones = np.ones(len(x))
                        for j, y in enumerate((ones, v[0, 0], x[:, top], v[1, 0], v[2, 0])):
                            total[0, :, j] += np.bincount(at, weights=y, minlength=count)
                        continue
                    times = k[r - 1].astype(float)
                    for j, y in ((0, times), (3, times * v[1, r]), (4, times * v[2, r])):  # a replicate gives n and y alone
                        total[r, :, j] += np.bincount(at, weights=y, minlength=count)
            import pyarrow as pa

            i, j = (z.reshape(-1) for z in np.indices((size, count)))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(total[:, :, c].reshape(-1)) for c in range(5))], ["r", "bin", "n", "x", "top_ref", "y_a", "y_b"])

        sums = rows.mapInArrow(run, "r int, bin int, n double, x double, top_ref double, y_a double, y_b double").groupBy("r", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "x", "top_ref", "y_a", "y_b"))).where("n > 0")
        sums = stored(sums, "bins")  # both readers below would go through all rows
        means = sums.select("r", "bin", "n", *((F.col(c) / F.col("n")).alias(c) for c in ("x", "top_ref", "y_a", "y_b")))
        ends = F.array(F.lit(self.level / 2), F.lit(1 - self.level / 2))
        spread = means.where("r > 0").groupBy("bin").agg(F.percentile("y_a", ends).alias("_a"), F.percentile("y_b", ends).alias("_b"))
        one = means.where("r = 0").drop("r").join(spread, "bin", "left")
        return one.select("bin", F.col("n").cast("long").alias("n"), "x", "top_ref", "y_a", F.col("_a")[0].alias("y_a_low"), F.col("_a")[1].alias("y_a_high"), "y_b", F.col("_b")[0].alias("y_b_low"), F.col("_b")[1].alias("y_b_high"))

    def _weights(self, mean: np.ndarray, cov: np.ndarray) -> dict[str, np.ndarray]:
        return {s: self._residual(mean, cov, s) for s in SENSORS}

    def _draws(self) -> DataFrame:
        """(_tile, _k): how often each replicate draws the tile."""
        return multiplicities(self.blocks.select("_tile"), "_tile", self.replicates).select("_tile", F.col("times").cast("array<int>").alias("_k"))
