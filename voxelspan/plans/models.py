"""Queries of regressions on several columns, their bootstrap, the residual ladder and the calibration curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gram as gr
from ..operators.metrics import fixed_bin
from ..operators import ranking as r
from ..operators import regression as re_
from ..operators import significance as sg
from .accuracy import student_p
from .inference import CI, REPLICATES, _draw, _reps
from .registry import query

_MOMENTS = "m AS (SELECT biome, count(*) AS n, avg(y) AS my, avg(q) AS mx, avg(slope) AS mz, var_pop(q) * count(*) AS xx, var_pop(slope) * count(*) AS zz, var_pop(y) * count(*) AS yy, covar_pop(q, slope) * count(*) AS xz, covar_pop(q, y) * count(*) AS xy, covar_pop(slope, y) * count(*) AS zy FROM fp GROUP BY biome)"
_SOLVED = "f AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS c, xx * zz - xz * xz AS d FROM m), e AS (SELECT *, (yy - b * xy - c * zy) / (n - 3) AS v, 1 - (yy - b * xy - c * zy) / yy AS r2 FROM f)"
_TERMS = """k AS (SELECT biome, 'intercept' AS term, my - b * mx - c * mz AS coef, sqrt(v * (1.0 / n + (mx * mx * zz - 2 * mx * mz * xz + mz * mz * xx) / d)) AS se, n, r2 FROM e
UNION ALL SELECT biome, 'q', b, sqrt(v * zz / d), n, r2 FROM e UNION ALL SELECT biome, 'slope', c, sqrt(v * xx / d), n, r2 FROM e)"""


@query("g01_ols_two_regressors", f"WITH {{fp}}, {_MOMENTS}, {_SOLVED}, {_TERMS}, s AS (SELECT *, coef / se AS t FROM k) SELECT *, {student_p('t', '(n - 3)')} AS p FROM s", "coef se t p r2", 5)
def _(t):
    return gr.ols(t.fp(), "y", ["q", "slope"], ["biome"])


@query("g01_residual_two_regressors", f"WITH {{fp}}, {_MOMENTS}, {_SOLVED} SELECT tile, avg(y - (my - b * mx - c * mz) - b * q - c * slope) AS mean, stddev_samp(y - (my - b * mx - c * mz) - b * q - c * slope) AS sd FROM fp JOIN e USING (biome) GROUP BY tile", "mean sd", 5)
def _(t):
    return gr.fitted_residual(t.fp(), "y", ["q", "slope"], ["biome"]).groupBy("tile").agg(F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd"))


_C = "(({f}{a}{b}{g}) - ({f}{a}{g}) * ({f}{b}{g}) / ({f}n{g}))"


def _two(f: str, g: str) -> dict[str, str]:
    c = lambda a, b: f"({f}{a}{b}{g} - {f}{a}{g} * {f}{b}{g} / {f}n{g})"
    d = f"({c('x', 'x')} * {c('z', 'z')} - {c('x', 'z')} * {c('x', 'z')})"
    b = f"(({c('x', 'y')} * {c('z', 'z')} - {c('z', 'y')} * {c('x', 'z')}) / {d})"
    k = f"(({c('z', 'y')} * {c('x', 'x')} - {c('x', 'y')} * {c('x', 'z')}) / {d})"
    return {"intercept": f"(({f}y{g} - {b} * {f}x{g} - {k} * {f}z{g}) / {f}n{g})", "q": b, "slope": k}


_BLOCKS = "blocks AS (SELECT tile, count(*) AS n, sum(q) AS x, sum(slope) AS z, sum(y) AS y, sum(q * q) AS xx, sum(q * slope) AS xz, sum(slope * slope) AS zz, sum(q * y) AS xy, sum(slope * y) AS zy FROM fp GROUP BY tile)"


@query("b04_bootstrap_ols", "WITH {fp}, " + _BLOCKS + ", " + _reps("n", "x", "z", "y", "xx", "xz", "zz", "xy", "zy") + ", long AS (" + " UNION ALL ".join(f"SELECT '{k}' AS term, {v} AS v FROM reps" for k, v in _two("", "").items()) + "), tot AS (" + " UNION ALL ".join(f"SELECT '{k}' AS term, {v} AS coef FROM blocks" for k, v in _two("sum(", ")").items()) + ") SELECT term, any_value(coef) AS coef, " + CI.format(x="v") + " FROM long JOIN tot USING (term) GROUP BY term", "coef low high", 4)
def _(t):
    return gr.bootstrap_ols(t.fp(), "y", ["q", "slope"], "tile", REPLICATES)


@query("g06_residual_ladder")
def _(t):
    """Tests hold the linear and spline rungs against plain fits of every fold."""
    return gr.residual_ladder(t.fp().select("tile", "q", "sens", "y", "slope"), ("y", "slope"), ["q", "sens"], "tile", 3, REPLICATES)


def calibration(t) -> gr.Calibration:
    """Stand-ins for three sensors: the part of the price not told by the quantity, and two blends of it."""
    rows = t.fp().selectExpr(
        "tile", "y as low_ref", "q as top_ref", "0.3 * y + 4000 * slope + p as low_a", "q + slope / 5 as top_a", "0.8 * y + 2000 * slope as low_b", "q - sens * 3 as top_b")
    return gr.Calibration(rows, "tile", 15, REPLICATES)


@query("g07_calibration_summary")
def _(t):
    """Tests hold slopes, recovery and intervals against plain refits."""
    return calibration(t).summary()


@query("g07_calibration_bins")
def _(t):
    """Tests hold bins and intervals against plain refits."""
    return calibration(t).curve()


def _classes(t):
    return t.fp().selectExpr("shot", "beam", "part", "tile", "tile % 6 as site", "biome", "q", "slope", "sens", "cast(y - p + slope * 500 > 0 as int) as g", "cast(floor(least(y, 99999) / 34000) as int) as class")


@query("g12_classify_report")
def _(t):
    """Folds of whole tiles; tests hold the scores against plain ones."""
    return re_.classify_report(_classes(t), {"height": ["q"], "both": ["q", "slope", "sens"]}, "g", "tile", "biome", 3)


@query("g12_leave_one_tile_out")
def _(t):
    """One site left out at a time."""
    return re_.classify_report(_classes(t), {"both": ["q", "slope"]}, "g", "site", "biome", None)


@query("g12_permutation_importance")
def _(t):
    return re_.permutation_importance(_classes(t), ["q", "slope", "sens"], "g", "tile", 3, "perm", "shot", "beam", "part")


@query("g13_class_sets_report")
def _(t):
    """Multinomial logit on each feature set, a report per class and the averages."""
    return re_.class_sets_report(_classes(t), {"height": ["q"], "both": ["q", "slope"]}, "class", "tile", 2)


@query("g13_boosted_report")
def _(t):
    """Boosted trees, one class against the rest."""
    return re_.class_sets_report(_classes(t), {"both": ["q", "slope"]}, "class", "tile", 2, "boosted")


_RATIO = f"""b AS (SELECT CAST(ceil(q / 10) AS INT) AS band, tile, y / 1000 AS num, q AS den, y / 1000 / q AS u FROM fp), c AS (SELECT band, quantile_cont(u, 0.3333) AS lo, quantile_cont(u, 1 - 0.3333) AS hi FROM b GROUP BY band),
x AS (SELECT b.*, CASE WHEN u >= hi THEN 1 WHEN u <= lo THEN 0 END AS g FROM b JOIN c USING (band)), v AS (SELECT * FROM x WHERE g IS NOT NULL),
w AS (SELECT band, avg(num) AS num, avg(den) AS den, avg(u) AS u, regr_slope(num, den) AS b FROM v GROUP BY band), m AS (SELECT band, count(*) FILTER (g = 1) AS n_high, count(*) FILTER (g = 0) AS n_low, avg(u) FILTER (g = 1) - avg(u) FILTER (g = 0) AS d_ratio,
  avg(num) FILTER (g = 1) AS num1, avg(num) FILTER (g = 0) AS num0, avg(den) FILTER (g = 1) AS den1, avg(den) FILTER (g = 0) AS den0 FROM v GROUP BY band),
e AS (SELECT band, avg(num - w.num - w.b * (den - w.den)) FILTER (g = 1) AS residual_high, avg(num - w.num - w.b * (den - w.den)) FILTER (g = 0) AS residual_low, var_samp(num - w.b * den) FILTER (g = 1) AS v1, var_samp(num - w.b * den) FILTER (g = 0) AS v0 FROM (SELECT band, g, num, den FROM v) JOIN (SELECT band, num AS wn, den AS wd, b AS wb FROM w) USING (band) GROUP BY band)""".replace("w.num", "wn").replace("w.den", "wd").replace("w.b ", "wb ")
_RATIO += f""", nb AS (SELECT count(DISTINCT tile) AS nb FROM v), held AS (SELECT tile, row_number() OVER (ORDER BY tile) - 1 AS i FROM (SELECT DISTINCT tile FROM v)), picked AS (SELECT r, {_draw('r', 'd', 'nb')} AS i, count(*) AS k FROM nb, range({REPLICATES}) a(r), (SELECT unnest(range((SELECT nb FROM nb))) AS d) GROUP BY ALL),
s AS (SELECT band, i, count(*) FILTER (g = 1) AS n1, coalesce(sum(u) FILTER (g = 1), 0) AS s1, count(*) FILTER (g = 0) AS n0, coalesce(sum(u) FILTER (g = 0), 0) AS s0 FROM v JOIN held USING (tile) GROUP BY ALL),
reps AS (SELECT band, r, sum(s1 * k) / sum(n1 * k) - sum(s0 * k) / sum(n0 * k) AS d FROM s JOIN picked USING (i) GROUP BY ALL), ci AS (SELECT band, quantile_cont(d, 0.025) AS d_ratio_low, quantile_cont(d, 0.975) AS d_ratio_high FROM reps GROUP BY band),
t AS (SELECT band, n_high, n_low, d_ratio, num1 - num0 AS numerator_difference, den1 - den0 AS denominator_difference, (num1 - num0) / w.den AS numerator_term, -w.u * (den1 - den0) / w.den AS denominator_term, residual_high, residual_low,
  (residual_high - residual_low) / sqrt(((n_high - 1) * v1 + (n_low - 1) * v0) / (n_high + n_low - 2)) AS cohen_d, d_ratio_low, d_ratio_high FROM m JOIN w USING (band) JOIN e USING (band) JOIN ci USING (band))"""


def _ratio_bands(t):
    f = t.fp().select("tile", "q", (F.col("y") / 1000).alias("num"), fixed_bin(F.col("q"), 10).alias("band")).withColumn("u", F.col("num") / F.col("q"))
    return sg.ratio_bands(r.tercile_labels(f, "u", "band", 0.3333, 1), "band", "num", "q", "label", "tile", REPLICATES)


@query("a35_ratio_bands", "WITH {fp}, " + _RATIO + " SELECT * FROM t", "d_ratio numerator_difference denominator_difference numerator_term denominator_term residual_high residual_low cohen_d d_ratio_low d_ratio_high")
def _(t):
    return _ratio_bands(t)


@query("a35_match_check", "WITH {fp}, " + _RATIO + " SELECT count(*) AS bands, CAST(sum(n_high + n_low) AS BIGINT) AS n, sum(denominator_difference * (n_high + n_low)) / sum(n_high + n_low) AS denominator_difference, sum(d_ratio * (n_high + n_low)) / sum(n_high + n_low) AS d_ratio, sum(cohen_d * (n_high + n_low)) / sum(n_high + n_low) AS cohen_d, abs(sum(denominator_difference * (n_high + n_low)) / sum(n_high + n_low)) <= 0.5 AS ok FROM t", "denominator_difference d_ratio cohen_d")
def _(t):
    return sg.match_check(_ratio_bands(t), 0.5)


_FOLD = "('0x' || md5(concat_ws('|', 'fold', id % 10))[1:8])::BIGINT % 3 = 0"


@query("g14_profile_baselines", f"""WITH {{profiles}}, {{levels}}, l AS (SELECT id, k, profile[64] AS h, v / profile[64] AS v, (v * 0.9 + 0.02 * k) / profile[64] AS near, {_FOLD} AS test FROM levels WHERE profile[64] > 0), tr AS (SELECT * FROM l WHERE NOT test),
hs AS (SELECT DISTINCT id, h FROM tr), q AS (SELECT unnest(list_distinct(quantile_cont(h, [x / 20.0 for x in range(1, 20)]))) AS edge FROM hs), b AS (SELECT id, count(edge) AS b FROM (SELECT DISTINCT id, h FROM l) LEFT JOIN q ON edge <= h GROUP BY id),
f AS (SELECT k, avg(v) AS mean, regr_slope(v, h) AS s, regr_intercept(v, h) AS i FROM tr GROUP BY k), g AS (SELECT b, k, avg(v) AS m FROM tr JOIN b USING (id) GROUP BY ALL),
e AS (SELECT id, sqrt(avg((mean - v) * (mean - v))) AS mean, sqrt(avg((i + s * h - v) * (i + s * h - v))) AS linear, sqrt(avg((coalesce(m, mean) - v) * (coalesce(m, mean) - v))) AS bins, sqrt(avg((near - v) * (near - v))) AS near FROM l JOIN f USING (k) JOIN b USING (id) LEFT JOIN g USING (b, k) WHERE test GROUP BY id),
o AS (SELECT count(*) AS n, avg(mean) AS mean, avg(linear) AS linear, avg(bins) AS bins, avg(near) AS near FROM e), u AS (SELECT 'mean' AS model, n, mean AS rmse, near FROM o UNION ALL SELECT 'linear', n, linear, near FROM o UNION ALL SELECT 'bins', n, bins, near FROM o UNION ALL SELECT 'near', n, near, near FROM o)
SELECT model, n, rmse, (rmse - near) / rmse AS delta_near FROM u""", "rmse delta_near")
def _(t):
    p = t.profiles().withColumn("h", F.element_at("profile", -1)).where("h > 0").selectExpr("id % 10 as tile", "h", "transform(profile, x -> x / h) as shape", "transform(profile, (x, k) -> (x * 0.9 + 0.02 * k) / h) as near")
    return re_.profile_baselines(p, "shape", ["near"], "h", "tile", 3)
