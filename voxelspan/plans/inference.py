"""Queries of resampling, regression and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import matching as ma
from ..operators import regression as re_
from ..operators import resampling as rs
from ..operators.metrics import fixed_bin, interval_metrics
from .accuracy import student_p
from .registry import query

REPLICATES = 50
STEP = "(({x}) * 48271 + 12345) % 2147483647"


def _draw(r: str, d: str, n: str) -> str:
    x = f"({r} * 1000003 + {d} * 7919 + 104729) % 2147483647"
    for _ in range(3):
        x = STEP.format(x=x)
    return f"({x}) % {n}"


REPS = f"nb AS (SELECT count(*) AS nb FROM blocks), held AS (SELECT *, row_number() OVER (ORDER BY tile) - 1 AS i FROM blocks), picked AS (SELECT r, {_draw('r', 'd', 'nb')} AS i, count(*) AS k FROM nb, range({REPLICATES}) a(r), (SELECT unnest(range((SELECT nb FROM nb))) AS d) GROUP BY ALL), reps AS (SELECT r, {{sums}} FROM picked JOIN held USING (i) GROUP BY r)"


def _reps(*cols: str) -> str:
    return REPS.format(sums=", ".join(f"sum({c} * k) AS {c}" for c in cols))


CI = "quantile_cont({x}, 0.025) AS low, quantile_cont({x}, 0.975) AS high"
ERRORS = "blocks AS (SELECT tile, count(*) AS n, sum(p - y) AS ea, sum(p2 - y) AS eb, sum(abs(p - y)) AS aa, sum(abs(p2 - y)) AS ab, sum((p - y) * (p - y)) AS sa, sum((p2 - y) * (p2 - y)) AS sb FROM fp GROUP BY tile)"
DIFF = {"rmse": "sqrt({f}sa{g} / {f}n{g}) - sqrt({f}sb{g} / {f}n{g})", "mae": "({f}aa{g} - {f}ab{g}) / {f}n{g}", "me": "({f}ea{g} - {f}eb{g}) / {f}n{g}", "abs_me": "abs({f}ea{g} / {f}n{g}) - abs({f}eb{g} / {f}n{g})"}


@query("b01_bootstrap_metric_diff", "WITH {fp}, " + ERRORS + ", " + _reps("n", "ea", "eb", "aa", "ab", "sa", "sb") + ", long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {x.format(f='', g='')} AS v FROM reps" for m, x in DIFF.items()) + "), tot AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {x.format(f='sum(', g=')')} AS difference FROM blocks" for m, x in DIFF.items()) + ") SELECT metric, any_value(difference) AS difference, " + CI.format(x="v") + f", greatest(least(2 * least(avg((v <= 0)::INT), avg((v >= 0)::INT)), 1), 1.0 / {REPLICATES}) AS p FROM long JOIN tot USING (metric) GROUP BY metric", "difference low high p")
def _(t):
    return rs.bootstrap_metric_diff(t.fp(), "y", "p", "p2", "tile", REPLICATES)


@query("b02_bootstrap_mean_ci", "WITH {fp}, blocks AS (SELECT tile, count(*) AS n, sum(y) AS s FROM fp GROUP BY tile), " + _reps("n", "s") + " SELECT (SELECT sum(s) / sum(n) FROM blocks) AS mean, " + CI.format(x="s / n") + " FROM reps", "mean low high")
def _(t):
    return rs.bootstrap_mean_ci(t.fp(), "y", "tile", REPLICATES)


CORR = "({f}xy{g} - {f}x{g} * {f}y{g} / {f}n{g}) / sqrt(({f}xx{g} - {f}x{g} * {f}x{g} / {f}n{g}) * ({f}yy{g} - {f}y{g} * {f}y{g} / {f}n{g}))"


@query("b02_bootstrap_corr_ci", "WITH {fp}, blocks AS (SELECT tile, count(*) AS n, sum(q) AS x, sum(y) AS y, sum(q * q) AS xx, sum(y * y) AS yy, sum(q * y) AS xy FROM fp GROUP BY tile), " + _reps("n", "x", "y", "xx", "yy", "xy") + f" SELECT (SELECT {CORR.format(f='sum(', g=')')} FROM blocks) AS r, " + CI.format(x=CORR.format(f="", g="")) + " FROM reps", "r low high")
def _(t):
    return rs.bootstrap_corr_ci(t.fp(), "q", "y", "tile", REPLICATES)


@query("b03_bootstrap_diff_ci", "WITH {fp}, blocks AS (SELECT tile, count(*) FILTER (flag = 'R') AS n1, coalesce(sum(y) FILTER (flag = 'R'), 0) AS s1, count(*) FILTER (flag <> 'R') AS n0, coalesce(sum(y) FILTER (flag <> 'R'), 0) AS s0 FROM fp GROUP BY tile), " + _reps("n1", "s1", "n0", "s0") + " SELECT (SELECT sum(s1) / sum(n1) - sum(s0) / sum(n0) FROM blocks) AS difference, " + CI.format(x="s1 / n1 - s0 / n0") + " FROM reps", "difference low high")
def _(t):
    return rs.bootstrap_diff_ci(t.fp().withColumn("g", (F.col("flag") == "R").cast("int")), "y", "g", "tile", REPLICATES)


@query("b04_block_bootstrap_slope", "WITH {fp}, blocks AS (SELECT tile, count(*) AS n, sum(q) AS x, sum(y) AS y, sum(q * q) AS xx, sum(q * y) AS xy FROM fp GROUP BY tile), " + _reps("n", "x", "y", "xx", "xy") + " SELECT (SELECT (sum(xy) - sum(x) * sum(y) / sum(n)) / (sum(xx) - sum(x) * sum(x) / sum(n)) FROM blocks) AS slope, " + CI.format(x="(xy - x * y / n) / (xx - x * x / n)") + " FROM reps", "slope low high")
def _(t):
    return rs.bootstrap_slope(t.fp(), "y", "q", "tile", REPLICATES)


@query("r24_image_bootstrap_change")
def _(t):
    """Days as images of weeks as years; checked by its properties in the tests."""
    e = t.events.selectExpr("user_id as pixel", "weekofyear(ts) as year", "dayofyear(ts) as image", "value")
    one = e.groupBy("pixel", "year", "image").agg(F.max("value").alias("value"))
    return rs.image_bootstrap(one, "pixel", "year", "image", "value", 5)


# regression

@query("g01_ols_fit", "WITH {fp} SELECT biome, count(*) AS n, regr_slope(y, q) AS slope, regr_intercept(y, q) AS intercept FROM fp GROUP BY biome", "slope intercept")
def _(t):
    return re_.ols_fit(t.fp(), "y", "q", ["biome"])


@query("g01_ols_residual", "WITH {fp}, f AS (SELECT biome, regr_slope(y, q) AS s, regr_intercept(y, q) AS i FROM fp GROUP BY biome) SELECT tile, avg(y - s * q - i) AS mean, stddev_samp(y - s * q - i) AS sd FROM fp JOIN f USING (biome) GROUP BY tile", "mean sd")
def _(t):
    return re_.ols_residual(t.fp(), "y", "q", ["biome"]).groupBy("tile").agg(F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd"))


PC = "(({ab}) - ({ac}) * ({bc})) / sqrt((1 - ({ac}) * ({ac})) * (1 - ({bc}) * ({bc})))"


def _partial_sql(by: str, x: str, y: str, z: str, source: str, more: str = "") -> str:
    xy, xw, yw = PC.format(ab="xy", ac="xz", bc="yz"), PC.format(ab="xw", ac="xz", bc="zw"), PC.format(ab="yw", ac="yz", bc="zw")
    inner = f"SELECT {by}count(*) AS n, corr({x}, {y}) AS xy, corr({x}, {z}) AS xz, corr({y}, {z}) AS yz, corr({x}, {z} * {z}) AS xw, corr({y}, {z} * {z}) AS yw, corr({z}, {z} * {z}) AS zw FROM {source}" + (f" GROUP BY {by.rstrip(', ')}" if by else "")
    return f"SELECT {by}{more}n, xy AS r, CASE WHEN n >= 10 THEN {PC.format(ab=xy, ac=xw, bc=yw)} END AS partial_r, n - 4 AS df FROM ({inner})"


@query("g02_partial_corr", "WITH {fp} " + _partial_sql("biome, ", "y", "slope", "q", "fp"), "r partial_r")
def _(t):
    return re_.partial_corr(t.fp(), "y", "slope", "q", ["biome"])


@query("g03_structure_partial_report", "WITH {fp}, b AS (SELECT 'slope' AS metric, avg(r) AS binned_r, count(*) AS bins FROM (SELECT ceil(q / 10), corr(slope, y) AS r FROM fp GROUP BY 1 HAVING count(*) >= 20) UNION ALL SELECT 'sens', avg(r), count(*) FROM (SELECT ceil(q / 10), corr(sens, y) AS r FROM fp GROUP BY 1 HAVING count(*) >= 20)), p AS (" + _partial_sql("", "slope", "y", "q", "fp", "'slope' AS metric, ") + " UNION ALL " + _partial_sql("", "sens", "y", "q", "fp", "'sens' AS metric, ") + ") SELECT metric, n, r, partial_r, binned_r, bins FROM p JOIN b USING (metric)", "r partial_r binned_r")
def _(t):
    return re_.structure_report(t.fp(), ["slope", "sens"], "y", "q", 10, 20)


@query("g04_cross_sensor_report", "WITH {fp}, l AS (SELECT '1' AS level, y AS t, p + slope AS v, q FROM fp WHERE sens >= 0.95 UNION ALL SELECT '2', y, p2 - slope, q FROM fp WHERE sens >= 0.95), e AS (SELECT level, count(*) AS n, avg(v - t) AS me, avg(abs(v - t)) AS mae, sqrt(avg((v - t) * (v - t))) AS rmse, 1 - sum((v - t) * (v - t)) / (sum(t * t) - sum(t) * sum(t) / count(*)) AS r2, corr(t, v) AS r FROM l GROUP BY level), p AS (" + _partial_sql("level, ", "t", "v", "q", "l") + ") SELECT e.*, p.partial_r FROM e JOIN p ON e.level = p.level", "me mae rmse r2 r partial_r")
def _(t):
    f = t.fp().withColumns({"a": F.col("p") + F.col("slope"), "b": F.col("p2") - F.col("slope")})
    return re_.cross_sensor_report(f, {"1": ("y", "a"), "2": ("y", "b")}, "q", F.col("sens") >= 0.95)


@query("g07_calibration_curve", "WITH {fp} SELECT CAST(ceil(q / 10) AS INT) AS bin, count(*) AS n, avg(q) AS mean_x, avg(y) AS mean_y, regr_slope(y, q) AS slope, regr_slope(y, q) / (SELECT regr_slope(y, q) FROM fp) AS slope_ratio FROM fp GROUP BY 1", "mean_x mean_y slope slope_ratio")
def _(t):
    return re_.calibration_curve(t.fp().withColumn("bin", fixed_bin(F.col("q"), 10)), "y", "q", "bin")


@query("g08_sens_residual_corr", "WITH {fp}, f AS (SELECT biome, regr_slope(y, q) AS s, regr_intercept(y, q) AS i, regr_slope(slope, q) AS s2, regr_intercept(slope, q) AS i2 FROM fp GROUP BY biome), r AS (SELECT biome, y, y - s * q - i AS a, slope - s2 * q - i2 AS b FROM fp JOIN f USING (biome)) SELECT biome, count(*) AS n, corr(a, b) AS r, stddev_samp(a) AS sd_a, stddev_samp(b) AS sd_b, stddev_samp(a) / stddev_samp(y) AS u FROM r GROUP BY biome", "r sd_a sd_b u")
def _(t):
    return re_.sens_residual_corr(t.fp(), "y", "slope", "q", "biome")


@query("g09_random_intercept_fit")
def _(t):
    """A test holds it against dense matrices."""
    f = t.fp().select("y", (F.col("flag") == "R").cast("int").alias("high"), "q", "status", "biome")
    fits = re_.random_intercept_fit(f, "y", ["high", "q"], "biome", ["status"])
    return fits.select("status", "term", *(F.round(c, 3).alias(c) for c in ("coef", "se", "low", "high")), F.round("p", 4).alias("p"), "n", "bands")


@query("g10_ratio_decomposition", "WITH {fp}, m AS (SELECT biome, avg(y) FILTER (flag = 'R') AS na, avg(p) FILTER (flag = 'R') AS da, avg(y) FILTER (flag <> 'R') AS nb, avg(p) FILTER (flag <> 'R') AS db FROM fp GROUP BY biome), c AS (SELECT biome, ln(na / nb) AS num, -ln(da / db) AS den FROM m) SELECT biome, num + den AS contrast, num / (num + den) AS numerator_share, den / (num + den) AS denominator_share FROM c", "contrast numerator_share denominator_share")
def _(t):
    of = lambda c, hit: F.avg(F.when(hit, F.col(c)))
    high = F.col("flag") == "R"
    m = t.fp().groupBy("biome").agg(of("y", high).alias("na"), of("p", high).alias("da"), of("y", ~high).alias("nb"), of("p", ~high).alias("db"))
    return m.select("biome", *(c.alias(k) for k, c in C.ratio_shares(*map(F.col, ("na", "da", "nb", "db"))).items()))


@query("g11_interaction_test", "WITH {fp}, g AS (SELECT (flag = 'R')::INT AS g, count(*) AS n, regr_slope(y, sens) AS s, regr_syy(y, sens) AS syy, regr_sxx(y, sens) AS sxx, regr_sxy(y, sens) AS sxy FROM fp GROUP BY 1), v AS (SELECT g, s, (syy - sxy * sxy / sxx) / (n - 2) / sxx AS v, n FROM g), w AS (SELECT max(s) FILTER (g = 1) AS slope_high, max(s) FILTER (g = 0) AS slope_low, max(s) FILTER (g = 1) - max(s) FILTER (g = 0) AS interaction, (max(s) FILTER (g = 1) - max(s) FILTER (g = 0)) / sqrt(max(v) FILTER (g = 1) + max(v) FILTER (g = 0)) AS z, pow(max(v) FILTER (g = 1) + max(v) FILTER (g = 0), 2) / (pow(max(v) FILTER (g = 1), 2) / (max(n) FILTER (g = 1) - 2) + pow(max(v) FILTER (g = 0), 2) / (max(n) FILTER (g = 0) - 2)) AS df FROM v) SELECT * EXCLUDE (df), " + student_p("z", "df") + " AS p FROM w", "slope_high slope_low interaction z p", 4)
def _(t):
    return re_.interaction_test(t.fp().withColumn("g", (F.col("flag") == "R").cast("int")), "y", "sens", "g")


@query("g11_bin_trend", "WITH {fp}, m AS (SELECT CAST(ceil(q / 10) AS INT) AS b, avg(y) AS m FROM fp GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY b) AS x, rank() OVER (ORDER BY m) AS y FROM m) SELECT count(*) AS bins, regr_slope(m, b) AS slope, corr(x, y) AS spearman FROM r", "slope spearman")
def _(t):
    return re_.bin_trend(t.fp().withColumn("b", fixed_bin(F.col("q"), 10)), "b", "y")


def _labelled(t):
    return t.fp().select("tile", "q", "slope", "sens", "y", ((F.col("y") - F.col("p")) > 0).cast("int").alias("g"))


@query("g05_height_model_residual")
def _(t):
    f = t.fp().select("tile", "q", "y", "sens")
    return re_.height_model_residual(f, F.col("sens") >= 0.95, "q", "y", "spline", [10.0, 25.0, 40.0]).groupBy("tile").agg(F.count("*").alias("n"), F.round(F.avg("residual"), 2).alias("residual"))


@query("g06_oof_residual_corr")
def _(t):
    return re_.oof_residual_corr(t.fp().select("tile", "q", "y", "slope"), ("y", "slope"), "q", "tile", 2)


@query("g12_grouped_cv_classify")
def _(t):
    return re_.grouped_cv_classify(_labelled(t), ["q", "slope", "sens"], "g", "tile", 3)


@query("g13_multinomial_classify")
def _(t):
    rows = t.fp().selectExpr("tile", "q", "slope", "y", "cast(floor(least(y, 99999) / 34000) as int) as class")
    return re_.multinomial_classify(rows, {"height": ["q"], "both": ["q", "slope"]}, "class", "tile", 2)


@query("g14_shape_baselines")
def _(t):
    return re_.shape_baselines(t.fp().select("tile", "q", "y"), "y", "q", "tile", 2)


@query("g15_complexity_corr", "WITH {fp}, f AS (SELECT regr_slope(y, q) AS s, regr_intercept(y, q) AS i FROM fp) SELECT biome, count(*) AS n, corr(y - s * q - i, slope) AS r FROM fp, f GROUP BY biome", "r")
def _(t):
    res = re_.ols_residual(t.fp(), "y", "q", [])
    return res.groupBy("biome").agg(F.count("*").alias("n"), F.corr("residual", "slope").alias("r"))


@query("b05_image_bootstrap")
def _(t):
    """Median per replicate and week of images (days) drawn with replacement; a test holds it against a plain loop."""
    e = t.events.selectExpr("user_id as pixel", "weekofyear(ts) as year", "dayofyear(ts) as image", "value").groupBy("pixel", "year", "image").agg(F.max("value").alias("value"))
    return rs.image_bootstrap(e, "pixel", "year", "image", "value", 3)


@query("w14_points_in_polygons")
def _(t):
    """Points drawn in each box; their number and place are checked in the tests."""
    return ma.points_in_boxes(t.boxes(), "name", ("x0", "y0", "x1", "y1"), 5, "pts")


@query("w15_greedy_match")
def _(t):
    f = t.fp().selectExpr("biome", "concat_ws('-', cast(shot as string), cast(beam as string), cast(part as string), cast(tile as string)) as id", "y as height", "cast(flag = 'R' as int) as high")
    f = f.repartition("biome", "id", "high").groupBy("biome", "id", "high").agg(F.max("height").alias("height"))  # ids seldom repeat: grouping them before the shuffle saves nothing
    return ma.greedy_match(f, "biome", "id", "height", "high", 3.0)


@query("t03_hodges_lehmann", "WITH a AS (SELECT s_nationkey % 5 AS g, s_acctbal AS v FROM supplier), b AS (SELECT c_nationkey % 5 AS g, c_acctbal AS v FROM customer) SELECT g, median(a.v - b.v) AS shift, count(*) AS pairs FROM a JOIN b USING (g) GROUP BY g", "shift")
def _(t):
    a = t.supplier.selectExpr("s_nationkey % 5 as g", "s_acctbal as v")
    b = t.customer.selectExpr("c_nationkey % 5 as g", "c_acctbal as v")
    return ma.hodges_lehmann(a, b, "v", "g")


@query("t03_pseudomedian", "WITH a AS (SELECT c_nationkey AS g, c_acctbal AS v, CAST(c_custkey AS VARCHAR) AS id FROM customer) SELECT g, median((x.v + y.v) / 2) AS pseudomedian, count(*) AS pairs FROM a x JOIN a y USING (g) WHERE x.id <= y.id GROUP BY g", "pseudomedian")
def _(t):
    return ma.pseudomedian(t.customer.selectExpr("c_nationkey as g", "c_acctbal as v"), "v", "g")


@query("r03_vertical_profile")
def _(t):
    return ma.vertical_profiles(t.profiles(), "id", "profile", 2.0).select("id", F.size("density").alias("steps"), F.round(F.aggregate("density", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("y15_variant_compare", "WITH {triples}, v AS (SELECT 'a' AS variant, y, lo, mid, hi FROM triples UNION ALL SELECT 'c', y, lo + 1000, mid + 1000, hi + 1000 FROM triples) SELECT variant, count(*) AS n, avg((y BETWEEN lo AND hi)::INT) AS coverage, avg((y > hi)::INT) AS above, avg((y < lo)::INT) AS below, median(mid - y) AS median_bias, avg(abs(mid - y)) AS mae, avg(hi - lo) AS width FROM v GROUP BY variant", "coverage above below median_bias mae width")
def _(t):
    v = t.triples().select("y", F.expr("stack(2, 'a', lo, mid, hi, 'c', lo + 1000, mid + 1000, hi + 1000) as (variant, lo, mid, hi)"))
    return interval_metrics(v, "y", "lo", "hi", "mid", ["variant"])
