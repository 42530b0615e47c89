"""Queries of tests with p values, report averages, exact shifts and coverage by method."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformal as cp
from ..operators import metrics as m
from ..operators import ranking as r
from ..operators import regression as re_
from ..operators import resampling as rs
from ..operators import series as se
from ..operators import significance as sg
from .accuracy import ERR, RANKS, REPORT, SIGNED, _f1_sql, _holm_sql, _signed, student_p
from .inference import CI, DIFF, ERRORS, REPLICATES, _reps
from .registry import query

R_P = student_p("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")


@query("a01_error_tests", "WITH {fp}, e AS (SELECT tile, " + ERR + " FROM fp GROUP BY tile) SELECT *, " + R_P + " AS p FROM e", "me mae rmse r2 r p")
def _(t):
    return m.error_tests(t.fp(), "y", "p", ["tile"])


@query("a17_class_report_averages", "WITH {classes}, c AS (" + REPORT.replace("{p}", "a") + """)
SELECT CAST(class AS VARCHAR) AS class, support, precision, recall, f1, accuracy FROM c
UNION ALL SELECT 'macro', sum(support), avg(coalesce(precision, 0)), avg(coalesce(recall, 0)), avg(coalesce(f1, 0)), (SELECT avg((truth = a)::INT) FROM classes) FROM c
UNION ALL SELECT 'weighted', sum(support), sum(coalesce(precision, 0) * support) / sum(support), sum(coalesce(recall, 0) * support) / sum(support), sum(coalesce(f1, 0) * support) / sum(support), (SELECT avg((truth = a)::INT) FROM classes) FROM c""", "support precision recall f1 accuracy")
def _(t):
    return m.class_report_averages(t.classes(), "truth", "a")


_CORR = "count(*) AS n, corr(y, slope) AS pearson, corr(a, b) AS spearman, corr(y, slope) * corr(y, slope) AS r_squared"


@query("a33_correlation_overall", "WITH {fp}, " + RANKS.format(by="tile", x="y", y="slope") + ", g AS (SELECT tile, " + _CORR + " FROM rx GROUP BY tile HAVING count(*) >= 30), o AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY slope) + (count(*) OVER (PARTITION BY slope) - 1) / 2.0 AS b FROM fp), u AS (SELECT tile, n, pearson, spearman, r_squared, false AS overall FROM g UNION ALL SELECT NULL, " + _CORR + ", true FROM o) SELECT *, " + R_P.replace("r * ", "pearson * ").replace("1 - r * r", "1 - pearson * pearson").replace("pearson * r", "pearson * pearson") + " AS p FROM u", "pearson spearman r_squared p")
def _(t):
    return m.correlation_report(t.fp(), "y", "slope", ["tile"], 30)


_PAIRED = "c AS (SELECT c_nationkey AS g, c_acctbal AS a, CAST((c_custkey * 37) % 10000 AS DOUBLE) AS b FROM customer)"


@query("t01_wilcoxon_shift", "WITH " + _PAIRED + ", " + _signed("c", "g") + """, e AS (SELECT g, a - b AS d, row_number() OVER (PARTITION BY g ORDER BY a, b) AS i FROM c),
h AS (SELECT x.g, median((x.d + y.d) / 2) AS hodges_lehmann FROM e x JOIN e y ON x.g = y.g AND x.i <= y.i GROUP BY x.g) SELECT q.*, hodges_lehmann, p < 0.05 AND hodges_lehmann < 0 AS a_better FROM q JOIN h USING (g)""", "w_plus median_difference a_lower rank_biserial z p hodges_lehmann")
def _(t):
    rows = t.customer.selectExpr("c_nationkey as g", "c_acctbal as a", "cast((c_custkey * 37) % 10000 as double) as b")
    return r.paired_wilcoxon_shift(rows, "a", "b", "g").drop("p_exact")


@query("t02_rank_sum_shift", "WITH c AS (SELECT c_nationkey AS g, (c_mktsegment = 'BUILDING')::INT AS k, c_acctbal AS v FROM customer) SELECT g, (SELECT median(x.v - y.v) FROM c x JOIN c y USING (g) WHERE x.k = 1 AND y.k = 0 AND x.g = o.g) AS shift, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 0) AS n0, (SELECT sum((x.v > y.v)::INT + (x.v = y.v)::INT / 2) FROM c x JOIN c y USING (g) WHERE x.k = 1 AND y.k = 0 AND x.g = o.g) AS u FROM c o GROUP BY g", "shift u")
def _(t):
    rows = t.customer.selectExpr("c_nationkey as g", "cast(c_mktsegment = 'BUILDING' as int) as k", "c_acctbal as v")
    return r.rank_sum_shift(rows, "v", "k", "g").select("g", "shift", "n1", "n0", "u")


@query("t06_cell_tests_macro", "WITH {classes}, big AS (SELECT cell FROM classes GROUP BY cell HAVING count(*) >= 20), f AS (SELECT cell, x.class, x.f1 AS a, y.f1 AS b FROM " + _f1_sql("a") + " x JOIN " + _f1_sql("b") + " y USING (cell, class) JOIN big USING (cell)), e AS (SELECT class, a, b FROM f), w AS (WITH " + _signed("e", "class") + " " + _holm_sql("", "class") + "), m AS (SELECT 1 AS class, avg(a) AS a, avg(b) AS b FROM f GROUP BY cell), v AS (WITH " + _signed("m", "class").replace("m AS (", "mm AS (").replace("JOIN m USING", "JOIN mm USING") + " SELECT * FROM q) SELECT *, false AS macro FROM w UNION ALL SELECT * REPLACE (NULL AS class), NULL AS p_holm, true AS macro FROM v", SIGNED, 4)
def _(t):
    return sg.cell_paired_tests(t.classes(), "truth", "a", "b", "cell", 20, macro=True).drop("p_exact")


_METHODS = "[" + ", ".join(f"'{x}'" for x in cp.METHODS) + "]"
COVERAGE = """r AS (SELECT *, tile % 3 AS level FROM triples), x AS (SELECT r.*, method,
    CASE method[-2:] WHEN '_r' THEN CASE WHEN hi - lo > 0 THEN hi - lo ELSE 1 END WHEN '_m' THEN CASE WHEN mid - lo > 0 THEN mid - lo ELSE 1 END ELSE 1 END AS wl,
    CASE method[-2:] WHEN '_r' THEN CASE WHEN hi - lo > 0 THEN hi - lo ELSE 1 END WHEN '_m' THEN CASE WHEN hi - mid > 0 THEN hi - mid ELSE 1 END ELSE 1 END AS wh FROM r, (SELECT unnest(""" + _METHODS + """) AS method)),
k AS (SELECT biome, level, method, count(*) AS n, list_sort(list((lo - y) / wl)) AS a, list_sort(list((y - hi) / wh)) AS b, list_sort(list(greatest((lo - y) / wl, (y - hi) / wh))) AS c FROM x GROUP BY ALL),
o AS (SELECT biome, level, method, CASE WHEN method LIKE 'se%' THEN a[CAST(ceil((n + 1) * 0.95) AS BIGINT)] ELSE c[CAST(ceil((n + 1) * 0.9) AS BIGINT)] END AS ql, CASE WHEN method LIKE 'se%' THEN b[CAST(ceil((n + 1) * 0.95) AS BIGINT)] ELSE c[CAST(ceil((n + 1) * 0.9) AS BIGINT)] END AS qh FROM k),
z AS (SELECT x.*, coalesce(lo - ql * wl, lo) AS cal_lo, coalesce(hi + qh * wh, hi) AS cal_hi FROM x JOIN o USING (biome, level, method)),
g AS (SELECT method, biome, level, count(*) AS n, avg((y BETWEEN lo AND hi)::INT) AS coverage, avg((y BETWEEN cal_lo AND cal_hi)::INT) AS cal_coverage, avg(hi - lo) / 10 AS width, avg(cal_hi - cal_lo) / 10 AS cal_width FROM z GROUP BY ALL),
rep AS (SELECT *, false AS all_groups FROM g UNION ALL SELECT method, NULL, level, sum(n), sum(coverage * n) / sum(n), sum(cal_coverage * n) / sum(n), sum(width * n) / sum(n), sum(cal_width * n) / sum(n), true FROM g GROUP BY method, level)"""


def _by_method(t):
    rows = t.triples().withColumn("level", F.expr("tile % 3"))
    offsets = cp.fit_all_offsets(rows, cp.METHODS, ["biome", "level"], "y", "lo", "mid", "hi", 0.1)
    report = cp.coverage_of_methods(rows, offsets, cp.METHODS, ["biome", "level"], "y", "lo", "mid", "hi")
    return cp.with_all_groups(report, "biome", "level")


@query("c04_coverage_by_method", "WITH {triples}, " + COVERAGE + " SELECT * REPLACE (CAST(n AS BIGINT) AS n) FROM rep", "coverage cal_coverage width cal_width")
def _(t):
    return _by_method(t)


@query("c04_coverage_pivot", "WITH {triples}, " + COVERAGE + " SELECT biome, level, all_groups, " + ", ".join(f"max(cal_coverage) FILTER (method = '{x}') AS {x}" for x in cp.METHODS) + " FROM rep GROUP BY biome, level, all_groups", " ".join(cp.METHODS))
def _(t):
    return cp.coverage_pivot(_by_method(t), "biome", "level", cp.METHODS)


@query("y06_anomaly_summary", "WITH {series}, c AS (SELECT tile, avg(value) FILTER (year = 10) - avg(value) FILTER (year IN (1, 2, 3)) AS change, pixel % 4 AS g, pixel, ((pixel * 37) % 101) * 1.5 AS anomaly FROM series GROUP BY tile, pixel), d AS (SELECT * FROM c WHERE change IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY change) + (count(*) OVER (PARTITION BY change) - 1) / 2.0 AS a, rank() OVER (ORDER BY anomaly) + (count(*) OVER (PARTITION BY anomaly) - 1) / 2.0 AS b FROM d) SELECT g, count(*) AS n, median(change) AS median_change, median(anomaly) AS median_anomaly, NULL AS spearman, false AS overall FROM d GROUP BY g UNION ALL SELECT NULL, count(*), median(change), median(anomaly), corr(a, b), true FROM r", "median_change median_anomaly spearman")
def _(t):
    s = t.series()
    anomalies = s.select("pixel").distinct().withColumn("anomaly", F.expr("((pixel * 37) % 101) * 1.5"))
    changes = se.anomaly_change(s, anomalies, "pixel", "year", "value", 10, [1, 2, 3], "anomaly")
    return se.anomaly_summary(changes.withColumn("g", F.expr("pixel % 4")), "g", "change", "anomaly")


_LEAK = "l AS (SELECT user_id % 10 AS tile, user_id AS pixel, dayofmonth(ts) AS year, count(*) FILTER (event_type <> 'error' AND value < 50) / nullif(count(*) FILTER (event_type <> 'error'), 0) AS share, avg(value) AS dev FROM events GROUP BY ALL), k AS (SELECT * FROM l WHERE share IS NOT NULL)"


def _leak(t):
    e = t.events.selectExpr("user_id as pixel", "dayofmonth(ts) as year", "event_type", "value")
    leak = se.cloud_leak(e, "pixel", "year", F.col("event_type") != "error", "value", 50)
    return leak.join(e.groupBy("pixel", "year").agg(F.avg("value").alias("dev")), ["pixel", "year"]).withColumn("tile", F.expr("pixel % 10"))


@query("y08_cloud_leak_tiles", "WITH " + _LEAK + " SELECT tile, year, count(*) AS n, median(share) AS share_median FROM k GROUP BY tile, year", "share_median")
def _(t):
    return se.cloud_leak_tiles(_leak(t), "tile", "year")


@query("y08_cloud_leak_bins", "WITH " + _LEAK + " SELECT (share >= 0.2)::INT + (share >= 0.5)::INT + (share >= 0.8)::INT AS bin, count(*) AS n, median(dev) AS deviation_median, median(share) AS share_median FROM k WHERE share BETWEEN 0 AND 1 GROUP BY 1", "deviation_median share_median")
def _(t):
    return se.cloud_leak_bins(_leak(t), "dev", [0.0, 0.2, 0.5, 0.8, 1.0])


@query("y10_darkest_clear", "SELECT dayofmonth(ts) AS image, count(*) AS n_clear, CASE WHEN count(*) >= 50 THEN quantile_cont(value, 0.02) END AS p2_clear FROM events WHERE event_type <> 'error' AND value IS NOT NULL GROUP BY 1", "p2_clear")
def _(t):
    return se.darkest_clear(t.events.selectExpr("dayofmonth(ts) as image", "value", "event_type"), "image", "value", F.col("event_type") != "error")


_ROWS = "fp AS (SELECT c_custkey AS tile, c_acctbal AS y, c_acctbal + (c_custkey * 13) % 1000 - 500 AS p, c_acctbal + (c_custkey * 29) % 1400 - 600 AS p2 FROM customer)"


@query("b01_bootstrap_iid", "WITH " + _ROWS + ", " + ERRORS + ", " + _reps("n", "ea", "eb", "aa", "ab", "sa", "sb") + ", long AS (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, {x.format(f='', g='')} AS v FROM reps" for k, x in DIFF.items()) + "), tot AS (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, {x.format(f='sum(', g=')')} AS difference FROM blocks" for k, x in DIFF.items()) + ") SELECT metric, any_value(difference) AS difference, " + CI.format(x="v") + f", greatest(least(2 * least(avg((v <= 0)::INT), avg((v >= 0)::INT)), 1), 1.0 / {REPLICATES}) AS p FROM long JOIN tot USING (metric) GROUP BY metric", "difference low high p")
def _(t):
    """Single rows drawn: the block is a row's id."""
    rows = t.customer.selectExpr("c_custkey as id", "c_acctbal as y", "c_acctbal + (c_custkey * 13) % 1000 - 500 as p", "c_acctbal + (c_custkey * 29) % 1400 - 600 as p2")
    return rs.bootstrap_metric_diff(rows, "y", "p", "p2", "id", REPLICATES)


@query("g15_complexity_report", "WITH {fp}, f AS (SELECT regr_slope(y, q) AS s, regr_intercept(y, q) AS i FROM fp), e AS (SELECT biome, round(y - s * q - i, 4) AS y, slope FROM fp, f), rx AS (SELECT *, rank() OVER (PARTITION BY biome ORDER BY y) + (count(*) OVER (PARTITION BY biome, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY biome ORDER BY slope) + (count(*) OVER (PARTITION BY biome, slope) - 1) / 2.0 AS b FROM e), o AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY slope) + (count(*) OVER (PARTITION BY slope) - 1) / 2.0 AS b FROM e), u AS (SELECT biome, " + _CORR + ", false AS overall FROM rx GROUP BY biome HAVING count(*) >= 30 UNION ALL SELECT NULL, " + _CORR + ", true FROM o) SELECT *, " + student_p("(pearson * sqrt((n - 2) / (1 - pearson * pearson)))", "(n - 2)") + " AS p FROM u", "pearson spearman r_squared p", 5)
def _(t):
    rows = re_.ols_residual(t.fp(), "y", "q", []).select("biome", F.round("residual", 4).alias("residual"), "slope")
    return m.correlation_report(rows, "residual", "slope", ["biome"], 30)
