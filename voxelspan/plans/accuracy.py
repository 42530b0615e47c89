"""Queries of the aggregations, ranks and conformal calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import conformal as cp
from ..operators import metrics as m
from ..operators import ranking as r
from ..operators import significance as sg
from .registry import query



def student_p(t: str, df: str) -> str:
    """Two-sided tail of Student's t: the density summed by Simpson's rule from 0 to |t| (40 at most)."""
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * pow(1 + node_x * node_x / {df}, -({df} + 1) / 2)"
    nodes = f"SELECT node_i, node_h, node_i * node_h AS node_x FROM (SELECT node_i, least(abs({t}), 40) / 4000 AS node_h FROM range(4001) nodes(node_i))"
    return f"CASE WHEN {df} > 0 THEN greatest(0, 1 - 2 * (SELECT sum(node_h / 3 * CASE WHEN node_i IN (0, 4000) THEN 1 WHEN node_i % 2 = 1 THEN 4 ELSE 2 END * {density}) FROM ({nodes}))) END"


ERR = "count(*) AS n, avg(p - y) AS me, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, CASE WHEN sum(y * y) - sum(y) * sum(y) / count(*) > 0 THEN 1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)) END AS r2, corr(y, p) AS r"


@query("a01_error_metrics", "WITH {fp} SELECT tile, " + ERR + " FROM fp GROUP BY tile", "me mae rmse r2 r")
def _(t):
    return m.error_metrics(t.fp(), "y", "p", ["tile"])


@query("a02_pooled_from_tiles", "WITH {fp} SELECT biome, count(*) AS n, sqrt(avg((p - y) * (p - y))) AS rmse, avg(p - y) AS me, 1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM fp GROUP BY biome", "rmse me r2")
def _(t):
    sums = m.tile_sums(t.fp(), "y", "p", "tile").withColumn("biome", F.expr("tile % 14 + 1"))
    return m.pooled_from_tiles(sums, ["biome"])


@query("a03_thresholded_metrics", "WITH {fp} SELECT biome, count(*) AS n, avg(p - y) AS me, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(CASE WHEN y <> 0 THEN abs((p - y) / y) END) AS mape FROM fp WHERE q > 10 GROUP BY biome", "me mae rmse mape")
def _(t):
    return m.thresholded_metrics(t.fp(), "y", "p", "q", 10, "biome")


@query("a04_group_residual_stats", "WITH {profiles}, {levels} SELECT CAST(least(k // 10, 5) AS INT) AS level_group, count(*) AS n, stddev_pop(v) AS sd, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95 FROM levels GROUP BY 1", "sd p5 p25 p50 p75 p95", 3)
def _(t):
    levels = t.profiles().select("id", F.posexplode("profile").alias("k", "v"))
    return m.group_residual_stats(levels, "v", "k", 10, 64)


@query("a05_interval_metrics", "WITH {triples} SELECT tile, count(*) AS n, avg((y BETWEEN lo AND hi)::INT) AS coverage, avg((y > hi)::INT) AS above, avg((y < lo)::INT) AS below, median(mid - y) AS median_bias, avg(abs(mid - y)) AS mae, avg(hi - lo) AS width FROM triples GROUP BY tile", "coverage above below median_bias mae width")
def _(t):
    return m.interval_metrics(t.triples(), "y", "lo", "hi", "mid", ["tile"])


@query("a06_accuracy_report", """WITH {fp}, tiles AS (SELECT biome, tile, count(*) AS n, avg(p - y) AS me, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse FROM fp GROUP BY ALL)
SELECT biome, CAST(grouping(biome) AS INT) AS pooled, CAST(sum(n) AS BIGINT) AS n, sum(me * n) / sum(n) AS me, sum(mae * n) / sum(n) AS mae, sum(rmse * n) / sum(n) AS rmse FROM tiles GROUP BY GROUPING SETS ((biome), ())""", "me mae rmse")
def _(t):
    """Metrics per tile, pooled per biome and over all by number of points."""
    tiles = m.error_metrics(t.fp(), "y", "p", ["biome", "tile"])
    return m.weighted_pool(tiles, [], "biome", ["me", "mae", "rmse"])


@query("a07_binned_correlation", "WITH {fp} SELECT CAST(ceil(q / 5) AS INT) AS bin, count(*) AS n, corr(y, slope) AS r FROM fp GROUP BY 1 HAVING count(*) >= 50", "r")
def _(t):
    return m.binned_correlation(t.fp(), "y", "slope", "q", 5, 50)


@query("a08_equal_count_bins", """WITH {fp}, qs AS (SELECT quantile_cont(y, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM fp), b AS (SELECT y, CASE WHEN y < e[2] THEN 0 WHEN y < e[3] THEN 1 WHEN y < e[4] THEN 2 WHEN y < e[5] THEN 3 ELSE 4 END AS bin FROM fp, qs)
SELECT bin, count(*) AS n, avg(y) AS mean FROM b GROUP BY bin""", "mean")
def _(t):
    fp = t.fp()
    edges = m.equal_count_edges(fp, "y", 5, 10)
    return fp.groupBy(m.bin_of(F.col("y"), edges).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("mean"))


@query("a09_fixed_bands", "WITH {fp} SELECT CAST(least(floor((q - 0) / 10), 5) AS INT) AS bin, count(*) AS n FROM fp WHERE q >= 0 AND q < 50 GROUP BY 1 UNION ALL SELECT 5, count(*) FROM fp WHERE q >= 50 HAVING count(*) > 0")
def _(t):
    fp = t.fp()
    return fp.groupBy(m.bin_of(F.col("q"), m.fixed_edges(fp, "q", 10, 0, 50, 1)).alias("bin")).agg(F.count("*").alias("n"))


@query("a10_binned_bias_table", "WITH {fp} SELECT CAST(ceil(q / 10) AS INT) AS bin, count(*) AS n, avg(p - y) AS p_me, median(p - y) AS p_median, corr(y, p) AS p_r, avg(p2 - y) AS p2_me, median(p2 - y) AS p2_median, corr(y, p2) AS p2_r FROM fp GROUP BY 1", "p_me p_median p_r p2_me p2_median p2_r")
def _(t):
    return m.binned_bias_table(t.fp().withColumn("bin", m.fixed_bin(F.col("q"), 10)), "y", ["p", "p2"], "bin")


@query("a11_advantage_table", "WITH {fp} SELECT biome, count(*) AS n, corr(y, p) - corr(y, p2) AS delta_r, avg(p - y) - avg(p2 - y) AS delta_me, abs(avg(p - y)) - abs(avg(p2 - y)) AS delta_abs_me FROM fp GROUP BY biome", "delta_r delta_me delta_abs_me")
def _(t):
    return m.advantage_table(t.fp(), "y", "p", "p2", ["biome"])


CONTRAST = """SELECT {by}count(*) FILTER (g = 1) AS n_high, count(*) FILTER (g = 0) AS n_low, avg({v}) FILTER (g = 1) AS mean_high, avg({v}) FILTER (g = 0) AS mean_low, median({v}) FILTER (g = 1) AS median_high, median({v}) FILTER (g = 0) AS median_low,
avg({v}) FILTER (g = 1) - avg({v}) FILTER (g = 0) AS delta,
(avg({v}) FILTER (g = 1) - avg({v}) FILTER (g = 0)) / sqrt(((count(*) FILTER (g = 1) - 1) * var_samp({v}) FILTER (g = 1) + (count(*) FILTER (g = 0) - 1) * var_samp({v}) FILTER (g = 0)) / (count(*) FILTER (g = 1) + count(*) FILTER (g = 0) - 2)) AS cohen_d"""


@query("a12_class_contrast", "WITH {fp}, x AS (SELECT biome, y AS v, (flag = 'R')::INT AS g FROM fp) " + CONTRAST.format(by="biome, ", v="v") + " FROM x GROUP BY biome", "mean_high mean_low median_high median_low delta cohen_d")
def _(t):
    return m.class_contrast(t.fp().withColumn("g", (F.col("flag") == "R").cast("int")), "y", "g", ["biome"])


@query("a13_retention", """WITH {fp}, x AS (SELECT y, p, p2, (q > 25)::INT AS g FROM fp),
ref AS (SELECT delta, cohen_d FROM (""" + CONTRAST.format(by="", v="y") + """ FROM x)),
s AS (SELECT 'p' AS sensor, p AS v, y, g FROM x UNION ALL SELECT 'p2', p2, y, g FROM x),
o AS (""" + CONTRAST.format(by="sensor, ", v="v") + """, corr(v, y) AS r FROM s GROUP BY sensor)
SELECT sensor, o.delta, o.cohen_d, r, r * r AS r_squared, o.delta / ref.delta AS delta_kept, o.cohen_d / ref.cohen_d AS d_kept FROM o, ref""", "delta cohen_d r r_squared delta_kept d_kept")
def _(t):
    return m.retention(t.fp().withColumn("g", (F.col("q") > 25).cast("int")), "y", ["p", "p2"], "g")


@query("a14_height_match_table", "WITH {fp} SELECT biome, count(*) FILTER (flag = 'R') AS n_high, count(*) FILTER (flag <> 'R') AS n_low, avg(y) FILTER (flag = 'R') - avg(y) FILTER (flag <> 'R') AS mean_difference, median(y) FILTER (flag = 'R') - median(y) FILTER (flag <> 'R') AS median_difference FROM fp GROUP BY biome", "mean_difference median_difference")
def _(t):
    return m.height_match_table(t.fp().withColumn("g", (F.col("flag") == "R").cast("int")), "y", "g", "biome")


@query("a15_reference_group_compare", """WITH {fp}, ref AS (SELECT biome, avg(y) AS ref_mean, stddev_pop(y) AS ref_sd, quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.9) AS p90, var_samp(y) / count(*) AS ref_v, count(*) AS ref_n FROM fp WHERE flag = 'N' GROUP BY biome),
w AS (SELECT biome, count(*) AS n, avg(y) AS mean, avg((y < p10)::INT) AS below_p10, avg((y > p90)::INT) AS above_p90, max(ref_mean) AS ref_mean, max(ref_sd) AS ref_sd, max(p10) AS p10, max(p90) AS p90, (avg(y) - max(ref_mean)) / sqrt((var_pop(y) + max(ref_sd) * max(ref_sd)) / 2) AS cohen_d, (avg(y) - max(ref_mean)) / sqrt(var_samp(y) / count(*) + max(ref_v)) AS welch_t,
pow(var_samp(y) / count(*) + max(ref_v), 2) / (pow(var_samp(y) / count(*), 2) / (count(*) - 1) + pow(max(ref_v), 2) / (max(ref_n) - 1)) AS df FROM fp JOIN ref USING (biome) WHERE flag <> 'N' GROUP BY biome)
SELECT * EXCLUDE (df), """ + student_p("welch_t", "df") + """ AS welch_p FROM w""", "mean below_p10 above_p90 ref_mean ref_sd p10 p90 cohen_d welch_t welch_p")
def _(t):
    return m.reference_group_compare(t.fp().withColumn("is_ref", F.col("flag") == "N"), "y", "is_ref", "biome")


@query("a16_headline_share", "WITH {fp}, ref AS (SELECT biome, quantile_cont(y, 0.1) AS p10 FROM fp WHERE flag = 'N' GROUP BY biome HAVING count(*) >= 100) SELECT count(*) AS n, avg((y < p10)::INT) AS share FROM fp JOIN ref USING (biome) WHERE flag <> 'N'", "share")
def _(t):
    return m.headline_share(t.fp().withColumn("is_ref", F.col("flag") == "N"), "y", "is_ref", "biome", 100)


REPORT = """SELECT c AS class, count(*) FILTER (truth = c) AS support, count(*) FILTER (truth = c AND {p} = c) / nullif(count(*) FILTER ({p} = c), 0) AS precision, count(*) FILTER (truth = c AND {p} = c) / nullif(count(*) FILTER (truth = c), 0) AS recall,
2 * count(*) FILTER (truth = c AND {p} = c) / nullif(count(*) FILTER (truth = c) + count(*) FILTER ({p} = c), 0) AS f1, count(*) FILTER ((truth = c) = ({p} = c)) / count(*) AS accuracy FROM classes, (SELECT DISTINCT truth AS c FROM classes) GROUP BY c"""


@query("a17_class_report", "WITH {classes} " + REPORT.replace("{p}", "a"), "precision recall f1 accuracy")
def _(t):
    return m.class_report(t.classes(), "truth", "a")


@query("a17_confusion_matrix", "WITH {classes} SELECT truth, a, count(*) AS n FROM classes GROUP BY ALL")
def _(t):
    return m.confusion_matrix(t.classes(), "truth", "a")


@query("a18_class_scores_by_cell", """WITH {classes}, c AS (SELECT cell, truth AS class, count(*) FILTER (truth = a) AS tp, count(*) FILTER (truth <> a) AS fn, 0 AS fp FROM classes GROUP BY ALL UNION ALL SELECT cell, a, 0, 0, count(*) FILTER (truth <> a) FROM classes GROUP BY ALL),
s AS (SELECT cell, class, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp FROM c GROUP BY ALL), big AS (SELECT cell, count(*) AS n FROM classes GROUP BY cell HAVING count(*) >= 20)
SELECT cell, class, n, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fn > 0 THEN tp / nullif(tp + fp, 0) END AS precision, CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM s JOIN big USING (cell)""", "recall precision f1")
def _(t):
    return m.class_scores_by_cell(t.classes(), "truth", "a", "cell", 20)


@query("a19_grid_improvement", "WITH {classes} SELECT cell, count(*) AS n, count(*) FILTER (a = truth) AS hits_a, count(*) FILTER (b = truth) AS hits_b, count(*) FILTER (a = truth) / count(*) AS acc_a, count(*) FILTER (b = truth) / count(*) AS acc_b, (count(*) FILTER (a = truth) - count(*) FILTER (b = truth)) / count(*) AS gain FROM classes GROUP BY cell HAVING count(*) >= 20", "acc_a acc_b gain")
def _(t):
    return m.grid_improvement(t.classes(), "truth", "a", "b", "cell", 20)


@query("a20_headline_effect", "WITH {classes}, x AS (" + REPORT.replace("{p}", "a") + "), z AS (" + REPORT.replace("{p}", "b") + "), j AS (SELECT class, x.f1 AS f1_a, z.f1 AS f1_b FROM x FULL JOIN z USING (class)), u AS (SELECT * FROM j UNION ALL SELECT NULL, avg(f1_a), avg(f1_b) FROM j) SELECT class, f1_a, f1_b, f1_a - f1_b AS gain, (f1_a - f1_b) / f1_b AS relative_gain FROM u", "f1_a f1_b gain relative_gain")
def _(t):
    return m.headline_effect(t.classes(), "truth", "a", "b")


BIAS = "bias AS (WITH q AS (SELECT tile, beam, count(*) AS n, avg(p - y) AS mean, median(p - y) AS median, quantile_cont(p - y, 0.05) AS a, quantile_cont(p - y, 0.95) AS b FROM fp GROUP BY tile, beam HAVING count(*) > 10) SELECT q.tile, q.beam, any_value(q.n) AS n, any_value(mean) AS mean, any_value(median) AS median, avg(p - y) FILTER (p - y BETWEEN a AND b) AS trimmed_mean FROM q JOIN fp ON fp.tile = q.tile AND fp.beam = q.beam GROUP BY q.tile, q.beam)"


def _bias(t):
    return m.bias_stats(t.fp().withColumn("e", F.col("p") - F.col("y")), "e", ["tile", "beam"], 10)


@query("a21_bias_stats", "WITH {fp}, " + BIAS + " SELECT * FROM bias", "mean median trimmed_mean", 8)
def _(t):
    return _bias(t)


@query("a22_bias_variants", "WITH {fp}, " + BIAS + ", av AS (SELECT tile, avg(mean) AS m FROM bias GROUP BY tile), j AS (SELECT fp.y, fp.p AS raw, fp.p - coalesce(av.m, 0) AS average, fp.p - coalesce(bias.mean, 0) AS level FROM fp LEFT JOIN bias ON fp.tile = bias.tile AND fp.beam = bias.beam LEFT JOIN av ON fp.tile = av.tile), u AS (SELECT 'raw' AS variant, y, raw AS p FROM j UNION ALL SELECT 'average', y, average FROM j UNION ALL SELECT 'level', y, level FROM j) SELECT variant, " + ERR + " FROM u GROUP BY variant", "me mae rmse r2 r")
def _(t):
    return m.bias_variants(t.fp(), "y", "p", "tile", "beam", _bias(t))


@query("a23_bias_outlier_tiles", "WITH {fp}, " + BIAS + " SELECT tile, avg(mean) AS bias, quantile_cont(mean, 0.5) AS p50, quantile_cont(mean, 0.75) AS p75, quantile_cont(mean, 0.95) AS p95 FROM bias GROUP BY tile HAVING abs(avg(mean)) >= 500", "bias p50 p75 p95")
def _(t):
    return m.bias_outlier_tiles(_bias(t), "tile", 500)


@query("a25_channel_stats", "WITH {fp} SELECT beam, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS sd_pop, stddev_samp(y) AS sd_samp FROM fp WHERE y <> 0 GROUP BY beam", "mean sd_pop sd_samp")
def _(t):
    return m.channel_stats(t.fp(), "beam", "y", 0)


@query("a26_level_histogram", """WITH {fp}, e AS (SELECT beam, quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM fp GROUP BY beam), k AS (SELECT beam, CASE WHEN y < lo THEN 0 WHEN y > hi THEN 11 ELSE CAST(least(floor((y - lo) / (hi - lo) * 10), 9) AS INT) + 1 END AS bin FROM fp JOIN e USING (beam)), c AS (SELECT beam, bin, count(*) AS n FROM k GROUP BY ALL)
SELECT beam, bin, CASE WHEN bin BETWEEN 1 AND 10 THEN n ELSE max(n) FILTER (bin BETWEEN 1 AND 10) OVER (PARTITION BY beam) END AS n FROM c""")
def _(t):
    return m.level_histogram(t.fp(), "beam", "y", 10)


@query("a27_split_counts", "WITH {fp} SELECT biome, flag, count(*) AS n, count(DISTINCT tile) AS tiles, count(*) / sum(count(*)) OVER (PARTITION BY biome) AS share FROM fp GROUP BY biome, flag", "share")
def _(t):
    return m.split_counts(t.fp(), "flag", "biome", "tile")


@query("a28_zone_year_counts", "WITH d AS (SELECT o_orderpriority AS zone, year(o_orderdate) AS year, count(*) AS done FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), t AS (SELECT DISTINCT o_orderpriority AS zone, year(o_orderdate) AS year FROM orders) SELECT zone, year, coalesce(done, 0) AS done FROM t LEFT JOIN d USING (zone, year)")
def _(t):
    rows = t.orders.selectExpr("o_orderpriority as zone", "year(o_orderdate) as year", "o_orderstatus as s")
    return m.zone_year_counts(rows.where("s = 'F'"), rows.select("zone", "year").distinct(), "zone", "year")


@query("a29_majority_class", "WITH {classes}, c AS (SELECT cell, truth, count(*) AS n FROM classes GROUP BY ALL) SELECT cell, first(truth ORDER BY n DESC, truth) AS majority, max(n) / sum(n) AS share FROM c GROUP BY cell", "share")
def _(t):
    return m.majority_class(t.classes(), "truth", ["cell"])


@query("a30_patch_stats", "WITH {pixels} SELECT row // 5 AS pr, col // 5 AS pc, avg(value) AS mean, stddev_pop(value) AS sd_pop, stddev_samp(value) AS sd_samp, max(CASE WHEN row % 5 = 2 AND col % 5 = 2 THEN value END) AS centre FROM pixels GROUP BY ALL", "mean sd_pop sd_samp centre")
def _(t):
    px = t.pixels().withColumns({"pr": F.expr("row div 5"), "pc": F.expr("col div 5")})
    return m.patch_stats(px, ["pr", "pc"], "value", F.expr("row % 5 = 2 and col % 5 = 2"))


@query("a31_crosstab", "WITH {fp} SELECT flag, status, CAST(grouping(flag, status) AS INT) AS level, count(*) AS n FROM fp GROUP BY ROLLUP (flag, status)")
def _(t):
    return m.crosstab(t.fp(), "flag", "status")


@query("a32_distribution_summary", "WITH {fp} SELECT flag, count(*) AS n, avg(y) AS mean, stddev_samp(y) AS sd, min(y) AS min, quantile_cont(y, 0.25) AS p25, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.75) AS p75, max(y) AS max FROM fp GROUP BY flag", "mean sd min p25 p50 p75 max")
def _(t):
    return m.distribution_summary(t.fp(), "y", ["flag"])


RANKS = "rx AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 AS a, rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2.0 AS b FROM fp)"


@query("a33_correlation_report", "WITH {fp}, " + RANKS.format(by="biome", x="y", y="slope") + " SELECT biome, count(*) AS n, corr(y, slope) AS pearson, corr(a, b) AS spearman, corr(y, slope) * corr(y, slope) AS r_squared FROM rx GROUP BY biome", "pearson spearman r_squared")
def _(t):
    return r.spearman(t.fp(), "y", "slope", ["biome"])


@query("a34_residual_describe", "WITH {fp}, k AS (SELECT biome, p - y AS e, CASE WHEN q = 0 THEN 0 WHEN q > 0 AND q <= 10 THEN 0 WHEN q > 10 AND q <= 20 THEN 1 WHEN q > 20 AND q <= 50 THEN 2 END AS i FROM fp) SELECT biome, i AS interval, count(*) AS n, quantile_cont(e, 0.1) AS q10, quantile_cont(e, 0.25) AS q25, quantile_cont(e, 0.5) AS q50, quantile_cont(e, 0.75) AS q75, quantile_cont(e, 0.9) AS q90 FROM k WHERE i IS NOT NULL GROUP BY biome, i", "q10 q25 q50 q75 q90")
def _(t):
    return m.residual_describe(t.fp().withColumn("e", F.col("p") - F.col("y")), "e", "q", [0, 10, 20, 50], ["biome"])


@query("a36_band_stats_by_image", "WITH {fp} SELECT tile, beam, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS sd, min(y) AS min, max(y) AS max FROM fp WHERE y <> 32767 GROUP BY tile, beam", "mean sd")
def _(t):
    return m.band_stats_by_image(t.fp(), "tile", "beam", "y", 32767)


@query("a37_growing_month_mean", "WITH {scenes} SELECT tile, avg(value) AS mean, count(*) AS n_months FROM scenes WHERE list_contains([tile % 12 + 1, (tile + 1) % 12 + 1, (tile + 2) % 12 + 1], month(day)) GROUP BY tile", "mean")
def _(t):
    s = t.scenes().withColumns({"month": F.month("day").cast("bigint"), "months": F.expr("transform(array(0, 1, 2), i -> (tile + i) % 12 + 1)")})
    return m.growing_month_mean(s, "tile", "month", "value", "months")


@query("a24_tile_delta", """WITH {fp}, k AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY md5(concat_ws('|', 'delta', tile, shot, beam, part)), shot, beam, part, y) AS rn FROM fp) SELECT tile, median(y - p) AS delta, count(*) AS n FROM k WHERE rn <= 50 GROUP BY tile""", "delta")
def _(t):
    rows = r.first_n(t.fp(), ["tile"], 50, r.pick_order("delta", "tile", "shot", "beam", "part"), *map(F.col, ("shot", "beam", "part", "y")))
    return rows.groupBy("tile").agg(F.median(F.col("y") - F.col("p")).alias("delta"), F.count("*").alias("n"))


# ranks and picks

@query("w01_avg_rank", "WITH {fp} SELECT q, count(*) AS n, CAST((sum(count(*)) OVER (ORDER BY q) - count(*)) + (count(*) + 1) / 2.0 AS DOUBLE) AS rank FROM fp GROUP BY q", "rank")
def _(t):
    return r.global_avg_rank(t.fp().select("q"), "q").groupBy("q").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))


@query("w02_tercile_labels", "WITH {fp}, e AS (SELECT biome, quantile_cont(y, 0.3333) AS a, quantile_cont(y, 0.6667) AS b FROM fp GROUP BY biome HAVING count(*) >= 30) SELECT biome, CASE WHEN y >= b THEN 1 WHEN y <= a THEN 0 END AS label, count(*) AS n FROM fp JOIN e USING (biome) GROUP BY ALL")
def _(t):
    return r.tercile_labels(t.fp(), "y", "biome", 0.3333, 30).groupBy("biome", "label").agg(F.count("*").alias("n"))


@query("w03_global_residual_terciles", "WITH {fp}, e AS (SELECT quantile_cont(p - y, 0.25) AS a, quantile_cont(p - y, 0.75) AS b FROM fp) SELECT tile, CASE WHEN p - y >= b THEN 1 WHEN p - y <= a THEN 0 END AS label, count(*) AS n FROM fp, e GROUP BY ALL")
def _(t):
    return r.global_terciles(t.fp().withColumn("e", F.col("p") - F.col("y")), "e", 0.25).groupBy("tile", "label").agg(F.count("*").alias("n"))


@query("w04_latest_processing", "WITH {scenes} SELECT tile, orbit, first(scene ORDER BY day DESC, scene) AS scene FROM scenes GROUP BY ALL")
def _(t):
    return r.latest_processing(t.scenes(), ["tile", "orbit"], "day", "scene").select("tile", "orbit", "scene")


@query("w05_earliest_processing", "WITH {scenes}, s AS (SELECT *, CASE WHEN cloud > 10 THEN cloud END AS c FROM scenes) SELECT tile, orbit, first(c ORDER BY scene) FILTER (c IS NOT NULL) AS c, first(value ORDER BY scene) AS value FROM s GROUP BY ALL")
def _(t):
    return r.earliest_processing(t.scenes().withColumn("c", F.expr("case when cloud > 10 then cloud end")), ["tile", "orbit"], "scene", ["c", "value"])


@query("w06_select_scenes", """WITH {scenes}, s AS (SELECT *, scene % 3 AS nodata FROM scenes), f AS (SELECT * FROM s WHERE nodata = 0 AND tile % 2 = 0), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile, orbit ORDER BY cloud, scene) AS k FROM f) WHERE k <= 3),
l AS (SELECT * FROM s WHERE tile % 2 = 1 OR nodata <> 0), l2 AS (SELECT * FROM l WHERE tile NOT IN (SELECT tile FROM f)), o AS (SELECT tile, orbit FROM (SELECT tile, orbit, row_number() OVER (PARTITION BY tile ORDER BY min(cloud), orbit) AS k FROM l2 GROUP BY tile, orbit) WHERE k <= 2),
b AS (SELECT * FROM (SELECT l2.*, row_number() OVER (PARTITION BY tile, orbit ORDER BY cloud, scene) AS k FROM l2 JOIN o USING (tile, orbit)) WHERE k <= 2), u AS (SELECT tile, scene, cloud FROM a UNION ALL SELECT tile, scene, cloud FROM b)
SELECT tile, scene FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY cloud, scene) AS k FROM u) WHERE k <= 6""")
def _(t):
    s = t.scenes().withColumn("nodata", F.expr("case when tile % 2 = 1 then 1 + scene % 3 else scene % 3 end"))
    return r.select_scenes(s, "tile", "orbit", "cloud", "scene", "nodata", 3, 2, 2, 6).select("tile", "scene")


@query("w07_sample_per_key", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat_ws('|', 's1', c_nationkey, c_custkey)), c_custkey) AS k FROM customer) WHERE k <= 3")
def _(t):
    return r.sample_per_key(t.customer, ["c_nationkey"], 3, "s1", "c_custkey").select("c_nationkey", "c_custkey")


@query("w08_match_reference_counts", "WITH n AS (SELECT s_nationkey AS c_nationkey, count(*) AS want FROM supplier GROUP BY 1) SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, want, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat_ws('|', 's2', c_nationkey, c_custkey)), c_custkey) AS k FROM customer JOIN n USING (c_nationkey)) WHERE k <= want")
def _(t):
    return r.match_reference_counts(t.customer, t.supplier.selectExpr("s_nationkey as c_nationkey"), "c_nationkey", "s2", "c_custkey").select("c_nationkey", "c_custkey")


@query("w09_bernoulli_sample", "SELECT o_orderkey FROM orders WHERE substr(md5(concat_ws('|', 's3', o_orderkey)), 1, 8) < '40000000'")
def _(t):
    return r.bernoulli_sample(t.orders, 0.25, "s3", "o_orderkey").select("o_orderkey")


@query("w10_density_sample", "WITH n AS (SELECT c_nationkey, 5.0 * 0.7034 / count(*) + 0.001 AS ratio FROM customer GROUP BY 1) SELECT c_custkey FROM customer JOIN n USING (c_nationkey) WHERE CAST('0x' || substr(md5(concat_ws('|', 's4', c_custkey)), 1, 8) AS BIGINT) / 4294967296.0 < ratio")
def _(t):
    areas = t.nation.selectExpr("n_nationkey as c_nationkey", "5.0D as area")
    return r.density_sample(t.customer, areas, "c_nationkey", "area", "s4", "c_custkey").select("c_custkey")


@query("w11_split_tiles", "WITH k AS (SELECT p_partkey AS tile, row_number() OVER (ORDER BY md5(concat_ws('|', 's5', p_partkey)), p_partkey) AS k, count(*) OVER () AS n FROM part) SELECT tile, CASE WHEN k <= floor(n * 0.1) THEN 'test' WHEN k <= floor(n * 0.1) + floor(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM k")
def _(t):
    return r.split_tiles(t.part.selectExpr("p_partkey as tile"), "tile", [("test", 0.1), ("val", 0.2)], "s5")


@query("w12_stratified_tiles", "SELECT p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY (p_size < 5) DESC, md5(concat_ws('|', 's6', p_partkey)), p_partkey) AS k FROM part) WHERE k <= 7")
def _(t):
    return r.stratified_tiles(t.part, "p_partkey", "p_type", 7, t.part.where("p_size < 5"), "s6").select("p_partkey", "p_type")


@query("w13_round_robin_pick", "SELECT p_partkey, p_type, k AS turn FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) ORDER BY k, p_type LIMIT 12")
def _(t):
    return r.round_robin_pick(t.part, "p_retailprice", "p_type", "p_partkey", 12).select("p_partkey", "p_type", "turn")


@query("w16_dedup_shots", "SELECT l_orderkey, l_linenumber, min(l_suppkey) AS file FROM lineitem GROUP BY ALL")
def _(t):
    rows = r.dedup_shots(t.lineitem, ["l_orderkey", "l_linenumber"], F.col("l_suppkey"), F.col("l_partkey"), F.col("l_extendedprice"))
    return rows.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("file"))


@query("w17_holm_correct", """WITH {fp}, p AS (SELECT tile, biome, 1 / (1 + count(*)) AS p FROM fp GROUP BY ALL), k AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY biome) - row_number() OVER (PARTITION BY biome ORDER BY p, tile) + 1)) AS s FROM p)
SELECT tile, biome, p, max(s) OVER (PARTITION BY biome ORDER BY p, tile ROWS UNBOUNDED PRECEDING) AS p_holm FROM k""", "p p_holm", 8)
def _(t):
    p = t.fp().groupBy("tile", "biome").agg((1 / (1 + F.count("*"))).alias("p"))
    return r.holm(p, "p", ["biome"], "tile")


def _p(z: str) -> str:
    """Two-sided normal tail as in ``ranking.normal_sf2``."""
    x = f"(abs({z}) / sqrt(2.0))"
    t, poly = f"(1 / (1 + {x} / 2))", "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * t + ({c}))"
    return f"(SELECT t * exp(-x * x + {poly}) FROM (SELECT {t} AS t, {x} AS x))"


WILCOXON = """d AS (SELECT biome, abs(p - y) - abs(p2 - y) AS d FROM fp WHERE abs(p - y) <> abs(p2 - y)), k AS (SELECT *, rank() OVER (PARTITION BY biome ORDER BY abs(d)) + (count(*) OVER (PARTITION BY biome, abs(d)) - 1) / 2.0 AS r FROM d),
t AS (SELECT biome, sum(c * (c * c - 1.0)) AS ties FROM (SELECT biome, abs(d), count(*) AS c FROM d GROUP BY ALL) GROUP BY biome), s AS (SELECT biome, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, sum(r) AS total, avg((d < 0)::INT) AS a_lower FROM k GROUP BY biome), m AS (SELECT biome, count(*) FILTER (abs(p - y) = abs(p2 - y)) AS n_zero, median(abs(p - y) - abs(p2 - y)) AS median_difference FROM fp GROUP BY biome)"""


@query("t01_paired_wilcoxon", "WITH {fp}, " + WILCOXON + ", q AS (SELECT biome, n, n_zero, w_plus, median_difference, a_lower, (2 * w_plus - total) / total AS rank_biserial, (w_plus - n * (n + 1) / 4) / sqrt((n * (n + 1.0) * (2 * n + 1) - ties / 2) / 24) AS z FROM s JOIN t USING (biome) JOIN m USING (biome)) SELECT *, " + _p("z") + " AS p FROM q", "w_plus median_difference a_lower rank_biserial z p")
def _(t):
    e = t.fp().select("biome", F.abs(F.col("p") - F.col("y")).alias("a"), F.abs(F.col("p2") - F.col("y")).alias("b"))
    return r.paired_wilcoxon(e, "a", "b", ["biome"]).drop("p_exact")


@query("t02_rank_sum", """WITH {fp}, k AS (SELECT biome, flag, rank() OVER (PARTITION BY biome ORDER BY y) + (count(*) OVER (PARTITION BY biome, y) - 1) / 2.0 AS r FROM fp), s AS (SELECT biome, count(*) FILTER (flag = 'R') AS n1, count(*) FILTER (flag <> 'R') AS n0, sum(r) FILTER (flag = 'R') AS s FROM k GROUP BY biome),
t AS (SELECT biome, sum(c * c * c - c) AS ties FROM (SELECT biome, y, CAST(count(*) AS DOUBLE) AS c FROM fp GROUP BY ALL) GROUP BY biome),
u AS (SELECT biome, n1, n0, s - n1 * (n1 + 1) / 2 AS u, n1 + CAST(n0 AS DOUBLE) AS n, ties FROM s JOIN t USING (biome)), z AS (SELECT *, greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / sqrt(CAST(n1 AS DOUBLE) * n0 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)
SELECT biome, n1, n0, u, u / (n1 * n0) AS p_greater, 2 * u / (n1 * n0) - 1 AS rank_biserial, least(1.0, """ + _p("z") + """) AS p FROM z""", "u p_greater rank_biserial p")
def _(t):
    return r.rank_sum(t.fp().withColumn("g", (F.col("flag") == "R").cast("int")), "y", "g", ["biome"]).drop("p_exact")


@query("t04_mcnemar", "WITH {classes}, c AS (SELECT cell, count(*) FILTER (a = truth AND b <> truth) AS only_a, count(*) FILTER (a <> truth AND b = truth) AS only_b FROM classes GROUP BY cell) SELECT *, only_a / nullif(only_b, 0) AS odds_ratio, (abs(only_a - only_b) - 1) * (abs(only_a - only_b) - 1) / nullif(only_a + only_b, 0) AS chi2, CASE WHEN only_a + only_b > 0 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0))))) END AS p FROM c", "odds_ratio chi2 p")
def _(t):
    return r.mcnemar(t.classes(), "truth", "a", "b", ["cell"])


def _signed(source: str, by: str) -> str:
    return f"""d AS (SELECT {by}, a - b AS d FROM {source} WHERE a <> b), k AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0 AS r FROM d),
t AS (SELECT {by}, sum(c * (c * c - 1.0)) AS ties FROM (SELECT {by}, abs(d) AS ad, count(*) AS c FROM d GROUP BY ALL) GROUP BY {by}), s AS (SELECT {by}, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, sum(r) AS total, avg((d < 0)::INT) AS a_lower FROM k GROUP BY {by}), m AS (SELECT {by}, count(*) FILTER (a = b) AS n_zero, median(a - b) AS median_difference FROM {source} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY {by}),
z AS (SELECT {by}, n, n_zero, w_plus, median_difference, a_lower, (2 * w_plus - total) / total AS rank_biserial, (w_plus - n * (n + 1) / 4) / sqrt((n * (n + 1.0) * (2 * n + 1) - ties / 2) / 24) AS z FROM s JOIN t USING ({by}) JOIN m USING ({by})), q AS (SELECT *, {_p('z')} AS p FROM z)"""


def _holm_sql(within: str, tie: str) -> str:
    part = f"PARTITION BY {within} " if within else ""
    return f"SELECT * EXCLUDE (s), max(s) OVER ({part}ORDER BY p, {tie} ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, least(1.0, p * (count(*) OVER ({part}) - row_number() OVER ({part}ORDER BY p, {tie}) + 1)) AS s FROM q)"


SIGNED = "w_plus median_difference a_lower rank_biserial z p p_holm"


@query("t05_wilcoxon_vs_products", "WITH {fp}, l AS (SELECT 'p2' AS product, y, p, p2 AS v FROM fp UNION ALL SELECT 'slope', y, p, slope FROM fp), e AS (SELECT 'abs' AS metric, product, abs(p - y) AS a, abs(v - y) AS b FROM l UNION ALL SELECT 'square', product, (p - y) * (p - y), (v - y) * (v - y) FROM l), " + _signed("e", "metric, product") + " " + _holm_sql("metric", "product"), SIGNED, 4)
def _(t):
    return sg.wilcoxon_vs_products(t.fp(), "y", "p", ["p2", "slope"]).drop("p_exact")


def _f1_sql(p: str) -> str:
    return f"(WITH c AS (SELECT cell, truth AS class, count(*) FILTER (truth = {p}) AS tp, count(*) FILTER (truth <> {p}) AS fn, 0 AS fp FROM classes GROUP BY ALL UNION ALL SELECT cell, {p}, 0, 0, count(*) FILTER (truth <> {p}) FROM classes GROUP BY ALL) SELECT cell, class, CASE WHEN sum(tp) + sum(fn) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END AS f1 FROM c GROUP BY ALL)"


@query("t06_cell_paired_tests", "WITH {classes}, big AS (SELECT cell FROM classes GROUP BY cell HAVING count(*) >= 20), e AS (SELECT x.class, x.f1 AS a, y.f1 AS b FROM " + _f1_sql("a") + " x JOIN " + _f1_sql("b") + " y USING (cell, class) JOIN big USING (cell)), " + _signed("e", "class") + " " + _holm_sql("", "class"), SIGNED, 4)
def _(t):
    return sg.cell_paired_tests(t.classes(), "truth", "a", "b", "cell", 20).drop("p_exact")


@query("r23_stratified_samples", "WITH r AS (SELECT * FROM part WHERE p_size < 10), a AS (SELECT p_partkey, p_type, 'reference' AS origin, row_number() OVER (PARTITION BY p_type ORDER BY md5(concat_ws('|', 'st', p_type, p_partkey)), p_partkey) AS k FROM r), b AS (SELECT p_partkey, p_type, 'random' AS origin, row_number() OVER (PARTITION BY p_type ORDER BY md5(concat_ws('|', 'st', p_type, p_partkey)), p_partkey) AS k FROM part WHERE p_size >= 10) SELECT p_partkey, p_type, origin FROM a WHERE k <= 4 UNION ALL SELECT p_partkey, p_type, origin FROM b WHERE k <= 6")
def _(t):
    return sg.stratified_samples(t.part.where("p_size < 10"), t.part, "p_type", 4, 6, "st", "p_partkey").select("p_partkey", "p_type", "origin")


@query("a35_matched_band_table", "WITH {fp}, x AS (SELECT CAST(ceil(q / 10) AS INT) AS band, q, (flag = 'R')::INT AS g, y, slope FROM fp), u AS (SELECT band, 'y' AS value, g, y AS v FROM x UNION ALL SELECT band, 'slope', g, slope FROM x), c AS (" + CONTRAST.format(by="band, value, ", v="v") + " FROM u GROUP BY band, value), h AS (SELECT band, avg(q) FILTER (g = 1) - avg(q) FILTER (g = 0) AS height_difference FROM x GROUP BY band) SELECT band, value, n_high, n_low, delta, cohen_d, height_difference, abs(height_difference) <= 0.1 AS ok FROM c JOIN h USING (band)", "delta cohen_d height_difference")
def _(t):
    rows = t.fp().withColumns({"band": m.fixed_bin(F.col("q"), 10), "g": (F.col("flag") == "R").cast("int")})
    return sg.matched_band_table(rows, "band", "q", "g", ["y", "slope"], 0.1)


# conformal calibration

KTH = "(SELECT biome, max(n) AS n_cal, min(s) FILTER (k >= ceil((n + 1) * {share})) AS q FROM (SELECT biome, s, row_number() OVER (PARTITION BY biome ORDER BY s) AS k, count(*) OVER (PARTITION BY biome) AS n FROM (SELECT biome, {score} AS s FROM triples)) GROUP BY biome)"
WID = {"": ("1", "1"), "r": ("(CASE WHEN hi - lo > 0 THEN hi - lo ELSE 1 END)",) * 2, "m": ("(CASE WHEN mid - lo > 0 THEN mid - lo ELSE 1 END)", "(CASE WHEN hi - mid > 0 THEN hi - mid ELSE 1 END)")}


def _fit_sql() -> str:
    out = []
    for name in cp.METHODS:
        a, b = WID[name.partition("_")[2]]
        lo, hi = f"(lo - y) / {a}", f"(y - hi) / {b}"
        if name.startswith("se"):
            x, z = KTH.format(share=0.95, score=lo), KTH.format(share=0.95, score=hi)
            out.append(f"SELECT biome, '{name}' AS method, x.q AS q_lo, z.q AS q_hi, x.n_cal FROM {x} x JOIN {z} z USING (biome)")
        else:
            x = KTH.format(share=0.9, score=f"greatest({lo}, {hi})")
            out.append(f"SELECT biome, '{name}' AS method, q AS q_lo, q AS q_hi, n_cal FROM {x}")
    return "WITH {triples} " + " UNION ALL ".join(out)


@query("c02_fit_cqr", _fit_sql(), "q_lo q_hi", 8)
def _(t):
    """Offsets of all six score variants."""
    return cp.fit_all_offsets(t.triples(), cp.METHODS, ["biome"], "y", "lo", "mid", "hi", 0.1)


CAL = "o AS (SELECT biome, q FROM " + KTH.format(share=0.9, score="greatest(lo - y, y - hi)") + "), c AS (SELECT t.*, lo - coalesce(q, 0) AS cal_lo, hi + coalesce(q, 0) AS cal_hi FROM triples t LEFT JOIN o USING (biome))"


@query("c04_coverage_report", "WITH {triples}, " + CAL + " SELECT biome, count(*) AS n, avg((y BETWEEN lo AND hi)::INT) AS coverage, avg((y BETWEEN cal_lo AND cal_hi)::INT) AS cal_coverage, avg(hi - lo) / 10 AS width, avg(cal_hi - cal_lo) / 10 AS cal_width FROM c GROUP BY biome", "coverage cal_coverage width cal_width")
def _(t):
    rows = t.triples()
    done = cp.calibrate(rows, cp.fit_offsets(rows, "cqr", ["biome"], "y", "lo", "mid", "hi", 0.1), "cqr", ["biome"], "lo", "mid", "hi")
    return cp.coverage_report(done, ["biome"], "y", "lo", "hi")


@query("c01_calibration_prep", "WITH {triples}, d AS (SELECT DISTINCT * FROM triples WHERE biome BETWEEN 1 AND 14) SELECT biome, count(*) AS n, CAST(sum(y * 10) AS BIGINT) AS y, CAST(sum(least(lo, mid) * 10) AS BIGINT) AS lo, CAST(sum(greatest(hi, mid) * 10) AS BIGINT) AS hi FROM d GROUP BY biome")
def _(t):
    rows = cp.calibration_prep(t.triples(), ["y", "lo", "mid", "hi"], "biome", range(1, 15), "lo", "mid", "hi")
    return rows.groupBy("biome").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("bigint")).alias("y"), F.sum(F.col("lo").cast("bigint")).alias("lo"), F.sum(F.col("hi").cast("bigint")).alias("hi"))


@query("c05_conformal_score", "WITH {triples} SELECT tile, max(greatest(lo - y, y - hi)) AS worst, avg(greatest(lo - y, y - hi)) AS mean, avg(greatest((0.9 - 1) * (y - hi), 0.9 * (y - hi))) AS pinball FROM triples GROUP BY tile", "mean pinball")
def _(t):
    """Scores (c05) and pinball loss (c06)."""
    s = C.conformal_score(F.col("y"), F.col("lo"), F.col("hi"))
    return t.triples().groupBy("tile").agg(F.max(s).alias("worst"), F.avg(s).alias("mean"), F.avg(C.pinball_loss(F.col("y"), F.col("hi"), 0.9)).alias("pinball"))


OFF = "o AS (SELECT biome, 100.0 * biome AS c_lo, 50.0 * biome AS c_hi FROM (SELECT DISTINCT biome FROM triples WHERE biome <= 10)), a AS (SELECT t.*, CASE WHEN c_lo IS NULL THEN lo ELSE least(least(lo, hi) - c_lo, mid) END AS new_lo, CASE WHEN c_lo IS NULL THEN hi ELSE greatest(greatest(lo, hi) + c_hi, mid) END AS new_hi FROM triples t LEFT JOIN o USING (biome))"


def _applied(t):
    rows = t.triples()
    off = rows.where("biome <= 10").select("biome").distinct().selectExpr("biome", "100.0D * biome as c_lo", "50.0D * biome as c_hi")
    return cp.apply_offsets(rows, off, ["biome"], "lo", "mid", "hi")


@query("r19_apply_offsets", "WITH {triples}, " + OFF + " SELECT biome, count(*) AS n, sum(new_lo) AS lo, sum(new_hi) AS hi FROM a GROUP BY biome", "lo hi", 2)
def _(t):
    return _applied(t).groupBy("biome").agg(F.count("*").alias("n"), F.sum("new_lo").alias("lo"), F.sum("new_hi").alias("hi"))


@query("r20_check_offsets", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS new_lo_differ, CAST(0 AS BIGINT) AS new_hi_differ FROM (SELECT DISTINCT l_suppkey % 14 + 1, l_suppkey, CAST(round(l_extendedprice) AS INT), l_quantity FROM lineitem)")
def _(t):
    rows = _applied(t).distinct()
    return cp.check_offsets(rows, rows, ["biome", "tile", "y", "lo", "mid", "hi"], ["new_lo", "new_hi"])


@query("c03_calibrate", "WITH {triples}, " + CAL + " SELECT tile, count(*) AS n, sum(cal_lo) AS cal_lo, sum(cal_hi) AS cal_hi FROM c GROUP BY tile", "cal_lo cal_hi", 2)
def _(t):
    rows = t.triples()
    done = cp.calibrate(rows, cp.fit_offsets(rows, "cqr", ["biome"], "y", "lo", "mid", "hi", 0.1), "cqr", ["biome"], "lo", "mid", "hi")
    return done.groupBy("tile").agg(F.count("*").alias("n"), F.sum("cal_lo").alias("cal_lo"), F.sum("cal_hi").alias("cal_hi"))


@query("c06_pinball_loss", "WITH {triples} SELECT biome, avg(greatest((0.1 - 1) * (y - lo), 0.1 * (y - lo))) AS low, avg(greatest((0.5 - 1) * (y - mid), 0.5 * (y - mid))) AS middle, avg(greatest((0.9 - 1) * (y - hi), 0.9 * (y - hi))) AS high FROM triples GROUP BY biome", "low middle high")
def _(t):
    loss = lambda c, q: F.avg(C.pinball_loss(F.col("y"), F.col(c), q))
    return t.triples().groupBy("biome").agg(loss("lo", 0.1).alias("low"), loss("mid", 0.5).alias("middle"), loss("hi", 0.9).alias("high"))
