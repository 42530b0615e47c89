"""Queries of rasters, profiles and change series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import rasters as ra
from ..operators import series as se
from .registry import query

SHARES = """b AS (SELECT id, CAST(least(floor(least(v, 60) / 5), 11) AS INT) AS b, count(*) AS c FROM levels WHERE v > 0 GROUP BY ALL), s AS (SELECT id, c / sum(c) OVER (PARTITION BY id) AS p FROM b)"""


@query("r01_diversity_indices", "WITH {profiles}, {levels}, " + SHARES + " SELECT id, -sum(p * ln(p)) AS fhd, exp(-sum(p * ln(p))) AS enl1d, 1 / sum(p * p) AS enl2d, any_value((profile[63] - greatest(profile[17], 0)) / profile[63]) AS canopy_ratio FROM s JOIN profiles USING (id) GROUP BY id", "fhd enl1d enl2d canopy_ratio")
def _(t):
    return t.profiles().select("id", *(c.alias(k) for k, c in C.diversity(F.col("profile"), 5.0, 60.0, 16, 62).items()))


@query("r02_profile_histogram", "WITH {profiles}, {levels} SELECT CAST(least(floor(least(v, 60) / 5), 11) AS INT) AS bin, count(*) AS n FROM levels WHERE v > 0 GROUP BY 1")
def _(t):
    h = t.profiles().select(F.posexplode(C.profile_histogram(F.col("profile"), 5.0, 60.0)).alias("bin", "c"))
    return h.where("c > 0").groupBy("bin").agg(F.sum(F.col("c").cast("bigint")).alias("n"))


@query("r04_biome_mean_profiles", "WITH {profiles}, {levels} SELECT label, CAST(k AS INT) AS level, avg(v) AS mean, stddev_pop(v) AS sd FROM levels GROUP BY ALL", "mean sd")
def _(t):
    return t.profiles().select("label", F.posexplode("profile").alias("level", "v")).groupBy("label", "level").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


@query("r05_profile_auc", "WITH {profiles}, {levels} SELECT id, CASE WHEN any_value(profile[63]) >= 20 THEN greatest(avg(v / profile[63]), 0) END AS auc FROM levels GROUP BY id", "auc")
def _(t):
    return t.profiles().select("id", C.profile_auc(F.col("profile"), 62, 20.0).alias("auc"))


@query("r06_relative_entropy", "WITH {profiles}, {levels}, " + SHARES + " SELECT id, CASE WHEN any_value(profile[63]) > 5 THEN -sum(p * ln(p)) / ln(any_value(profile[63]) / 5) END AS entropy FROM s JOIN profiles USING (id) GROUP BY id", "entropy")
def _(t):
    fhd = C.diversity(F.col("profile"), 5.0, 60.0, 16, 62)["fhd"]
    return t.profiles().select("id", C.relative_entropy(fhd, C.level(F.col("profile"), 62), 5.0).alias("entropy"))


@query("r07_shape_rmse", "WITH {profiles}, {levels}, m AS (SELECT label, k, avg(v / profile[63]) AS m FROM levels GROUP BY ALL) SELECT id, sqrt(avg((v / profile[63] - m) * (v / profile[63] - m))) AS rmse FROM levels JOIN m USING (label, k) GROUP BY id", "rmse")
def _(t):
    p = t.profiles().select("id", "label", C.normalized_profile(F.col("profile"), 62).alias("shape"))
    mean = p.select("label", F.posexplode("shape").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("mean"))  # a label's 64 levels
    return p.join(mean, "label").select("id", C.shape_rmse(F.col("shape"), F.col("mean")).alias("rmse"))


@query("r08_yearly_composite", "WITH v AS (SELECT user_id, value FROM events WHERE event_type <> 'error') SELECT user_id AS pixel, round(quantile_disc(value, 0.5) * 10) AS value, count(*) AS n FROM v GROUP BY ALL", "value")
def _(t):
    return ra.yearly_composite(t.events.withColumnRenamed("user_id", "pixel"), ["pixel"], "value", F.col("event_type") != "error")


@query("r08_majority_mask", "SELECT user_id AS pixel, avg((event_type IN ('click', 'view', 'purchase'))::INT) > 0.5 AS flagged FROM events GROUP BY ALL")
def _(t):
    return ra.majority_mask(t.events.withColumnRenamed("user_id", "pixel"), ["pixel"], F.col("event_type").isin("click", "view", "purchase"))


@query("r09_monthly_composite", "SELECT o_custkey AS pixel, month(o_orderdate) AS month, median(o_totalprice) AS median, count(*) AS n FROM orders GROUP BY ALL", "median")
def _(t):
    return ra.monthly_composite(t.orders.withColumnRenamed("o_custkey", "pixel"), ["pixel"], "o_orderdate", "o_totalprice")


BLEND = "w AS (SELECT l_orderkey % 100 AS row, l_partkey % 100 AS col, l_quantity AS value, CAST(least(l_orderkey % 100 + 1, l_partkey % 100 + 1, 110 - l_orderkey % 100, 110 - l_partkey % 100) AS BIGINT) + l_linenumber AS w FROM lineitem)"


def _weights(t):
    px = t.lineitem.selectExpr("l_orderkey % 100 as row", "l_partkey % 100 as col", "l_quantity as value", "l_linenumber")
    return px.withColumn("w", ra.border_weight(F.col("row"), F.col("col"), 110, 110) + F.col("l_linenumber"))


@query("r10_blend_overlaps", "WITH " + BLEND + " SELECT row, col, coalesce(round(sum(value * w) FILTER (value <> 7) / sum(w) FILTER (value <> 7)), 7) AS value FROM w GROUP BY ALL", "value")
def _(t):
    return ra.blend_overlaps(_weights(t), ["row", "col"], "value", "w", 7.0)


@query("r10_blend_overlaps_quirk", "WITH " + BLEND + " SELECT row, col, coalesce(round(sum(value * w) FILTER (value <> 7) / sum(w)), 7) AS value FROM w GROUP BY ALL", "value")
def _(t):
    return ra.blend_overlaps(_weights(t), ["row", "col"], "value", "w", 7.0, renormalize=False)


@query("r11_mask_by_class", "WITH {pixels} SELECT row, col, CASE WHEN (row + col) % 5 IN (1, 3) THEN 32767 ELSE value END AS value FROM pixels", "value")
def _(t):
    px = t.pixels()
    return ra.mask_by_class(px, px.selectExpr("row", "col", "(row + col) % 5 as class"), ["row", "col"], "class", "value", [1, 3], 32767.0).select("row", "col", "value")


@query("r12_apply_tile_shift", "WITH {pixels} SELECT row, col, CASE WHEN value = 50 THEN 50 WHEN row % 10 < 7 THEN value + row % 10 ELSE value END AS value FROM pixels", "value")
def _(t):
    px = t.pixels().withColumn("tile", F.col("row") % 10)
    shifts = px.where("tile < 7").select("tile").distinct().withColumn("shift", F.col("tile").cast("double"))
    return ra.apply_tile_shift(px, shifts, ["tile"], "value", "shift", 50.0).select("row", "col", "value")


@query("r13_downsample_mean", "WITH {pixels} SELECT row // 10 AS row, col // 10 AS col, avg(value) AS value, count(*) AS n FROM pixels WHERE value <> 1 GROUP BY ALL", "value")
def _(t):
    return ra.downsample_mean(t.pixels(), "row", "col", "value", 10, 1.0)


@query("r14_interval_maps", "WITH {triples} SELECT tile, sum(hi - lo) AS width, sum(CASE WHEN mid > 0 THEN round((hi - lo) / mid * 1000) ELSE 32767 END) AS relative FROM triples GROUP BY tile", "width relative")
def _(t):
    w = C.interval_width(F.col("lo"), F.col("mid"), F.col("hi"))
    return t.triples().groupBy("tile").agg(F.sum(w["width"]).alias("width"), F.sum(w["relative"]).alias("relative"))


@query("r15_terrain_slope", """WITH {pixels}, s AS (SELECT a.row, a.col, sum(b.value * (b.col - a.col) * (2 - abs(b.row - a.row))) AS x, sum(b.value * (b.row - a.row) * (2 - abs(b.col - a.col))) AS y, count(*) AS n FROM pixels a JOIN pixels b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col)
SELECT row, col, CASE WHEN n = 9 THEN degrees(atan(sqrt(x * x + y * y) / 240)) END AS slope FROM s""", "slope")
def _(t):
    return ra.terrain_slope(t.pixels(), "row", "col", "value", 30.0)


@query("r16_stable_class_mask", "SELECT l_partkey AS pixel, CAST(bool_and(l_returnflag = 'N') AS INT) AS stable FROM lineitem GROUP BY ALL")
def _(t):
    return ra.stable_class_mask(t.lineitem.selectExpr("l_partkey as pixel", "l_returnflag = 'N' as c"), ["pixel"], "c", True)


@query("r17_glcm_texture", """WITH {pixels}, g AS (SELECT (row // 20) * 5 + col // 20 AS patch, row, col, CAST(value AS INT) // 10 AS g FROM pixels), pr AS (SELECT a.patch, a.g AS a, b.g AS b FROM g a JOIN g b ON a.patch = b.patch AND ((b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1))),
u AS (SELECT patch, a, b FROM pr UNION ALL SELECT patch, b, a FROM pr), c AS (SELECT patch, a, b, count(*) AS n FROM u GROUP BY ALL), q AS (SELECT patch, a, b, n / sum(n) OVER (PARTITION BY patch) AS p FROM c), m AS (SELECT patch, sum(p * a) AS mean FROM q GROUP BY patch)
SELECT patch, sum(p * (a - b) * (a - b)) AS contrast, sum(p * abs(a - b)) AS dissimilarity, sum(p / (1 + (a - b) * (a - b))) AS homogeneity, sum(p * p) AS asm, -sum(p * ln(p)) AS entropy, max(mean) AS mean, sum(p * (a - mean) * (a - mean)) AS variance, sqrt(sum(p * p)) AS energy, sum(p * (a - mean) * (b - mean)) / sum(p * (a - mean) * (a - mean)) AS correlation FROM q JOIN m USING (patch) GROUP BY patch""", "contrast dissimilarity homogeneity asm entropy mean variance energy correlation")
def _(t):
    g = t.pixels().selectExpr("(row div 20) * 5 + col div 20 as patch", "row", "col", "cast(value as int) div 10 as g")
    return ra.glcm_texture(g, "patch", "row", "col", "g")


@query("r18_quantile_sort", "WITH {triples} SELECT tile, sum(least(lo, mid, hi)) AS lo, sum(greatest(lo, mid, hi)) AS hi, count(*) AS n FROM triples GROUP BY tile", "lo hi")
def _(t):
    a, _, b = C.quantile_sort(F.col("lo"), F.col("mid"), F.col("hi"))
    return t.triples().groupBy("tile").agg(F.sum(a).alias("lo"), F.sum(b).alias("hi"), F.count("*").alias("n"))


@query("r22_forest_pixel_table", "WITH {pixels} SELECT CASE WHEN row < 80 THEN row % 14 + 1 ELSE 0 END AS biome, col % 3 = 0 AS protected, count(*) AS n FROM pixels WHERE value >= 5 GROUP BY ALL")
def _(t):
    px = t.pixels()
    biomes = px.where("row < 80").selectExpr("row", "col", "row % 14 + 1 as biome")
    rows = ra.forest_pixel_table(px, biomes, px.where("col % 3 = 0"), ["row", "col"], "value", 5)
    return rows.groupBy("biome", "protected").agg(F.count("*").alias("n"))


# years at fixed pixels (days stand for years)

@query("y01_year_offsets", "WITH {series}, m AS (SELECT tile, pixel, median(value) AS m FROM series GROUP BY ALL) SELECT tile, year, median(value - m) AS \"offset\", count(*) AS n FROM series JOIN m USING (tile, pixel) GROUP BY ALL", '"offset"')
def _(t):
    return se.year_offsets(t.series(), "tile", "pixel", "year", "value")


@query("y01_complete_pixels", """WITH {series}, np AS (SELECT tile, count(DISTINCT pixel) AS p FROM series GROUP BY tile), y AS (SELECT tile, year FROM (SELECT tile, year, count(DISTINCT pixel) AS v FROM series GROUP BY ALL) JOIN np USING (tile) WHERE v >= 0.8 * p), k AS (SELECT series.* FROM series JOIN y USING (tile, year)),
w AS (SELECT tile, pixel FROM (SELECT tile, pixel, count(DISTINCT year) AS c FROM k GROUP BY ALL) JOIN (SELECT tile, count(*) AS n FROM y GROUP BY tile) USING (tile) WHERE c = n) SELECT tile, count(*) AS n, sum(value) AS total FROM k JOIN w USING (tile, pixel) GROUP BY tile""", "total")
def _(t):
    return se.complete_pixels(t.series(), "tile", "pixel", "year", "value", 0.8).groupBy("tile").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("y02_pixel_sd", "WITH {series}, m AS (SELECT tile, pixel, median(value) AS m, stddev_samp(value) AS sd FROM series GROUP BY ALL), d AS (SELECT tile, pixel, 1.4826 * median(abs(value - m)) AS mad, max(sd) AS sd FROM series JOIN m USING (tile, pixel) GROUP BY ALL) SELECT tile, count(*) AS n, median(sd) AS sd_median, quantile_cont(sd, 0.9) AS sd_p90, median(mad) AS mad_median, quantile_cont(mad, 0.9) AS mad_p90 FROM d GROUP BY tile", "sd_median sd_p90 mad_median mad_p90")
def _(t):
    return se.pixel_spread(t.series(), "tile", "pixel", "value")


@query("y04_year_to_year_change", "WITH {series}, l AS (SELECT *, lag(value) OVER w AS v, lag(year) OVER w AS py FROM series WINDOW w AS (PARTITION BY tile, pixel ORDER BY year)) SELECT tile, year, median(value - v) AS change, count(*) AS n FROM l WHERE py = year - 1 GROUP BY ALL", "change")
def _(t):
    return se.year_to_year(t.series(), "tile", "pixel", "year", "value")


@query("y05_neighbour_change", "WITH {series}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b, lag(year) OVER w AS py, lead(year) OVER w AS ny FROM series WINDOW w AS (PARTITION BY tile, pixel ORDER BY year)) SELECT tile, year, median(value - (a + b) / 2) AS change, count(*) AS n FROM l WHERE py = year - 1 AND ny = year + 1 GROUP BY ALL", "change")
def _(t):
    return se.neighbour_change(t.series(), "tile", "pixel", "year", "value")


@query("y06_anomaly_change", "WITH {series} SELECT tile, avg(value) FILTER (year = 10) - avg(value) FILTER (year IN (1, 2, 3)) AS change, tile * 1.5 AS anomaly FROM series GROUP BY tile", "change anomaly")
def _(t):
    s = t.series()
    return se.anomaly_change(s, s.select("tile").distinct().withColumn("anomaly", F.col("tile") * 1.5), "tile", "year", "value", 10, [1, 2, 3], "anomaly")


@query("y08_cloud_leak", "SELECT user_id AS pixel, dayofmonth(ts) AS year, count(*) FILTER (event_type <> 'error') AS used, count(*) FILTER (event_type <> 'error' AND value < 50) AS leaked, count(*) FILTER (event_type <> 'error' AND value < 50) / nullif(count(*) FILTER (event_type <> 'error'), 0) AS share FROM events GROUP BY ALL", "share")
def _(t):
    e = t.events.selectExpr("user_id as pixel", "dayofmonth(ts) as year", "event_type", "value")
    return se.cloud_leak(e, "pixel", "year", F.col("event_type") != "error", "value", 50)


@query("y09_input_offsets", """WITH e AS (SELECT user_id % 10 AS tile, user_id AS pixel, dayofmonth(ts) AS year, value AS b1, value * 2 AS b2, event_type FROM events), u AS (SELECT 'all' AS mask, tile, pixel, year, 'b1' AS band, b1 AS value FROM e UNION ALL SELECT 'all', tile, pixel, year, 'b2', b2 FROM e UNION ALL SELECT 'ok', tile, pixel, year, 'b1', b1 FROM e WHERE event_type <> 'error' UNION ALL SELECT 'ok', tile, pixel, year, 'b2', b2 FROM e WHERE event_type <> 'error'),
m AS (SELECT mask, tile, pixel, band, median(value) AS m FROM u GROUP BY ALL) SELECT mask, tile, band, year, median(value - m) AS "offset" FROM u JOIN m USING (mask, tile, pixel, band) GROUP BY ALL""", '"offset"')
def _(t):
    e = t.events.selectExpr("user_id % 10 as tile", "user_id as pixel", "dayofmonth(ts) as year", "value as b1", "value * 2 as b2", "event_type")
    return se.input_offsets(e, "tile", "pixel", "year", ["b1", "b2"], {"all": F.lit(True), "ok": F.col("event_type") != "error"})


@query("y10_per_image_offsets", "WITH e AS (SELECT dayofmonth(ts) AS image, user_id AS pixel, value, event_type AS kind FROM events), m AS (SELECT pixel, median(value) AS m FROM e GROUP BY ALL) SELECT image, count(*) AS n, CASE WHEN count(*) FILTER (kind = 'click') >= 5 THEN median(value - m) FILTER (kind = 'click') END AS offset_click, CASE WHEN count(*) FILTER (kind = 'error') >= 5 THEN median(value - m) FILTER (kind = 'error') END AS offset_error FROM e JOIN m USING (pixel) GROUP BY image", "offset_click offset_error")
def _(t):
    e = t.events.selectExpr("dayofmonth(ts) as image", "user_id as pixel", "value", "event_type as kind")
    return se.per_image_offsets(e, "image", "pixel", "value", "kind", {"click": 5, "error": 5})


@query("y12_same_season_offset", "WITH {scenes} SELECT a.tile, a.scene, any_value(a.value) - median(b.value) AS \"offset\", count(*) AS n FROM scenes a JOIN scenes b ON a.tile = b.tile AND a.year <> b.year AND abs(a.doy - b.doy) <= 20 GROUP BY a.tile, a.scene", '"offset"')
def _(t):
    return se.same_season_offset(t.scenes(), "tile", "scene", "year", "doy", "value", 20)


@query("y13_external_anomalies", "WITH {scenes}, m AS (SELECT tile, doy // 30 AS d, median(value) AS m FROM scenes GROUP BY ALL) SELECT scenes.tile, year, avg(value - m) AS anomaly FROM scenes JOIN m ON m.tile = scenes.tile AND m.d = scenes.doy // 30 GROUP BY ALL", "anomaly")
def _(t):
    return se.climatology_anomaly(t.scenes().withColumn("d", F.expr("doy div 30")), "tile", "year", "d", "value")


GROWING = "month BETWEEN tile % 4 + 1 AND tile % 4 + 6"


@query("y13_growing_anomaly", "WITH {scenes}, s AS (SELECT tile, year, doy // 30 AS d, month(day) AS month, value FROM scenes), m AS (SELECT tile, d, median(value) AS m FROM s GROUP BY ALL) SELECT s.tile, year, median(value - m) AS anomaly, count(*) AS n FROM s JOIN m ON m.tile = s.tile AND m.d = s.d WHERE " + GROWING.replace("tile", "s.tile") + " GROUP BY ALL", "anomaly")
def _(t):
    return se.growing_anomaly(t.scenes().withColumns({"d": F.expr("doy div 30"), "month": F.month("day")}), "tile", "year", "d", "value", F.expr(GROWING))


@query("y13_weather_anomalies", "WITH {scenes}, y AS (SELECT tile, year, sum(value) AS v, avg(cloud) AS c FROM (SELECT *, month(day) AS month FROM scenes) WHERE " + GROWING + " GROUP BY ALL) SELECT tile, year, 100 * (v / avg(v) OVER (PARTITION BY tile) - 1) AS value_percent, c - avg(c) OVER (PARTITION BY tile) AS cloud_anomaly FROM y", "value_percent cloud_anomaly")
def _(t):
    return se.weather_anomalies(t.scenes().withColumn("month", F.month("day")), "tile", "year", F.expr(GROWING), ["value"], ["cloud"])


@query("y14_scene_counts", "WITH {scenes}, a AS (SELECT tile, year, count(DISTINCT scene) AS candidates FROM scenes GROUP BY ALL), b AS (SELECT tile, year, count(DISTINCT scene) AS selected, avg(cloud) AS mean_cloud, max(cloud) AS max_cloud FROM scenes WHERE cloud < 30 GROUP BY ALL) SELECT tile, year, candidates, coalesce(selected, 0) AS selected, mean_cloud, max_cloud FROM a LEFT JOIN b USING (tile, year)", "mean_cloud max_cloud")
def _(t):
    s = t.scenes()
    return se.scene_counts(s, s.where("cloud < 30"), "tile", "year", "scene", "cloud")


@query("y03_yearly_truth_metrics", """WITH {fp}, v AS (SELECT tile, biome, year(ts) AS year, beam AS level, CAST(round(y) AS INT) AS y, CAST(q * 1500 AS INT) AS lo, CAST(q * 2000 AS INT) AS mid, CAST(q * 2500 AS INT) AS hi FROM fp),
m AS (SELECT tile, biome, year, level, count(*) AS n, avg((y BETWEEN lo AND hi)::INT) AS coverage, avg((y > hi)::INT) AS above, avg((y < lo)::INT) AS below, median(mid - y) AS median_bias, avg(abs(mid - y)) AS mae, avg(hi - lo) AS width FROM v GROUP BY ALL)
SELECT year, level, biome, CAST(grouping(biome) AS INT) AS pooled, CAST(sum(n) AS BIGINT) AS n, sum(coverage * n) / sum(n) AS coverage, sum(above * n) / sum(n) AS above, sum(below * n) / sum(n) AS below, sum(median_bias * n) / sum(n) AS median_bias, sum(mae * n) / sum(n) AS mae, sum(width * n) / sum(n) AS width FROM m GROUP BY GROUPING SETS ((year, level, biome), (year, level))""", "coverage above below median_bias mae width")
def _(t):
    v = t.fp().selectExpr("tile", "biome", "year(ts) as year", "beam as level", "cast(round(y) as int) as y", "cast(q * 1500 as int) as lo", "cast(q * 2000 as int) as mid", "cast(q * 2500 as int) as hi")
    return se.yearly_truth_metrics(v, "tile", "biome", "year", "level", "y", "lo", "mid", "hi")


@query("y11_per_image_height_offsets", """WITH e AS (SELECT user_id % 10 AS tile, user_id AS pixel, weekofyear(ts) AS year, dayofyear(ts) AS image, value FROM events), i AS (SELECT tile, pixel, year, image, max(value) AS value FROM e GROUP BY ALL), s AS (SELECT tile, pixel, year, max(value) AS value FROM e GROUP BY ALL),
np AS (SELECT tile, count(DISTINCT pixel) AS p FROM s GROUP BY tile), y AS (SELECT tile, year FROM (SELECT tile, year, count(DISTINCT pixel) AS v FROM s GROUP BY ALL) JOIN np USING (tile) WHERE v >= 0.5 * p), k AS (SELECT s.* FROM s JOIN y USING (tile, year)),
w AS (SELECT tile, pixel FROM (SELECT tile, pixel, count(DISTINCT year) AS c FROM k GROUP BY ALL) JOIN (SELECT tile, count(*) AS n FROM y GROUP BY tile) USING (tile) WHERE c = n), m AS (SELECT tile, pixel, median(value) AS m FROM k JOIN w USING (tile, pixel) GROUP BY ALL HAVING median(value) >= 50),
b AS (SELECT k.tile, k.pixel, k.year, k.value AS yv, m FROM k JOIN m USING (tile, pixel)), o AS (SELECT tile, year, median(yv - m) AS year_offset FROM b GROUP BY ALL)
SELECT i.tile, i.year, i.image, count(*) AS n_pixels, median(i.value - m) AS "offset", avg((i.value = yv)::INT) AS equal_share, any_value(year_offset) AS year_offset FROM i JOIN b ON i.tile = b.tile AND i.pixel = b.pixel AND i.year = b.year JOIN o ON o.tile = i.tile AND o.year = i.year GROUP BY i.tile, i.year, i.image""", '"offset" equal_share year_offset')
def _(t):
    """Days as images of weeks as years."""
    e = t.events.selectExpr("user_id % 10 as tile", "user_id as pixel", "weekofyear(ts) as year", "dayofyear(ts) as image", "value")
    images = e.groupBy("tile", "pixel", "year", "image").agg(F.max("value").alias("value"))
    return se.per_image_height_offsets(images, e.groupBy("tile", "pixel", "year").agg(F.max("value").alias("value")), "tile", "pixel", "year", "image", "value", 50)


@query("y07_undisturbed_mask", "SELECT l_suppkey AS tile, count(*) AS n, count(*) FILTER (l_linenumber <> 3 AND l_tax < 0.07 AND l_returnflag <> 'R') AS undisturbed FROM lineitem GROUP BY ALL")
def _(t):
    marks = t.lineitem.selectExpr("l_suppkey as tile", "cast(l_linenumber = 3 as int) as loss", "case when l_tax >= 0.07 then 1 end as fire", "cast(l_returnflag = 'R' as int) as gain")
    return marks.groupBy("tile").agg(F.count("*").alias("n"), F.count_if(C.undisturbed(F.col("loss"), F.col("fire"), F.col("gain"))).alias("undisturbed"))
