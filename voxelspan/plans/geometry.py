"""Queries of spatial, temporal and validated joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins as jo
from .registry import query

BOX = ("x0", "y0", "x1", "y1")


@query("f10_mgrs_square")
def _(t):
    """Name of the 100 km square of each point; checked against known coordinates in the tests."""
    return t.points().select("id", C.mgrs_square(F.col("lon"), F.col("lat")).alias("square"))


@query("f11_utm_project")
def _(t):
    e, n = C.utm(F.col("lon"), F.col("lat"))
    return t.points().select("id", C.utm_zone(F.col("lon")).alias("zone"), F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query("f12_pixel_index", "WITH {points} SELECT id, CAST(floor((60 - lat) / 0.5) AS BIGINT) AS row, CAST(floor((lon + 180) / 0.5) AS BIGINT) AS col, (60 - lat) / 0.5 < 200 AND lon < 100 AS inside FROM points")
def _(t):
    p = t.points()
    return p.select("id", F.floor((60 - F.col("lat")) / 0.5).alias("row"), F.floor((F.col("lon") + 180) / 0.5).alias("col"), (((60 - F.col("lat")) / 0.5 < 200) & (F.col("lon") < 100)).alias("inside"))


@query("j01_assign_tile", "WITH {points}, {boxes} SELECT id, min(name) AS name FROM points JOIN boxes ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 GROUP BY id")
def _(t):
    return jo.assign_tile(t.points(), t.boxes().select("name", "ring"), "id", "lon", "lat", "name", "ring", 10.0).select("id", "name")


@query("j02_tag_biome", "WITH {points}, {boxes} SELECT id, min(name) AS name FROM points LEFT JOIN boxes ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 GROUP BY id")
def _(t):
    return jo.assign_tile(t.points(), t.boxes().select("name", "ring"), "id", "lon", "lat", "name", "ring", 10.0, "left").select("id", "name")


ORBITS = "orbits AS (SELECT o_orderkey AS orbit, CAST(o_custkey % 400 - 200 AS DOUBLE) AS ox0, CAST(o_custkey % 400 - 200 + 3 AS DOUBLE) AS ox1, CAST(o_orderkey % 80 - 40 AS DOUBLE) AS oy0, CAST(o_orderkey % 80 - 38 AS DOUBLE) AS oy1, month(o_orderdate) AS month FROM orders)"
PAIRS = "pairs AS (SELECT name, orbit, min(abs(s)) > 0 AS wrapped, bool_or(month BETWEEN 5 AND 8) AS in_growing FROM boxes, (VALUES (0), (360), (-360)) v(s), orbits WHERE x0 + s <= ox1 AND x1 + s >= ox0 AND y0 <= oy1 AND y1 >= oy0 GROUP BY name, orbit)"


def _pairs(t):
    orbits = t.orders.selectExpr("o_orderkey as orbit", "cast(o_custkey % 400 - 200 as double) as ox0", "cast(o_custkey % 400 - 197 as double) as ox1", "cast(o_orderkey % 80 - 40 as double) as oy0", "cast(o_orderkey % 80 - 38 as double) as oy1", "month(o_orderdate) as month")
    tiles = t.boxes().select("name", *BOX).withColumn("months", F.array(*map(F.lit, (5, 6, 7, 8))))
    return jo.tile_orbit_pairs(tiles, orbits, "name", "orbit", BOX, ("ox0", "oy0", "ox1", "oy1"), "month", "months", 10.0)


@query("j03_tile_orbit_pairs", "WITH {boxes}, " + ORBITS + ", " + PAIRS + " SELECT * FROM pairs")
def _(t):
    return _pairs(t)


@query("j04_target_orbits", "WITH {boxes}, " + ORBITS + ", " + PAIRS + " SELECT * FROM (SELECT *, bool_or(in_growing) OVER (PARTITION BY name) AS has_growing FROM pairs) WHERE in_growing OR NOT has_growing".replace("SELECT * FROM (", "SELECT name, orbit, wrapped, in_growing FROM ("))
def _(t):
    return jo.target_orbits(_pairs(t), "name", "in_growing")


NEAR = "a AS (SELECT s_suppkey AS sid, CAST(s_suppkey * 37 % 200 AS DOUBLE) AS sx, CAST(s_suppkey * 53 % 110 AS DOUBLE) AS sy, s_acctbal AS sens FROM supplier), b AS (SELECT c_custkey AS cid, CAST(c_custkey * 7 % 200 AS DOUBLE) AS cx, CAST(c_custkey * 11 % 110 AS DOUBLE) AS cy FROM customer), d AS (SELECT cid, sid, sens, sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)) AS distance FROM b JOIN a ON sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)) <= 12)"


def _near(t):
    a = t.supplier.selectExpr("s_suppkey as sid", "cast(s_suppkey * 37 % 200 as double) as sx", "cast(s_suppkey * 53 % 110 as double) as sy", "s_acctbal as sens")
    b = t.customer.selectExpr("c_custkey as cid", "cast(c_custkey * 7 % 200 as double) as cx", "cast(c_custkey * 11 % 110 as double) as cy")
    return a, b


@query("j05_nearest_within", "WITH " + NEAR + " SELECT b.cid, k.sid, k.distance FROM b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY distance, sid) AS k FROM d) k ON k.cid = b.cid AND k.k = 1", "distance")
def _(t):
    a, b = _near(t)
    return jo.nearest_within(b, a, "cid", "sid", "cx", "cy", "sx", "sy", 12.0, "left").select("cid", "sid", "distance")


@query("j06_best_within", "WITH " + NEAR + " SELECT cid, sid, sens FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY sens DESC, sid) AS k FROM d) WHERE k = 1 AND sens >= 2000", "sens")
def _(t):
    a, b = _near(t)
    return jo.best_within(b, a, "cid", "sid", "cx", "cy", "sx", "sy", "sens", 12.0, 2000)


LONG = 'px AS (SELECT l_orderkey % 100 AS "row", l_partkey % 100 AS col, l_linenumber AS band, max(l_quantity) AS value FROM lineitem GROUP BY ALL)'


def _long(t):
    return t.lineitem.groupBy(F.expr("l_orderkey % 100 as row"), F.expr("l_partkey % 100 as col"), F.col("l_linenumber").alias("band")).agg(F.max("l_quantity").alias("value"))


@query("j07_sample_raster", "WITH " + LONG + " SELECT c_custkey AS id, max(value) FILTER (band = 1 AND value <> 50) AS band_1, max(value) FILTER (band = 2 AND value <> 50) AS band_2 FROM customer LEFT JOIN px ON px.row = c_custkey % 120 AND px.col = c_custkey * 7 % 100 GROUP BY 1", "band_1 band_2")
def _(t):
    p = t.customer.selectExpr("c_custkey as id", "c_custkey % 120 as row", "c_custkey * 7 % 100 as col")
    return jo.sample_raster(p, _long(t), ["row", "col"], "band", "value", [1, 2], 50).select("id", "band_1", "band_2")


PATCH = "g AS (SELECT c_custkey AS id, dy, dx, c_custkey % 100 + dy AS r, c_custkey * 7 % 100 + dx AS c FROM customer, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)), patches AS (SELECT id, dy, dx, value FROM g LEFT JOIN pixels ON pixels.row = r AND pixels.col = c)"


def _patches(t):
    p = t.customer.selectExpr("c_custkey as id", "c_custkey % 100 as row", "c_custkey * 7 % 100 as col")
    return jo.sample_patches(p, t.pixels(), "id", "row", "col", "value", 3)


@query("j08_sample_patches", "WITH {pixels}, " + PATCH + " SELECT * FROM patches", "value")
def _(t):
    return _patches(t)


@query("j09_mask_semi_join", "WITH {pixels} SELECT c_custkey AS id FROM customer SEMI JOIN pixels ON pixels.row = c_custkey % 100 AND pixels.col = c_custkey * 7 % 100 AND value > 10")
def _(t):
    p = t.customer.selectExpr("c_custkey as id", "c_custkey % 100 as row", "c_custkey * 7 % 100 as col")
    return jo.mask_semi_join(p, t.pixels().withColumn("ok", (F.col("value") > 10).cast("int")), ["row", "col"], "ok").select("id")


@query("j10_aggregate_to_pixel", 'SELECT l_orderkey % 100 AS "row", l_partkey % 100 AS col, count(*) AS n_shots, avg(l_quantity) AS low, max(l_extendedprice) AS top, max(l_tax) AS p FROM lineitem GROUP BY 1, 2', "low top p")
def _(t):
    s = t.lineitem.selectExpr("l_orderkey % 100 as row", "l_partkey % 100 as col", "l_quantity as low", "l_extendedprice as top", "l_tax as p")
    return jo.aggregate_to_pixel(s, ["row", "col"], ["low", "top"], "p", "mean_max", ["top"])


@query("j12_merge_columns", "SELECT coalesce(c_custkey, s_suppkey) AS key, c_acctbal, s_acctbal FROM customer FULL JOIN supplier ON c_custkey = s_suppkey", "c_acctbal s_acctbal")
def _(t):
    return jo.merge_columns(t.customer.selectExpr("c_custkey as key", "c_acctbal"), t.supplier.selectExpr("s_suppkey as key", "s_acctbal"), ["key"])


@query("j13_append_report", "WITH a AS (SELECT o_custkey % 10 AS tile, o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_custkey % 10 AS tile, o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0) SELECT coalesce(a.tile, b.tile) AS tile, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (b.k IS NULL) AS only_source, count(*) FILTER (a.k IS NULL) AS only_target FROM a FULL JOIN b ON a.tile = b.tile AND a.k = b.k GROUP BY 1")
def _(t):
    s = t.orders.selectExpr("o_custkey % 10 as tile", "o_orderkey as k")
    return jo.append_report(s.where("k % 3 <> 0"), s.where("k % 5 <> 0"), "tile", ["k"])


@query("j14_sidecar_report", "SELECT o_custkey % 10 AS tile, count(*) AS n, count(*) FILTER (o_orderkey % 7 = 0) AS missing, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 4 = 0) AS v_changed FROM orders GROUP BY 1")
def _(t):
    s = t.orders.selectExpr("o_custkey % 10 as tile", "o_orderkey as k", "o_totalprice as v")
    return jo.sidecar_report(s.where("k % 7 <> 0").drop("tile"), s.withColumn("v", F.expr("case when k % 4 = 0 then null else v end")), ["k"], "tile", ["v"])


@query("j15_diagnose_keys", "SELECT o_orderkey AS shot, o_orderkey % 3 <> 0 AND o_custkey % 5 <> 0 AS by_id, o_orderkey % 3 <> 0 AND o_custkey % 5 <> 0 AS by_rounded_id FROM orders")
def _(t):
    a = t.orders.selectExpr("o_orderkey as shot", "cast(o_custkey as double) as x", "0D as y")
    b = t.orders.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey as shot", "cast(o_custkey + if(o_custkey % 5 = 0, 9, 0) as double) as x", "0D as y")
    return jo.diagnose_keys(a, b, "shot", "x", "y", 1.0)


CAND = "c AS (SELECT c_custkey AS id, scene, cloud, abs(date_diff('day', DATE '1996-06-01' + CAST(c_custkey % 365 AS INT), day)) AS gap FROM customer JOIN scenes ON scenes.tile = c_custkey % 50)"


def _dated(t):
    return t.customer.selectExpr("c_custkey as id", "c_custkey % 50 as tile", "date_add(date'1996-06-01', cast(c_custkey % 365 as int)) as want")


@query("j17_scene_candidates", "WITH {scenes}, " + CAND + ", k AS (SELECT *, count(*) FILTER (gap <= 180) OVER (PARTITION BY id) >= 3 AS enough FROM c), r AS (SELECT id, scene, row_number() OVER (PARTITION BY id ORDER BY cloud, gap, scene) AS k FROM k WHERE NOT enough OR gap <= 180) SELECT id, scene FROM r WHERE k <= 4")
def _(t):
    return jo.scene_candidates(_dated(t), t.scenes(), "id", "tile", "want", "scene", "day", "cloud", 180, 4, 3).select("id", "scene")


@query("j18_best_scene", "WITH {scenes}, " + CAND + " SELECT id, scene FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cloud / 100, gap, scene) AS k FROM c WHERE cloud / 100 <= 0.2) WHERE k = 1")
def _(t):
    return jo.best_scene(_dated(t), t.scenes().withColumn("defect", F.col("cloud") / 100), "tile", "want", "scene", "day", "defect", 0.2).select("id", "scene")


@query("j28_expanding_window_scenes", "WITH {scenes}, " + CAND + ", l AS (SELECT id, scene, greatest(ceil(gap / 15), 1) AS level FROM c WHERE gap <= 182) SELECT id, scene, CAST(level AS BIGINT) AS level FROM (SELECT *, min(level) OVER (PARTITION BY id) AS m FROM l) WHERE level = m")
def _(t):
    return jo.expanding_window(_dated(t), t.scenes(), "id", "tile", "want", "scene", "day", 15).select("id", "scene", F.col("level").cast("bigint"))


@query("j19_assign_split", "WITH s AS (SELECT p_partkey AS tile, CASE p_partkey % 9 WHEN 0 THEN 'test' WHEN 1 THEN 'cal' WHEN 2 THEN 'val' END AS split FROM part WHERE p_partkey % 9 <= 2) SELECT l_orderkey AS id, CASE min(CASE split WHEN 'test' THEN 1 WHEN 'cal' THEN 2 WHEN 'val' THEN 3 END) WHEN 1 THEN 'test' WHEN 2 THEN 'cal' WHEN 3 THEN 'val' ELSE 'train' END AS split FROM lineitem LEFT JOIN s ON s.tile = l_partkey GROUP BY 1")
def _(t):
    tiles = t.part.where("p_partkey % 9 <= 2").selectExpr("p_partkey as tile", "case p_partkey % 9 when 0 then 'test' when 1 then 'cal' else 'val' end as split")
    return jo.assign_split(t.lineitem.selectExpr("l_orderkey as id", "l_partkey as tile"), tiles, "id", "tile", "split", ["test", "cal", "val"])


@query("j20_combine_predictions", "WITH a AS (SELECT c_custkey AS id, c_nationkey AS p FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, c_nationkey % 5 AS p FROM customer WHERE c_custkey % 4 <> 0) SELECT coalesce(a.id, b.id) AS id, coalesce(a.p, -1) AS cnn_p, coalesce(b.p, -1) AS lr_p FROM a FULL JOIN b ON a.id = b.id")
def _(t):
    a = t.customer.where("c_custkey % 3 <> 0").selectExpr("c_custkey as id", "c_nationkey as p")
    b = t.customer.where("c_custkey % 4 <> 0").selectExpr("c_custkey as id", "c_nationkey % 5 as p")
    return jo.combine_predictions({"cnn": a, "lr": b}, "id")


NEIGH = "tn AS (SELECT DISTINCT a.name, b.name AS neighbour FROM boxes a, (VALUES (0), (360), (-360)) v(s), boxes b WHERE a.x0 + s <= b.x1 AND a.x1 + s >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 AND a.name <> b.name)"


@query("j22_tile_neighbours", "WITH {boxes}, " + NEIGH + " SELECT * FROM tn")
def _(t):
    return jo.tile_neighbours(t.boxes(), "name", BOX, 10.0)


@query("j23_uncovered_tiles", "WITH {boxes}, " + NEIGH + " SELECT DISTINCT name FROM tn WHERE name NOT IN (SELECT tn.name FROM tn JOIN boxes ON boxes.name = tn.neighbour WHERE tile < 8)")
def _(t):
    return jo.uncovered_tiles(jo.tile_neighbours(t.boxes(), "name", BOX, 10.0), t.boxes().where("tile < 8"), "name")


@query("j24_redundant_tiles", """WITH {boxes}, wide AS (SELECT name, tile, x0 - tile % 3 AS x0, x1 + tile % 4 AS x1, y0, y1 FROM boxes), o AS (SELECT a.name, b.name AS partner, max((least(a.x1 + s, b.x1) - greatest(a.x0 + s, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS area FROM wide a, (VALUES (0), (360), (-360)) v(s), wide b WHERE a.tile % 2 = 0 AND a.x0 + s <= b.x1 AND a.x1 + s >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 AND a.name <> b.name GROUP BY a.name, b.name)
SELECT name, partner, area, least(name, partner) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY area DESC, partner) AS k FROM o) WHERE k = 1""", "area")
def _(t):
    wide = t.boxes().selectExpr("name", "tile", "x0 - tile % 3 as x0", "x1 + tile % 4 as x1", "y0", "y1")
    return jo.redundant_tiles(wide.select("name", *BOX), "name", BOX, wide.where("tile % 2 = 0").select("name"), 10.0)


@query("j25_coastal_tiles", "SELECT n_nationkey AS tile FROM nation SEMI JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 SEMI JOIN supplier ON s_nationkey = n_nationkey")
def _(t):
    land = t.customer.where("c_acctbal > 9000").selectExpr("c_nationkey as tile")
    return jo.coastal_tiles(t.nation.selectExpr("n_nationkey as tile"), land, t.supplier.selectExpr("s_nationkey as tile"), "tile")


@query("j26_index_unnest", "SELECT user_id AS path, CAST(k AS INT) AS position, event_id + k AS a, value * k AS b, row_number() OVER (PARTITION BY user_id ORDER BY k, event_id + k, value * k) - 1 AS number FROM events, (VALUES (0), (1)) v(k)", "b")
def _(t):
    s = t.events.selectExpr("user_id as path", "array(event_id, event_id + 1) as a", "array(0D, value) as b")
    return jo.index_unnest(s, "path", ["a", "b"]).select("path", "position", "a", "b", F.col("number").cast("bigint"))


@query("j27_covered_tiles", "WITH {boxes} SELECT DISTINCT name FROM boxes, (VALUES (0), (360), (-360)) v(s), (SELECT CAST(s_suppkey * 3 % 360 - 180 AS DOUBLE) AS a, CAST(s_suppkey % 60 - 30 AS DOUBLE) AS b FROM supplier) WHERE x0 + s <= a + 1 AND x1 + s >= a AND y0 <= b + 1 AND y1 >= b")
def _(t):
    reg = t.supplier.selectExpr("cast(s_suppkey * 3 % 360 - 180 as double) as a", "cast(s_suppkey % 60 - 30 as double) as b").selectExpr("a", "b", "a + 1 as c", "b + 1 as d")
    return jo.covered_tiles(t.boxes(), reg, "name", BOX, ("a", "b", "c", "d"), 10.0)


@query("j29_defect_cover", "WITH {pixels}, " + PATCH + " SELECT id, CAST(dy AS BIGINT) AS scene, avg((value IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10))::INT) AS defect FROM patches GROUP BY ALL", "defect")
def _(t):
    return jo.defect_cover(_patches(t).withColumn("scene", F.col("dy").cast("bigint")), "id", "scene", "value", [float(k) for k in range(1, 11)])


@query("j30_attach_by_coordinates", "WITH {points}, r AS (SELECT lat, lon, min(nation) AS nation FROM points WHERE nation < 10 GROUP BY ALL) SELECT id, r.nation AS label FROM points LEFT JOIN r USING (lat, lon)")
def _(t):
    p = t.points()
    right = p.where("nation < 10").selectExpr("lat", "lon", "nation as label")
    return jo.attach_by_coordinates(p.select("id", "lat", "lon"), right, "lat", "lon", "label").select("id", "label")


@query("j11_attach_by_pixel", "WITH {pixels}, r AS (SELECT o_orderkey % 100 AS row, o_custkey % 100 AS col, min({{'price': o_totalprice, 'status': o_orderstatus}}) AS r FROM orders WHERE o_orderkey % 100 < 80 GROUP BY ALL) SELECT p.row, p.col, p.value, r.price, r.status FROM pixels p LEFT JOIN (SELECT row, col, r.price AS price, r.status AS status FROM r) r ON p.row = r.row AND p.col = r.col")
def _(t):
    right = t.orders.where("o_orderkey % 100 < 80").selectExpr("o_orderkey % 100 as row", "o_custkey % 100 as col", "o_totalprice as price", "o_orderstatus as status")
    return jo.attach_by_pixel(t.pixels().select("row", "col", "value"), right, ["row", "col"], ["price", "status"])


@query("r21_pixel_biome", "WITH {pixels}, {boxes}, p AS (SELECT row, col, col * 3.6 - 178.2 AS lon, row * 1.8 - 89.1 AS lat FROM pixels) SELECT row, col, coalesce(min(tile + 1), 0) AS biome FROM p LEFT JOIN boxes ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 GROUP BY row, col")
def _(t):
    px = t.pixels().selectExpr("row", "col", "cast(col * 3.6 - 178.2 as double) as lon", "cast(row * 1.8 - 89.1 as double) as lat")
    biomes = t.boxes().selectExpr("tile + 1 as biome", "ring")
    return jo.pixel_biome(px, biomes, "lon", "lat", "biome", "ring", 10.0, ["row", "col"]).select("row", "col", "biome")


@query("j21_grid_assign", "WITH {points}, {boxes}, c AS (SELECT DISTINCT i * 90 + j AS cell_id, (i + 0.5) * 2 - 180 AS lon, (j + 0.5) * 2 - 90 AS lat FROM boxes, range(180) a(i), range(90) b(j) WHERE x0 < 150 AND i BETWEEN greatest(floor((x0 + 180) / 2), 0) AND floor((x1 + 180) / 2) AND j BETWEEN greatest(floor((y0 + 90) / 2), 0) AND floor((y1 + 90) / 2)) SELECT id, c.cell_id, c.lon AS cell_lon, c.lat AS cell_lat FROM points p LEFT JOIN c ON c.cell_id = floor((p.lon + 180) / 2) * 90 + floor((p.lat + 90) / 2)", "cell_lon cell_lat")
def _(t):
    """Points in the cells, two degrees wide, that touch a box (land)."""
    cells = jo.grid_cells(t.boxes().where("x0 < 150"), BOX, 2.0)
    return jo.grid_assign(t.points().select("id", "lon", "lat"), cells, "lon", "lat", 2.0).select("id", "cell_id", "cell_lon", "cell_lat")
