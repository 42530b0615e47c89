"""Queries of filters, reconciliation, ledgers and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import curation as cu
from ..operators import joins as jo
from ..sources import tiles as so
from .registry import query


@query("f01_quality_filter", "SELECT l_suppkey AS tile, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND l_tax < 0.04 AND l_quantity > 10 AND coalesce((l_returnflag = 'A')::INT, 0) <> 1 AND 1 - l_discount >= 0.95 GROUP BY ALL")
def _(t):
    s = t.lineitem.selectExpr("l_suppkey as tile", "l_linenumber as quality_flag", "cast(l_tax >= 0.04 as int) as degrade_flag", "cast(l_quantity > 10 as int) as region_class", "cast(l_returnflag = 'A' as int) as leaf_off_flag", "1 - l_discount as sensitivity")
    return cu.quality_filter(s, 0.95).groupBy("tile").agg(F.count("*").alias("n"))


@query("f02_water_filter", "SELECT c_nationkey AS tile, count(*) AS n FROM customer WHERE c_acctbal > -1000 AND c_custkey % 20 < 10 GROUP BY ALL")
def _(t):
    s = t.customer.selectExpr("c_nationkey as tile", "c_acctbal as dem", "c_custkey % 20 as water")
    return cu.water_filter(s, "dem", "water", 10).groupBy("tile").agg(F.count("*").alias("n"))


@query("f03_drop_water_report", "SELECT l_suppkey AS tile, count(*) AS before, count(*) FILTER (l_quantity > 5) AS after FROM lineitem GROUP BY ALL")
def _(t):
    return cu.before_after(t.lineitem.withColumnRenamed("l_suppkey", "tile"), "tile", F.col("l_quantity") > 5)


@query("f05_slope_filter_impact", "SELECT l_partkey AS tile, count(*) AS before, count(*) FILTER (l_tax * 250 < 10) AS after FROM lineitem GROUP BY ALL HAVING count(*) > 20 AND count(*) FILTER (l_tax * 250 < 10) <= 20")
def _(t):
    return cu.filter_impact(t.lineitem.withColumnRenamed("l_partkey", "tile"), "tile", F.col("l_tax") * 250 < 10, 20)


@query("f06_finite_filter", "SELECT c_mktsegment, count(*) AS n, sum(greatest(c_acctbal, 0)) AS total FROM customer WHERE c_acctbal > -500 AND c_acctbal <> 0 GROUP BY ALL", "total")
def _(t):
    s = t.customer.withColumn("c_acctbal", F.when(F.col("c_acctbal") == 0, float("nan")).otherwise(F.col("c_acctbal")))
    return cu.clip_negative(cu.finite_filter(s, ["c_acctbal"], -500), ["c_acctbal"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))


@query("f07_realistic_profile", "WITH {profiles} SELECT label, count(*) AS n FROM profiles WHERE list_max(profile) <= 30 AND list_min(profile) >= 0 GROUP BY label")
def _(t):
    return t.profiles().where(C.realistic(F.col("profile"), 0.0, 30.0)).groupBy("label").agg(F.count("*").alias("n"))


SHOT = "l_orderkey % 900000 * 10000000000000 + l_linenumber % 1000 * 100000000 + l_partkey % 100000000"


@query("f08_decode_shot_id", "SELECT DISTINCT l_orderkey % 900000 AS orbit, CAST(l_linenumber AS BIGINT) % 1000 AS minor_frame, l_partkey % 100000000 AS within_beam FROM lineitem")
def _(t):
    """Orders fold into 900,000 orbits, so every shot id fits a bigint."""
    s = t.lineitem.selectExpr(f"{SHOT} as shot")
    return s.select(*(c.alias(k) for k, c in C.shot_parts(F.col("shot")).items())).distinct()


@query("f09_fill_report", "SELECT o_custkey % 50 AS tile, count(*) FILTER (o_totalprice > 200000 AND o_orderkey % 3 = 0) AS filled, count(*) FILTER (o_totalprice > 200000 AND o_orderkey % 3 <> 0) AS empty FROM orders GROUP BY ALL")
def _(t):
    s = t.orders.selectExpr("o_custkey % 50 as tile", "case when o_totalprice <= 200000 then 1 end as old", "case when o_totalprice <= 200000 or o_orderkey % 3 = 0 then 1 end as new")
    return cu.fill_report(s, "tile", "old", "new")


@query("f13_units", "SELECT l_suppkey AS tile, sum(CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INT) / 10.0 END) AS m, sum(CAST(round_even(l_quantity / 4 * 10, 0) AS BIGINT)) AS dm FROM lineitem GROUP BY ALL", "m dm")
def _(t):
    s = t.lineitem.selectExpr("l_suppkey as tile", "case when l_linenumber = 7 then 32767 else cast(l_quantity as int) end as v", "l_quantity / 4 as h")
    return s.groupBy("tile").agg(F.sum(C.dm_to_m(F.col("v"))).alias("m"), F.sum(C.m_to_dm(F.col("h"))).alias("dm"))


@query("f14_spatial_cell", "WITH {points} SELECT concat_ws('_', CAST(floor(lat / 5) AS BIGINT), CAST(floor(lon / 5) AS BIGINT)) AS cell, count(*) AS n FROM points GROUP BY 1")
def _(t):
    return t.points().groupBy(C.spatial_cell(F.col("lon"), F.col("lat"), 5).alias("cell")).agg(F.count("*").alias("n"))


@query("f15_boa_harmonize", "SELECT o_orderpriority AS band, sum(CASE WHEN o_orderpriority <> '1-URGENT' AND CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 8 >= 4 WHEN o_custkey % 3 = 1 THEN o_orderdate >= '1995-01-01' ELSE o_orderdate >= '1997-01-01' END THEN greatest(floor(o_totalprice), 1000) - 1000 ELSE floor(o_totalprice) END) AS total FROM orders GROUP BY 1", "total")
def _(t):
    s = t.orders.selectExpr("o_orderpriority as band", "floor(o_totalprice) as v", "case when o_custkey % 3 = 0 then o_custkey % 8 end as baseline", "case when o_custkey % 3 = 1 then date_format(add_months(o_orderdate, 24), 'yyyy-MM-dd') end as processed", "date_format(o_orderdate, 'yyyy-MM-dd') as acquired")
    v = C.boa_offset(F.col("v"), F.col("band") != "1-URGENT", F.col("baseline"), F.col("processed"), F.col("acquired"), "1997-01-01")
    return s.groupBy("band").agg(F.sum(v).alias("total"))


@query("f16_scene_id_parts", "SELECT count(*) AS n, 'T' || CAST(o_custkey % 50 AS VARCHAR) AS scene_tile FROM orders GROUP BY 2")
def _(t):
    s = t.orders.selectExpr("concat_ws('_', 'S2A', 'L2A', date_format(o_orderdate, 'yyyyMMdd'), 'R1', concat('T', cast(o_custkey % 50 as string)), 'P') as scene")
    return s.select(C.scene_parts(F.col("scene"))["scene_tile"].alias("scene_tile")).groupBy("scene_tile").agg(F.count("*").alias("n"))


@query("f17_growing_window", """WITH s AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('year', o_orderdate) AS DATE) + 120 AS a, CAST(date_trunc('year', o_orderdate) AS DATE) + 280 AS b, o_orderkey % 2 AS f FROM orders)
SELECT id, CAST(CASE WHEN f = 0 AND d BETWEEN a AND b THEN a ELSE d - 90 END AS VARCHAR) AS first_day, CAST(CASE WHEN f = 0 AND d BETWEEN a AND b THEN b ELSE d + 90 END AS VARCHAR) AS last_day FROM s""")
def _(t):
    s = t.orders.selectExpr("o_orderkey as id", "to_date(o_orderdate) as d", "date_add(to_date(date_trunc('year', o_orderdate)), 120) as a", "date_add(to_date(date_trunc('year', o_orderdate)), 280) as b", "o_orderkey % 2 as f")
    x, y = C.growing_window(F.col("d"), F.col("a"), F.col("b"), F.col("f"))
    return s.select("id", x.cast("string").alias("first_day"), y.cast("string").alias("last_day"))


@query("f18_understory_ratio", "WITH {profiles} SELECT label, avg(profile[17] / profile[63]) AS ratio, avg(list_sum(profile) / 64 / profile[63]) AS mean_shape FROM profiles GROUP BY label", "ratio mean_shape")
def _(t):
    p = F.col("profile")
    mean = F.aggregate(C.normalized_profile(p, 62), F.lit(0.0), lambda a, x: a + x) / 64
    return t.profiles().groupBy("label").agg(F.avg(C.understory_ratio(p, 16, 62)).alias("ratio"), F.avg(mean).alias("mean_shape"))


@query("f19_winsorize", "WITH e AS (SELECT quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.95) AS b FROM lineitem) SELECT l_suppkey AS tile, sum(least(greatest(l_extendedprice, a), b)) AS total FROM lineitem, e GROUP BY 1", "total", 4)
def _(t):
    return cu.winsorize(t.lineitem, "l_extendedprice", 0.05, 0.95).groupBy(F.col("l_suppkey").alias("tile")).agg(F.sum("l_extendedprice").alias("total"))


# reconciliation

@query("u01_coverage_check", """WITH e AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 <> 0), l AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' END AS status FROM customer)
SELECT coalesce(e.k, a.k) AS k, CASE WHEN e.k IS NULL THEN 'unexpected' WHEN a.k IS NOT NULL THEN 'ok' WHEN status = 'done' THEN 'empty' WHEN status = 'failed' THEN 'failed' ELSE 'missing' END AS state FROM e FULL JOIN a ON e.k = a.k LEFT JOIN l ON l.k = coalesce(e.k, a.k)""")
def _(t):
    e = t.customer.where("c_custkey % 5 <> 0").selectExpr("c_custkey as k")
    a = t.orders.where("o_custkey % 3 <> 0").selectExpr("o_custkey as k")
    led = t.customer.selectExpr("c_custkey as k", "case c_custkey % 4 when 0 then 'done' when 1 then 'failed' end as status")
    return cu.coverage_check(e, a, led, "k")


@query("u02_ownership_summary", """WITH o AS (SELECT l_orderkey AS k, min(l_suppkey) AS own FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1), f AS (SELECT DISTINCT l_suppkey AS own FROM lineitem WHERE l_suppkey % 5 <> 0)
SELECT l_suppkey AS file, count(*) FILTER (o.own = l_suppkey) AS owned, count(*) FILTER (o.own <> l_suppkey AND f.own IS NOT NULL) AS copy, count(*) FILTER (o.own IS NULL) AS orphan, count(*) FILTER (o.own IS NOT NULL AND f.own IS NULL) AS owner_no_file FROM lineitem LEFT JOIN o ON o.k = l_orderkey LEFT JOIN f ON f.own = o.own GROUP BY 1""")
def _(t):
    rows = t.lineitem.selectExpr("l_orderkey as k", "l_suppkey as file")
    owners = rows.where("k % 7 <> 0").groupBy("k").agg(F.min("file").alias("own"))
    return cu.ownership_summary(rows, owners, rows.where("file % 5 <> 0").select("file"), "k", "file", "own")


@query("u03_compare_datasets", "WITH a AS (SELECT l_suppkey AS f, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS f, count(*) AS n FROM lineitem WHERE l_suppkey % 4 <> 0 OR l_tax > 0 GROUP BY 1) SELECT coalesce(a.f, b.f) AS f, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(a.n, 0) = coalesce(b.n, 0) AS equal FROM a FULL JOIN b ON a.f = b.f")
def _(t):
    rows = t.lineitem.withColumnRenamed("l_suppkey", "f")
    return cu.compare_datasets(rows, rows.where("f % 4 <> 0 or l_tax > 0"), "f")


@query("u04_reproducibility_diff", """WITH {pixels}, b AS (SELECT row, col, CASE WHEN row % 9 = 0 THEN value + 1 ELSE value END AS value FROM pixels WHERE col <> 5), j AS (SELECT coalesce(p.row, b.row) % 3 AS band, p.value AS x, b.value AS y FROM pixels p FULL JOIN b ON p.row = b.row AND p.col = b.col),
v AS (SELECT band, x, y, coalesce(x <> 50, FALSE) AS vx, coalesce(y <> 50, FALSE) AS vy FROM j) SELECT band, count(*) AS n, count(*) FILTER (vx AND vy AND x <> y) AS differing, count(*) FILTER (vx <> vy) AS nodata_mismatch, max(abs(x - y)) FILTER (vx AND vy) AS max_abs_diff, avg((vx AND vy)::INT) AS valid_share,
count(*) FILTER (vx AND vy AND x <> y) = 0 AND count(*) FILTER (vx <> vy) = 0 AS same FROM v GROUP BY band""", "max_abs_diff valid_share")
def _(t):
    a = t.pixels().withColumn("band", F.col("row") % 3)
    b = a.where("col <> 5").withColumn("value", F.expr("case when row % 9 = 0 then value + 1 else value end"))
    return cu.reproducibility_diff(a, b, ["band", "row", "col"], "band", "value", 50.0)


def _listing(t):
    return t.lineitem.selectExpr("concat('v1/T', cast(l_suppkey as string), '/RH', cast(l_linenumber as string), '_Q', cast(cast(l_quantity as int) % 3 as string), '.tif') as path", "cast(l_partkey as bigint) as length", "concat('T', cast(l_suppkey as string)) as tile", "cast(l_quantity as int) % 3 as quantile", "l_linenumber as level")


@query("u05_release_manifest", "SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS tile, count(*) AS files, CAST(sum(l_partkey) AS BIGINT) AS bytes, string_agg(DISTINCT CAST(CAST(l_quantity AS INT) % 3 AS VARCHAR), ',' ORDER BY CAST(CAST(l_quantity AS INT) % 3 AS VARCHAR)) AS quantiles, count(DISTINCT 1) AS roots FROM lineitem GROUP BY 1")
def _(t):
    return cu.release_manifest(_listing(t))


@query("u06_version_snapshot", "SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS tile, count(*) FILTER (CAST(l_quantity AS INT) % 3 = 0) AS q0, count(*) FILTER (CAST(l_quantity AS INT) % 3 = 1) AS q1, count(*) FILTER (CAST(l_quantity AS INT) % 3 = 2) AS q2 FROM lineitem GROUP BY 1")
def _(t):
    return cu.version_snapshot(_listing(t), ["tile"], "quantile", [0, 1, 2])


@query("u06_number_ranges", "WITH d AS (SELECT DISTINCT l_suppkey AS tile, l_partkey AS k FROM lineitem), g AS (SELECT tile, k, k - row_number() OVER (PARTITION BY tile ORDER BY k) AS g FROM d) SELECT tile, min(k) AS first, max(k) AS last FROM g GROUP BY tile, g")
def _(t):
    return cu.number_ranges(t.lineitem.selectExpr("l_suppkey as tile", "l_partkey as k"), ["tile"], "k")


@query("u07_object_audit", "SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS tile, CAST(l_quantity AS INT) % 3 AS quantile, count(DISTINCT l_linenumber) AS levels, count(*) FILTER (l_partkey = 0) AS zero_size, count(DISTINCT l_linenumber) BETWEEN 1 AND 6 AS partial FROM lineitem GROUP BY 1, 2")
def _(t):
    rows = _listing(t)
    return cu.object_audit(rows.select("tile", "quantile", "level", "length"), rows.select("tile"), "tile", "quantile", "level", "length", 7)


@query("u08_asset_readiness", "SELECT l_suppkey AS tile, CASE max(CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_quantity < 45 THEN 2 ELSE 3 END) WHEN 0 THEN 'ready' WHEN 1 THEN 'retarget' WHEN 2 THEN 'translate' ELSE 'no_match' END AS state FROM lineitem GROUP BY 1")
def _(t):
    sev = F.expr("case when l_returnflag = 'N' then 0 when l_returnflag = 'A' then 1 when l_quantity < 45 then 2 else 3 end")
    return cu.asset_readiness(t.lineitem.withColumnRenamed("l_suppkey", "tile"), "tile", sev, ["ready", "retarget", "translate", "no_match"])


@query("u09_nodata_tiles", "SELECT l_partkey AS tile, max(l_quantity) AS largest FROM lineitem GROUP BY 1 HAVING max(l_quantity) < 50", "largest")
def _(t):
    return cu.small_only(t.lineitem.withColumnRenamed("l_partkey", "tile"), "tile", "l_quantity", 50)


@query("u10_prediction_status", "SELECT o_custkey AS tile, year(o_orderdate) AS year, count(*) AS files, min(o_totalprice) AS smallest, count(*) >= 2 AND min(o_totalprice) >= 20000 AS valid FROM orders GROUP BY 1, 2", "smallest")
def _(t):
    return cu.prediction_status(t.orders.selectExpr("o_custkey as tile", "year(o_orderdate) as year", "o_totalprice as size"), "tile", "year", "size", 2, 20000)


@query("u11_orbit_overview", """WITH r AS (SELECT o_custkey % 5 AS band, o_custkey AS tile, year(o_orderdate) AS year, count(DISTINCT o_orderkey) AS orbits, count(DISTINCT o_orderkey) FILTER (month(o_orderdate) BETWEEN 5 AND 9) AS in_season_orbits FROM orders GROUP BY 1, 2, 3), m AS (SELECT band, year, median(orbits) AS m FROM r GROUP BY ALL)
SELECT band, tile, year, orbits, in_season_orbits, orbits < 0.6 * m AS few FROM r JOIN m USING (band, year)""")
def _(t):
    s = t.orders.selectExpr("o_custkey % 5 as band", "o_custkey as tile", "year(o_orderdate) as year", "o_orderkey as orbit", "month(o_orderdate) between 5 and 9 as season")
    return cu.orbit_overview(s, "tile", "year", "orbit", "season", "band", 0.6)


@query("u12_growing_months_rule", """WITH c AS (SELECT o_custkey AS tile, month(o_orderdate) AS month, count(*) / sum(count(*)) OVER (PARTITION BY o_custkey) * 3 AS f FROM orders GROUP BY 1, 2), k AS (SELECT *, count(*) FILTER (f > 0.5) OVER (PARTITION BY tile) AS often, row_number() OVER (PARTITION BY tile ORDER BY f DESC, month) AS k FROM c)
SELECT tile, string_agg(CAST(month AS VARCHAR), ',' ORDER BY month) AS months FROM k WHERE CASE WHEN often >= 5 THEN f > 0.5 ELSE k <= 5 END GROUP BY tile""")
def _(t):
    s = t.orders.selectExpr("o_custkey as tile", "month(o_orderdate) as month").groupBy("tile").pivot("month", list(range(1, 13))).count().fillna(0)
    total = sum((F.col(str(k)) for k in range(1, 13)), F.lit(0))
    share = F.array(*(F.col(str(k)) / total * 3 for k in range(1, 13)))
    return s.select("tile", F.array_join(C.majority_months(share).cast("array<string>"), ",").alias("months"))


@query("u13_item_store_check", "SELECT o_custkey % 50 AS tile, count(DISTINCT o_custkey % 5) AS zones, count(*) AS n, CAST(0 AS BIGINT) AS lost, count(*) FILTER (o_orderkey % 10 = 0) AS extra FROM orders GROUP BY 1")
def _(t):
    s = t.orders.selectExpr("o_custkey % 50 as tile", "o_custkey % 5 as zone", "o_orderkey as item")
    return cu.store_check(s, s.where("item % 10 <> 0"), "zone", "tile")


@query("u14_scene_inventory", """WITH {scenes}, k AS (SELECT tile, scene, row_number() OVER (PARTITION BY tile ORDER BY day, scene) AS a, row_number() OVER (PARTITION BY tile ORDER BY cloud, scene) AS b FROM scenes)
SELECT tile, count(*) AS scenes, CAST(0 AS BIGINT) AS repeated, list(scene ORDER BY scene) FILTER (a <= 5) <> list(scene ORDER BY scene) FILTER (b <= 5) AS differs FROM k GROUP BY tile""")
def _(t):
    return cu.scene_inventory(t.scenes(), "tile", "scene", "day", "cloud", 5)


@query("u15_transfer_remaining", "WITH d AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT o_custkey AS key, count(*) AS files FROM orders GROUP BY 1) SELECT key, coalesce(files, 0) AS files FROM d LEFT JOIN h USING (key) WHERE coalesce(files, 0) < 8")
def _(t):
    led = t.orders.selectExpr("o_custkey as key", "case when o_orderstatus = 'F' then 'done' else 'started' end as status")
    return cu.transfer_remaining(led, t.orders.selectExpr("o_custkey as key"), "key", 8)


@query("u15_prunable", "SELECT o_custkey AS key FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') >= 4")
def _(t):
    s = t.orders.selectExpr("o_custkey as key", "o_orderstatus as s")
    return cu.prunable(s, s.where("s = 'F'"), "key", 4)


# ledgers

@query("l01_ledger_fold", "WITH {log}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time DESC, seq DESC) AS k FROM log) SELECT key, status, time FROM k WHERE k = 1 AND status <> 'reset'")
def _(t):
    return cu.ledger_fold(t.log(), "key", "status", "time", "seq")


@query("l02_ledger_summary", """WITH {log}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time DESC, seq DESC) AS k FROM log), s AS (SELECT key, status FROM k WHERE k = 1 AND status <> 'reset'), e AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 3 <> 0), j AS (SELECT e.key IS NOT NULL AS e, s.status AS st, coalesce(e.key, s.key) % 2 = 0 AS alive FROM e FULL JOIN s ON e.key = s.key)
SELECT count(*) FILTER (e AND st = 'done') AS done, count(*) FILTER (e AND st = 'failed') AS failed, count(*) FILTER (e AND st = 'started' AND alive) AS running, count(*) FILTER (e AND st = 'started' AND NOT alive) AS interrupted, count(*) FILTER (e AND st IS NULL) AS never_started, count(*) FILTER (NOT e) AS extra, coalesce(bool_and(coalesce(st = 'done', FALSE)) FILTER (e), TRUE) AS complete FROM j""")
def _(t):
    state = cu.ledger_fold(t.log(), "key", "status", "time", "seq")
    keys = t.events.selectExpr("user_id as key").union(t.customer.selectExpr("c_custkey as key")).where("key % 2 = 0")
    return cu.ledger_summary(state, t.customer.where("c_custkey % 3 <> 0").selectExpr("c_custkey as key"), keys, "key", "status")


@query("l03_ledger_shots", "SELECT user_id AS key, CAST(sum(CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT)) AS BIGINT) AS shots FROM events GROUP BY 1")
def _(t):
    return cu.ledger_numbers(t.log(), "info", r'"k": (\d+)', "n").groupBy("key").agg(F.sum("n").alias("shots"))


# sources

@query("s02_read_filtered", "SELECT 'lineitem' AS tile, l_suppkey, count(*) AS n FROM lineitem WHERE l_tax < 0.03 GROUP BY ALL")
def _(t):
    rows = so.read_tiles(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_suppkey"], F.col("l_tax") < 0.03, None)
    return rows.groupBy(F.lit("lineitem").alias("tile"), "l_suppkey").agg(F.count("*").alias("n"))


@query("s09_combine_tiles", "SELECT p_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5(concat_ws('|', 'c', p_type, p_partkey)), p_partkey) AS k FROM part) WHERE k <= 20 GROUP BY 1")
def _(t):
    return so.combine_tiles(t.part, "p_type", 20, "c", "p_partkey").groupBy("p_type").agg(F.count("*").alias("n"))


@query("s12_repartition_index", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS number FROM orders")
def _(t):
    return so.repartition_index(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.col("number").cast("bigint"))


@query("j16_append_new_shots", "WITH o AS (SELECT l_suppkey AS tile, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 2 = 0) SELECT tile, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem n WHERE l_suppkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber)) GROUP BY tile")
def _(t):
    s = t.lineitem.selectExpr("l_suppkey as tile", "l_orderkey", "l_linenumber")
    return jo.append_new(s.where("tile % 2 = 0"), s.where("tile % 2 = 1"), ["l_orderkey", "l_linenumber"]).groupBy("tile").agg(F.count("*").alias("n"))


@query("f04_class_filter", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def _(t):
    return cu.class_filter(t.customer, "c_mktsegment", ["BUILDING", "MACHINERY"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("s01_read_tiles", "SELECT 'supplier' AS tile, s_nationkey, count(*) AS n FROM supplier GROUP BY ALL")
def _(t):
    """The tile is the stem of a file; of a table in many files, the folder's."""
    rows = so.read_tiles(t.spark, f"{t.sf_dir}/supplier.parquet", ["s_nationkey"])
    return rows.withColumn("tile", F.when(F.col("tile").startswith("part-"), "supplier").otherwise(F.col("tile"))).groupBy("tile", "s_nationkey").agg(F.count("*").alias("n"))


@query("s10_select_columns", "SELECT s_nationkey, s_acctbal FROM supplier")
def _(t):
    return so.read_tiles(t.spark, f"{t.sf_dir}/supplier.parquet", ["s_nationkey", "s_acctbal"], tile=None)


@query("s03_read_delimited_header", "SELECT CAST(s_suppkey AS DOUBLE) AS LFID, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(CAST(floor(s_acctbal) AS BIGINT) AS DOUBLE) END AS ZH, CAST(s_nationkey AS DOUBLE) AS RH10 FROM supplier")
def _(t):
    """Missing heights are written as NaN, which no balance is; -999 is one."""
    path = t.scratch("delimited")
    rows = t.supplier.selectExpr("s_nationkey as k", "1 as kind", "concat_ws('  ', s_suppkey, if(s_suppkey % 5 = 0, 'NaN', cast(cast(floor(s_acctbal) as bigint) as string)), s_nationkey) as value")
    heads = t.supplier.selectExpr("s_nationkey as k").distinct().selectExpr("k", "0 as kind", "'# LFID ZH  RH10' as value")
    rows.union(heads).repartition("k").sortWithinPartitions("kind").select("value").write.text(path)
    return so.read_delimited_header(t.spark, path, float("nan")).drop("source_file")


@query("s04_read_metrics_csv", "SELECT CAST(s_suppkey AS DOUBLE) AS lfid, CAST(s_nationkey AS DOUBLE) AS fhd FROM supplier")
def _(t):
    path = t.scratch("metrics")
    t.supplier.selectExpr("s_suppkey as `LFID `", "s_nationkey as FHD", "s_name as other").write.option("header", True).csv(path)
    return so.read_metrics_csv(t.spark, path, ["lfid", "fhd"])


@query("s05_read_geojson_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey % 180 + 0.5 AS lon, s_nationkey + 0.25 AS lat FROM supplier", "lon lat")
def _(t):
    path = t.scratch("geojson")
    point = "to_json(named_struct('type', 'Point', 'coordinates', array(s_suppkey % 180 + 0.5D, s_nationkey + 0.25D)))"
    t.supplier.selectExpr("s_suppkey as id", f"{point} as geo").write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return so.read_geojson_csv(t.spark, path, "geo", r"part-(\d+)").drop("date")


@query("s06_write_by_tile", "SELECT l_suppkey AS tile, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL", "quantity")
def _(t):
    path = t.scratch("tiles")
    so.write_by_tile(t.lineitem.selectExpr("l_suppkey as tile", "l_orderkey", "l_quantity"), path, "tile")
    rows = t.spark.read.parquet(path)
    return rows.groupBy(F.col("tile").cast("bigint").alias("tile"), ).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("s07_consolidate_by_zone", "SELECT concat('Z', CAST(l_suppkey % 7 AS VARCHAR)) AS zone, count(*) AS n, count(DISTINCT l_suppkey) AS tiles FROM lineitem GROUP BY ALL")
def _(t):
    path = t.scratch("zones")
    so.consolidate_by_zone(t.lineitem.selectExpr("concat('Z', l_suppkey % 7, '-', l_suppkey) as tile", "l_orderkey"), path, "tile", 2)
    return t.spark.read.parquet(path).groupBy("zone").agg(F.count("*").alias("n"), F.count_distinct("tile").alias("tiles"))


@query("s08_read_items_for_tiles", "SELECT concat('Z', CAST(l_suppkey % 7 AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS tile, count(*) AS n FROM lineitem WHERE l_suppkey IN (1, 8, 9) GROUP BY ALL")
def _(t):
    path = t.scratch("items")
    so.consolidate_by_zone(t.lineitem.selectExpr("concat('Z', l_suppkey % 7, '-', l_suppkey) as tile", "l_orderkey"), path, "tile", 2)
    return so.read_items_for_tiles(t.spark, path, ["Z1-1", "Z1-8", "Z2-9"], "tile", 2).groupBy("tile").agg(F.count("*").alias("n"))


@query("s11_dataset_manifest")
def _(t):
    """Files of a table with their SHA-256; a test holds it against hashlib."""
    return so.dataset_manifest(t.spark, f"{t.sf_dir}/supplier.parquet").drop("modificationTime")
