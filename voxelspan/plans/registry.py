"""Registration of queries with their SQL, and the tables' stand-ins for footprints, pixels and scenes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register ``f(t)`` under a name. doubles: columns rounded on both sides, as sums of doubles depend on their order."""

    def wrap(f: Callable[[Tables], DataFrame]):
        cols = doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.withColumns({c.strip('"'): F.round(F.col(c.strip('"')).cast("double"), digits) + F.lit(0.0) for c in cols}) if cols else df

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            body = sql.format(**CTE) if "{" in sql else sql
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}' for c in cols)}) FROM ({body})" if cols else body
        return f

    return wrap


class Tables:
    """The given tables, and the stand-ins built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A new path for files in the folder that driver and executors share (``spark.checkpoint.dir``; one process alone may go without)."""
        return scratch_path(self.spark, name)

    def fp(self) -> DataFrame:
        """Footprints with a truth, two predictions, sensitivity and slope."""
        return self.lineitem.selectExpr(
            "l_orderkey as shot", "l_linenumber as beam", "l_partkey as part", "l_suppkey as tile", "l_suppkey % 14 + 1 as biome", "l_extendedprice as y", "l_quantity * 2000 as p", "l_quantity * 2100 - 500 as p2",
            "1 - l_discount as sens", "l_tax * 250 as slope", "l_quantity as q", "l_returnflag as flag", "l_linestatus as status", "l_shipdate as ts")

    def triples(self) -> DataFrame:
        """Calibration triples in whole numbers."""
        return self.lineitem.selectExpr("l_suppkey % 14 + 1 as biome", "l_suppkey as tile", "cast(round(l_extendedprice) as int) as y", "cast(l_quantity * 1500 as int) as lo", "cast(l_quantity * 2000 as int) as mid", "cast(l_quantity * 2500 as int) as hi")

    def profiles(self) -> DataFrame:
        return self.embeddings.selectExpr("vec_id as id", "label", "array_sort(transform(embedding, x -> round(abs(cast(x as double)) * 100, 6))) as profile")

    def pixels(self) -> DataFrame:
        """One value per (row, col)."""
        return self.lineitem.groupBy(F.expr("l_orderkey % 100").alias("row"), F.expr("l_partkey % 100").alias("col")).agg(F.max("l_quantity").alias("value"), F.max("l_tax").alias("tax"))

    def scenes(self) -> DataFrame:
        return self.orders.selectExpr("o_orderkey as scene", "o_custkey % 50 as tile", "to_date(o_orderdate) as day", "cast(floor(o_totalprice) as bigint) % 100 as cloud", "o_orderpriority as orbit", "year(o_orderdate) as year", "dayofyear(o_orderdate) as doy", "o_totalprice as value")

    def series(self) -> DataFrame:
        """A value per pixel (user) and day of January, standing for years."""
        return self.events.groupBy(F.expr("user_id % 10").alias("tile"), F.col("user_id").alias("pixel"), F.expr("dayofmonth(ts)").alias("year")).agg(F.max("value").alias("value"))

    def classes(self) -> DataFrame:
        """Class truths and two models' predictions per cell."""
        return self.lineitem.selectExpr("l_suppkey as cell", "cast(l_quantity as int) % 4 as truth", "cast(l_quantity + l_tax * 30 as int) % 4 as a", "cast(l_quantity + l_discount * 30 as int) % 4 as b")

    def log(self) -> DataFrame:
        return self.events.selectExpr("user_id as key", "case event_type when 'purchase' then 'done' when 'error' then 'failed' when 'signup' then 'reset' else 'started' end as status", "ts as time", "event_id as seq", "props as info")

    def points(self) -> DataFrame:
        return self.customer.selectExpr("c_custkey as id", "c_nationkey as nation", "cast(c_custkey % 360 - 180 as double) + 0.25 as lon", "cast(c_custkey % 110 - 55 as double) + 0.25 as lat", "c_acctbal as value")

    def boxes(self) -> DataFrame:
        """Ten-degree boxes, one per nation and row of the globe, with their ring."""
        b = self.nation.selectExpr("n_nationkey as tile", "cast(n_nationkey * 12 - 180 as double) as x0", "cast(n_nationkey * 12 - 168 as double) as x1", "explode(array(-50D, -20D, 10D)) as y0").withColumn("y1", F.col("y0") + 25)
        corner = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
        return b.withColumn("ring", F.expr(f"array({corner('x0', 'y0')}, {corner('x1', 'y0')}, {corner('x1', 'y1')}, {corner('x0', 'y1')})")).withColumn("name", F.expr("concat(cast(tile as string), '_', cast(cast(y0 as int) as string))"))


CTE = {
    "fp": "fp AS (SELECT l_orderkey AS shot, l_linenumber AS beam, l_partkey AS part, l_suppkey AS tile, l_suppkey % 14 + 1 AS biome, l_extendedprice AS y, l_quantity * 2000 AS p, l_quantity * 2100 - 500 AS p2, 1 - l_discount AS sens, l_tax * 250 AS slope, l_quantity AS q, l_returnflag AS flag, l_linestatus AS status, l_shipdate AS ts FROM lineitem)",
    "triples": "triples AS (SELECT l_suppkey % 14 + 1 AS biome, l_suppkey AS tile, CAST(round(l_extendedprice) AS INT) AS y, CAST(l_quantity * 1500 AS INT) AS lo, CAST(l_quantity * 2000 AS INT) AS mid, CAST(l_quantity * 2500 AS INT) AS hi FROM lineitem)",
    "profiles": "profiles AS (SELECT vec_id AS id, label, list_sort(list_transform(embedding, lambda x: round(abs(CAST(x AS DOUBLE)) * 100, 6))) AS profile FROM embeddings)",
    "levels": "levels AS (SELECT id, label, unnest(profile) AS v, generate_subscripts(profile, 1) - 1 AS k, profile FROM profiles)",
    "pixels": 'pixels AS (SELECT l_orderkey % 100 AS "row", l_partkey % 100 AS col, max(l_quantity) AS value, max(l_tax) AS tax FROM lineitem GROUP BY ALL)',
    "scenes": "scenes AS (SELECT o_orderkey AS scene, o_custkey % 50 AS tile, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice) AS BIGINT) % 100 AS cloud, o_orderpriority AS orbit, year(o_orderdate) AS year, dayofyear(o_orderdate) AS doy, o_totalprice AS value FROM orders)",
    "series": "series AS (SELECT user_id % 10 AS tile, user_id AS pixel, dayofmonth(ts) AS year, max(value) AS value FROM events GROUP BY ALL)",
    "classes": "classes AS (SELECT l_suppkey AS cell, CAST(l_quantity AS INT) % 4 AS truth, CAST(trunc(l_quantity + l_tax * 30) AS INT) % 4 AS a, CAST(trunc(l_quantity + l_discount * 30) AS INT) % 4 AS b FROM lineitem)",
    "log": "log AS (SELECT user_id AS key, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'reset' ELSE 'started' END AS status, ts AS time, event_id AS seq, props AS info FROM events)",
    "points": "points AS (SELECT c_custkey AS id, c_nationkey AS nation, CAST(c_custkey % 360 - 180 AS DOUBLE) + 0.25 AS lon, CAST(c_custkey % 110 - 55 AS DOUBLE) + 0.25 AS lat, c_acctbal AS value FROM customer)",
    "boxes": "boxes AS (SELECT n_nationkey AS tile, CAST(n_nationkey * 12 - 180 AS DOUBLE) AS x0, CAST(n_nationkey * 12 - 168 AS DOUBLE) AS x1, y0, y0 + 25 AS y1, concat(n_nationkey, '_', CAST(y0 AS INT)) AS name FROM nation, (VALUES (-50.0::DOUBLE), (-20.0::DOUBLE), (10.0::DOUBLE)) t(y0))",
}
