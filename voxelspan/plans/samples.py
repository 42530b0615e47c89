"""Queries of points drawn in polygons and of images drawn anew."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import matching as ma
from ..operators import resampling as rs
from .registry import query

N = 40


def polygons(t) -> DataFrame:
    """One to three five-sided rings per nation, some of them not convex."""
    p = t.nation.selectExpr("n_nationkey as tile", "explode(sequence(0, n_nationkey % 3)) as part").selectExpr("tile", "part", "cast(tile * 12 - 150 + part * 3 as double) as x", "cast((tile * 7) % 90 - 45 as double) as y", "cast(1 + (tile + part) % 4 as double) as s")
    corner = lambda x, y: f"named_struct('x', x + {x} * s, 'y', y + {y} * s)"
    return p.selectExpr("tile", "part", f"array({', '.join(corner(x, y) for x, y in CORNERS)}) as ring")


CORNERS = ((0, 0), (2, 0.25), (1.75, 2), (1, 0.75), (-0.25, 1.5))
_EDGES = "e AS (SELECT tile, part, k, x + s * dx AS ax, y + s * dy AS ay, x + s * ex AS cx, y + s * ey AS cy FROM p, (VALUES " + ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, (a, b) in enumerate(zip(CORNERS, [*CORNERS[1:], CORNERS[0]], strict=True))) + ") v(k, dx, dy, ex, ey))"
_PARTS = f"""p AS (SELECT n_nationkey AS tile, part, CAST(n_nationkey * 12 - 150 + part * 3 AS DOUBLE) AS x, CAST((n_nationkey * 7) % 90 - 45 AS DOUBLE) AS y, CAST(1 + (n_nationkey + part) % 4 AS DOUBLE) AS s FROM nation, range(3) r(part) WHERE part <= n_nationkey % 3),
{_EDGES}, z AS (SELECT tile, part, abs(sum(ax * cy - cx * ay)) / 2 AS area, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM e GROUP BY tile, part),
w AS (SELECT *, round_even({N} * area / sum(area) OVER (PARTITION BY tile), 0) AS k0, row_number() OVER (PARTITION BY tile ORDER BY round(area, 6) DESC, part) AS i FROM z),
k AS (SELECT *, CASE WHEN i = 1 THEN k0 + {N} - sum(k0) OVER (PARTITION BY tile) ELSE k0 END AS k FROM w)"""
_HIT = "SELECT c.tile, c.part, c.point FROM c JOIN e USING (tile, part) GROUP BY c.tile, c.part, c.point HAVING count(*) FILTER ((ay > lat) <> (cy > lat) AND lon < (cx - ax) * (lat - ay) / (cy - ay) + ax) % 2 = 1"


@query("w14_random_points_in_polygons", f"""WITH {_PARTS}, d AS (SELECT k.*, point, md5(concat_ws('|', 'pts', tile, part, point)) AS h FROM k, range({N * 28}) r(point) WHERE k > 0),
c AS (SELECT tile, part, k, point, x0 + ('0x' || h[1:8])::BIGINT / 4294967296.0::DOUBLE * (x1 - x0) AS lon, y0 + ('0x' || h[9:16])::BIGINT / 4294967296.0::DOUBLE * (y1 - y0) AS lat FROM d),
hit AS ({_HIT}), o AS (SELECT c.tile, c.part, k, row_number() OVER (PARTITION BY c.tile, c.part ORDER BY c.point) - 1 AS point, lon, lat FROM c JOIN hit ON hit.tile = c.tile AND hit.part = c.part AND hit.point = c.point) SELECT tile, part, point, lon, lat FROM o WHERE point < k""", "lon lat")
def _(t):
    return ma.points_in_polygons(polygons(t), "tile", "part", "ring", N, "pts")


@query("w14_lattice_in_polygons", f"""WITH {_PARTS}, m AS (SELECT *, CAST(ceil(sqrt(k)) AS BIGINT) AS m FROM k WHERE k > 0),
c AS (SELECT tile, part, point, x0 + (x1 - x0) * (point % m + 1) / (m + 1) AS lon, y0 + (y1 - y0) * (point // m + 1) / (m + 1) AS lat FROM m, range({2 * N}) r(point) WHERE point < m * m),
hit AS ({_HIT}) SELECT c.* FROM c JOIN hit ON hit.tile = c.tile AND hit.part = c.part AND hit.point = c.point""", "lon lat")
def _(t):
    return ma.lattice_in_polygons(polygons(t), "tile", "part", "ring", N)


@query("r24_image_bootstrap_year_change")
def _(t):
    """Days as images of weeks as years; a test holds it against a plain loop."""
    e = t.events.selectExpr("user_id % 5 as tile", "user_id as pixel", "weekofyear(ts) as year", "dayofyear(ts) as image", "value")
    return rs.image_bootstrap_change(e.groupBy("tile", "pixel", "year", "image").max("value").withColumnRenamed("max(value)", "value"), "tile", "pixel", "year", "image", "value", 20)
