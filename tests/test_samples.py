"""Points in polygons and the bootstrap of images against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_gram import plain_draw
from voxelspan.operators import matching as ma
from voxelspan.operators import resampling as rs

RINGS = {("a", 0): [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], ("a", 1): [(10, 0), (11, 0), (11, 1), (10, 1)], ("b", 0): [(0, 0), (1, 0), (0, 0.02)], ("flat", 0): [(0, 0), (1, 1), (2, 2)], ("line", 0): [(0, 0), (1, 1)]}


def within(x, y, ring):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


def frame(spark):
    rows = [(name, part, [(float(x), float(y)) for x, y in ring], "clash") for (name, part), ring in RINGS.items()]
    return spark.createDataFrame(rows, "name string, part int, ring array<struct<x: double, y: double>>, lon string")


@pytest.mark.parametrize("cut", [1, 5])
def test_points_are_the_first_candidates_inside(spark, cut):
    n = 30
    found = {}
    for r in ma.points_in_polygons(frame(spark).repartition(cut), "name", "part", "ring", n, "s").collect():
        found.setdefault((r.name, r.part), {})[r.point] = (r.lon, r.lat)
    assert set(found) == {("a", 0), ("a", 1), ("b", 0)}
    for name, parts in (("a", (0, 1)), ("b", (0,))):
        areas = [area(RINGS[name, p]) for p in parts]
        share = [int(np.round(n * x / sum(areas))) for x in areas]
        share[int(np.argmax(areas))] += n - sum(share)
        for p, k in zip(parts, share, strict=True):
            ring = RINGS[name, p]
            (x0, y0), (x1, y1) = np.min(ring, axis=0), np.max(ring, axis=0)
            wanted, c = [], 0
            while len(wanted) < k:
                h = hashlib.md5(f"s|{name}|{p}|{c}".encode()).hexdigest()
                x, y = x0 + int(h[:8], 16) / 2**32 * (x1 - x0), y0 + int(h[8:16], 16) / 2**32 * (y1 - y0)
                wanted += [(x, y)] * within(x, y, ring)
                c += 1
            assert [found[name, p][i] for i in range(k)] == [pytest.approx(w) for w in wanted] and len(found[name, p]) == k


def test_thin_parts_are_told(spark):
    thin = spark.createDataFrame([("x", 0, [(0.0, 0.0), (1.0, 1.0), (1.0, 1.0 + 1e-12)])], "name string, part int, ring array<struct<x: double, y: double>>")
    with pytest.raises(ValueError, match="too thin"):
        ma.points_in_polygons(thin, "name", "part", "ring", 2, "s", rounds=3)
    assert ma.points_in_polygons(thin.limit(0), "name", "part", "ring", 2, "s").count() == 0


def test_lattice(spark):
    found = sorted((r.lon, r.lat) for r in ma.lattice_in_polygons(frame(spark).where("name = 'a' and part = 1"), "name", "part", "ring", 9).collect())
    assert found == [(10 + i / 4, j / 4) for i in (1, 2, 3) for j in (1, 2, 3)]


def test_year_change_against_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(t, f"p{p}", y, f"i{i}", float(rng.integers(0, 40))) for t in (1, 2) for p in range(7) for y in (2018, 2019, 2021) for i in range(4 + y % 3) if rng.random() < 0.7]
    df = spark.createDataFrame([*rows, (1, "p0", 2019, "i0x", None), (3, "only", 2020, "i", 1.0)], "tile int, pixel string, year int, image string, value double")
    seed = {(r.tile, r.year): r.s for r in df.select("tile", "year", (F.pmod(F.xxhash64("tile", "year"), F.lit(100_000)) * 4096).alias("s")).distinct().collect()}
    images = {k: sorted({r[3] for r in [*rows, (1, "", 2019, "i0x")] if (r[0], r[2]) == k}) for k in seed}

    def medians(tile, year, boot):
        names = images[tile, year]
        picks = names if boot == 0 else [names[plain_draw(seed[tile, year] + boot - 1, d, len(names))] for d in range(len(names))]
        out = {}
        for p in {r[1] for r in rows if r[0] == tile}:
            v = sorted(r[4] for i in picks for r in rows if (r[0], r[1], r[2], r[3]) == (tile, p, year, i))
            if v:
                out[p] = v[(len(v) - 1) // 2]
        return out

    wanted = {}
    for t in (1, 2):
        for y0, y1 in ((2018, 2019), (2019, 2021)):
            for b in range(9):
                old, new = medians(t, y0, b), medians(t, y1, b)
                d = [new[p] - old[p] for p in new if p in old]
                if d:
                    wanted[t, y1, b] = float(np.median(d))
    found = {(r.tile, r.year, r.boot): r.change for r in rs.image_bootstrap_change(df, "tile", "pixel", "year", "image", "value", 8, 3).collect()}
    assert found == wanted
    assert rs.image_bootstrap_change(df.limit(0), "tile", "pixel", "year", "image", "value", 3).count() == 0
