"""Column functions against plain Python and known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxelspan.functions import columns as C


@pytest.mark.parametrize(
    ("lon", "lat", "zone", "east", "north"),
    [(9.0, 0.0, 32, 500000.0, 0.0), (12.0, 55.0, 33, 308124.37, 6098907.83), (9.7915, 55.4934, 32, 550007.33, 6149983.36)],
)
def test_utm_known_points(spark, lon, lat, zone, east, north):
    e, n = C.utm(F.lit(lon), F.lit(lat))
    r = spark.range(1).select(C.utm_zone(F.lit(lon)).alias("z"), e.alias("e"), n.alias("n")).first()
    assert r["z"] == zone
    assert abs(r["e"] - east) < 0.02 and abs(r["n"] - north) < 0.02


def test_mgrs_square(spark):
    name = lambda lon, lat: spark.range(1).select(C.mgrs_square(F.lit(lon), F.lit(lat)).alias("s")).first()["s"]
    assert name(9.7915, 55.4934) == "32UNG"
    assert name(-0.1276, 51.5072) == "30UXC"
    assert name(151.2093, -33.8688) == "56HLH"
    assert name(10.0, 56.0) is None


def profiles():
    r = random.Random(5)
    rows = [sorted(r.uniform(-3, 40) for _ in range(101)) for _ in range(40)]
    return [*rows, [-1.0] * 101, [7.0] * 101, [-1.0] * 100 + [3.0], [r.uniform(0, 90) for _ in range(101)]]


def plain_diversity(p, width, top):
    counts = {}
    for x in p:
        if x > 0:
            k = min(int(min(x, top) // width), math.ceil(top / width) - 1)
            counts[k] = counts.get(k, 0) + 1
    shares = [c / sum(counts.values()) for c in counts.values()]
    return (-sum(s * math.log(s) for s in shares), 1 / sum(s * s for s in shares)) if shares else (None, None)


def test_diversity_matches_a_loop(spark):
    rows = profiles()
    df = spark.createDataFrame([(k, p) for k, p in enumerate(rows)], "id long, profile array<double>")
    got = {r["id"]: r for r in df.select("id", *(c.alias(k) for k, c in C.diversity(F.col("profile"), 5.0, 60.0, 25, 98).items())).collect()}
    for k, p in enumerate(rows):
        fhd, enl2 = plain_diversity(p, 5.0, 60.0)
        if fhd is None:
            assert got[k]["fhd"] is None and got[k]["enl2d"] is None
        else:
            assert abs(got[k]["fhd"] - fhd) < 1e-9 and abs(got[k]["enl2d"] - enl2) < 1e-9


def test_inside_and_shot_parts(spark):
    ring = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 0D, 'y', 4D))")
    parts = (c.alias(k) for k, c in C.shot_parts(F.lit(123_0_04_2_00000017)).items())
    r = spark.range(1).select(C.inside(F.lit(1.0), F.lit(1.0), ring).alias("a"), C.inside(F.lit(5.0), F.lit(1.0), ring).alias("b"), *parts).first()
    assert r["a"] and not r["b"]
    shot = 123_0_04_2_00000017
    assert (r["orbit"], r["minor_frame"], r["within_beam"]) == (shot // 10**13, shot // 10**8 % 1000, shot % 10**8)


def test_quantile_sort_and_losses(spark):
    a, m, b = C.quantile_sort(F.lit(3.0), F.lit(1.0), F.lit(2.0), 2.0)
    r = spark.range(1).select(a.alias("a"), m.alias("m"), b.alias("b"), C.pinball_loss(F.lit(3.0), F.lit(1.0), 0.9).alias("l"), C.m_to_dm(F.lit(0.25)).alias("d")).first()
    assert (r["a"], r["m"], r["b"], r["d"]) == (0.0, 2.0, 4.0, 2)
    assert abs(r["l"] - 1.8) < 1e-12
