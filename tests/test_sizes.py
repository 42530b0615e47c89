"""Odd values and many copies: what larger tables bring."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxelspan.operators import joins as jo
from voxelspan.operators import ranking as rk
from voxelspan.operators import resampling as rs
from voxelspan.plans import catalogue
from voxelspan.sources import tiles as so


def test_a_height_of_minus_999_is_no_missing_one(spark, tmp_path):
    rows = [(1, 7, -998.5), (2, 7, 12.25), (5, 8, 3.5), (6, 8, -998.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalogue.queries()["s03_read_delimited_header"](spark, str(tmp_path)).collect()
    assert sorted((r["LFID"], r["ZH"], r["RH10"]) for r in got) == [(1.0, -999.0, 7.0), (2.0, 12.0, 7.0), (5.0, None, 8.0), (6.0, -998.0, 8.0)]


def test_rows_at_one_position_are_compared_once(spark, monkeypatch):
    met, plain = [], jo.neighbours_within

    def counted(left, right, *rest):
        met.append((left.count(), right.count()))
        return plain(left, right, *rest)

    monkeypatch.setattr(jo, "neighbours_within", counted)
    a = spark.createDataFrame([(i, float(i % 2) * 20, 0.0) for i in range(40)] + [(40, None, 0.0), (41, 90.0, 0.0)], "i long, x double, y double")
    b = spark.createDataFrame([(j, float(j % 3) * 3, 1.0, None if j == 0 else float(j)) for j in range(30)] + [(30, None, 1.0, 99.0)], "j long, u double, v double, w double")
    near = jo.nearest_within(a, b, "i", "j", "x", "y", "u", "v", 6.0, "left").collect()
    assert sorted((r["i"], r["j"], r["distance"]) for r in near) == [(i, None if i % 2 or i >= 40 else 0, None if i % 2 or i >= 40 else 1.0) for i in range(42)]
    best = jo.best_within(a, b, "i", "j", "x", "y", "u", "v", "w", 6.0, 5.0).collect()
    assert sorted((r["i"], r["j"], r["w"]) for r in best) == [(i, 28, 28.0) for i in range(0, 40, 2)]
    assert met == [(3, 3), (3, 3)]


def test_best_and_widened_scenes_meet_days(spark):
    import datetime as dt
    import random

    rng, day = random.Random(4), lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    points = [(i, rng.randrange(4), day(rng.randrange(300)) if i else None) for i in range(60)]
    scenes = [(100 + k, rng.randrange(3), day(rng.randrange(300)), rng.choice([0.05, 0.1, 0.3])) for k in range(90)] + [(1, 0, None, 0.05), (2, 3, None, 0.05)]
    p, s = spark.createDataFrame(points, "id long, tile int, want date"), spark.createDataFrame(scenes, "scene long, tile int, day date, defect double")
    gap = lambda a, b: 10**6 if a is None or b is None else abs((a - b).days)
    wanted, wide = [], []
    for i, tile, want in points:
        own = [x for x in scenes if x[1] == tile]
        if fit := [(x[3], gap(want, x[2]), x[0]) for x in own if x[3] <= 0.2]:
            wanted.append((i, min(fit)[2]))
        levels = [(max(-(-gap(want, x[2]) // 5), 1), x[0]) for x in own if gap(want, x[2]) <= 182]
        wide += [(i, k, level) for level, k in levels if level == min(levels)[0]]
    best = jo.best_scene(p, s, "tile", "want", "scene", "day", "defect", 0.2)
    assert sorted((r["id"], r["scene"]) for r in best.collect()) == wanted
    found = jo.expanding_window(p, s, "id", "tile", "want", "scene", "day", 5).collect()
    assert sorted((r["id"], r["scene"], r["level"]) for r in found) == sorted(wide)


def test_draws_of_many_blocks_are_shared_and_joined_by_shuffles(spark):
    blocks = spark.createDataFrame([(k * 7 % 101 if k else None, float(k)) for k in range(101)], "key long, v double")
    sums = rs.replicate_sums(blocks, "key", ["v"], 3)
    order = [v for _, v in sorted((((k * 7 % 101) if k else -1), float(k)) for k in range(101))]

    def drawn(r, d):
        x = (r * 1000003 + d * 7919 + 104729) % rs.PRIME
        for _ in range(3):
            x = (x * rs.FACTOR + 12345) % rs.PRIME
        return order[x % 101]

    assert sorted((r["replicate"], r["v"]) for r in sums.collect()) == [(r, sum(drawn(r, d) for d in range(101))) for r in range(3)]
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "sequence(0, (_n" not in plan  # one row that holds all draws was one task's work
    times = {r["key"]: r["times"] for r in rs.multiplicities(blocks, "key", 3).collect()}
    assert len(times) == 101 and [sum(x[r] for x in times.values()) for r in range(3)] == [101] * 3


def test_signed_ranks_come_from_counts(spark):
    import random
    import statistics

    rng = random.Random(2)
    rows = [(g, rng.choice([0.0, 0.5, -1.0, 2.0, 3.5, -2.5]), rng.choice([0.0, 1.0, None])) for g in (1, 2) for _ in range(60)] + [(None, 1.0, 1.0), (None, 3.0, 1.0)]
    df = spark.createDataFrame(rows * 3, "g int, a double, b double")
    for zeros in ("wilcox", "pratt"):
        found = rk.paired_wilcoxon(df, "a", "b", ["g"], zeros)
        plan = found._jdf.queryExecution().analyzed().toString()
        assert "median(" not in plan and "rank(_a" not in plan  # a group's rows met in one task
        for r in found.collect():
            d = [a - b for g, a, b in rows * 3 if g == r["g"] and b is not None]
            size = [abs(x) for x in d if x or zeros == "pratt"]
            rank = {v: sum(x < v for x in size) + (size.count(v) + 1) / 2 for v in set(size)}
            some = [x for x in d if x]
            assert (r["n"], r["n_zero"], r["median_difference"], r["w_plus"]) == (len(some), d.count(0), statistics.median(d), sum(rank[x] for x in some if x > 0))
            assert abs(r["a_lower"] - sum(x < 0 for x in some) / len(some)) < 1e-12


def test_a_tile_is_one_file(spark, tmp_path):
    so.write_by_tile(spark.range(2_000).selectExpr("id % 20 as tile", "id"), str(tmp_path / "t"), "tile")
    assert [len(list(d.glob("*.parquet"))) for d in (tmp_path / "t").glob("tile=*")] == [1] * 20
    assert spark.read.parquet(str(tmp_path / "t")).selectExpr("count(*)", "sum(id)").first()[:] == (2_000, 1_999_000)
