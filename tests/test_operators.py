"""Operators against brute force, and their invariants."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelspan.operators import conformal as cp
from voxelspan.operators import curation as cu
from voxelspan.operators import joins as jo
from voxelspan.operators import matching as ma
from voxelspan.operators import metrics as m
from voxelspan.operators import ranking as rk
from voxelspan.operators import regression as re_
from voxelspan.operators import resampling as rs
from voxelspan.plans import catalogue
from voxelspan.sources import tiles as so
from voxelspan.streaming import ledger

SF = "/root/testdata/sf0.001"


def compared(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    text = lambda df: sorted(tuple("-" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))
    assert text(got) == text(want)


@pytest.mark.parametrize("name", ["a06_accuracy_report", "a13_retention", "a18_class_scores_by_cell", "c02_fit_cqr", "w06_select_scenes", "j03_tile_orbit_pairs", "r17_glcm_texture", "b01_bootstrap_metric_diff", "g02_partial_corr", "y02_pixel_sd", "l02_ledger_summary", "u04_reproducibility_diff"])
@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_sql(spark, name):
    compared(spark, name)


def test_global_rank_does_not_depend_on_partitions(spark):
    rows = [(k, (k * 37) % 11) for k in range(100)]
    want = {k: sum(v < w for _, v in rows) + (sum(v == w for _, v in rows) + 1) / 2 for k, w in rows}
    for n in ("1", "3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = rk.global_avg_rank(spark.createDataFrame(rows, "id long, v long"), "v").collect()
        assert {r["id"]: r["rank"] for r in got} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_conformal_order_statistic(spark):
    df = spark.createDataFrame([(1, k) for k in range(1, 20)] + [(2, 5)], "g int, s int")
    rows = df.select("g", F.col("s").alias("y"), *(F.lit(0).alias(c) for c in ("lo", "mid", "hi")))  # the score is y
    got = {r["g"]: r["q_lo"] for r in cp.fit_offsets(rows, "cqr", ["g"], "y", "lo", "mid", "hi", 0.1).collect()}
    assert got == {1: 18, 2: None}  # k = ceil(20 * 0.9); k = 2 > n = 1


def test_holm_is_monotone_and_skips_null(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double").withColumn("g", F.lit(1))
    got = {r["k"]: round(r["p_holm"], 6) for r in rk.holm(df, "p", ["g"], "k").collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_merge_small():
    assert m.merge_small([0, 1, 2, 3], [5, 1, 9], 3) == [0, 2, 3]
    assert m.merge_small([0, 1, 2], [1, 1], 9) == [0, 2]


def test_nearest_matches_brute_force(spark):
    a = [(k, float(k * 7 % 50), float(k * 13 % 40)) for k in range(60)]
    b = [(k, float(k * 11 % 50) + 0.5, float(k * 3 % 40)) for k in range(40)]
    want = {}
    for i, x, y in a:
        best = min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, u, v in b)
        want[i] = best[1] if best[0] <= 6 else None
    got = jo.nearest_within(spark.createDataFrame(a, "i long, x double, y double"), spark.createDataFrame(b, "j long, u double, v double"), "i", "j", "x", "y", "u", "v", 6.0, "left")
    assert {r["i"]: r["j"] for r in got.collect()} == want


def test_each_shot_is_owned_once_and_merge_rejects_repeats(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id long, file string")
    assert sorted(map(tuple, rk.dedup_shots(df, ["id"], F.col("file")).collect())) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception, match="more than once"):
        jo.merge_columns(df, df.withColumn("x", F.lit(1)), ["id"]).collect()


def test_greedy_match_pairs_once(spark):
    rows = [("h1", 10.0, 1), ("h2", 10.5, 1), ("l1", 10.4, 0), ("l2", 12.0, 0), ("l3", 30.0, 0), ("h3", 60.0, 1)]
    df = spark.createDataFrame([(1, *r) for r in rows], "bin int, id string, h double, high int")
    got = {(r["high_id"], r["low_id"]) for r in ma.greedy_match(df, "bin", "id", "h", "high", 2.0).collect()}
    assert got == {("h1", "l1"), ("h2", "l2")}


def test_replicates_draw_as_many_blocks(spark):
    blocks = spark.createDataFrame([(k, 1) for k in range(13)], "tile long, n long")
    assert {r["n"] for r in rs.replicate_sums(blocks, "tile", ["n"], 20).collect()} == {13}


def test_manifest_fails_on_an_unexpected_path(spark):
    good = spark.createDataFrame([("v1/T1/RH98_Q0.tif", 5), ("v1/T1/RH98_Q1.tif", 6)], "path string, length long")
    r = cu.release_manifest(good).first()
    assert (r["tile"], r["files"], r["bytes"], r["quantiles"]) == ("T1", 2, 11, "0,1")
    with pytest.raises(Exception, match="unexpected path"):
        cu.release_manifest(good.union(spark.createDataFrame([("v1/x.txt", 1)], good.schema))).collect()


def test_points_lie_in_their_boxes(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 2.0), ("b", 5.0, 5.0, 6.0, 6.0)], "name string, x0 double, y0 double, x1 double, y1 double")
    rows = ma.points_in_boxes(boxes, "name", ("x0", "y0", "x1", "y1"), 7, "s").join(boxes, "name").collect()
    assert len(rows) == 14 and all(r["x0"] <= r["lon"] <= r["x1"] and r["y0"] <= r["lat"] <= r["y1"] for r in rows)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("10AAA", 1, 2.0), ("10AAB", 2, 3.0), ("11BBB", 3, 4.0)], "tile string, id long, v double")
    so.write_by_tile(df, str(tmp_path / "tiles"), "tile")
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 3
    so.consolidate_by_zone(df, str(tmp_path / "zones"), "tile")
    assert [r["id"] for r in so.read_items_for_tiles(spark, str(tmp_path / "zones"), ["10AAB"], "tile").collect()] == [2]
    text = tmp_path / "a.txt"
    text.write_text("# old header\n# LFID HLON X\n1 -999 -999\n2 5.5 7\n")
    got = [(r["LFID"], r["HLON"], r["X"]) for r in so.read_delimited_header(spark, str(text)).orderBy("LFID").collect()]
    assert got == [(1.0, None, -999.0), (2.0, 5.5, 7.0)]
    csv = tmp_path / "b.csv"
    csv.write_text(" LFID ,Lai\n1,2.5\n")
    assert so.read_metrics_csv(spark, str(csv), ["lfid", "lai"]).first()["lai"] == 2.5
    geo = tmp_path / "x_20200102.csv"
    geo.write_text('id,geo\n1,"{""type"":""Point"",""coordinates"":[9.5,55.5]}"\n')
    r = so.read_geojson_csv(spark, str(geo), "geo", r"_(\d{8})").first()
    assert (r["lon"], r["lat"], r["date"]) == (9.5, 55.5, "20200102")
    man = so.dataset_manifest(spark, str(tmp_path / "zones"))
    assert so.manifest_hash(man).first()["files"] == man.count()
    with pytest.raises(ValueError, match="missing columns"):
        so.require_columns(df, ["nope"])


def test_ledger_stream_equals_batch(spark, tmp_path):
    rows = [("a", "started", 1, 1), ("a", "done", 5, 2), ("a", "failed", 3, 3), ("b", "started", 2, 4), ("b", "reset", 9, 5), ("c", "done", 1, 6)]
    schema = "key string, status string, time long, seq long"
    src = tmp_path / "log"
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(str(src))
    held = {}

    def sink(batch, _):
        held.update({r["key"]: r["status"] for r in batch.collect()})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    ledger.run_available(ledger.ledger_stream(stream, "key", "status", "time", "seq"), sink, str(tmp_path / "ck"))
    batch = {r["key"]: r["status"] for r in cu.ledger_fold(spark.createDataFrame(rows, schema), "key", "status", "time", "seq").collect()}
    assert {k: v for k, v in held.items() if v != "reset"} == batch == {"a": "done", "c": "done"}


def test_greedy_match_at_the_tolerance(spark):
    """A pair at the tolerance is none, whatever lies between; against a walk over all lows."""
    rows = [("a", 10.0, 1), ("b", 12.0, 0)]
    df = lambda r: spark.createDataFrame([(1, *x) for x in r], "bin int, id string, height double, high int")
    got = lambda r, size=20_000: sorted((x["high_id"], x["low_id"]) for x in ma.greedy_match(df(r), "bin", "id", "height", "high", 2.0, size).collect())
    assert got(rows) == [] and got([*rows, ("c", 11.0, 1)]) == [("c", "b")]
    r = random.Random(4)
    for _ in range(3):
        own = [(f"r{k:02d}", r.randint(0, 60) / 2, r.randint(0, 1)) for k in range(60)]
        lows = sorted((h, i) for i, h, side in own if side == 0)
        free, want = [True] * len(lows), []
        for h, i in sorted((h, i) for i, h, side in own if side == 1):
            first = sum(x < h for x, _ in lows)
            options = [(abs(lows[k][0] - h), first - 1 - k if k < first else k - first, k < first, k) for k in range(len(lows)) if free[k]]
            near = [min((o for o in options if o[2] == side), key=lambda o: o[1]) for side in (True, False) if any(o[2] == side for o in options)]
            best = min(near, default=None)
            if best and best[0] < 2.0:
                free[best[3]] = False
                want.append((i, lows[best[3]][1]))
        assert got(own) == got(own, 1) == sorted(want)  # one stretch, and many that depend on each other


def test_exact_p_values(spark):
    """Signed ranks over all sign patterns, and binomial tails, against sums over every case."""
    for n in (1, 3, 6, 10):
        sums = [sum(k + 1 for k in range(n) if bits >> k & 1) for bits in range(2**n)]
        df = spark.createDataFrame([(float(w), n) for w in range(n * (n + 1) // 2 + 1)], "w double, n int")
        for x in df.select("w", rk.exact_signed_rank(F.col("w"), F.col("n")).alias("p")).collect():
            low, high = sum(s <= x["w"] for s in sums), sum(s >= x["w"] for s in sums)
            assert x["p"] == pytest.approx(min(1, 2 * min(low, high) / 2**n))
    cases = [(k, n) for n in (1, 2, 9, 40, 3000) for k in {0, 1, n // 3, n // 2, n}]
    for x in spark.createDataFrame([*cases, (0, 0)], "k long, n long").select("k", "n", rk.exact_binomial(F.col("k"), F.col("n")).alias("p")).collect():
        k, n = x["k"], x["n"]
        assert x["p"] is None if n == 0 else x["p"] == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n), rel=1e-9)


def test_signed_rank_of_zeros(spark):
    """Medians take all pairs; Pratt's way ranks zeros and then drops them."""
    d = [0.0, 0.0, 0.0, 1.0, -2.0, 3.0, 4.0]
    df = spark.createDataFrame([(1, x, 0.0) for x in d] + [(2, 5.0, 5.0), (2, None, 1.0)], "g int, a double, b double")
    got = {r["g"]: r for r in rk.paired_wilcoxon(df, "a", "b", ["g"]).collect()}
    assert (got[1]["n"], got[1]["n_zero"], got[1]["median_difference"], got[1]["w_plus"]) == (4, 3, 0.0, 8.0)
    assert (got[2]["n"], got[2]["n_zero"], got[2]["median_difference"], got[2]["p"]) == (0, 1, 0.0, None)
    pratt = {r["g"]: r for r in rk.paired_wilcoxon(df, "a", "b", ["g"], "pratt").collect()}
    assert pratt[1]["w_plus"] == 4 + 6 + 7 and pratt[1]["n"] == 4


def test_vertical_profiles_match_numpy(spark):
    r = random.Random(2)
    rows = [(k, sorted(round(r.uniform(0, 30), 1) for _ in range(r.randint(1, 40)))) for k in range(40)] + [(90, [5.0, 5.0]), (91, []), (92, None)]
    got = {x["id"]: x["density"] for x in ma.vertical_profiles(spark.createDataFrame(rows, "id int, p array<double>"), "id", "p", 2.0).collect()}
    for k, values in rows:
        h, first = np.unique(np.asarray(values or [], float), return_index=True)
        grid = np.arange(h[0], h[-1] + 2.0, 2.0) if len(h) > 1 else np.zeros(0)
        want = [] if len(grid) < 3 else np.convolve(np.pad(np.diff(np.interp(grid, h, first)) / 2.0, 1, "edge"), np.ones(3) / 3, "valid").tolist()
        assert got[k] == pytest.approx(want)


def test_exact_quantiles(spark):
    r = random.Random(6)
    for values in ([r.gauss(0, 5) for _ in range(3_000)], [r.randint(0, 3) for _ in range(500)], [7.0], [1.0, 2.0], [None, 4.0, None]):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
        shares = [0.0, 0.2, 0.25, 0.5, 0.9, 1.0]
        assert rk.exact_quantiles(df, "v", shares) == pytest.approx(np.quantile([v for v in values if v is not None], shares).tolist())
    assert rk.exact_quantiles(df.limit(0), "v", [0.5]) == []


def test_image_bootstrap_matches_a_plain_loop(spark):
    r = random.Random(7)
    rows = [(p, y, i, float(r.randint(0, 50))) for p in range(4) for y in (1, 2) for i in range(5) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "pixel int, year int, image int, value double")
    got = {(x["replicate"], x["year"]): x["median"] for x in rs.image_bootstrap(df, "pixel", "year", "image", "value", 6).collect()}
    images = {y: sorted({i for _, z, i, _ in rows if z == y}) for y in (1, 2)}
    draws = spark.createDataFrame([(y, k, d, len(images[y])) for y in (1, 2) for k in range(6) for d in range(len(images[y]))], "year int, replicate int, d long, n long")
    picked = {}
    for x in draws.select("year", "replicate", rs.draw(F.col("replicate") * 100 + F.col("year") % 100, F.col("d"), F.col("n")).alias("i")).collect():
        picked.setdefault((x["replicate"], x["year"]), []).append(images[x["year"]][x["i"]])
    for (k, y), own in picked.items():
        medians = []
        for p in range(4):
            held = sorted(v for i in own for q, z, j, v in rows if (q, z, j) == (p, y, i))
            if held:
                medians.append(held[(len(held) - 1) // 2])
        assert got[k, y] == float(np.median(medians))


def test_manifest_hashes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    got = so.dataset_manifest(spark, str(tmp_path)).first()
    assert (got["file"], got["length"], got["sha256"]) == ("a.txt", 3, hashlib.sha256(b"one").hexdigest())


def test_diversity_of_edge_profiles(spark):
    """Null, empty, negative, constant and single-level profiles, and values above the cap."""
    from voxelspan.functions import columns as C

    rows = [(0, None), (1, []), (2, [-1.0, 0.0]), (3, [7.0] * 4), (4, [-3.0, 1.0]), (5, [1.0, 6.0, 500.0, 59.0])]
    df = spark.createDataFrame(rows, "id int, p array<double>")
    got = {x["id"]: x for x in df.select("id", *(c.alias(k) for k, c in C.diversity(F.col("p"), 5.0, 60.0, 0, 3).items())).collect()}
    assert all(got[k]["fhd"] is None and got[k]["enl2d"] is None for k in (0, 1, 2))
    assert got[3]["fhd"] == pytest.approx(0) and got[3]["enl2d"] == pytest.approx(1) == got[4]["enl2d"]
    assert got[5]["fhd"] == pytest.approx(1.5 * math.log(2)) and got[5]["enl2d"] == pytest.approx(16 / 6) and got[5]["canopy_ratio"] == pytest.approx(58 / 59)


def test_random_intercept_matches_dense_matrices(spark):
    r = np.random.default_rng(4)
    band = r.integers(0, 6, 90)
    x, g = r.normal(50, 9, 90), r.integers(0, 2, 90)
    y = 3 + 1.5 * g + 0.2 * x + r.normal(0, 2, 6)[band] + r.normal(0, 1, 90)
    rows = [(float(a), int(b), float(c), int(d), "k") for a, b, c, d in zip(y, g, x, band, strict=True)] + [(None, 1, 2.0, 3, "k"), (1.0, 1, None, 3, "k")]
    df = spark.createDataFrame(rows, "y double, g int, x double, band int, cell string")
    got = {t["term"]: t for t in re_.random_intercept_fit(df, "y", ["g", "x"], "band", levels={"cell": ["k", "m"]}).collect()}
    assert set(got) == {"g", "x"} and got["g"]["n"] == 90 and got["g"]["bands"] == 6
    design, same = np.column_stack([np.ones(90), g, x]), (band[:, None] == band[None, :]).astype(float)

    def dense(ratio):
        v = np.linalg.inv(np.eye(90) + ratio * same)
        a = design.T @ v @ design
        beta = np.linalg.solve(a, design.T @ v @ y)
        s2 = (y - design @ beta) @ v @ (y - design @ beta) / 87
        return 87 * np.log(s2) - np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], beta, np.sqrt(s2 * np.diag(np.linalg.inv(a)))

    crit, beta, se = dense(got["g"]["ratio"])
    assert crit <= min(dense(k)[0] for k in np.exp(np.linspace(-8, 5, 80))) + 1e-9
    assert np.allclose([got["g"]["coef"], got["x"]["coef"]], beta[1:]) and np.allclose([got["g"]["se"], got["x"]["se"]], se[1:])
    one = re_.random_intercept_fit(df.where("band = 1"), "y", ["g", "x"], "band").collect()
    assert {t["ratio"] for t in one} == {0.0} and re_.random_intercept_fit(df.limit(0), "y", ["g", "x"], "band").count() == 0


@pytest.mark.parametrize("name", ["y12_same_season_offset", "j17_scene_candidates", "j28_expanding_window_scenes", "t01_paired_wilcoxon", "t02_rank_sum", "t04_mcnemar", "t03_hodges_lehmann", "t03_pseudomedian", "f08_decode_shot_id", "r21_pixel_biome", "j11_attach_by_pixel", "j21_grid_assign", "y03_yearly_truth_metrics", "y13_growing_anomaly", "y13_weather_anomalies", "y11_per_image_height_offsets", "s03_read_delimited_header", "s05_read_geojson_csv", "s06_write_by_tile", "s08_read_items_for_tiles", "w03_global_residual_terciles", "a08_equal_count_bins"])
@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_sql_of_this_round(spark, name):
    compared(spark, name)
