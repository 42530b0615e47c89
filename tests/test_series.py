"""Same-season offsets against a plain loop."""

import numpy as np
import pytest

from voxelspan.operators import series


@pytest.mark.parametrize("n", [1, 2, 37, 400])
def test_medians_of_other_years(n):
    rng = np.random.default_rng(n)
    year, day, value = rng.integers(2018, 2022, n), rng.integers(1, 367, n), rng.integers(0, 30, n) / 4
    asked = np.flatnonzero(rng.random(n) < 0.8)
    median, many = series.others_median(year, day, value, asked, 20)
    for k, m, c in zip(asked, median, many, strict=True):
        others = value[(np.abs(day - day[k]) <= 20) & (year != year[k])]
        assert c == len(others) and (np.isnan(m) if not c else m == np.median(others))


def test_offsets_of_images(spark):
    rng = np.random.default_rng(3)
    rows = [(int(t), f"i{k}", int(y), int(d), float(v)) for k, (t, y, d, v) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(2018, 2021, 300), rng.integers(1, 367, 300), rng.normal(size=300), strict=True))]
    rows += [(None, "a", 2018, 5, 1.0), (None, "b", 2019, 25, 4.0), (None, "c", 2019, 26, 9.0), (5, "alone", 2018, 1, 1.0), (0, "null", 2018, 3, None), (0, "none", None, 3, 1.0)]
    df = spark.createDataFrame(rows, "tile int, image string, year int, doy int, value double")
    wanted = []
    for t, i, y, d, v in rows:
        others = [x[4] for x in rows if x[0] == t and None not in x[2:] and y is not None and x[2] != y and abs(x[3] - d) <= 20]
        if others and v is not None:
            wanted.append((str(t), i, round(v - float(np.median(others)), 9), len(others)))
    found = [(str(r.tile), r.image, round(r.offset, 9), r.n) for r in series.same_season_offset(df, "tile", "image", "year", "doy", "value", 20).collect()]
    assert sorted(found) == sorted(wanted)
    assert series.same_season_offset(df.limit(0), "tile", "image", "year", "doy", "value", 20).count() == 0


def test_leaks_and_dark_pixels(spark):
    from pyspark.sql import functions as F

    leak = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 1, 0.5, 7.0), (1, 1, 1.0, 9.0), (1, 1, None, 1.0), (2, 1, 0.4, None), (None, 1, 0.2, 3.0)], "tile int, year int, share double, dev double")
    assert {(r.tile, r.n, r.share_median) for r in series.cloud_leak_tiles(leak, "tile", "year").collect()} == {(1, 3, 0.5), (2, 1, 0.4), (None, 1, 0.2)}
    assert sorted(tuple(r) for r in series.cloud_leak_bins(leak, "dev", [0.0, 0.2, 0.5, 1.0]).collect()) == [(0, 1, 5.0, 0.0), (1, 1, 3.0, 0.2), (2, 2, 8.0, 0.75)]
    px = spark.createDataFrame([(1, float(k), k % 2 == 0) for k in range(200)] + [(2, 1.0, True), (3, 1.0, False), (1, None, True)], "image int, value double, clear boolean")
    found = {r.image: (r.n_clear, r.p2_clear) for r in series.darkest_clear(px, "image", "value", F.col("clear")).collect()}
    assert found[2] == (1, None) and found[1] == (100, pytest.approx(np.quantile(np.arange(0, 200, 2), 0.02))) and 3 not in found
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 5.0), ("b", 2.0, 4.0), ("b", None, 1.0)], "g string, c double, x double")
    got = {(r.g, r.overall): r for r in series.anomaly_summary(rows, "g", "c", "x").collect()}
    assert got[None, True].spearman == pytest.approx(1.0) and got["a", False].median_c == 2.0 and got["b", False].n == 1
