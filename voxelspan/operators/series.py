"""Change over years at fixed pixels: offsets, spread, differences, climatologies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import interval_metrics, weighted_pool
from .order import beside, quantiles
from .ranking import global_avg_rank


def complete_pixels(df: DataFrame, tile: str, pixel: str, year: str, value: str, least_share: float) -> DataFrame:
    """Rows of years with enough valid pixels in their tile, at pixels valid in all those years."""
    n_pixels = df.groupBy(tile).agg(F.count_distinct(pixel).alias("_p"))
    years = df.where(F.col(value).isNotNull()).groupBy(tile, year).agg(F.count_distinct(pixel).alias("_v")).join(n_pixels, tile).where(F.col("_v") >= least_share * F.col("_p")).select(tile, year)
    kept = df.where(F.col(value).isNotNull()).join(years, [tile, year])
    n_years = years.groupBy(tile).agg(F.count("*").alias("_y"))
    whole = kept.groupBy(tile, pixel).agg(F.count_distinct(year).alias("_k")).join(n_years, tile).where("_k = _y").select(tile, pixel)
    return kept.join(whole, [tile, pixel])


def year_offsets(df: DataFrame, tile: str, pixel: str, year: str, value: str) -> DataFrame:
    """Per tile and year the median of (value - median of the pixel over years)."""
    medians = df.groupBy(tile, pixel).agg(F.median(value).alias("_m"))
    return df.join(medians, [tile, pixel]).groupBy(tile, year).agg(F.median(F.col(value) - F.col("_m")).alias("offset"), F.count("*").alias("n"))


def pixel_spread(df: DataFrame, tile: str, pixel: str, value: str) -> DataFrame:
    """Per tile median and p90 over pixels of the sample sd and of 1.4826 MAD over years."""
    medians = df.groupBy(tile, pixel).agg(F.median(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    mad = df.join(medians, [tile, pixel]).groupBy(tile, pixel).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("_mad"), F.max("_sd").alias("_sd"))
    return mad.groupBy(tile).agg(F.count("*").alias("n"), F.median("_sd").alias("sd_median"), F.percentile("_sd", F.lit(0.9)).alias("sd_p90"), F.median("_mad").alias("mad_median"), F.percentile("_mad", F.lit(0.9)).alias("mad_p90"))


def year_to_year(df: DataFrame, tile: str, pixel: str, year: str, value: str) -> DataFrame:
    """Median over pixels of the change from the year before."""
    w = Window.partitionBy(tile, pixel).orderBy(year)
    rows = df.withColumns({"_v": F.lag(value).over(w), "_y": F.lag(year).over(w)}).where(F.col("_y") == F.col(year) - 1)
    return rows.groupBy(tile, year).agg(F.median(F.col(value) - F.col("_v")).alias("change"), F.count("*").alias("n"))


def neighbour_change(df: DataFrame, tile: str, pixel: str, year: str, value: str) -> DataFrame:
    """Median over pixels of the difference from the mean of the years before and after."""
    w = Window.partitionBy(tile, pixel).orderBy(year)
    rows = df.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w), "_x": F.lag(year).over(w), "_y": F.lead(year).over(w)}).where((F.col("_x") == F.col(year) - 1) & (F.col("_y") == F.col(year) + 1))
    return rows.groupBy(tile, year).agg(F.median(F.col(value) - (F.col("_a") + F.col("_b")) / 2).alias("change"), F.count("*").alias("n"))


def anomaly_change(df: DataFrame, anomalies: DataFrame, tile: str, year: str, value: str, wanted: int, reference: Sequence[int], anomaly: str) -> DataFrame:
    """Per tile the mean of a year less that of the reference years, beside an external anomaly."""
    rows = df.groupBy(tile).agg(F.avg(F.when(F.col(year) == wanted, F.col(value))).alias("_a"), F.avg(F.when(F.col(year).isin(list(reference)), F.col(value))).alias("_b"))
    return rows.select(tile, (F.col("_a") - F.col("_b")).alias("change")).join(anomalies.select(tile, anomaly), tile)


def cloud_leak(df: DataFrame, pixel: str, year: str, ok: Column, score: str, least: float) -> DataFrame:
    """Per pixel and year images used, those used below the clear score, and their share."""
    rows = df.groupBy(pixel, year).agg(F.count_if(ok).alias("used"), F.count_if(ok & (F.col(score) < least)).alias("leaked"))
    return rows.withColumn("share", F.try_divide("leaked", "used"))


def anomaly_summary(changes: DataFrame, group: str, change: str, anomaly: str) -> DataFrame:
    """Per group n, medians of change and anomaly, and the same with Spearman's r over all rows (group null, overall true). Rows with a null in either don't count."""
    rows = changes.dropna(subset=[change, anomaly]).select(group, change, anomaly)

    def medians(by: list[str]) -> DataFrame:
        one = lambda c: quantiles(rows, c, by, [0.5]).select(*by, "n", F.col("q")[0].alias(f"median_{c}"))
        return beside(one(change), one(anomaly).drop("n"), by)

    ranked = global_avg_rank(global_avg_rank(rows, change, "_rx"), anomaly, "_ry")
    r = ranked.agg(F.corr("_rx", "_ry").alias("spearman"))
    overall = medians([]).crossJoin(r).withColumns({group: F.lit(None).cast(changes.schema[group].dataType), "overall": F.lit(True)})  # one row each
    return medians([group]).withColumns({"spearman": F.lit(None).cast("double"), "overall": F.lit(False)}).unionByName(overall)


def cloud_leak_tiles(leak: DataFrame, tile: str, year: str) -> DataFrame:
    """Median share of leaked images over the pixels of a tile and year; pixel-years without used images don't count."""
    return quantiles(leak, "share", [tile, year], [0.5]).select(tile, year, "n", F.col("q")[0].alias("share_median"))


def cloud_leak_bins(leak: DataFrame, deviation: str, edges: Sequence[float]) -> DataFrame:
    """Per bin of the leaked share, [edge, next edge) and the last one closed, n, median deviation and median share. Rows outside the edges or with a null don't count."""
    at = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges[1:-1])), lambda e: e <= F.col("share")))
    rows = leak.dropna(subset=["share", deviation]).where((F.col("share") >= edges[0]) & (F.col("share") <= edges[-1])).withColumn("bin", at)
    one = lambda c, name: quantiles(rows, c, ["bin"], [0.5]).select("bin", "n", F.col("q")[0].alias(name))
    return beside(one(deviation, "deviation_median"), one("share", "share_median").drop("n"), ["bin"])


def darkest_clear(df: DataFrame, image: str, value: str, clear: Column, least: int = 50, share: float = 0.02) -> DataFrame:
    """Per image the quantile ``share`` of its clear pixels' values, null for fewer than ``least`` of them, and their number; images without clear pixels have no row."""
    q = quantiles(df.where(clear), value, [image], [share])
    return q.select(image, F.col("n").alias("n_clear"), F.when(F.col("n") >= least, F.col("q")[0]).alias("p2_clear"))


def input_offsets(df: DataFrame, tile: str, pixel: str, year: str, bands: Sequence[str], masks: dict[str, Column]) -> DataFrame:
    """``year_offsets`` of every band under every mask."""
    out = None
    for name, keep in masks.items():
        rows = df.where(keep)
        long = rows.select(tile, pixel, year, F.expr(f"stack({len(bands)}, {', '.join(f"'{b}', {b}" for b in bands)}) as (band, value)"))
        medians = long.groupBy(tile, pixel, "band").agg(F.median("value").alias("_m"))
        part = long.join(medians, [tile, pixel, "band"]).groupBy(tile, "band", year).agg(F.median(F.col("value") - F.col("_m")).alias("offset")).withColumn("mask", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def per_image_offsets(df: DataFrame, image: str, pixel: str, value: str, kind: str, least: dict[str, int]) -> DataFrame:
    """Per image median deviation from the pixel medians for each kind of pixel with enough of them."""
    medians = df.groupBy(pixel).agg(F.median(value).alias("_m"))
    rows = df.join(medians, pixel).withColumn("_d", F.col(value) - F.col("_m"))
    of = lambda k, n: F.when(F.count_if(F.col(kind) == k) >= n, F.median(F.when(F.col(kind) == k, F.col("_d")))).alias(f"offset_{k}")
    return rows.groupBy(image).agg(F.count("*").alias("n"), *(of(k, n) for k, n in least.items()))


class RankIndex:
    """Counts by value rank and place of a sequence: for any stretch of it, how many of its ranks have a bit set, bit by bit from the highest.

    Each level holds the sequence sorted by the bits before it, and running counts of the zeros of its own bit; memory is the sequence times the bits of a rank.
    """

    def __init__(self, ranks: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for bit in range(bits - 1, -1, -1):
            one = (ranks >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            ranks = ranks[np.argsort(one, kind="stable")]

    def split(self, level: int, at: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Number of zeros in each stretch, and where its zeros and its ones lie on the next level."""
        run = self.zeros[level]
        low = [run[at[0]], run[at[1]]]
        return low[1] - low[0], low, [x - z + run[-1] for x, z in zip(at, low, strict=True)]


def others_median(year: np.ndarray, day: np.ndarray, value: np.ndarray, asked: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per asked row the median and number of the values within ``window`` days in other years; NaN where there are none.

    The k-th value is found bit by bit of its rank, in the index by day less that by year and day.
    """
    order = np.argsort(value, kind="stable")
    rank = np.empty(len(value), np.int64)
    rank[order] = np.arange(len(value))
    bits = max(1, int(len(value) - 1).bit_length())
    by_day = np.argsort(day, kind="stable")
    key = year * 1_000_003 + day
    by_year = np.argsort(key, kind="stable")
    whole, own = RankIndex(rank[by_day], bits), RankIndex(rank[by_year], bits)
    d, k = day[asked], key[asked]
    a = [np.searchsorted(day[by_day], d - window), np.searchsorted(day[by_day], d + window, "right")]
    b = [np.searchsorted(key[by_year], k - window), np.searchsorted(key[by_year], k + window, "right")]
    n = (a[1] - a[0]) - (b[1] - b[0])
    found = []
    for wanted in ((n - 1) // 2, n // 2):
        x, y, left, at = a, b, wanted.copy(), np.zeros(len(d), np.int64)
        for level in range(bits):
            zx, x0, x1 = whole.split(level, x)
            zy, y0, y1 = own.split(level, y)
            up = left >= zx - zy
            left = np.where(up, left - (zx - zy), left)
            at = at * 2 + up
            x = [np.where(up, q, p) for p, q in zip(x0, x1, strict=True)]
            y = [np.where(up, q, p) for p, q in zip(y0, y1, strict=True)]
        found.append(value[order[np.minimum(at, len(value) - 1)]])
    return np.where(n > 0, (found[0] + found[1]) / 2, np.nan), n


def same_season_offset(df: DataFrame, tile: str, image: str, year: str, doy: str, value: str, window: int) -> DataFrame:
    """Value of an image less the median of other years' images within a window of days of the year (no wrap at new year), and their number.

    Days meet in buckets of twice the window, each with the days beside it that its images reach: an image is in two buckets at most. A bucket of a tile is one task's group and holds an index of ranks over all years, linear in its images (times the bits of their number). Images without year, day or value neither count nor come out; nor do those without others.
    """
    wide = 2 * window
    own = F.floor(F.col(doy) / wide)
    near = F.sequence(F.floor((F.col(doy) - window) / wide), F.floor((F.col(doy) + window) / wide))
    rows = df.dropna(subset=[year, doy, value]).select(F.col(tile).alias("_t"), F.col(image).alias("_i"), F.col(year).cast("long").alias("_y"), F.col(doy).cast("long").alias("_d"), F.col(value).cast("double").alias("_v"), own.alias("_o"), F.explode(near).alias("_w"))
    kinds = {c: df.schema[c].dataType.simpleString() for c in (tile, image)}

    def match(held: pd.DataFrame) -> pd.DataFrame:
        asked = np.flatnonzero((held["_o"] == held["_w"]).to_numpy())
        median, n = others_median(held["_y"].to_numpy(), held["_d"].to_numpy(), held["_v"].to_numpy(), asked, window)
        out = pd.DataFrame({tile: held["_t"].iloc[asked].to_numpy(), image: held["_i"].iloc[asked].to_numpy(), "offset": held["_v"].to_numpy()[asked] - median, "n": n})
        return out[n > 0]

    return rows.groupBy("_t", "_w").applyInPandas(match, f"`{tile}` {kinds[tile]}, `{image}` {kinds[image]}, offset double, n bigint")


def climatology_anomaly(df: DataFrame, tile: str, year: str, doy: str, value: str) -> DataFrame:
    """Per tile and year the mean of values less the median of their tile and day of year."""
    base = df.groupBy(tile, doy).agg(F.median(value).alias("_m"))
    return df.join(base, [tile, doy]).groupBy(tile, year).agg(F.avg(F.col(value) - F.col("_m")).alias("anomaly"))


def growing_anomaly(df: DataFrame, tile: str, year: str, doy: str, value: str, growing: Column) -> DataFrame:
    """Per tile and year the median over growing composites of value less the median over years of the same tile and day of year."""
    base = df.groupBy(tile, doy).agg(F.median(value).alias("_m"))
    return df.where(growing).join(base, [tile, doy]).groupBy(tile, year).agg(F.median(F.col(value) - F.col("_m")).alias("anomaly"), F.count("*").alias("n"))


def weather_anomalies(df: DataFrame, tile: str, year: str, growing: Column, totals: Sequence[str] = (), means: Sequence[str] = ()) -> DataFrame:
    """Growing months per tile and year: totals in percent above the tile's mean over years, means less the tile's mean over years."""
    years = df.where(growing).groupBy(tile, year).agg(*(F.sum(c).alias(c) for c in totals), *(F.avg(c).alias(c) for c in means))
    w = Window.partitionBy(tile)  # a row per year
    percent = [(100 * (F.try_divide(F.col(c), F.avg(c).over(w)) - 1)).alias(f"{c}_percent") for c in totals]
    return years.select(tile, year, *percent, *((F.col(c) - F.avg(c).over(w)).alias(f"{c}_anomaly") for c in means))


def scene_counts(candidates: DataFrame, selected: DataFrame, tile: str, year: str, scene: str, cloud: str) -> DataFrame:
    """Candidate and selected scenes per tile and year, and the clouds of the selected."""
    a = candidates.groupBy(tile, year).agg(F.count_distinct(scene).alias("candidates"))
    b = selected.groupBy(tile, year).agg(F.count_distinct(scene).alias("selected"), F.avg(cloud).alias("mean_cloud"), F.max(cloud).alias("max_cloud"))
    return a.join(b, [tile, year], "left").fillna(0, ["selected"])


def yearly_truth_metrics(df: DataFrame, tile: str, biome: str, year: str, level: str, y: str, lo: str, mid: str, hi: str) -> DataFrame:
    """Interval metrics per tile, year and level, pooled by number of rows per year and level for each biome, and for all (pooled = 1)."""
    tiles = interval_metrics(df, y, lo, hi, mid, [tile, biome, year, level])
    return weighted_pool(tiles, [year, level], biome, ["coverage", "above", "below", "median_bias", "mae", "width"])


def per_image_height_offsets(images: DataFrame, yearly: DataFrame, tile: str, pixel: str, year: str, image: str, value: str, least: float, share: float = 0.5) -> DataFrame:
    """Offset of each image at the vegetated pixels of its tile, beside the offset of its year there.

    Pixels are those of ``complete_pixels`` of the yearly values; vegetated ones have a median over years of ``least`` or more. An image's offset is the median of its values less these medians; equal_share is the share of its values that equal the year's.
    """
    whole = complete_pixels(yearly, tile, pixel, year, value, share)
    medians = whole.groupBy(tile, pixel).agg(F.median(value).alias("_m")).where(F.col("_m") >= least)
    base = whole.join(medians, [tile, pixel])
    years = base.groupBy(tile, year).agg(F.median(F.col(value) - F.col("_m")).alias("year_offset"))
    rows = images.where(F.col(value).isNotNull()).join(base.select(tile, pixel, year, F.col(value).alias("_y"), "_m"), [tile, pixel, year])
    of = rows.groupBy(tile, year, image).agg(F.count("*").alias("n_pixels"), F.median(F.col(value) - F.col("_m")).alias("offset"), F.avg((F.col(value) == F.col("_y")).cast("double")).alias("equal_share"))
    return of.join(years, [tile, year])
