"""Composites, blending, masks, stencils and texture over pixel tables (row, col, band, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yearly_composite(images: DataFrame, key: Sequence[str], value: str, valid: Column) -> DataFrame:
    """Per pixel the lower median of valid values, in tenths, and how many there were."""
    rows = images.where(valid).select(*key, F.col(value).alias("_v"))
    return rows.groupBy(*key).agg(F.expr("percentile_disc(0.5) within group (order by _v)").alias("_m"), F.count("*").alias("n")).select(*key, F.round(F.col("_m") * 10).alias("value"), "n")


def majority_mask(images: DataFrame, key: Sequence[str], flag: Column) -> DataFrame:
    """Pixels for which more than half of the images have the flag."""
    return images.groupBy(*key).agg((F.avg(flag.cast("double")) > 0.5).alias("flagged"))


def monthly_composite(images: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """Median and count of values per pixel and calendar month."""
    return images.where(F.col(value).isNotNull()).groupBy(*key, F.month(day).alias("month")).agg(F.median(value).alias("median"), F.count("*").alias("n"))


def border_weight(row: Column, col: Column, height: int, width: int) -> Column:
    """Distance of a pixel to the nearest border of its tile, from 1."""
    return F.least(row + 1, col + 1, height - row, width - col)


def blend_overlaps(pixels: DataFrame, place: Sequence[str], value: str, weight: str, nodata: float, renormalize: bool = True) -> DataFrame:
    """Weighted mean of overlapping tiles at each place. Without ``renormalize`` tiles without data keep their share of the weight."""
    ok = F.col(value) != nodata
    total = F.sum(F.when(ok, F.col(weight))) if renormalize else F.sum(weight)
    return pixels.groupBy(*place).agg(F.coalesce(F.round(F.sum(F.when(ok, F.col(value) * F.col(weight))) / total), F.lit(nodata)).alias(value))


def mask_by_class(pixels: DataFrame, classes: DataFrame, key: Sequence[str], label: str, value: str, masked: Sequence, nodata: float) -> DataFrame:
    rows = pixels.join(classes.select(*key, label), list(key), "left")
    return rows.withColumn(value, F.when(F.col(label).isin(list(masked)), F.lit(nodata)).otherwise(F.col(value))).drop(label)


def apply_tile_shift(pixels: DataFrame, shifts: DataFrame, key: Sequence[str], value: str, shift: str, nodata: float) -> DataFrame:
    rows = pixels.join(shifts.select(*key, shift), list(key), "left")
    return rows.withColumn(value, F.when(F.col(value) == nodata, F.lit(nodata)).otherwise(F.col(value) + F.coalesce(shift, F.lit(0.0)))).drop(shift)


def downsample_mean(pixels: DataFrame, row: str, col: str, value: str, factor: int, nodata: float) -> DataFrame:
    """Mean of the valid pixels of each coarse cell."""
    cell = lambda c: F.floor(F.col(c) / factor).alias(c)
    return pixels.where(F.col(value) != nodata).groupBy(cell(row), cell(col)).agg(F.avg(value).alias(value), F.count("*").alias("n"))


def terrain_slope(pixels: DataFrame, row: str, col: str, height: str, size: float) -> DataFrame:
    """Slope in degrees by Horn's 3 x 3 stencil; pixels without all neighbours are null. Each pixel gives its share to its neighbours, so one aggregation does."""
    shares = F.array(*(F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(j * (2 - abs(i))).alias("wx"), F.lit(i * (2 - abs(j))).alias("wy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    given = pixels.select(row, col, height, F.explode(shares).alias("_s"))
    moved = given.select((F.col(row) + F.col("_s.i")).alias(row), (F.col(col) + F.col("_s.j")).alias(col), (F.col(height) * F.col("_s.wx")).alias("_x"), (F.col(height) * F.col("_s.wy")).alias("_y"), (F.col("_s.i") + F.col("_s.j") * 10 == 0).alias("_own"), F.col(height))
    sums = moved.groupBy(row, col).agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"), F.count(height).alias("_n"), F.max("_own").alias("_own")).where("_own")
    slope = F.degrees(F.atan(F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")) / (8 * size)))
    return sums.select(row, col, F.when(F.col("_n") == 9, slope).alias("slope"))


def stable_class_mask(years: DataFrame, key: Sequence[str], label: str, wanted: int) -> DataFrame:
    return years.groupBy(*key).agg(F.every(F.col(label) == wanted).cast("int").alias("stable"))


def glcm_texture(pixels: DataFrame, patch: str, row: str, col: str, grey: str) -> DataFrame:
    """Co-occurrence over four directions, both ways: contrast, dissimilarity, homogeneity, ASM, energy, entropy, mean, variance, correlation."""
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (1, 1), (1, -1)))))
    a = pixels.select(patch, row, col, F.col(grey).alias("_a"), steps.alias("_s")).select(patch, (F.col(row) + F.col("_s.i")).alias(row), (F.col(col) + F.col("_s.j")).alias(col), "_a")
    pairs = a.join(pixels.select(patch, row, col, F.col(grey).alias("_b")), [patch, row, col]).groupBy(patch, "_a", "_b").agg(F.count("*").alias("_n"))
    both = pairs.union(pairs.select(patch, F.col("_b"), F.col("_a"), "_n")).groupBy(patch, "_a", "_b").agg(F.sum("_n").alias("_n"))
    total = both.groupBy(patch).agg(F.sum("_n").alias("_t"), (F.sum(F.col("_n") * F.col("_a")) / F.sum("_n")).alias("mean"))
    p = F.col("_n") / F.col("_t")
    d = F.col("_a") - F.col("_b")
    rows = both.join(total, patch)
    sums = rows.groupBy(patch).agg(
        F.sum(p * d * d).alias("contrast"), F.sum(p * F.abs(d)).alias("dissimilarity"), F.sum(p / (1 + d * d)).alias("homogeneity"), F.sum(p * p).alias("asm"), (-F.sum(p * F.ln(p))).alias("entropy"),
        F.max("mean").alias("mean"), F.sum(p * (F.col("_a") - F.col("mean")) * (F.col("_a") - F.col("mean"))).alias("variance"), F.sum(p * (F.col("_a") - F.col("mean")) * (F.col("_b") - F.col("mean"))).alias("_cov"))
    return sums.withColumns({"energy": F.sqrt("asm"), "correlation": F.when(F.col("variance") > 0, F.col("_cov") / F.col("variance"))}).drop("_cov")


def forest_pixel_table(pixels: DataFrame, biomes: DataFrame, protected: DataFrame, key: Sequence[str], height: str, least: float) -> DataFrame:
    """Pixels above the forest threshold with biome (0 outside) and whether they are protected."""
    flag = protected.select(*key).distinct().withColumn("protected", F.lit(True))
    rows = pixels.where(F.col(height) >= least).join(biomes, list(key), "left").join(flag, list(key), "left")
    return rows.fillna(0, ["biome"]).withColumn("protected", F.coalesce("protected", F.lit(False)))
