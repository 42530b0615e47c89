"""Bootstrap inference from sufficient statistics of blocks: replicates draw blocks, never rows.

A draw is whole-number arithmetic on replicate and draw number, so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .order import beside, quantiles

PRIME, FACTOR = 2147483647, 48271


def draw(replicate: Column, number: Column, n: Column) -> Column:
    """A block number from 0 to n - 1."""
    x = (replicate.cast("long") * 1000003 + number.cast("long") * 7919 + 104729) % PRIME
    for _ in range(3):
        x = (x * FACTOR + 12345) % PRIME
    return x % n


def numbered_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks (one row each) with a number from 0 in the order of their key: sorted by range and stored with their place; a row per task has the blocks before it."""
    keyed = blocks.withColumn("_key", F.struct(key))  # a null key is a block too
    held = stored(keyed.repartitionByRange("_key").sortWithinPartitions("_key").drop("_key").withColumn("_at", F.monotonically_increasing_id()), "blocks")
    held = held.withColumn("_part", F.shiftright("_at", 33))
    ahead = held.groupBy("_part").agg(F.count("*").alias("_sum"))  # a row per task
    ahead = ahead.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return held.join(F.broadcast(ahead), "_part").withColumn("_i", F.col("_ahead") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_ahead")


def picks(held: DataFrame, replicates: int) -> DataFrame:
    """(replicate, _i, _k): how often each replicate draws the blocks numbered ``_i``; blocks it leaves out have no row. The blocks' own numbers are the numbers of the draws, so tasks share them."""
    n = held.agg(F.count("*").cast("long").alias("_n"))
    draws = held.select(F.col("_i").alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).crossJoin(F.broadcast(n))  # one row
    return draws.select("replicate", draw(F.col("replicate"), F.col("_d"), F.col("_n")).alias("_i")).groupBy("replicate", "_i").agg(F.count("*").alias("_k"))


def replicate_sums(blocks: DataFrame, key: str, sums: Sequence[str], replicates: int) -> DataFrame:
    """Sums of the drawn blocks' statistics per replicate; as many draws as blocks. Blocks may be as many as rows, so none of the sides is broadcast."""
    held = numbered_blocks(blocks, key)
    return picks(held, replicates).join(held.hint("merge"), "_i").groupBy("replicate").agg(*(F.sum(F.col(c) * F.col("_k")).alias(c) for c in sums))


def multiplicities(blocks: DataFrame, key: str, replicates: int) -> DataFrame:
    """(key, times): per block an array of how often each replicate draws it, so that rows need not be copied per replicate."""
    held = numbered_blocks(blocks, key)
    drawn = picks(held, replicates).groupBy("_i").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "_k"))).alias("_m"))  # at most ``replicates`` entries
    times = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0)))
    none = F.array_repeat(F.lit(0).cast("long"), replicates)
    return held.join(drawn.hint("merge"), "_i", "left").select(key, F.coalesce(times, none).alias("times"))


def error_sums(df: DataFrame, y: str, a: str, b: str, block: str) -> DataFrame:
    ea, eb = F.col(a) - F.col(y), F.col(b) - F.col(y)
    return df.dropna(subset=[y, a, b]).groupBy(block).agg(F.count("*").alias("n"), F.sum(ea).alias("ea"), F.sum(eb).alias("eb"), F.sum(F.abs(ea)).alias("aa"), F.sum(F.abs(eb)).alias("ab"), F.sum(ea * ea).alias("sa"), F.sum(eb * eb).alias("sb"))


def _differences() -> list[Column]:
    n = F.col("n")
    return [
        (F.sqrt(F.col("sa") / n) - F.sqrt(F.col("sb") / n)).alias("rmse"), ((F.col("aa") - F.col("ab")) / n).alias("mae"),
        ((F.col("ea") - F.col("eb")) / n).alias("me"), (F.abs(F.col("ea") / n) - F.abs(F.col("eb") / n)).alias("abs_me")]


def bootstrap_metric_diff(df: DataFrame, y: str, a: str, b: str, block: str, replicates: int = 200) -> DataFrame:
    """Per metric the difference a - b, its 95 % interval and a two-sided p of at least 1 / replicates."""
    sums = error_sums(df, y, a, b, block)
    names = ["rmse", "mae", "me", "abs_me"]
    total = sums.agg(*(F.sum(c).alias(c) for c in sums.columns if c != block)).select(*_differences())
    reps = replicate_sums(sums, block, [c for c in sums.columns if c != block], replicates).select(*_differences())
    long = lambda df: df.select(F.expr(f"stack(4, {', '.join(f"'{m}', {m}" for m in names)}) as (metric, value)"))
    side = F.least(F.avg((F.col("value") <= 0).cast("double")), F.avg((F.col("value") >= 0).cast("double")))
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    ci = long(reps).groupBy("metric").agg(q.alias("_q"), F.greatest(F.least(2 * side, F.lit(1.0)), F.lit(1.0 / replicates)).alias("p"))
    return long(total).withColumnRenamed("value", "difference").join(ci, "metric").select("metric", "difference", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "p")


def bootstrap_mean_ci(df: DataFrame, value: str, block: str, replicates: int = 200) -> DataFrame:
    sums = df.where(F.col(value).isNotNull()).groupBy(block).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    reps = replicate_sums(sums, block, ["n", "s"], replicates).select((F.col("s") / F.col("n")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return reps.agg(q.alias("_q")).crossJoin(sums.agg((F.sum("s") / F.sum("n")).alias("mean"))).select("mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))  # one row each


def _corr(n: str = "n") -> Column:
    c = lambda x: F.col(x)
    return (c("xy") - c("x") * c("y") / c(n)) / F.sqrt((c("xx") - c("x") * c("x") / c(n)) * (c("yy") - c("y") * c("y") / c(n)))


def bootstrap_corr_ci(df: DataFrame, x: str, y: str, block: str, replicates: int = 200) -> DataFrame:
    """Pearson r with a percentile interval, from the moments of blocks."""
    a, b = F.col(x), F.col(y)
    sums = df.dropna(subset=[x, y]).groupBy(block).agg(F.count("*").alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(b * b).alias("yy"), F.sum(a * b).alias("xy"))
    names = ["n", "x", "y", "xx", "yy", "xy"]
    reps = replicate_sums(sums, block, names, replicates).select(_corr().alias("r"))
    q = F.percentile("r", F.array(F.lit(0.025), F.lit(0.975)))
    return reps.agg(q.alias("_q")).crossJoin(sums.agg(*(F.sum(c).alias(c) for c in names)).select(_corr().alias("r"))).select("r", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))  # one row each


def bootstrap_diff_ci(df: DataFrame, value: str, group: str, block: str, replicates: int = 200) -> DataFrame:
    """Mean of group 1 less mean of group 0, with a percentile interval."""
    of = lambda k: F.when(F.col(group) == k, F.col(value))
    sums = df.groupBy(block).agg(F.count(of(1)).alias("n1"), F.sum(F.coalesce(of(1), F.lit(0.0))).alias("s1"), F.count(of(0)).alias("n0"), F.sum(F.coalesce(of(0), F.lit(0.0))).alias("s0"))
    names = ["n1", "s1", "n0", "s0"]
    diff = F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    reps = replicate_sums(sums, block, names, replicates).select(diff.alias("d"))
    return reps.agg(q.alias("_q")).crossJoin(sums.agg(*(F.sum(c).alias(c) for c in names)).select(diff.alias("difference"))).select("difference", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))  # one row each


def bootstrap_slope(df: DataFrame, y: str, x: str, block: str, replicates: int = 200) -> DataFrame:
    """Slope of y on x refitted on every replicate of whole blocks, in closed form from their moments."""
    a, b = F.col(x), F.col(y)
    names = ["n", "x", "y", "xx", "xy"]
    sums = df.dropna(subset=[x, y]).groupBy(block).agg(F.count("*").alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(a * b).alias("xy"))
    slope = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("xx") - F.col("x") * F.col("x") / F.col("n"))
    q = F.percentile("s", F.array(F.lit(0.025), F.lit(0.975)))
    reps = replicate_sums(sums, block, names, replicates).select(slope.alias("s"))
    return reps.agg(q.alias("_q")).crossJoin(sums.agg(*(F.sum(c).alias(c) for c in names)).select(slope.alias("slope"))).select("slope", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))  # one row each


def image_bootstrap(df: DataFrame, pixel: str, year: str, image: str, value: str, replicates: int) -> DataFrame:
    """Per replicate and year: images drawn with replacement, lower median per pixel by running counts, then the median over pixels."""
    w = Window.partitionBy(year).orderBy(image)
    images = df.select(year, image).distinct().withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(year))})
    draws = images.select(year, "_n").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    picked = draws.select(year, "replicate", draw(F.col("replicate") * 100 + F.col(year) % 100, F.col("_d"), F.col("_n")).alias("_i")).groupBy(year, "replicate", "_i").agg(F.count("*").alias("_k"))
    rows = picked.join(images.drop("_n"), [year, "_i"]).join(df.where(F.col(value).isNotNull()), [year, image])
    p = Window.partitionBy("replicate", year, pixel)
    run = rows.withColumns({"_t": F.sum("_k").over(p), "_r": F.sum("_k").over(p.orderBy(value, image).rowsBetween(Window.unboundedPreceding, 0))})
    medians = run.where(2 * F.col("_r") >= F.col("_t")).groupBy("replicate", year, pixel).agg(F.min(value).alias("_m"))
    return medians.groupBy("replicate", year).agg(F.median("_m").alias("median"))


def image_bootstrap_change(df: DataFrame, tile: str, pixel: str, year: str, image: str, value: str, replicates: int, parts: int = 16) -> DataFrame:
    """(tile, year, boot, change): median over pixels of the change from the tile's year before, with the images of every year drawn anew; boot 0 takes each image once.

    A pixel's year is the lower median of its values on the drawn images, as often as they are drawn. An image carries an array of
    how often each replicate draws it, so no row is copied per replicate; a tile's pixels are dealt over ``parts`` tasks. Nulls don't count; a
    change needs both years; years or tiles without changes have no row.
    """
    keys = [tile, year]
    images = df.select(*keys, image).distinct()
    w = Window.partitionBy(*keys)  # the images of a tile's year
    held = images.withColumns({"_i": F.row_number().over(w.orderBy(image)) - 1, "_n": F.count("*").over(w)})
    sizes = held.select(*keys, "_n").distinct().withColumn("_seed", F.pmod(F.xxhash64(*keys), F.lit(100_000)) * 4096)
    draws = sizes.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    drawn = draws.select(*keys, "_r", draw(F.col("_seed") + F.col("_r"), F.col("_d"), F.col("_n")).alias("_i")).groupBy(*keys, "_i", "_r").agg(F.count("*").alias("_k"))
    per = drawn.groupBy(*keys, "_i").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_k"))).alias("_m"))  # at most ``replicates`` entries
    times = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0)).cast("int"))
    times = F.concat(F.array(F.lit(1)), F.coalesce(times, F.array_repeat(F.lit(0), replicates)))
    known = stored(beside(held, per, [*keys, "_i"], "left").select(F.col(tile).alias("_tile"), F.col(year).alias("_year"), F.col(image).alias("_image"), times.alias("_times")), "images")
    rows = df.where(F.col(value).isNotNull()).select(F.col(tile).alias("_tile"), F.col(year).alias("_year"), F.col(pixel).alias("_pixel"), F.col(image).alias("_image"), F.col(value).cast("double").alias("_value"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_pixel"), F.lit(parts)).cast("int"))
    spread = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = {c: df.schema[c].dataType.simpleString() for c in (tile, year, pixel)}

    def medians(mine: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(drawn):
            return pd.DataFrame(columns=["_tile", "_year", "_pixel", "_medians"])
        count = dict(zip(drawn["_image"], (np.asarray(x) for x in drawn["_times"]), strict=True))
        mine = mine.sort_values(["_pixel", "_value"], kind="stable")
        codes, names = pd.factorize(mine["_pixel"])
        out, value = [], mine["_value"].to_numpy()
        weight = np.stack([count[x] for x in mine["_image"]])
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(codes)], strict=True):
            run = np.cumsum(weight[a:b], axis=0)
            total = run[-1]
            at = (run * 2 < total).sum(0)  # first place with half of the draws
            out.append([float(v) if t else None for v, t in zip(value[a:b][np.minimum(at, b - a - 1)], total, strict=True)])
        return pd.DataFrame({"_tile": [mine["_tile"].iloc[0]] * len(out), "_year": [mine["_year"].iloc[0]] * len(out), "_pixel": names, "_medians": out})

    yearly = rows.groupBy("_tile", "_year", "_part").cogroup(spread.groupBy("_tile", "_year", "_part")).applyInPandas(medians, f"_tile {kind[tile]}, _year {kind[year]}, _pixel {kind[pixel]}, _medians array<double>")
    yearly = stored(yearly, "medians")
    years = yearly.select("_tile", "_year").distinct()
    before = years.withColumn("_before", F.lag("_year").over(Window.partitionBy("_tile").orderBy("_year"))).where("_before is not null")  # a row per year
    now = beside(yearly, before, ["_tile", "_year"])
    then = yearly.select("_tile", F.col("_year").alias("_before"), "_pixel", F.col("_medians").alias("_old"))
    change = beside(now, then, ["_tile", "_before", "_pixel"]).select("_tile", "_year", F.posexplode(F.zip_with("_medians", "_old", lambda x, y: x - y)).alias("boot", "change"))
    found = quantiles(change, "change", ["_tile", "_year", "boot"], [0.5])
    return found.select(F.col("_tile").alias(tile), F.col("_year").alias(year), "boot", F.col("q")[0].alias("change"))
