"""Matching, drawn points, shifts and profiles; Arrow and numpy only inside the stretches of a match."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import inside
from ..sources.scratch import scratch_path, stored
from .order import PAIRS, beside, pair_order_statistic


def points_in_boxes(boxes: DataFrame, name: str, box: Sequence[str], n: int, seed: str) -> DataFrame:
    """n uniform points in each box, from md5 so that they do not depend on partitions."""
    rows = boxes.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(name), F.col("point").cast("string")))
    u = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double") / 2.0**32
    x, y = F.col(box[0]) + u(1) * (F.col(box[2]) - F.col(box[0])), F.col(box[1]) + u(9) * (F.col(box[3]) - F.col(box[1]))
    return rows.select(name, "point", x.alias("lon"), y.alias("lat"))


def ring_area(ring: Column) -> Column:
    """Area inside a ring of struct<x,y>, by the shoelace formula about its first corner."""
    n = F.size(ring)
    o = F.get(ring, F.lit(0))

    def term(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])

    return F.when(n > 2, F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(F.lit(0.0))


def part_counts(parts: DataFrame, name: str, part: str, ring: str, n: int) -> DataFrame:
    """``parts`` with ``_k``, its share of the name's n points by area, rounded (halves to even); the largest part, of equal ones the first, takes the rest. Names without area have no row."""
    w = Window.partitionBy(name)  # the parts of one name
    rows = parts.withColumn("_area", ring_area(F.col(ring))).withColumn("_all", F.sum("_area").over(w)).where("_all > 0")
    rows = rows.withColumn("_k", F.bround(F.lit(n) * F.col("_area") / F.col("_all")).cast("long"))
    first = F.row_number().over(w.orderBy(F.desc("_area"), part)) == 1
    return rows.withColumn("_k", F.when(first, F.col("_k") + n - F.sum("_k").over(w)).otherwise(F.col("_k"))).where("_k > 0").drop("_area", "_all")


def _box(ring: Column) -> list[Column]:
    side = lambda c, f: f(F.transform(ring, lambda p: p[c]))
    return [side("x", F.array_min), side("y", F.array_min), side("x", F.array_max), side("y", F.array_max)]


def points_in_polygons(parts: DataFrame, name: str, part: str, ring: str, n: int, seed: str, rounds: int = 16) -> DataFrame:
    """(name, part, point, lon, lat): n uniform points inside each name's rings, which share them by area.

    Each part has an endless row of candidates in its box, from md5 of seed, name, part and number; its points are the first of them
    inside the ring, so they depend on nothing else. Every round tries more candidates for the parts that still lack points: 4 n, then twice as many.
    A part too thin to be hit in all rounds is an error. n is the caller's: one part's candidates of a round are one group.
    """
    lacking = stored(part_counts(parts.select(name, part, ring), name, part, ring, n).withColumn("_found", F.lit(0).cast("long")))
    out, start = None, 0
    for r in range(rounds):
        stop = start + 4 * n * 2**r
        tried = lacking.withColumn("_c", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))))
        digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(name).cast("string"), F.col(part).cast("string"), F.col("_c").cast("string")))
        u = lambda at, d=digest: F.conv(F.substring(d, at, 8), 16, 10).cast("double") / 2.0**32
        x0, y0, x1, y1 = _box(F.col(ring))
        tried = tried.withColumns({"lon": x0 + u(1) * (x1 - x0), "lat": y0 + u(9) * (y1 - y0)}).where(inside(F.col("lon"), F.col("lat"), F.col(ring)))
        at = F.col("_found") + F.row_number().over(Window.partitionBy(name, part).orderBy("_c")) - 1
        found = stored(tried.withColumn("point", at).where(F.col("point") < F.col("_k")).select(name, part, "point", "lon", "lat"))
        out = found if out is None else out.unionByName(found)
        more = found.groupBy(name, part).agg(F.count("*").alias("_more"))
        lacking = stored(lacking.join(more, [name, part], "left").withColumn("_found", F.col("_found") + F.coalesce("_more", F.lit(0))).drop("_more").where("_found < _k"))
        if lacking.isEmpty():
            return out
        start = stop
    raise ValueError(f"no point found in {lacking.count()} parts after {start} candidates: too thin")


def lattice_in_polygons(parts: DataFrame, name: str, part: str, ring: str, n: int) -> DataFrame:
    """(name, part, point, lon, lat): the points inside the ring of an even lattice of m x m over the part's box, its borders left out; m is the square root of the part's share of n, rounded up."""
    rows = part_counts(parts.select(name, part, ring), name, part, ring, n).withColumn("_m", F.ceil(F.sqrt("_k")))
    rows = rows.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") * F.col("_m") - 1)))
    x0, y0, x1, y1 = _box(F.col(ring))
    at = lambda low, high, k: low + (high - low) * (k + 1) / (F.col("_m") + 1)
    rows = rows.withColumns({"lon": at(x0, x1, F.col("point") % F.col("_m")), "lat": at(y0, y1, F.floor(F.col("point") / F.col("_m")))})
    return rows.where(inside(F.col("lon"), F.col("lat"), F.col(ring))).select(name, part, "point", "lon", "lat")


def _free(next_: list[int], k: int) -> int:
    while next_[k] != k:
        next_[k] = next_[next_[k]]
        k = next_[k]
    return k


def match_stretch(highs: np.ndarray, lows: np.ndarray, taken: np.ndarray, tolerance: float) -> np.ndarray:
    """Place of the low that each high takes (-1: none), of heights of highs and lows in order; ``taken`` marks lows that are not free.

    ``up`` and ``down`` lead to the next low that is free; lows are numbered from 1, 0 and n + 1 stand for none.
    """
    at, n, out = lows.tolist(), len(lows), []
    up, down = list(range(n + 2)), list(range(n + 2))
    for k in (np.flatnonzero(taken) + 1).tolist():
        down[k], up[k] = k - 1, k + 1
    for h, below in zip(highs.tolist(), np.searchsorted(lows, highs).tolist(), strict=True):
        i, j = _free(down, below), _free(up, below + 1)
        x, y = h - at[i - 1] if i else math.inf, at[j - 1] - h if j <= n else math.inf
        lower = x < y or x == y and below - i < j - below - 1
        if (x if lower else y) < tolerance:
            k = i if lower else j
            down[k], up[k] = k - 1, k + 1
            out.append(k - 1)
        else:
            out.append(-1)
    return np.array(out, dtype=np.int64)


def greedy_match(df: DataFrame, bin_column: str, id_column: str, height: str, high: str, tolerance: float, size: int = 50_000) -> DataFrame:
    """One-to-one matches of high (1) and low (0) rows nearest in height, highs ascending (of equal ones by id), nearer than a tolerance.

    Of equally near lows the one reached in fewer outward steps wins, then the taller one. A bin's highs are cut into stretches of equal height,
    of about ``size`` rows on average in the largest bin and at least four tolerances, each with the lows that its highs reach. All
    stretches are matched at once, each from an eighth of a stretch below its lower border on: what depends on the highs further below seldom lasts so long.
    Where the lows near the border that those highs took are not the ones that the stretch below took in the end, the stretch is matched again from
    its border on with these, until all agree: a stretch is right once the one below it is. A task holds one stretch. The cut does not change the result.
    Ids are unique within a bin; rows with a null in height or side don't count.
    """
    rows = df.dropna(subset=[height, high]).where(F.col(high).isin(0, 1))
    rows = rows.select(F.col(bin_column).alias("_bin"), F.col(id_column).alias("_id"), F.col(height).cast("double").alias("_h"), F.col(high).cast("int").alias("_high"))
    rows = stored(rows.where(F.abs("_h") < math.inf), "rows")
    most = rows.groupBy("_bin").agg(F.count("*").alias("n"), (F.max("_h") - F.min("_h")).alias("range")).agg(F.max(F.struct("n", "range"))).first()[0]
    wide = max(4.0 * tolerance, most["range"] * size / most["n"] if most else 0.0) or 1.0
    at = lambda h: F.floor(h / wide)
    first = at(F.when(F.col("_high") == 1, F.col("_h")).otherwise(F.col("_h") - tolerance))
    last = at(F.col("_h") + wide / 8 + F.when(F.col("_high") == 1, 0.0).otherwise(tolerance))
    stretches = rows.withColumn("_s", F.explode(F.sequence(first, last)))
    kind, name = df.schema[bin_column].dataType.simpleString(), df.schema[id_column].dataType.simpleString()
    schema = f"_bin {kind}, _s bigint, high_id {name}, low_id {name}, distance double, used binary, left binary"
    spark = df.sparkSession

    def match(key: tuple, held: pa.Table, given: pa.Table) -> pa.Table:
        """The stretch's matches, and a row with the lows near its lower border that were taken before it (used) and near its upper border that it took (left), a bit per low."""
        s = key[1].as_py()
        held = held.take(pc.sort_indices(held, sort_keys=[("_h", "ascending"), ("_id", "ascending")]))
        h, side = held["_h"].to_numpy(), held["_high"].to_numpy() == 1
        highs, lows = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = np.floor((h[lows] - tolerance) / wide), np.floor((h[lows] + tolerance) / wide)
        lower, upper = (a < s) & (b >= s), (a <= s) & (b > s)
        before, taken = np.floor(h[highs] / wide) < s, np.zeros(len(lows), dtype=bool)
        if given.num_rows:
            highs, before = highs[~before], before[~before]
            bits = np.frombuffer(given["given"][0].as_py() + b"\0", dtype=np.uint8)
            taken[lower] = np.unpackbits(bits, count=int(lower.sum()), bitorder="little")
        low = match_stretch(h[highs], h[lows], taken, tolerance)
        taken[low[before & (low >= 0)]] = True
        own = ~before & (low >= 0)
        mine = np.zeros(len(lows), dtype=bool)
        mine[low[own]] = True
        packed = lambda x: np.packbits(x, bitorder="little").tobytes().rstrip(b"\0")
        highs, lows = highs[own], lows[low[own]]
        n = len(highs)
        last = np.arange(n + 1) == n  # the row of the stretch itself
        pick = lambda x: pa.array(np.append(x, 0), mask=last)
        mark = lambda x: pa.chunked_array([pa.nulls(n, pa.binary()), pa.array([x], pa.binary())])
        same, ids = np.zeros(n + 1, dtype=np.int64), held["_id"]
        columns = [held["_bin"].take(same), held["_s"].take(same), ids.take(pick(highs)), ids.take(pick(lows)), pick(np.abs(h[highs] - h[lows])), mark(packed(taken[lower])), mark(packed(mine[upper]))]
        return pa.table(columns, names=["_bin", "_s", "high_id", "low_id", "distance", "used", "left"])

    path, turn = scratch_path(spark, "matches"), 0
    part, given = stretches, spark.createDataFrame([], f"_bin {kind}, _s bigint, given binary")
    while True:
        fresh = part.groupBy("_bin", "_s").cogroup(given.groupBy("_bin", "_s")).applyInArrow(match, schema)
        fresh.withColumn("_turn", F.lit(turn)).write.mode("append").parquet(path)
        found = spark.read.schema(f"{schema}, _turn int").parquet(path)
        marks = found.where("used is not null").groupBy("_bin", "_s").agg(F.max(F.struct("_turn", "used", "left")).alias("m"))
        marks = stored(marks.select("_bin", "_s", "m.*"), "marks")
        below = marks.select("_bin", (F.col("_s") + 1).alias("_s"), F.col("left").alias("given"))
        known = beside(marks, below, ["_bin", "_s"], "left").withColumn("given", F.coalesce("given", F.lit(bytearray())))
        given = stored(known.where("given <> used").select("_bin", "_s", "given"), "again")
        if given.isEmpty():
            break
        part, turn = beside(stretches, given.select("_bin", "_s"), ["_bin", "_s"]), turn + 1
    found = beside(found.where("used is null"), marks.select("_bin", "_s", "_turn"), ["_bin", "_s", "_turn"])
    return found.select(F.col("_bin").alias(bin_column), "high_id", "low_id", "distance")


def hodges_lehmann(a: DataFrame, b: DataFrame, value: str, by: str, pairs: int = PAIRS) -> DataFrame:
    """Median of the cross differences a - b per group, exactly, with their number. Nulls don't count; groups with an empty side have no row."""
    return pair_order_statistic(a, b, value, by, pairs=pairs).select(F.col("g").alias(by), F.col("middle").alias("shift"), "pairs")


def pseudomedian(df: DataFrame, value: str, by: str, pairs: int = PAIRS) -> DataFrame:
    """Median of the Walsh averages (x_i + x_j) / 2, i <= j, per group, exactly: the one-sample Hodges-Lehmann estimate. Nulls don't count."""
    rows = df.select(by, F.col(value).cast("double").alias(value))
    other = rows.select(by, (-F.col(value)).alias(value))
    return pair_order_statistic(rows, other, value, by, own=True, pairs=pairs).select(F.col("g").alias(by), (F.col("middle") / 2).alias("pseudomedian"), "pairs")


def vertical_profiles(df: DataFrame, id_column: str, profile: str, step: float) -> DataFrame:
    """Density of levels over height (d level / d height) on an even grid, smoothed over three points; empty for fewer than three grid points.

    Heights between two levels are interpolated; of levels at one height the lowest counts.
    """
    heights = F.array_distinct(F.array_sort(F.filter(profile, lambda x: x.isNotNull())))
    rows = df.select(id_column, F.col(profile).alias("_p"), heights.alias("_h")).withColumn("_k", F.transform("_h", lambda h: F.array_position("_p", h) - 1))
    low, high = F.get("_h", F.lit(0)), F.element_at("_h", -1)
    steps = F.when(F.size("_h") > 1, F.ceil((high + step - low) / step)).otherwise(0)
    rows = rows.withColumn("_n", steps.cast("int"))

    def at(g: Column) -> Column:
        i = F.greatest(F.size(F.filter("_h", lambda h: h <= g)) - 1, F.lit(0))
        x0, x1, y0, y1 = F.get("_h", i), F.get("_h", i + 1), F.get("_k", i), F.get("_k", i + 1)
        return F.when(x1.isNull(), y0).otherwise(y0 + (y1 - y0) * (g - x0) / (x1 - x0))

    grid = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n"), F.lit(1)) - 1), lambda k: at(low + k * step))
    rows = rows.withColumn("_v", F.when(F.col("_n") >= 3, grid))
    rows = rows.withColumn("_d", F.transform(F.sequence(F.lit(0), F.size("_v") - 2), lambda k: (F.get("_v", k + 1) - F.get("_v", k)) / step))
    m = F.size("_d")
    smooth = F.transform("_d", lambda x, k: (F.get("_d", F.greatest(k - 1, F.lit(0))) + x + F.get("_d", F.least(k + 1, m - 1))) / 3)
    return rows.select(id_column, F.when(F.col("_n") >= 3, smooth).otherwise(F.array().cast("array<double>")).alias("density"))
