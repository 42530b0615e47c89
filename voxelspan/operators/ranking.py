"""Ranks, top-k, deterministic sampling and rank tests.

Picks follow the hexadecimal md5 of seed, key and id, so they depend on the rows alone. No window runs over a whole
table: global ranks come from counts per distinct value, range-partitioned, with the partitions' totals summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_sf2, rank_sum_sf2
from ..sources.scratch import stored
from .order import beside, quantiles, running_sums

#: Most distinct values whose ranks Spark may broadcast.
BROADCAST = 100_000


def pick_order(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def avg_rank(df: DataFrame, value: str, by: Sequence[str], out: str = "rank") -> DataFrame:
    """Tie-averaged rank from 1 within groups."""
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    ties = Window.partitionBy(*by, value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def global_avg_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Tie-averaged rank over the whole table without a single-partition window: null where the value is.

    The counts of the distinct values are sorted by range and stored with their place, so that both readers see one cut; a table with a row per task has the rows before it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    held = stored(counts.repartitionByRange("_v").sortWithinPartitions("_v").withColumn("_at", F.monotonically_increasing_id()), "ranks")
    held = held.withColumn("_part", F.shiftright("_at", 33))
    totals = held.groupBy("_part").agg(F.sum("_n").alias("_sum"))  # a row per task
    ahead = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = held.withColumn("_inner", inner).join(F.broadcast(ahead), "_part").select("_v", (F.col("_ahead") + F.col("_inner") + (F.col("_n") + 1) / 2).alias(out))
    few = held.count() <= BROADCAST  # from the files' footers; their bytes say little of what the rows take in memory
    ranks = ranks.hint("broadcast" if few else "merge")  # few values: a task that got all rows of one would hold much of the table
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Pearson, Spearman, r squared and n per group."""
    rows = avg_rank(avg_rank(df.dropna(subset=[x, y]), x, by, "_rx"), y, by, "_ry")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman")).withColumn("r_squared", F.col("pearson") * F.col("pearson"))


def tercile_labels(df: DataFrame, value: str, bin_column: str, q: float, min_n: int, out: str = "label") -> DataFrame:
    """1 for the top q of a bin, 0 for the bottom q, null between; bins with fewer than ``min_n`` rows go."""
    edges = quantiles(df, value, [bin_column], [q, 1 - q]).where(F.col("n") >= min_n).select(bin_column, F.col("q").alias("_q"))
    label = F.when(F.col(value) >= F.col("_q")[1], 1).when(F.col(value) <= F.col("_q")[0], 0)
    return beside(df, edges, [bin_column]).withColumn(out, label).drop("_q")


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], accuracy: int = 1_000) -> list[float]:
    """Interpolated quantiles of a whole table, exactly; [] for a table without values. One number per share reaches the driver.

    A first pass brackets each quantile by approximate ones, off by a share 1 / accuracy of the rows at most; a second counts the rows below each bracket and looks at those inside it alone.
    """
    near = [min(1.0, max(0.0, s + d / accuracy)) for s in shares for d in (-2, 2)]
    first = df.agg(F.count(value).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"), F.percentile_approx(value, near, accuracy).alias("q")).first()
    if not first["n"]:
        return []
    few = first["n"] <= 10 * accuracy  # a bracket then might hold no two neighbours
    brackets = [(first["a"] if few or near[2 * k] == 0 else first["q"][2 * k], first["b"] if few or near[2 * k + 1] == 1 else first["q"][2 * k + 1]) for k in range(len(shares))]
    of = lambda k: (F.col(value) >= F.lit(brackets[k][0])) & (F.col(value) <= F.lit(brackets[k][1]))
    counts = df.agg(*(F.count_if(F.col(value) < F.lit(lo)).alias(f"below_{k}") for k, (lo, _) in enumerate(brackets)), *(F.count_if(of(k)).alias(f"in_{k}") for k in range(len(shares)))).first()
    at = [((first["n"] - 1) * s - counts[f"below_{k}"]) / max(1, counts[f"in_{k}"] - 1) for k, s in enumerate(shares)]
    row = df.agg(*(F.percentile(F.when(of(k), F.col(value)), F.lit(min(1.0, max(0.0, x)))).alias(f"q_{k}") for k, x in enumerate(at))).first()
    return [float(row[f"q_{k}"]) for k in range(len(shares))]


def global_terciles(df: DataFrame, value: str, q: float, out: str = "label") -> DataFrame:
    """1 for the top q of the table, 0 for the bottom q, null between."""
    edges = exact_quantiles(df, value, [q, 1 - q])
    if not edges:
        return df.withColumn(out, F.lit(None).cast("int"))
    return df.withColumn(out, F.when(F.col(value) >= edges[1], 1).when(F.col(value) <= edges[0], 0))


def first_per_key(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def latest_processing(df: DataFrame, key: Sequence[str], processed: str, tie: str) -> DataFrame:
    """Newest processing of each acquisition."""
    return first_per_key(df, key, F.col(processed).desc_nulls_last(), F.col(tie).asc())


def earliest_processing(df: DataFrame, key: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Per acquisition and column the first value that is not null, by ``order``."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c)
    return df.groupBy(*key).agg(*map(first, values))


def sample_per_key(df: DataFrame, key: Sequence[str], n: int, seed: str, *ids: str) -> DataFrame:
    return first_n(df, key, n, pick_order(seed, *key, *ids), *map(F.col, ids))


def first_n(df: DataFrame, key: Sequence[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def match_reference_counts(df: DataFrame, reference: DataFrame, key: str, seed: str, *ids: str) -> DataFrame:
    """Per key as many rows as the reference table has; keys without reference go."""
    counts = reference.groupBy(key).agg(F.count("*").alias("_want"))
    w = Window.partitionBy(key).orderBy(pick_order(seed, key, *ids), *ids)
    return df.join(counts, key).withColumn("_k", F.row_number().over(w)).where("_k <= _want").drop("_k", "_want")


def bernoulli_sample(df: DataFrame, p: float, seed: str, *ids: str) -> DataFrame:
    return df.where(F.substring(pick_order(seed, *ids), 1, 8) < F.lit(f"{int(p * 2**32):08x}"))


def density_sample(df: DataFrame, areas: DataFrame, zone: str, area: str, seed: str, *ids: str) -> DataFrame:
    """Keep the share area * 0.7034 / count + 0.001 of each zone's rows."""
    ratio = df.groupBy(zone).agg(F.count("*").alias("_n")).join(areas, zone).select(zone, (F.col(area) * 0.7034 / F.col("_n") + 0.001).alias("_ratio"))
    draw = F.conv(F.substring(pick_order(seed, *ids), 1, 8), 16, 10).cast("double") / 2.0**32
    return df.join(ratio, zone).where(draw < F.col("_ratio")).drop("_ratio")


def split_tiles(tiles: DataFrame, tile: str, shares: Sequence[tuple[str, float]], seed: str, rest: str = "train") -> DataFrame:
    """Disjoint sets of int(n * share) distinct tiles in pick order; the others are ``rest``. Tiles are numbered as ranges with offsets, so no task holds all."""
    names = tiles.select(tile).distinct()
    numbered = global_avg_rank(names.withColumn("_o", F.struct(pick_order(seed, tile).alias("p"), F.col(tile).alias("t"))), "_o", "_k").drop("_o")
    rows = numbered.crossJoin(F.broadcast(names.agg(F.count("*").alias("_n"))))  # one row
    out, low = F.lit(rest), F.lit(0)
    split = None
    for name, share in shares:
        high = low + F.floor(F.col("_n") * share)
        hit = (F.col("_k") > low) & (F.col("_k") <= high)
        split = F.when(hit, name) if split is None else split.when(hit, name)
        low = high
    return rows.select(tile, split.otherwise(out).alias("split"))


def stratified_tiles(tiles: DataFrame, tile: str, group: str, per_group: int, kept: DataFrame, seed: str) -> DataFrame:
    """Up to ``per_group`` tiles of each group, those already kept first."""
    held = kept.select(tile).distinct().withColumn("kept", F.lit(True))
    rows = tiles.select(tile, group).distinct().join(held, tile, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return first_n(rows, [group], per_group, F.col("kept").desc(), pick_order(seed, tile), F.col(tile))


def round_robin_pick(df: DataFrame, value: str, group: str, id_column: str, n: int) -> DataFrame:
    """The n highest values, taken by rank within their group and then by group, so that groups take turns."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(id_column))
    return df.withColumn("turn", F.row_number().over(w)).orderBy("turn", group).limit(n)


def select_scenes(df: DataFrame, tile: str, orbit: str, cloud: str, scene: str, nodata: str, per_full: int, orbits: int, per_orbit: int, most: int) -> DataFrame:
    """Scenes per tile: of orbits without nodata the least cloudy; tiles without such an orbit take their best orbits' least cloudy."""
    full = df.where(F.col(nodata) == 0)
    a = first_n(full, [tile, orbit], per_full, F.col(cloud), F.col(scene))
    lacking = df.join(full.select(tile).distinct(), tile, "left_anti")
    best = first_n(lacking.groupBy(tile, orbit).agg(F.min(cloud).alias("_c")), [tile], orbits, F.col("_c"), F.col(orbit)).drop("_c")
    b = first_n(lacking.join(best, [tile, orbit]), [tile, orbit], per_orbit, F.col(cloud), F.col(scene))
    return first_n(a.unionByName(b), [tile], most, F.col(cloud), F.col(scene))


def dedup_shots(df: DataFrame, ids: Sequence[str], *order: Column) -> DataFrame:
    return first_per_key(df, ids, *order)


def holm(df: DataFrame, p: str, within: Sequence[str], *tie: str) -> DataFrame:
    """Holm-adjusted p: running maximum of min(1, p * (m - rank + 1)); null p is skipped."""
    rows = df.where(F.col(p).isNotNull())
    w = Window.partitionBy(*within).orderBy(p, *tie)
    m = F.count("*").over(Window.partitionBy(*within))
    step = rows.withColumn("_s", F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1)))
    return step.withColumn("p_holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def exact_signed_rank(w_plus: Column, n: Column, most: int = 50) -> Column:
    """Exact two-sided p of a signed-rank statistic of n pairs without ties or zeros; null for more than ``most``."""
    size = n * (n + 1) / 2 + 1
    start = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    shares = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, lambda acc, k: F.transform(acc, lambda x, i: (x + F.coalesce(F.get(acc, i - k), F.lit(0.0))) / 2))
    tail = lambda keep: F.aggregate(F.filter(shares, keep), F.lit(0.0), lambda a, x: a + x)
    return F.when((n > 0) & (n <= most), F.least(F.lit(1.0), 2 * F.least(tail(lambda x, i: i <= w_plus), tail(lambda x, i: i >= w_plus))))


def paired_wilcoxon(df: DataFrame, a: str, b: str, by: Sequence[str], zeros: str = "wilcox") -> DataFrame:
    """Signed-rank test of a - b: pairs, zeros, median difference over all pairs, W+, z, p, rank-biserial r, share where a is lower.

    zeros: ``wilcox`` drops zero differences before they are ranked, ``pratt`` after. The normal approximation with tie correction; where there are no ties or zeros and at most 50 pairs, ``p_exact`` besides.
    Ranks and median come from counts of the distinct differences, sorted by range, so a group may be of any size.
    """
    by, d = list(by), F.col("_d")
    rows = df.dropna(subset=[a, b]).groupBy(*by, (F.col(a) - F.col(b)).alias("_d")).agg(F.count("*").alias("_c"))
    held = running_sums(stored(rows, "differences"), by, "_d", ["_c"])
    size = held.groupBy(*by).agg(F.sum("_c").alias("_m"), F.sum(F.when(d == 0, F.col("_c")).otherwise(0)).alias("n_zero"))
    at = lambda k: F.max(F.when((F.col("before__c") <= k) & (k < F.col("before__c") + F.col("_c")), d))
    middle = beside(held, size, by).groupBy(*by, "n_zero").agg(((at(F.floor((F.col("_m") - 1) / 2)) + at(F.floor(F.col("_m") / 2))) / 2).alias("median_difference"))
    sizes = held.where(F.lit(zeros == "pratt") | (d != 0)).groupBy(*by, F.abs("_d").alias("_a")).agg(F.sum("_c").alias("_t"), F.sum(F.when(d > 0, F.col("_c")).otherwise(0)).alias("_up"), F.sum(F.when(d < 0, F.col("_c")).otherwise(0)).alias("_down"))
    ranked = running_sums(sizes, by, "_a", ["_t"]).where("_a <> 0").withColumn("_r", F.col("before__t") + (F.col("_t") + 1) / 2)
    ties = F.sum(F.col("_t") * (F.col("_t") * F.col("_t") - 1).cast("double"))
    s = ranked.groupBy(*by).agg(F.sum("_t").alias("n"), F.sum(F.col("_r") * F.col("_up")).alias("w_plus"), F.sum(F.col("_r") * F.col("_t")).alias("_all"), (F.sum("_down") / F.sum("_t")).alias("a_lower"), ties.alias("_ties"))
    s = beside(middle, s, by, "left").fillna(0, ["n"])
    n, z0 = F.col("n").cast("double"), F.col("n_zero").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1)
    if zeros == "pratt":
        m = n + z0
        mean, var = (m * (m + 1) - z0 * (z0 + 1)) / 4, m * (m + 1) * (2 * m + 1) - z0 * (z0 + 1) * (2 * z0 + 1)
    z = (F.col("w_plus") - mean) / F.sqrt((var - F.col("_ties") / 2) / 24)
    exact = F.when((F.col("_ties") == 0) & (F.col("n_zero") == 0), exact_signed_rank(F.col("w_plus"), F.col("n")))
    out = s.select(*by, "n", "n_zero", "w_plus", "median_difference", "a_lower", ((2 * F.col("w_plus") - F.col("_all")) / F.col("_all")).alias("rank_biserial"), z.alias("z"), exact.alias("p_exact"))
    return out.withColumn("p", normal_sf2(F.col("z")))


def rank_sum(df: DataFrame, value: str, group: str, by: Sequence[str]) -> DataFrame:
    """Mann-Whitney U of group 1 against 0, P(a > b), rank-biserial correlation, and p by the normal approximation with tie and continuity correction.

    Where no values are equal and neither group has more than 50, ``p_exact`` besides.
    """
    given = df.where(F.col(value).isNotNull())
    rows = avg_rank(given, value, by, "_r")
    n1, n0 = F.count_if(F.col(group) == 1), F.count_if(F.col(group) == 0)
    u = F.sum(F.when(F.col(group) == 1, F.col("_r")).otherwise(0.0)) - n1 * (n1 + 1) / 2
    ties = given.groupBy(*by, value).agg(F.count("*").cast("double").alias("_t")).groupBy(*by).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"))
    out = rows.groupBy(*by).agg(n1.alias("n1"), n0.alias("n0"), u.alias("u")).join(ties, list(by))
    share = F.try_divide("u", F.col("n1") * F.col("n0"))
    both, n = F.col("n1").cast("double") * F.col("n0"), (F.col("n1") + F.col("n0")).cast("double")
    sd = F.sqrt(both / 12 * (n + 1 - F.try_divide("_ties", n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - both / 2) - 0.5, F.lit(0.0)), sd)
    exact = rank_sum_sf2(F.when(F.col("_ties") == 0, F.col("u")).cast("double"), F.col("n1"), F.col("n0"))
    return out.withColumns({"p_greater": share, "rank_biserial": 2 * share - 1, "p": F.least(F.lit(1.0), normal_sf2(z)), "p_exact": exact}).drop("_ties")


def rank_sum_shift(df: DataFrame, value: str, group: str, by: str) -> DataFrame:
    """``rank_sum`` with the Hodges-Lehmann shift of group 1 against 0, exactly."""
    from .order import pair_order_statistic

    of = lambda k: df.where(F.col(group) == k).select(by, value)
    shift = pair_order_statistic(of(1), of(0), value, by).select(F.col("g").alias(by), F.col("middle").alias("shift"))
    return beside(rank_sum(df, value, group, [by]), shift, [by], "left")


def paired_wilcoxon_shift(df: DataFrame, a: str, b: str, by: str, zeros: str = "wilcox", level: float = 0.05) -> DataFrame:
    """``paired_wilcoxon`` with the Hodges-Lehmann estimate (median of the Walsh averages of a - b, zeros included) and ``a_better``: a is lower and p below the level."""
    from .order import pair_order_statistic

    d = df.dropna(subset=[a, b]).select(by, (F.col(a) - F.col(b)).cast("double").alias("_d"))
    other = d.select(by, (-F.col("_d")).alias("_d"))
    shift = pair_order_statistic(d, other, "_d", by, own=True).select(F.col("g").alias(by), (F.col("middle") / 2).alias("hodges_lehmann"))
    out = beside(paired_wilcoxon(df, a, b, [by], zeros), shift, [by], "left")
    return out.withColumn("a_better", (F.coalesce("p_exact", "p") < level) & (F.col("hodges_lehmann") < 0))


def exact_binomial(k: Column, n: Column) -> Column:
    """Two-sided p of k hits in n fair draws: twice the tail up to min(k, n - k), summed from its largest term; null for n = 0."""
    least = F.least(k, n - k).cast("int")
    ratio = lambda i: i / (n - i + 1)
    steps = F.when(least > 0, F.sequence(F.lit(1), F.greatest(least, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(0.0).alias("log"))
    held = F.aggregate(steps, zero, lambda acc, i: F.struct((1 + acc["sum"] * ratio(i)).alias("sum"), (acc["log"] - F.ln(ratio(i))).alias("log")))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * held["sum"] * F.exp(held["log"] - n * F.ln(F.lit(2.0)))))


def mcnemar(df: DataFrame, truth: str, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Discordant counts, odds ratio, the chi-square statistic with continuity correction, and the exact two-sided binomial p."""
    ra, rb = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    out = df.groupBy(*by).agg(F.count_if(ra & ~rb).alias("only_a"), F.count_if(~ra & rb).alias("only_b"))
    x, y = F.col("only_a"), F.col("only_b")
    return out.withColumns({"odds_ratio": F.try_divide(x, y), "chi2": F.try_divide((F.abs(x - y) - 1) * (F.abs(x - y) - 1), x + y), "p": exact_binomial(x, x + y)})
