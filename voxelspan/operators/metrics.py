"""Accuracy, contrast and distribution summaries: grouped aggregates over footprint and class tables.

All functions are lazy and take column names. ``by`` lists grouping columns ([] for one overall row). Population
standard deviation unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import correlation_p, student_sf2
from .order import beside, quantiles
from .ranking import exact_quantiles, global_avg_rank, spearman

By = Sequence[str]


def _error_columns(y: str, p: str) -> list[Column]:
    e = F.col(p) - F.col(y)
    rss = F.sum(e * e)
    tss = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count(e)
    return [
        F.count(e).alias("n"), F.avg(e).alias("me"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(tss > 0, 1 - rss / tss).alias("r2"), F.corr(y, p).alias("r"),
    ]


def pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns have a value."""
    return df.dropna(subset=list(columns))


def error_metrics(df: DataFrame, y: str, p: str, by: By = ()) -> DataFrame:
    """n, mean error, mean absolute error, RMSE, R2 = 1 - rss / tss, Pearson r of p against y."""
    return pairs(df, y, p).groupBy(*by).agg(*_error_columns(y, p))


def error_tests(df: DataFrame, y: str, p: str, by: By = ()) -> DataFrame:
    """``error_metrics`` with the two-sided p of Pearson's r (null below three pairs)."""
    return error_metrics(df, y, p, by).withColumn("p", correlation_p(F.col("r"), F.col("n")))


def tile_sums(df: DataFrame, y: str, p: str, tile: str) -> DataFrame:
    """Per tile what pooled metrics need: n, sums of error, squared error, y and y squared."""
    e = F.col(p) - F.col(y)
    return pairs(df, y, p).groupBy(tile).agg(F.count("*").alias("n"), F.sum(e).alias("s_e"), F.sum(e * e).alias("s_ee"), F.sum(y).alias("s_y"), F.sum(F.col(y) * F.col(y)).alias("s_yy"))


def pooled_from_tiles(sums: DataFrame, by: By = ()) -> DataFrame:
    """Pooled RMSE, mean error and R2 out of the per-tile sums."""
    n, tss = F.sum("n"), F.sum("s_yy") - F.sum("s_y") * F.sum("s_y") / F.sum("n")
    return sums.groupBy(*by).agg(n.alias("n"), F.sqrt(F.sum("s_ee") / n).alias("rmse"), (F.sum("s_e") / n).alias("me"), F.when(tss > 0, 1 - F.sum("s_ee") / tss).alias("r2"))


def thresholded_metrics(levels: DataFrame, y: str, p: str, top: str, least: float, level: str) -> DataFrame:
    """ME, MAE, RMSE and MAPE per level of rows whose top height exceeds ``least``."""
    e = F.col(p) - F.col(y)
    rows = pairs(levels, y, p).where(F.col(top) > least)
    return rows.groupBy(level).agg(F.count("*").alias("n"), F.avg(e).alias("me"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))).alias("mape"))


def level_group(level: Column, group_size: int, n_levels: int) -> Column:
    """Number of the group of a level; a short last group is merged into the one before."""
    groups = max(1, n_levels // group_size)
    return F.least(F.floor(level / group_size), F.lit(groups - 1)).cast("int")


def group_residual_stats(levels: DataFrame, residual: str, level: str, group_size: int, n_levels: int) -> DataFrame:
    """Residuals pooled over groups of levels: n, standard deviation and box quantiles."""
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    rows = levels.where(F.col(residual).isNotNull()).groupBy(level_group(F.col(level), group_size, n_levels).alias("level_group"))
    rows = rows.agg(F.count("*").alias("n"), F.stddev_pop(residual).alias("sd"), F.percentile(residual, F.array(*map(F.lit, q))).alias("_q"))
    return rows.select("level_group", "n", "sd", *(F.col("_q")[k].alias(f"p{round(100 * x)}") for k, x in enumerate(q)))


def interval_metrics(df: DataFrame, y: str, lo: str, hi: str, mid: str, by: By = ()) -> DataFrame:
    """Coverage of [lo, hi] (put in order), shares above and below, median bias, MAE, mean width."""
    a, b, e = F.least(lo, hi), F.greatest(lo, hi), F.col(mid) - F.col(y)
    share = lambda c: F.avg(c.cast("double"))
    return pairs(df, y, lo, hi, mid).groupBy(*by).agg(
        F.count("*").alias("n"), share((F.col(y) >= a) & (F.col(y) <= b)).alias("coverage"), share(F.col(y) > b).alias("above"), share(F.col(y) < a).alias("below"),
        F.median(e).alias("median_bias"), F.avg(F.abs(e)).alias("mae"), F.avg(b - a).alias("width"))


def weighted_pool(tiles: DataFrame, by: By, group: str, values: By, weight: str = "n") -> DataFrame:
    """Weighted means of tile metrics per (by, group) and over all groups (pooled = 1, group null)."""
    sets = [[*by, group], list(by)]
    aggs = [F.sum(weight).alias(weight), *((F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(v) for v in values)]
    rows = tiles.groupingSets(sets, *by, group).agg(F.grouping(group).cast("int").alias("pooled"), *aggs)
    return rows.select(*by, group, "pooled", weight, *values)


def fixed_bin(value: Column, width: float) -> Column:
    """Number of the right-closed bin ((k-1) width, k width]."""
    return F.ceil(value / width).cast("int")


def binned_correlation(df: DataFrame, x: str, y: str, height: str, width: float, min_n: int) -> DataFrame:
    """Pearson r per right-closed height bin with at least ``min_n`` rows."""
    return pairs(df, x, y, height).groupBy(fixed_bin(F.col(height), width).alias("bin")).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).where(F.col("n") >= min_n)


def merge_small(edges: list[float], counts: list[int], min_n: int) -> list[float]:
    """Inner and outer edges after the smallest bin below ``min_n`` joined its smaller neighbour, again and again."""
    edges, counts = list(edges), list(counts)
    while len(counts) > 1 and min(counts) < min_n:
        k = counts.index(min(counts))
        to = k + 1 if k == 0 or k + 1 < len(counts) and counts[k + 1] < counts[k - 1] else k - 1
        counts[to] += counts[k]
        del counts[k], edges[max(k, to)]
    return edges


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of the bin [edge k, edge k+1); the last one also holds its upper edge; null outside."""
    out = F.when(value == edges[-1], F.lit(len(edges) - 2))
    for k in range(len(edges) - 1):
        out = out.when((value >= edges[k]) & (value < edges[k + 1]), F.lit(k))
    return out


def equal_count_edges(df: DataFrame, value: str, n_bins: int, min_n: int) -> list[float]:
    """Quantile edges without repeats, merged until each bin has ``min_n`` rows (n_bins + 1 numbers reach the driver)."""
    q = exact_quantiles(df, value, [k / n_bins for k in range(n_bins + 1)])
    return _merged(df, value, sorted(set(q)), min_n)


def fixed_edges(df: DataFrame, value: str, width: float, start: float, top: float, min_n: int) -> list[float]:
    """Edges of bands of fixed width, the last one open above, merged like ``equal_count_edges``."""
    edges = [start + k * width for k in range(int((top - start) / width) + 1)]
    return _merged(df, value, [*edges, float("inf")], min_n)


def _merged(df: DataFrame, value: str, edges: list[float], min_n: int) -> list[float]:
    if len(edges) < 2:
        return edges
    rows = df.groupBy(bin_of(F.col(value), edges).alias("b")).count().where("b is not null").collect()
    found = {r["b"]: r["count"] for r in rows}
    return merge_small(edges, [found.get(k, 0) for k in range(len(edges) - 1)], min_n)


def binned_bias_table(df: DataFrame, y: str, predictions: By, bin_column: str) -> DataFrame:
    """Per bin n and for each prediction mean error, median error and Pearson r."""
    aggs = [F.count("*").alias("n")]
    for p in predictions:
        e = F.col(p) - F.col(y)
        aggs += [F.avg(e).alias(f"{p}_me"), F.median(e).alias(f"{p}_median"), F.corr(y, p).alias(f"{p}_r")]
    return pairs(df, y, *predictions).groupBy(bin_column).agg(*aggs)


def advantage_table(df: DataFrame, y: str, a: str, b: str, by: By = ()) -> DataFrame:
    """How much prediction a is better than b: differences of r, mean error and absolute mean error."""
    me = lambda p: F.avg(F.col(p) - F.col(y))
    return pairs(df, y, a, b).groupBy(*by).agg(F.count("*").alias("n"), (F.corr(y, a) - F.corr(y, b)).alias("delta_r"), (me(a) - me(b)).alias("delta_me"), (F.abs(me(a)) - F.abs(me(b))).alias("delta_abs_me"))


def class_contrast(df: DataFrame, value: str, group: str, by: By = ()) -> DataFrame:
    """Means and medians of the high (1) and low (0) group, their difference, Cohen's d with pooled sample variance."""
    of = lambda k: F.when(F.col(group) == k, F.col(value))
    n1, n0 = F.count(of(1)), F.count(of(0))
    pooled = F.sqrt(((n1 - 1) * F.var_samp(of(1)) + (n0 - 1) * F.var_samp(of(0))) / (n1 + n0 - 2))
    delta = F.avg(of(1)) - F.avg(of(0))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        n1.alias("n_high"), n0.alias("n_low"), F.avg(of(1)).alias("mean_high"), F.avg(of(0)).alias("mean_low"), F.median(of(1)).alias("median_high"), F.median(of(0)).alias("median_low"),
        delta.alias("delta"), F.try_divide(delta, pooled).alias("cohen_d"))


def retention(df: DataFrame, reference: str, others: By, group: str, by: By = ()) -> DataFrame:
    """Per sensor delta, d and correlation with the reference, and the share of the reference's delta and d that it keeps."""
    base = class_contrast(pairs(df, reference, *others), reference, group, by).select(*by, F.col("delta").alias("_delta"), F.col("cohen_d").alias("_d"))
    out = None
    for s in others:
        rows = pairs(df, reference, *others)
        one = class_contrast(rows, s, group, by).select(*by, "delta", "cohen_d")
        r = rows.groupBy(*by).agg(F.corr(s, reference).alias("r"))
        both = one.join(r, list(by)).join(base, list(by)) if by else one.crossJoin(r).crossJoin(base)  # one row each
        part = both.select(*by, F.lit(s).alias("sensor"), "delta", "cohen_d", "r", (F.col("r") * F.col("r")).alias("r_squared"), F.try_divide("delta", "_delta").alias("delta_kept"), F.try_divide("cohen_d", "_d").alias("d_kept"))
        out = part if out is None else out.unionByName(part)
    return out


def height_match_table(df: DataFrame, height: str, group: str, bin_column: str) -> DataFrame:
    """Mean and median height of both groups per bin, and their differences."""
    of = lambda k: F.when(F.col(group) == k, F.col(height))
    return df.groupBy(bin_column).agg(
        F.count(of(1)).alias("n_high"), F.count(of(0)).alias("n_low"), (F.avg(of(1)) - F.avg(of(0))).alias("mean_difference"), (F.median(of(1)) - F.median(of(0))).alias("median_difference"))


def reference_group_compare(df: DataFrame, value: str, is_reference: str, by: str) -> DataFrame:
    """Per group: reference mean, sd, p10, p90; the others' mean, Cohen's d (mean of population variances), shares beyond p10 and p90, Welch's t and p.

    Groups without reference or other values go; with one value on a side, or none that differ, t and p are null.
    """
    given = df.where(F.col(value).isNotNull())
    known = given.where(F.col(is_reference))
    q = quantiles(known, value, [by], [0.1, 0.9]).select(by, F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"))
    moments = given.groupBy(by).agg(*(x.alias(f"{k}{name}") for k, side in (("ref_", F.col(is_reference)), ("", ~F.col(is_reference))) for name, x in (
        ("n", F.count_if(side)), ("mean", F.avg(F.when(side, F.col(value)))), ("sd", F.stddev_pop(F.when(side, F.col(value)))), ("v", F.var_samp(F.when(side, F.col(value)))))))
    rows = beside(given.where(~F.col(is_reference)), q, [by])
    share = lambda c: F.avg(c.cast("double"))
    beyond = rows.groupBy(by).agg(share(F.col(value) < F.col("p10")).alias("below_p10"), share(F.col(value) > F.col("p90")).alias("above_p90"), F.max("p10").alias("p10"), F.max("p90").alias("p90"))
    out = beside(beyond, moments, [by])
    d = F.try_divide(F.col("mean") - F.col("ref_mean"), F.sqrt((F.col("sd") * F.col("sd") + F.col("ref_sd") * F.col("ref_sd")) / 2))
    a, b = F.try_divide("v", "n"), F.try_divide("ref_v", "ref_n")
    t = F.try_divide(F.col("mean") - F.col("ref_mean"), F.sqrt(a + b))
    free = F.try_divide((a + b) * (a + b), a * a / (F.col("n") - 1) + b * b / (F.col("ref_n") - 1))
    out = out.withColumns({"cohen_d": d, "welch_t": t, "welch_df": free})
    return out.select(by, "n", "mean", "below_p10", "above_p90", "ref_mean", "ref_sd", "p10", "p90", "cohen_d", "welch_t", student_sf2(F.col("welch_t"), F.col("welch_df")).alias("welch_p"))


def headline_share(df: DataFrame, value: str, is_reference: str, by: str, min_reference: int) -> DataFrame:
    """Share of the other rows below their own group's reference p10, over groups with enough reference rows."""
    ref = df.where(F.col(is_reference)).groupBy(by).agg(F.count("*").alias("_n"), F.percentile(value, F.lit(0.1)).alias("_p10")).where(F.col("_n") >= min_reference)
    return df.where(~F.col(is_reference)).join(ref, by).agg(F.count("*").alias("n"), F.avg((F.col(value) < F.col("_p10")).cast("double")).alias("share"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, truth: str, predicted: str, by: By = (), times: str | None = None) -> DataFrame:
    """Per class (and group) true positives, false positives and false negatives, from one pass over the matrix. times: how many rows a row stands for."""
    matrix = df.groupBy(*by, truth, predicted).agg((F.sum(times) if times else F.count("*")).alias("n"))
    sides = F.when(F.col(truth) == F.col(predicted), F.array(F.struct(F.col(truth).alias("class"), F.lit("tp").alias("side")))).otherwise(
        F.array(F.struct(F.col(truth).alias("class"), F.lit("fn").alias("side")), F.struct(F.col(predicted).alias("class"), F.lit("fp").alias("side"))))
    rows = matrix.select(*by, "n", F.explode(sides).alias("s"))
    of = lambda x: F.sum(F.when(F.col("s.side") == x, F.col("n")).otherwise(0)).alias(x)
    return rows.groupBy(*by, F.col("s.class").alias("class")).agg(of("tp"), of("fp"), of("fn"))


def class_report(df: DataFrame, truth: str, predicted: str, times: str | None = None) -> DataFrame:
    """Precision, recall, F1, support and accuracy (tp + tn) / n per class. times: how many rows a row stands for."""
    total = df.agg((F.sum(times) if times else F.count("*")).alias("_n"))
    c = class_counts(df, truth, predicted, (), times).crossJoin(F.broadcast(total))  # one row
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("class", (tp + fn).alias("support"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), ((F.col("_n") - fp - fn) / F.col("_n")).alias("accuracy"))


def class_report_averages(df: DataFrame, truth: str, predicted: str, times: str | None = None) -> DataFrame:
    """``class_report`` with a row for the macro average, where every class counts once, and one for the average weighted by support; their accuracy is the share of rows that are right.

    Rows with a null on either side don't count; only classes that occur as truth or prediction have a row; undefined scores count as 0 in the averages. times: how many rows a row stands for.
    """
    rows = pairs(df, truth, predicted)
    per = class_report(rows, truth, predicted, times).withColumn("class", F.col("class").cast("string"))
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    right = rows.agg((F.try_divide(F.sum(hit * F.col(times)), F.sum(times)) if times else F.avg(hit)).alias("accuracy"))
    names = ("precision", "recall", "f1")
    score = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    macro = per.agg(F.sum("support").alias("support"), *(F.avg(score(c)).alias(c) for c in names)).withColumn("class", F.lit("macro"))
    weighted = per.agg(F.sum("support").alias("support"), *(F.try_divide(F.sum(score(c) * F.col("support")), F.sum("support")).alias(c) for c in names)).withColumn("class", F.lit("weighted"))
    averages = macro.unionByName(weighted).where("support is not null").crossJoin(F.broadcast(right))  # one row
    return per.unionByName(averages)


def correlation_report(df: DataFrame, x: str, y: str, by: By, min_n: int) -> DataFrame:
    """Pearson and Spearman r, r squared, n and the p of Pearson's r per group with at least ``min_n`` pairs, and over all rows (group null, overall true)."""
    rows = df.dropna(subset=[x, y, *by])
    per = spearman(rows, x, y, by).where(F.col("n") >= min_n).withColumn("overall", F.lit(False))
    ranked = global_avg_rank(global_avg_rank(rows.select(x, y), x, "_rx"), y, "_ry")
    one = ranked.agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman")).withColumn("r_squared", F.col("pearson") * F.col("pearson"))
    one = one.withColumns({"overall": F.lit(True), **{c: F.lit(None).cast(df.schema[c].dataType) for c in by}})
    return per.unionByName(one.where("n > 0")).withColumn("p", correlation_p(F.col("pearson"), F.col("n")))


def class_scores_by_cell(df: DataFrame, truth: str, predicted: str, cell: str, min_n: int) -> DataFrame:
    """Recall, precision and F1 per class and cell with at least ``min_n`` rows; null without support."""
    big = df.groupBy(cell).agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = class_counts(df, truth, predicted, [cell]).join(big, cell)
    score = lambda x: F.when(tp + fn > 0, x)
    return rows.select(cell, "class", "n", score(F.try_divide(tp, tp + fn)).alias("recall"), score(F.try_divide(tp, tp + fp)).alias("precision"), score(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def grid_improvement(df: DataFrame, truth: str, a: str, b: str, cell: str, min_n: int) -> DataFrame:
    """Per cell n, hits and accuracy of two models, and the difference."""
    hit = lambda p: F.count_if(F.col(p) == F.col(truth))
    rows = df.groupBy(cell).agg(F.count("*").alias("n"), hit(a).alias("hits_a"), hit(b).alias("hits_b")).where(F.col("n") >= min_n)
    return rows.withColumns({"acc_a": F.col("hits_a") / F.col("n"), "acc_b": F.col("hits_b") / F.col("n")}).withColumn("gain", F.col("acc_a") - F.col("acc_b"))


def headline_effect(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """Per class F1 of two models, absolute and relative gain, and a macro row (class null)."""
    f1 = lambda p: class_report(df, truth, p).select("class", F.col("f1").alias(f"f1_{p}"))
    rows = f1(a).join(f1(b), "class", "full")
    x, y = f"f1_{a}", f"f1_{b}"
    both = rows.select("class", F.col(x).alias("f1_a"), F.col(y).alias("f1_b"))
    macro = both.agg(F.avg("f1_a").alias("f1_a"), F.avg("f1_b").alias("f1_b")).select(F.lit(None).alias("class"), "f1_a", "f1_b")
    return both.union(macro).withColumns({"gain": F.col("f1_a") - F.col("f1_b"), "relative_gain": F.try_divide(F.col("f1_a") - F.col("f1_b"), F.col("f1_b"))})


def bias_stats(df: DataFrame, residual: str, by: By, min_n: int) -> DataFrame:
    """Mean, median and mean within [p5, p95] of residuals, for groups with more than ``min_n`` rows before and after nulls go."""
    by = list(by)
    counts = df.groupBy(*by).agg(F.count("*").alias("_all"), F.count(residual).alias("n"), F.avg(residual).alias("mean")).where((F.col("_all") > min_n) & (F.col("n") > min_n))
    q = beside(counts, quantiles(df, residual, by, [0.05, 0.5, 0.95]).select(*by, F.col("q").alias("_q")), by)
    kept = beside(df, q.select(*by, "_q"), by).where((F.col(residual) >= F.col("_q")[0]) & (F.col(residual) <= F.col("_q")[2]))
    trimmed = kept.groupBy(*by).agg(F.avg(residual).alias("trimmed_mean"))
    return beside(q, trimmed, by).select(*by, "n", "mean", F.col("_q")[1].alias("median"), "trimmed_mean")


def bias_variants(df: DataFrame, y: str, p: str, tile: str, level: str, bias: DataFrame) -> DataFrame:
    """RMSE and mean error of raw predictions and of those less a tile's average or per-level bias (missing: 0)."""
    average = bias.groupBy(tile).agg(F.avg("mean").alias("_avg"))
    rows = df.join(bias.select(tile, level, F.col("mean").alias("_own")), [tile, level], "left").join(average, tile, "left")
    variants = F.expr(f"stack(3, 'raw', {p}, 'average', {p} - coalesce(_avg, 0), 'level', {p} - coalesce(_own, 0)) as (variant, value)")
    return error_metrics(rows.select(y, variants), y, "value", ["variant"])


def bias_outlier_tiles(bias: DataFrame, tile: str, least: float) -> DataFrame:
    """Tiles whose bias averaged over levels is at least ``least`` in size, with quantiles over levels."""
    q = F.percentile("mean", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    rows = bias.groupBy(tile).agg(F.avg("mean").alias("bias"), q.alias("_q")).where(F.abs("bias") >= least)
    return rows.select(tile, "bias", *(F.col("_q")[k].alias(c) for k, c in enumerate(("p50", "p75", "p95"))))


def channel_stats(df: DataFrame, channel: str, value: str, nodata: float | None = None) -> DataFrame:
    """Count, mean, population and sample standard deviation per channel without nodata."""
    rows = df if nodata is None else df.where(F.col(value) != nodata)
    return rows.groupBy(channel).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop"), F.stddev_samp(value).alias("sd_samp"))


def level_histogram(df: DataFrame, level: str, value: str, n_bins: int, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Counts per level in n equal bins between two quantiles; bins 0 and n + 1 (outliers) get the largest inner count."""
    edges = quantiles(df, value, [level], [low, high]).select(level, F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    rows = beside(df, edges, [level]).where(F.col("_hi") > F.col("_lo"))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * n_bins), F.lit(n_bins - 1)).cast("int") + 1
    k = F.when(F.col(value) < F.col("_lo"), 0).when(F.col(value) > F.col("_hi"), n_bins + 1).otherwise(at)
    counts = rows.groupBy(level, k.alias("bin")).agg(F.count("*").alias("n"))
    inner = F.max(F.when(F.col("bin").between(1, n_bins), F.col("n"))).over(Window.partitionBy(level))
    return counts.withColumn("n", F.when(F.col("bin").between(1, n_bins), F.col("n")).otherwise(inner))


def split_counts(df: DataFrame, split: str, zone: str, tile: str) -> DataFrame:
    """Rows, distinct tiles and share of the zone's rows per zone and split."""
    rows = df.groupBy(zone, split).agg(F.count("*").alias("n"), F.count_distinct(tile).alias("tiles"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(zone)))


def zone_year_counts(done: DataFrame, targets: DataFrame, zone: str, year: str) -> DataFrame:
    """Per target (zone, year) the number done; missing is 0."""
    counts = done.groupBy(zone, year).agg(F.count("*").alias("done"))
    return targets.join(counts, [zone, year], "left").fillna(0, ["done"])


def majority_class(df: DataFrame, label: str, by: By) -> DataFrame:
    """Most frequent class (of equal ones the smallest) and its share."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("_n"))
    best = F.min_by(label, F.struct(-F.col("_n"), F.col(label)))
    return counts.groupBy(*by).agg(best.alias("majority"), (F.max("_n") / F.sum("_n")).alias("share"))


def patch_stats(df: DataFrame, by: By, value: str, is_centre: Column) -> DataFrame:
    """Mean, population and sample standard deviation and centre value per patch."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop"), F.stddev_samp(value).alias("sd_samp"), F.max(F.when(is_centre, F.col(value))).alias("centre"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) with margins: level 0 a cell, 1 the total of a, 3 the grand total."""
    return df.rollup(a, b).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def distribution_summary(df: DataFrame, value: str, by: By) -> DataFrame:
    """n, mean, sample sd, min, quartiles, max."""
    by = list(by)
    rows = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, value, by, [0.25, 0.5, 0.75]).select(*by, F.col("q").alias("_q"))
    return beside(rows, q, by, "left").select(*by, "n", "mean", "sd", "min", *(F.col("_q")[k].alias(c) for k, c in enumerate(("p25", "p50", "p75"))), "max")


def residual_describe(df: DataFrame, residual: str, height: str, edges: Sequence[float], by: By = ()) -> DataFrame:
    """Residual quantiles .1 .25 .5 .75 .9 per height interval (first one closed below) and group."""
    q = [0.1, 0.25, 0.5, 0.75, 0.9]
    k = F.when(F.col(height) == edges[0], F.lit(0))
    for i in range(len(edges) - 1):
        k = k.when((F.col(height) > edges[i]) & (F.col(height) <= edges[i + 1]), F.lit(i))
    rows = df.withColumn("interval", k).where("interval is not null").groupBy(*by, "interval").agg(F.count(residual).alias("n"), F.percentile(residual, F.array(*map(F.lit, q))).alias("_q"))
    return rows.select(*by, "interval", "n", *(F.col("_q")[i].alias(f"q{round(100 * x)}") for i, x in enumerate(q)))


def band_stats_by_image(df: DataFrame, image: str, band: str, value: str, nodata: float) -> DataFrame:
    rows = df.where(F.col(value) != nodata)
    return rows.groupBy(image, band).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def growing_month_mean(df: DataFrame, tile: str, month: str, value: str, months: str) -> DataFrame:
    """Mean of monthly values over the months in a tile's own array column, and how many there were."""
    rows = df.where(F.array_contains(F.col(months), F.col(month)))
    return rows.groupBy(tile).agg(F.avg(value).alias("mean"), F.count(value).alias("n_months"))
