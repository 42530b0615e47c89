"""Composed tests: products against a base, models cell by cell, samples by stratum, matched bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .metrics import class_contrast, class_scores_by_cell
from .order import beside
from .ranking import holm, paired_wilcoxon, sample_per_key
from .resampling import numbered_blocks, picks


def wilcoxon_vs_products(df: DataFrame, y: str, base: str, products: Sequence[str]) -> DataFrame:
    """Signed-rank test of absolute and squared errors, base against each product, over complete pairs; Holm within a metric."""
    names = ", ".join(f"'{p}', {p}" for p in products)
    long = df.select(y, base, F.expr(f"stack({len(products)}, {names}) as (product, value)")).dropna()
    ea, eb = F.col(base) - F.col(y), F.col("value") - F.col(y)
    errors = F.explode(F.array(F.struct(F.lit("abs").alias("metric"), F.abs(ea).alias("a"), F.abs(eb).alias("b")), F.struct(F.lit("square").alias("metric"), (ea * ea).alias("a"), (eb * eb).alias("b"))))
    rows = long.select("product", errors.alias("_e")).select("product", "_e.*")
    return holm(paired_wilcoxon(rows, "a", "b", ["metric", "product"]), "p", ["metric"], "product")


def cell_paired_tests(df: DataFrame, truth: str, a: str, b: str, cell: str, min_n: int, macro: bool = False) -> DataFrame:
    """Signed-rank test over cells of two models' F1 per class, Holm over classes.

    macro: besides, a row (class null, macro true) over each cell's mean F1 of the classes it has; it is no part of the Holm family and its ``p_holm`` is null.
    """
    f1 = lambda p, c: class_scores_by_cell(df, truth, p, cell, min_n).select(cell, "class", F.col("f1").alias(c))
    rows = f1(a, "a").join(f1(b, "b"), [cell, "class"])
    per = holm(paired_wilcoxon(rows, "a", "b", ["class"]).withColumn("_all", F.lit(1)), "p", ["_all"], "class").drop("_all")
    if not macro:
        return per
    means = rows.groupBy(cell).agg(F.avg("a").alias("a"), F.avg("b").alias("b")).withColumn("_one", F.lit(1))
    one = paired_wilcoxon(means, "a", "b", ["_one"]).drop("_one").withColumns({"class": F.lit(None).cast(per.schema["class"].dataType), "p_holm": F.lit(None).cast("double"), "macro": F.lit(True)})
    return per.withColumn("macro", F.lit(False)).unionByName(one)


def stratified_samples(reference: DataFrame, pixels: DataFrame, stratum: str, most: int, n: int, seed: str, *ids: str) -> DataFrame:
    """Reference points, at most ``most`` per stratum, and ``n`` other pixels per stratum, with where they come from."""
    a = sample_per_key(reference, [stratum], most, seed, *ids).withColumn("origin", F.lit("reference"))
    rest = pixels.join(reference.select(*ids).distinct(), list(ids), "left_anti")
    return a.unionByName(sample_per_key(rest, [stratum], n, seed, *ids).withColumn("origin", F.lit("random")))


def matched_band_table(df: DataFrame, band: str, height: str, group: str, values: Sequence[str], most: float) -> DataFrame:
    """Per band and value the contrast of the groups, beside the height difference that matching left; ok: that is at most ``most``."""
    match = df.groupBy(band).agg((F.avg(F.when(F.col(group) == 1, F.col(height))) - F.avg(F.when(F.col(group) == 0, F.col(height)))).alias("height_difference"))
    out = None
    for v in values:
        part = class_contrast(df, v, group, [band]).select(band, F.lit(v).alias("value"), "n_high", "n_low", "delta", "cohen_d")
        out = part if out is None else out.unionByName(part)
    return out.join(match, band).withColumn("ok", F.abs("height_difference") <= most)



def ratio_bands(df: DataFrame, band: str, numerator: str, denominator: str, group: str, block: str, replicates: int = 200, level: float = 0.05) -> DataFrame:
    """Per band the contrast of numerator / denominator between the high (1) and low (0) group, where it comes from, and what height leaves of it.

    d_ratio and its interval (whole blocks drawn; the sums of a block, band and group are all that is read per replicate); numerator_term + denominator_term,
    its first-order parts by a change of either mean; residual_high, residual_low and cohen_d of the numerator's residual on the denominator, fitted over
    both groups of the band; denominator_difference, what matching left. Rows with another group, a null, or a denominator of 0 don't count; bands without both groups have no row.
    """
    num, den = F.col(numerator).cast("double"), F.col(denominator).cast("double")
    rows = df.where(F.col(group).isin(0, 1)).select(F.col(band).alias("_band"), F.col(group).alias("_g"), F.col(block).alias("_block"), num.alias("_num"), den.alias("_den")).dropna(subset=["_num", "_den", "_band"]).where("_den <> 0")
    rows = rows.withColumn("_u", F.col("_num") / F.col("_den"))
    of = lambda f, c, k: f(F.when(F.col("_g") == k, F.col(c)))
    both = lambda x, y, k: F.covar_samp(F.when(F.col("_g") == k, F.col(x)), F.when(F.col("_g") == k, F.col(y)))
    whole = rows.groupBy("_band").agg(
        *(of(F.count, "_u", k).alias(f"n{k}") for k in (1, 0)), F.avg("_u").alias("u"), F.avg("_den").alias("den"), F.avg("_num").alias("num"), F.regr_slope("_num", "_den").alias("b"),
        *(of(F.avg, f"_{c}", k).alias(f"{c}{k}") for c in ("u", "num", "den") for k in (1, 0)),
        *(both(f"_{x}", f"_{y}", k).alias(f"{x}_{y}{k}") for x, y in (("num", "num"), ("num", "den"), ("den", "den")) for k in (1, 0))).where("n1 > 0 and n0 > 0")
    c = F.col
    left = lambda k: c(f"num{k}") - c("num") - c("b") * (c(f"den{k}") - c("den"))
    var = lambda k: c(f"num_num{k}") - 2 * c("b") * c(f"num_den{k}") + c("b") * c("b") * c(f"den_den{k}")
    pooled = F.sqrt(((c("n1") - 1) * var(1) + (c("n0") - 1) * var(0)) / (c("n1") + c("n0") - 2))
    d_num, d_den = c("num1") - c("num0"), c("den1") - c("den0")
    table = whole.select(
        "_band", c("n1").alias("n_high"), c("n0").alias("n_low"), (c("u1") - c("u0")).alias("d_ratio"), d_num.alias("numerator_difference"), d_den.alias("denominator_difference"),
        (d_num / c("den")).alias("numerator_term"), (-c("u") * d_den / c("den")).alias("denominator_term"), left(1).alias("residual_high"), left(0).alias("residual_low"),
        F.try_divide(left(1) - left(0), pooled).alias("cohen_d"))
    sums = rows.groupBy("_band", "_block").agg(*(of(f, "_u", k).alias(f"{n}{k}") for n, f in (("n", F.count), ("s", F.sum)) for k in (1, 0))).fillna(0.0, ["s1", "s0"])
    blocks = stored(numbered_blocks(rows.select("_block").distinct(), "_block"), "blocks")
    drawn = beside(sums, blocks, ["_block"]).join(picks(blocks, replicates), "_i").groupBy("_band", "replicate").agg(*(F.sum(F.col(x) * F.col("_k")).alias(x) for x in ("n1", "s1", "n0", "s0")))
    q = F.percentile(F.try_divide("s1", "n1") - F.try_divide("s0", "n0"), F.array(F.lit(level / 2), F.lit(1 - level / 2)))
    ends = drawn.groupBy("_band").agg(q.alias("_q")).select("_band", c("_q")[0].alias("d_ratio_low"), c("_q")[1].alias("d_ratio_high"))
    return table.join(ends, "_band", "left").withColumnRenamed("_band", band)


def match_check(table: DataFrame, most: float) -> DataFrame:
    """One row of ``ratio_bands``: bands, rows, the differences of denominator and ratio weighted by rows, and whether that of the denominator is at most ``most``."""
    n = F.col("n_high") + F.col("n_low")
    mean = lambda x: F.sum(F.col(x) * n) / F.sum(n)
    one = table.agg(F.count("*").alias("bands"), F.sum(n).alias("n"), mean("denominator_difference").alias("denominator_difference"), mean("d_ratio").alias("d_ratio"), mean("cohen_d").alias("cohen_d"))
    return one.withColumn("ok", F.abs("denominator_difference") <= most)
