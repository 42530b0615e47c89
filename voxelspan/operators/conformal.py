"""Conformal calibration of predicted intervals: offsets as exact order statistics of scores, and their effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quantile_sort
from ..sources.scratch import stored
from .order import beside, order_statistic_of_each

METHODS = ("cqr", "cqr_r", "cqr_m", "se", "se_r", "se_m")


def calibration_prep(df: DataFrame, columns: Sequence[str], group: str, groups: Sequence[int], lo: str, mid: str, hi: str) -> DataFrame:
    """Rows without nulls, of the wanted groups, each once, with quantiles in order and in whole decimetres."""
    rows = df.dropna(subset=list(columns)).where(F.col(group).isin(list(groups))).dropDuplicates()
    a, b, c = quantile_sort(F.col(lo), F.col(mid), F.col(hi))
    others = [x for x in columns if x not in (lo, mid, hi)]
    return rows.select(group, *(x for x in df.columns if x not in (*columns, group)), *(F.bround(F.col(x) * 10).cast("int").alias(x) for x in others), *(F.bround(x * 10).cast("int").alias(n) for x, n in ((a, lo), (b, mid), (c, hi))))


def _width(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(1)


def scores(method: str, y: Column, lo: Column, mid: Column, hi: Column) -> tuple[Column, Column]:
    """Lower and upper score; symmetric methods have one for both sides. Widths of 0 or less count as 1."""
    scale = {"r": (_width(hi - lo), _width(hi - lo)), "m": (_width(mid - lo), _width(hi - mid))}.get(method.partition("_")[2], (F.lit(1), F.lit(1)))
    low, high = (lo - y) / scale[0], (y - hi) / scale[1]
    return (low, high) if method.startswith("se") else (F.greatest(low, high),) * 2


def fit_all_offsets(df: DataFrame, methods: Sequence[str], by: Sequence[str], y: str, lo: str, mid: str, hi: str, alpha: float) -> DataFrame:
    """Offsets q_lo and q_hi per group and method: the score of rank k = ceil((n + 1) (1 - alpha)), exactly, null where k > n; two-sided methods spend half of alpha on each side. Rows with a null score don't count."""
    rows, shares, sides = df, [], {}
    for name in methods:
        low, high = scores(name, *map(F.col, (y, lo, mid, hi)))
        for side, score in (("lo", low), ("hi", high))[: 1 + name.startswith("se")]:
            rows = rows.withColumn(f"_s{len(shares)}", score.cast("double"))
            sides.setdefault(name, []).append(len(shares))
            shares.append(1 - alpha / 2 if name.startswith("se") else 1 - alpha)
    rank = [lambda n, s=s: F.ceil((n + 1) * F.lit(s)) - 1 for s in shares]
    found = order_statistic_of_each(rows, [f"_s{k}" for k in range(len(shares))], by, shares, rank)
    told = lambda name, at: F.struct(F.lit(name).alias("method"), F.col("at")[at[0]].alias("q_lo"), F.col("at")[at[-1]].alias("q_hi"), F.greatest(*(F.col("n")[k] for k in [*at, at[0]])).alias("n_cal"))
    return found.select(*by, F.explode(F.array(*(told(name, at) for name, at in sides.items()))).alias("_o")).select(*by, "_o.*").where("n_cal > 0")


def fit_offsets(df: DataFrame, method: str, by: Sequence[str], y: str, lo: str, mid: str, hi: str, alpha: float) -> DataFrame:
    """Offsets of one method."""
    return fit_all_offsets(df, [method], by, y, lo, mid, hi, alpha)


def calibrate(df: DataFrame, offsets: DataFrame, method: str, by: Sequence[str], lo: str, mid: str, hi: str) -> DataFrame:
    """Intervals widened by their group's offsets; groups without offsets keep theirs. Offsets have a row per group and are stored, see ``apply_offsets``."""
    kind = method.partition("_")[2]
    a, m, b = map(F.col, (lo, mid, hi))
    scale = {"r": (_width(b - a), _width(b - a)), "m": (_width(m - a), _width(b - m))}.get(kind, (F.lit(1), F.lit(1)))
    rows = df.join(stored(offsets.select(*by, "q_lo", "q_hi"), "offsets"), list(by), "left")
    return rows.withColumns({"cal_lo": F.coalesce(a - F.col("q_lo") * scale[0], a), "cal_hi": F.coalesce(b + F.col("q_hi") * scale[1], b)}).drop("q_lo", "q_hi")


def coverage_report(df: DataFrame, by: Sequence[str], y: str, lo: str, hi: str) -> DataFrame:
    """Coverage and mean width / 10 of raw and calibrated intervals."""
    inside = lambda a, b: F.avg(((F.col(y) >= F.col(a)) & (F.col(y) <= F.col(b))).cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), inside(lo, hi).alias("coverage"), inside("cal_lo", "cal_hi").alias("cal_coverage"), (F.avg(F.col(hi) - F.col(lo)) / 10).alias("width"), (F.avg(F.col("cal_hi") - F.col("cal_lo")) / 10).alias("cal_width"))


def calibrate_all(df: DataFrame, offsets: DataFrame, methods: Sequence[str], by: Sequence[str], lo: str, mid: str, hi: str) -> DataFrame:
    """``calibrate`` for every method: each row once per method, with ``method``, ``cal_lo`` and ``cal_hi``."""
    a, m, b = map(F.col, (lo, mid, hi))
    kind = lambda k: F.col("method").endswith(k)
    low = F.when(kind("_r"), _width(b - a)).when(kind("_m"), _width(m - a)).otherwise(1)
    high = F.when(kind("_r"), _width(b - a)).when(kind("_m"), _width(b - m)).otherwise(1)
    rows = df.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    rows = beside(rows, stored(offsets.select(*by, "method", "q_lo", "q_hi"), "offsets"), [*by, "method"], "left")
    return rows.withColumns({"cal_lo": F.coalesce(a - F.col("q_lo") * low, a), "cal_hi": F.coalesce(b + F.col("q_hi") * high, b)}).drop("q_lo", "q_hi")


def coverage_of_methods(df: DataFrame, offsets: DataFrame, methods: Sequence[str], by: Sequence[str], y: str, lo: str, mid: str, hi: str) -> DataFrame:
    """``coverage_report`` per group and method of ``calibrate_all``'s intervals: each row meets its group's offsets once and is counted for all methods at once."""
    a, m, b = map(F.col, (lo, mid, hi))
    known = offsets.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("method", F.struct("q_lo", "q_hi")))).alias("_q"))  # an entry per method
    rows = beside(df, stored(known, "offsets"), by, "left")
    inside = lambda low, high: F.avg(((F.col(y) >= low) & (F.col(y) <= high)).cast("double"))

    def of(name: str) -> Column:
        q, kind = F.try_element_at("_q", F.lit(name)), name.partition("_")[2]
        wide = {"r": (_width(b - a), _width(b - a)), "m": (_width(m - a), _width(b - m))}.get(kind, (F.lit(1), F.lit(1)))
        low, high = F.coalesce(a - q["q_lo"] * wide[0], a), F.coalesce(b + q["q_hi"] * wide[1], b)
        return F.struct(F.lit(name).alias("method"), inside(low, high).alias("cal_coverage"), (F.avg(high - low) / 10).alias("cal_width"))

    per = rows.groupBy(*by).agg(F.count("*").alias("n"), inside(a, b).alias("coverage"), (F.avg(b - a) / 10).alias("width"), F.array(*map(of, methods)).alias("_m"))
    return per.select(*by, "n", "coverage", "width", F.explode("_m").alias("_m")).select("_m.method", *by, "n", "coverage", "_m.cal_coverage", "width", "_m.cal_width")


SCORES = ("coverage", "cal_coverage", "width", "cal_width")


def coverage_by_method(calibrated: DataFrame, group: str, level: str, y: str, lo: str, hi: str) -> DataFrame:
    """``coverage_report`` per method, group and level, and per method and level the mean over groups weighted by their rows (``all_groups`` true, the group null)."""
    return with_all_groups(coverage_report(calibrated, ["method", group, level], y, lo, hi), group, level)


def with_all_groups(report: DataFrame, group: str, level: str) -> DataFrame:
    """A report per method, group and level, and per method and level the mean over groups weighted by their rows."""
    per = report.withColumn("all_groups", F.lit(False))
    whole = per.groupBy("method", level).agg(F.sum("n").alias("_n"), *((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in SCORES))
    whole = whole.withColumnRenamed("_n", "n").withColumns({group: F.lit(None).cast(per.schema[group].dataType), "all_groups": F.lit(True)})
    return per.unionByName(whole)


def coverage_pivot(report: DataFrame, group: str, level: str, methods: Sequence[str], score: str = "cal_coverage") -> DataFrame:
    """One row per group and level of ``coverage_by_method`` with a column per method."""
    return report.groupBy(group, level, "all_groups").pivot("method", list(methods)).agg(F.first(score))


def apply_offsets(df: DataFrame, offsets: DataFrame, by: Sequence[str], lo: str, mid: str, hi: str, nodata: float = 32767) -> DataFrame:
    """Bounds moved by c_lo and c_hi, never past the median; nodata and groups without offsets stay.

    Offsets are stored, so that Spark knows their size: those of few groups are broadcast, and no task gets all rows of a group.
    """
    rows = df.join(stored(offsets.select(*by, "c_lo", "c_hi"), "offsets"), list(by), "left")
    ok = (F.col(lo) != nodata) & (F.col(mid) != nodata) & (F.col(hi) != nodata) & F.col("c_lo").isNotNull()
    low = F.least(F.least(lo, hi) - F.col("c_lo"), F.col(mid))
    high = F.greatest(F.greatest(lo, hi) + F.col("c_hi"), F.col(mid))
    return rows.withColumns({"new_lo": F.when(ok, low).otherwise(F.col(lo)), "new_hi": F.when(ok, high).otherwise(F.col(hi))}).drop("c_lo", "c_hi")


def check_offsets(applied: DataFrame, expected: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Differences between two tables of calibrated values at the same keys."""
    j = applied.join(expected.select(*key, *(F.col(c).alias(f"_{c}") for c in columns)), list(key))
    return j.agg(F.count("*").alias("n"), *(F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_differ") for c in columns))
