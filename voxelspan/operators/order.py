"""Exact order statistics per group, for groups of any size, and of the differences of all pairs without pair rows.

``order_statistics`` brackets each wanted rank by a mergeable sketch, then counts the rows below the bracket and the values
inside it: two narrow passes, and no window or list over a group of unbounded size. Wide brackets are narrowed first. Groups of few rows
are sorted. ``order_statistic_of_each`` does the same for several columns in the same passes, one rank each.

``pair_order_statistic`` finds the value of a rank among all a - b of a group. Cells of neighbouring values bound it, each value of b
goes to those cells of a alone where its differences may lie inside the bounds, and tasks of one cell count the
differences up to a few thresholds by bisection in sorted values; the bounds close in until few differences are left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Cells of a sketch and its accuracy: a rank lies within 1 / ACCURACY of the rows.
CELLS, ACCURACY = 256, 5_000
#: Rows of a group from which it is bracketed, and rows inside a bracket that one task may sort.
SMALL, MOST = 4_096, 1_000_000
#: Differences between the bounds that become rows, and thresholds of a pass.
PAIRS, THRESHOLDS = 20_000, 31


def beside(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of which nulls are equal; the right side's columns besides ``by`` are new."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by))
    return left.join(renamed, on, how).drop(*(f"_by_{c}" for c in by))


def _cell(rank: Column, n: Column) -> Column:
    return F.floor(rank * CELLS / F.greatest(n, F.lit(1))).cast("int")


def _grid(value: Column) -> Column:
    return F.percentile_approx(value, [k / CELLS for k in range(CELLS + 1)], ACCURACY)


def order_statistics(df: DataFrame, value: str, by: Sequence[str], ranks: Sequence[Callable[[Column], Column]], small: int = SMALL, most: int = MOST) -> DataFrame:
    """(*by, n, at, after): per wanted rank, a function of n counted from 0, its value and the next one (the last has itself). Nulls don't count.

    A rank outside 0 to n - 1 gives null. Equal values are ranked one after the other; groups without values have no row.
    """
    by, small = list(by), max(small, 2 * CELLS)  # so that a cell is wider than the sketch errs
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    if not by:
        return _bracketed(rows, by, ranks, small, most)
    sizes = stored(rows.groupBy(*by).agg(F.count("*").alias("_n")), "sizes")
    least, widest = sizes.agg(F.min("_n"), F.max("_n")).first()
    if widest is None or widest <= small:
        return _windowed(rows, by, ranks)
    if least > small:
        return _bracketed(rows, by, ranks, small, most)
    part = lambda few: beside(rows, sizes.where((F.col("_n") <= small) == few).select(*by), by)
    return _windowed(part(True), by, ranks).unionByName(_bracketed(part(False), by, ranks, small, most))


def _windowed(rows: DataFrame, by: Sequence[str], ranks: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """``order_statistics`` of groups of few rows: one shuffle, and each row once for all ranks."""
    w = Window.partitionBy(*by)  # at most SMALL rows
    placed = rows.withColumns({"n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("_v")).cast("long") - 1})
    rank = [f(F.col("n")).cast("long") for f in ranks]
    here = lambda r, ahead: F.max(F.when((r >= 0) & (r < F.col("n")) & (F.col("_i") == F.least(r + ahead, F.col("n") - 1)), F.col("_v")))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *(F.array(*(here(r, a) for r in rank)).alias(c) for a, c in enumerate(("at", "after"))))


def _bracketed(rows: DataFrame, by: Sequence[str], ranks: Sequence[Callable[[Column], Column]], small: int, most: int) -> DataFrame:
    held = stored(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), _grid(F.col("_v")).alias("_g")).where("n > 0"), "sketches")
    n = F.col("n")
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), f(n).cast("long").alias("rank")) for k, f in enumerate(ranks)))
    marks = held.withColumn("_w", F.explode(wanted)).select(*by, "n", "_a", "_b", "_g", "_w.*").where((F.col("rank") >= 0) & (F.col("rank") < n))
    at, last = _cell(F.col("rank"), n), F.lit(CELLS)
    low = F.when((n <= small) | (at < 2), F.col("_a")).otherwise(F.get("_g", at - 1))
    high = F.when((n <= small) | (at > CELLS - 4), F.col("_b")).otherwise(F.get("_g", F.least(at + 3, last)))
    marks = marks.select(*by, "n", "k", "rank", low.alias("_a"), high.alias("_b"))
    widest = held.agg(F.max("n")).first()[0] or 0
    inside = (F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b"))
    expected = widest if widest <= small else widest * 5 // CELLS
    while expected > most:  # a pass narrows the brackets to about a fiftieth
        met = beside(rows, marks, by)
        found = met.groupBy(*by, "n", "k", "rank", "_a", "_b").agg(F.count_if(F.col("_v") < F.col("_a")).alias("_below"), F.count_if(inside).alias("_m"), _grid(F.when(inside, F.col("_v"))).alias("_g"))
        at = _cell(F.col("rank") - F.col("_below"), F.col("_m"))
        few = F.col("_m") <= small
        marks = found.select(*by, "n", "k", "rank", F.when(few | (at < 2), F.col("_a")).otherwise(F.get("_g", at - 1)).alias("_a"), F.when(few | (at > CELLS - 4), F.col("_b")).otherwise(F.get("_g", F.least(at + 3, last))).alias("_b"))
        expected = expected * 5 // CELLS
    marks = stored(marks, "marks")  # of known size: few are broadcast, and rows then are not shuffled
    met = beside(rows, marks, by).where(F.col("_v") <= F.col("_b"))
    counts = met.groupBy(*by, "n", "k", "rank", F.when(F.col("_v") >= F.col("_a"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by, "k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_r", F.sum("_c").over(w))  # the values inside a bracket
    here = lambda ahead: F.min(F.when(F.col("_r") > F.least(F.col("rank") + ahead, F.col("n") - 1), F.col("_v")))
    per = run.groupBy(*by, "n", "k").agg(here(0).alias("_x"), here(1).alias("_y"))
    pick = lambda c: F.array(*(F.max(F.when(F.col("k") == k, F.col(c))) for k in range(len(ranks))))
    known = per.groupBy(*by).agg(pick("_x").alias("at"), pick("_y").alias("after"))
    nothing = F.array(*(F.lit(None).cast(rows.schema["_v"].dataType) for _ in ranks))
    return beside(held.select(*by, "n"), known, by, "left").select(*by, "n", F.coalesce("at", nothing).alias("at"), F.coalesce("after", nothing).alias("after"))


def quantiles(df: DataFrame, value: str, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(*by, n, q): interpolated quantiles per group, exactly, as an array of doubles in the order of ``shares``."""
    found = order_statistics(df, value, by, [lambda n, s=s: F.floor((n - 1) * F.lit(float(s))) for s in shares])
    n = F.col("n") - 1

    def one(k: int, s: float) -> Column:
        x, y = F.get("at", F.lit(k)).cast("double"), F.get("after", F.lit(k)).cast("double")
        return x + (y - x) * (n * F.lit(float(s)) - F.floor(n * F.lit(float(s))))

    return found.select(*by, "n", F.array(*(one(k, s) for k, s in enumerate(shares))).alias("q"))


def order_statistic_of_each(df: DataFrame, values: Sequence[str], by: Sequence[str], shares: Sequence[float], ranks: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """(*by, n, at): arrays with an entry per column of ``values``, its number of values and the one of its rank, a function of n counted from 0. Nulls don't count.

    A rank lies within two rows of n times the column's share; outside 0 to n - 1 it gives null. Every row is read twice, whatever the number of columns: for the
    sketches, and for the counts below the brackets together with the values inside them.
    """
    by, size = list(by), range(len(values))
    rows = df.select(*by, *(F.col(c).alias(f"_v{k}") for k, c in enumerate(values)))
    widest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    accuracy = max(1_000, min(20_000, widest // 50_000))
    near = lambda s: F.array(*(F.lit(min(1.0, max(0.0, s + d / accuracy))) for d in (-3, 3)))
    sketch = lambda k: F.struct(F.count(f"_v{k}").alias("n"), F.min(f"_v{k}").alias("a"), F.max(f"_v{k}").alias("b"), F.percentile_approx(f"_v{k}", near(shares[k]), F.lit(accuracy)).alias("q")).alias(f"_k{k}")
    held = stored(rows.groupBy(*by).agg(*(sketch(k) for k in size)), "sketches")

    def mark(k: int) -> Column:
        c = F.col(f"_k{k}")
        whole = c["n"] <= 10 * accuracy  # a bracket then might hold no two neighbours
        low, high = F.when(whole | F.lit(shares[k] * accuracy <= 3), c["a"]).otherwise(c["q"][0]), F.when(whole | F.lit((1 - shares[k]) * accuracy <= 3), c["b"]).otherwise(c["q"][1])
        return F.struct(c["n"].alias("n"), ranks[k](c["n"]).cast("long").alias("rank"), low.alias("a"), high.alias("b"))

    marks = stored(held.select(*by, F.array(*(mark(k) for k in size)).alias("_m")), "marks")  # of known size: few are broadcast
    met = beside(rows, marks, by)
    at = [F.col("_m")[k] for k in size]
    inside = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.when((F.col(f"_v{k}") >= at[k]["a"]) & (F.col(f"_v{k}") <= at[k]["b"]), F.col(f"_v{k}")).alias("v")) for k in size)), lambda x: x["v"].isNotNull())
    below = met.groupBy(*by).agg(F.array(*(F.count_if(F.col(f"_v{k}") < at[k]["a"]) for k in size)).alias("_below"))
    counts = met.select(*by, F.explode(inside).alias("_x")).groupBy(*by, "_x.k", "_x.v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by, "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # the values inside a bracket
    run = beside(beside(counts.withColumn("_r", F.sum("_c").over(w)), stored(below, "below"), by), marks, by)
    run = run.where(F.get("_below", F.col("k")) + F.col("_r") > F.get("_m", F.col("k"))["rank"]).groupBy(*by, "k").agg(F.min("v").alias("v"))
    known = run.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_at"))  # an entry per column
    pick = lambda k: F.when((at[k]["rank"] >= 0) & (at[k]["rank"] < at[k]["n"]), F.try_element_at("_at", F.lit(k)))
    return beside(marks, known, by, "left").select(*by, F.array(*(at[k]["n"] for k in size)).alias("n"), F.array(*(pick(k) for k in size)).alias("at"))


def running_sums(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``before_<c>``: the sum of each column over the group's rows that come before in the order, for groups of any size.

    Rows are sorted by range and stored; sums within a task's stretch of a group are windows, and a table with a row per stretch has the sums before it. ``order`` has no repeats within a group.
    """
    by = list(by)
    ranged = df.repartitionByRange(*by, order).sortWithinPartitions(*by, order) if by else df.repartitionByRange(order).sortWithinPartitions(order)
    held = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    spans = held.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    w = (Window.partitionBy(*by) if by else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    spans = spans.select(*by, "_part", *(F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_b_{c}") for c in columns))
    inner = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = beside(held, spans, [*by, "_part"])
    rows = rows.withColumns({f"before_{c}": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in columns})
    return rows.drop("_at", "_part", *(f"_b_{c}" for c in columns))


def _cells_of(df: DataFrame, value: str, by: str) -> DataFrame:
    """Distinct values with their number and cell."""
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    size = F.least(F.greatest(F.ceil(F.count("*") / SMALL), F.lit(1)), F.lit(CELLS))
    grid = rows.groupBy("g").agg(size.cast("int").alias("_k"), F.percentile_approx("v", [k / CELLS for k in range(CELLS + 1)], ACCURACY).alias("_g"))
    # of every (CELLS / k)-th edge those not above the value
    edges = F.transform(F.sequence(F.lit(1), F.col("_k")), lambda i: F.get("_g", F.floor(i * CELLS / F.col("_k")).cast("int")))
    placed = beside(rows, grid.select("g", F.when(F.col("_k") > 1, F.slice(edges, F.lit(1), F.col("_k") - 1)).otherwise(F.array().cast("array<double>")).alias("_e")), ["g"])
    return placed.withColumn("p", F.size(F.filter("_e", lambda e: e <= F.col("v")))).drop("_e")


def first_at_most(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """For each a the first place in ascending b from which a - b <= t, as the machine rounds differences."""
    if not len(b):
        return np.zeros(len(a), np.int64)
    at = np.searchsorted(b, a - t)
    while (back := (at > 0) & (a - b[np.maximum(at - 1, 0)] <= t)).any():
        at = at - back
    while (on := (at < len(b)) & (a - b[np.minimum(at, len(b) - 1)] > t)).any():
        at = at + on
    return at


def _bounds(cells: pd.DataFrame, own: bool) -> tuple[float, float, int, int]:
    """Values between which the lower middle difference and the next one lie: too few are at or below the first, both are at or below the second. Besides, that rank and the number of pairs."""
    a, b = cells[cells.side == 0], cells[cells.side == 1]
    weight = np.outer(a.n.to_numpy().astype(float), b.n.to_numpy().astype(float)).reshape(-1)
    n, m = int(a.n.sum()), int(b.n.sum())
    pairs = n * (n + 1) // 2 if own else n * m
    rank = (pairs - 1) // 2
    # of both orders of a pair one counts, and each own pair: ranks of ordered pairs lie between these
    least, greatest = (max(0, 2 * rank - n), 2 * rank + 3) if own else (rank, rank + 1)
    lows = np.subtract.outer(a.lo.to_numpy(), b.hi.to_numpy()).reshape(-1)
    highs = np.subtract.outer(a.hi.to_numpy(), b.lo.to_numpy()).reshape(-1)

    def at(x: np.ndarray, k: float) -> float:
        order = np.argsort(x)
        run = np.cumsum(weight[order])
        return float(x[order][min(int(np.searchsorted(run, k, "right")), len(x) - 1)])

    slack = 1e-9 * weight.sum() + 1  # sums of weights are rounded
    return float(np.nextafter(at(lows, max(0.0, least - slack)), -np.inf)), at(highs, greatest + slack), rank, pairs


def pair_order_statistic(a: DataFrame, b: DataFrame, value: str, by: str, own: bool = False, pairs: int = PAIRS) -> DataFrame:
    """(g, pairs, middle): the median of a - b over all pairs per group, exactly; own: b holds the negatives of a, and a pair and its reverse count once.

    Groups in which a side is empty have no row. At most ``pairs`` differences of a group become rows.
    """
    va, vb = stored(_cells_of(a, value, by)), stored(_cells_of(b, value, by))
    both = va.withColumn("side", F.lit(0)).unionByName(vb.withColumn("side", F.lit(1)))
    cells = stored(both.groupBy("g", "side", "p").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n")))
    kind = va.schema["g"].dataType.simpleString()

    def bound(held: pd.DataFrame) -> pd.DataFrame:
        if held.side.nunique() < 2:
            return pd.DataFrame(columns=["g", "low", "high", "rank", "pairs"])
        low, high, rank, n = _bounds(held, own)
        if n <= pairs:  # all become rows
            low, high = -np.inf, np.inf
        return pd.DataFrame([[held.g.iloc[0], low, high, str(rank), str(n)]], columns=["g", "low", "high", "rank", "pairs"])

    ends = cells.groupBy("g").applyInPandas(bound, f"g {kind}, low double, high double, rank string, pairs string")
    ends = stored(ends.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("rank", "pairs")}))
    # cells of a beside each value of b: inside the bounds, or all differences at or below the lower one
    spans = cells.where("side = 0").groupBy("g").agg(F.collect_list(F.struct("p", "lo", "hi", "n")).alias("_cells"))
    met = beside(beside(vb, spans, ["g"]), ends.select("g", "low", "high"), ["g"])
    under = F.aggregate(F.filter("_cells", lambda s: s["hi"] - F.col("v") <= F.col("low")), F.lit(0).cast("long"), lambda t, s: t + s["n"])
    base = met.groupBy("g").agg(F.sum((under * F.col("c")).cast("decimal(38,0)")).alias("base"))
    routed = met.select("g", F.explode(F.filter("_cells", lambda s: (s["hi"] - F.col("v") > F.col("low")) & (s["lo"] - F.col("v") <= F.col("high")))).alias("_s"), "v", "c").select("g", F.col("_s.p").alias("p"), F.lit(1).alias("side"), "v", "c")
    keyed = stored(beside(va, ends.select("g"), ["g"]).select("g", "p", F.lit(0).alias("side"), "v", "c").unionByName(routed))
    done = ends.where(F.col("pairs") <= pairs).select("g", "rank", "pairs", F.lit(0).cast("decimal(38,0)").alias("base"), "low", "high", F.lit(0).cast("decimal(38,0)").alias("below"), F.col("pairs").alias("inside"))
    ends = stored(beside(ends.where(F.col("pairs") > pairs), base, ["g"]))

    def sides(held: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        held = held.sort_values("v")
        x, y = held[held.side == 0], held[held.side == 1]
        return x.v.to_numpy(), x.c.to_numpy(), y.v.to_numpy(), np.concatenate([[0], np.cumsum(y.c.to_numpy())])

    def upto(x: tuple, t: float) -> int:
        """Pairs up to t, and for ``own`` the own pairs again, as each of them is there once and not twice."""
        v, c, w, run = x
        total = int((c * (run[-1] - run[first_at_most(v, w, t)])).sum())
        return total + (int(c[v + v <= t].sum()) if own else 0)

    def count(held: pd.DataFrame) -> pd.DataFrame:
        x, low, high = sides(held), float(held.low.iloc[0]), float(held.high.iloc[0])
        marks = low + (high - low) * (np.arange(THRESHOLDS) + 1) / (THRESHOLDS + 1)
        v, _, w, _ = x
        least, most = np.inf, -np.inf
        if len(w):
            over, down = first_at_most(v, w, low) - 1, first_at_most(v, w, high)  # the last b with a difference above the lower bound, the first with one up to the upper
            least = float((v - w[np.maximum(over, 0)])[over >= 0].min(initial=np.inf))
            most = float((v - w[np.minimum(down, len(w) - 1)])[down < len(w)].max(initial=-np.inf))
        out = [[held.g.iloc[0], k, float(t), str(upto(x, float(t))), least, most] for k, t in enumerate([low, *marks, high])]
        return pd.DataFrame(out, columns=["g", "k", "t", "n", "least", "most"])

    scale = 2 if own else 1
    while not ends.isEmpty():
        rows = beside(keyed, ends.select("g", "low", "high"), ["g"])
        told = rows.groupBy("g", "p").applyInPandas(count, f"g {kind}, k int, t double, n string, least double, most double")
        per = told.groupBy("g", "k").agg(F.first("t").alias("t"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        per = beside(per, ends.select("g", "rank", "pairs", "base"), ["g"]).withColumn("n", (F.col("n") + F.col("base")).cast("decimal(38,0)"))
        enough = F.col("n") > F.col("rank") * scale + (scale - 1)
        pick = per.groupBy("g").agg(
            F.first("rank").alias("rank"), F.first("pairs").alias("pairs"), F.first("base").alias("base"), F.max(F.when(~enough, F.col("t"))).alias("low"), F.max(F.when(~enough, F.col("n"))).alias("below"),
            F.min(F.when(enough, F.col("t"))).alias("high"), F.min(F.when(enough, F.col("n"))).alias("upto"), F.min("least").alias("least"), F.max("most").alias("most"))
        now = stored(pick.withColumn("inside", (F.col("upto") - F.col("below")).cast("decimal(38,0)")))
        # the outermost differences were those between the former bounds: equal ones leave one value
        single = F.col("least") == F.col("most")
        ready = (F.col("inside") <= pairs * scale) | single
        done = done.unionByName(now.where(ready).select("g", "rank", "pairs", "base", "low", "high", "below", "inside"))
        ends = stored(now.where(~ready).select("g", "rank", "pairs", "base", "low", "high"))
    ends = stored(done)

    def emit(held: pd.DataFrame) -> pd.DataFrame:
        """Differences above the lower bound up to the upper one, with their number. Besides, without one, the least above the upper."""
        (v, c, w, run), low, high = sides(held), float(held.low.iloc[0]), float(held.high.iloc[0])
        start, stop = (first_at_most(v, w, high), first_at_most(v, w, low)) if len(w) else (np.zeros(len(v), int),) * 2
        over = start - 1
        above = (v - w[np.maximum(over, 0)])[over >= 0] if len(w) else np.zeros(0)  # of each a the least difference above
        many = np.maximum(stop - start, 0)
        k = np.repeat(np.arange(len(v)), many)
        at = np.repeat(start - np.cumsum(many) + many, many) + np.arange(len(k))
        d, n = v[k] - w[at], np.diff(run)[at] * c[k]
        if own:
            mine = (v + v > low) & (v + v <= high)
            d, n = np.concatenate([d, (v + v)[mine]]), np.concatenate([n, c[mine]])
        if len(above):
            d, n = np.append(d, above.min()), np.append(n, 0)
        return pd.DataFrame({"g": [held.g.iloc[0]] * len(d), "d": d, "n": n.astype(np.int64)})

    rows = beside(keyed, ends.select("g", "low", "high"), ["g"]).groupBy("g", "p").applyInPandas(emit, f"g {kind}, d double, n bigint")
    values = beside(rows.groupBy("g", "d").agg(F.sum("n").alias("n")), ends.select("g", "rank", "pairs", "below"), ["g"])
    w = Window.partitionBy("g").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    run = values.withColumn("_r", F.col("below") + F.sum("n").over(w))  # at most ``pairs`` differences
    # the least difference above has no number but is the next one where the rank ends the list
    lower = F.min(F.when(F.col("_r") > F.col("rank") * scale + (scale - 1), F.col("d")))
    upper = F.min(F.when((F.col("_r") > (F.col("rank") + 1) * scale + (scale - 1)) | ((F.col("n") == 0) & (F.col("_r") > F.col("rank") * scale + (scale - 1))), F.col("d")))
    both = run.groupBy("g").agg(F.first("pairs").cast("bigint").alias("pairs"), lower.alias("_x"), upper.alias("_y"))
    return both.select("g", "pairs", F.when(F.col("pairs") % 2 == 1, F.col("_x")).otherwise((F.col("_x") + F.coalesce("_y", "_x")) / 2).alias("middle"))
