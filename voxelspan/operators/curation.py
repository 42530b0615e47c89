"""Filters with reports, reconciliation of catalogues, and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import quantiles


def quality_filter(df: DataFrame, least_sensitivity: float | None = None) -> DataFrame:
    """Shots of good quality that are not degraded, lie in a region and are not leaf-off."""
    rows = df.where("quality_flag = 1 and degrade_flag = 0 and region_class > 0 and coalesce(leaf_off_flag, 0) <> 1")
    return rows if least_sensitivity is None else rows.where(F.col("sensitivity") >= least_sensitivity)


def water_filter(df: DataFrame, elevation: str | None = None, persistence: str | None = None, most: float = 10) -> DataFrame:
    """Rows with an elevation above -1000 m and little water; either test only where its column is named."""
    if elevation:
        df = df.where(F.col(elevation) > -1000)
    return df.where(F.col(persistence) < most) if persistence else df


def before_after(df: DataFrame, by: str, keep: Column) -> DataFrame:
    """Rows of each group before and after a filter."""
    return df.groupBy(by).agg(F.count("*").alias("before"), F.count_if(keep).alias("after"))


def filter_impact(df: DataFrame, by: str, keep: Column, least: int) -> DataFrame:
    """Groups that had more than ``least`` rows before the filter but not after it."""
    return before_after(df, by, keep).where((F.col("before") > least) & (F.col("after") <= least))


def class_filter(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    return df.where(F.col(label).isin(list(classes)))


def finite_filter(df: DataFrame, columns: Sequence[str], least: float | None = None) -> DataFrame:
    """Rows whose columns are all finite and, if asked, above ``least``."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        df = df if least is None else df.where(F.col(c) > least)
    return df


def clip_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) < 0, 0).otherwise(F.col(c)) for c in columns})


def winsorize(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """The value clipped to two quantiles of all rows (one aggregated row is joined back)."""
    q = quantiles(df, value, [], [low, high]).agg(F.max("q").alias("_q"))  # a row also where all values are null
    return df.crossJoin(F.broadcast(q)).withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.greatest(value, F.col("_q")[0]), F.col("_q")[1]))).drop("_q")


def fill_report(df: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """Rows filled and still empty per group."""
    return df.groupBy(by).agg(F.count_if(F.col(before).isNull() & F.col(after).isNotNull()).alias("filled"), F.count_if(F.col(after).isNull()).alias("empty"))


def coverage_check(expected: DataFrame, actual: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Each key as ok, missing, unexpected, empty or failed. ledger: key and status."""
    sides = expected.select(key).distinct().withColumn("_e", F.lit(1)).join(actual.select(key).distinct().withColumn("_a", F.lit(1)), key, "full").join(ledger, key, "left")
    state = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_a").isNotNull(), "ok").when(F.col("status") == "done", "empty").when(F.col("status") == "failed", "failed").otherwise("missing")
    return sides.select(key, state.alias("state"))


def ownership_summary(rows: DataFrame, owners: DataFrame, files: DataFrame, key: str, file: str, owner: str) -> DataFrame:
    """Per file: rows owned by it, copies (owned by another file that exists), orphans (no owner), owners without a file."""
    have = files.select(F.col(file).alias(owner)).distinct().withColumn("_f", F.lit(1))
    j = rows.join(owners, key, "left").join(have, owner, "left")
    return j.groupBy(file).agg(
        F.count_if(F.col(owner) == F.col(file)).alias("owned"), F.count_if((F.col(owner) != F.col(file)) & F.col("_f").isNotNull()).alias("copy"),
        F.count_if(F.col(owner).isNull()).alias("orphan"), F.count_if(F.col(owner).isNotNull() & F.col("_f").isNull()).alias("owner_no_file"))


def compare_datasets(a: DataFrame, b: DataFrame, file: str) -> DataFrame:
    """Row counts per file of two datasets, and whether they are equal."""
    n = lambda df, c: df.groupBy(file).agg(F.count("*").alias(c))
    rows = n(a, "n_a").join(n(b, "n_b"), file, "full").fillna(0, ["n_a", "n_b"])
    return rows.withColumn("equal", F.col("n_a") == F.col("n_b"))


def reproducibility_diff(a: DataFrame, b: DataFrame, key: Sequence[str], band: str, value: str, nodata: float) -> DataFrame:
    """Per band: pixels that differ, nodata in one only, largest difference, share valid in both, verdict."""
    j = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), list(key), "full")
    va, vb = F.coalesce(F.col("_a") != nodata, F.lit(False)), F.coalesce(F.col("_b") != nodata, F.lit(False))
    rows = j.groupBy(band).agg(
        F.count("*").alias("n"), F.count_if(va & vb & (F.col("_a") != F.col("_b"))).alias("differing"), F.count_if(va != vb).alias("nodata_mismatch"),
        F.max(F.when(va & vb, F.abs(F.col("_a") - F.col("_b")))).alias("max_abs_diff"), F.avg((va & vb).cast("double")).alias("valid_share"))
    return rows.withColumn("same", (F.col("differing") == 0) & (F.col("nodata_mismatch") == 0))


def release_manifest(listing: DataFrame, pattern: str = r"^(.+)/([A-Z0-9]+)/(?:RH)?(\d+)_Q(\d)\.tif$") -> DataFrame:
    """Per tile files, bytes and the quantiles present, from (path, length); a path that breaks the layout fails the job."""
    part = lambda k: F.regexp_extract("path", pattern, k)
    ok = F.when(F.col("path").rlike(pattern), part(2)).otherwise(F.raise_error(F.concat(F.lit("unexpected path "), F.col("path"))))
    rows = listing.select(ok.alias("tile"), part(1).alias("root"), part(4).alias("quantile"), "length")
    return rows.groupBy("tile").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.array_join(F.array_sort(F.collect_set("quantile")), ",").alias("quantiles"), F.count_distinct("root").alias("roots"))


def number_ranges(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive numbers as (first, last)."""
    w = Window.partitionBy(*by).orderBy(number)
    rows = df.select(*by, number).withColumn("_g", F.col(number) - F.dense_rank().over(w))  # repeated numbers share a rank: one shuffle, no table of distinct ones in a task
    return rows.groupBy(*by, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_g")


def version_snapshot(df: DataFrame, by: Sequence[str], quantile: str, values: Sequence) -> DataFrame:
    """File counts per key with a column for each quantile."""
    return df.groupBy(*by).pivot(quantile, list(values)).count().select(*by, *(F.coalesce(F.col(str(v)), F.lit(0)).alias(f"q{v}") for v in values))


def object_audit(listing: DataFrame, tiles: DataFrame, tile: str, quantile: str, lev: str, size: str, n_levels: int) -> DataFrame:
    """Per tile and quantile the levels found, files of no size, and whether some but not all levels are there."""
    rows = tiles.select(tile).distinct().join(listing, tile, "left").groupBy(tile, quantile).agg(F.count_distinct(lev).alias("levels"), F.count_if(F.col(size) == 0).alias("zero_size"))
    return rows.withColumn("partial", (F.col("levels") > 0) & (F.col("levels") < n_levels))


def asset_readiness(df: DataFrame, tile: str, severity: Column, names: Sequence[str]) -> DataFrame:
    """Per tile the name of its worst asset's severity (0 is best)."""
    return df.groupBy(tile).agg(F.max(severity).alias("_s")).select(tile, F.get(F.array(*map(F.lit, names)), F.col("_s").cast("int")).alias("state"))


def small_only(df: DataFrame, tile: str, size: str, least: float) -> DataFrame:
    """Tiles all of whose files are below a size."""
    return df.groupBy(tile).agg(F.max(size).alias("largest")).where(F.col("largest") < least)


def prediction_status(df: DataFrame, tile: str, year: str, size: str, n_files: int, least: float) -> DataFrame:
    """Whether each tile and year has all its files at a sensible size."""
    return df.groupBy(tile, year).agg(F.count("*").alias("files"), F.min(size).alias("smallest")).withColumn("valid", (F.col("files") >= n_files) & (F.col("smallest") >= least))


def orbit_overview(pairs: DataFrame, tile: str, year: str, orbit: str, in_season: str, band: str, few: float) -> DataFrame:
    """Orbits and in-season orbits per tile and year; few: below a share of the median of the latitude band."""
    rows = pairs.groupBy(band, tile, year).agg(F.count_distinct(orbit).alias("orbits"), F.count_distinct(F.when(F.col(in_season), F.col(orbit))).alias("in_season_orbits"))
    medians = rows.groupBy(band, year).agg(F.median("orbits").alias("_m"))
    return rows.join(medians, [band, year]).withColumn("few", F.col("orbits") < few * F.col("_m")).drop("_m")


def store_check(store: DataFrame, source: DataFrame, zone: str, tile: str) -> DataFrame:
    """Per tile rows that only one side has (as multisets), and the number of zones the store keeps it under."""
    cols = [c for c in source.columns if c != zone]
    lost = source.select(*cols).exceptAll(store.select(*cols)).groupBy(tile).agg(F.count("*").alias("lost"))
    extra = store.select(*cols).exceptAll(source.select(*cols)).groupBy(tile).agg(F.count("*").alias("extra"))
    zones = store.groupBy(tile).agg(F.count_distinct(zone).alias("zones"), F.count("*").alias("n"))
    return zones.join(lost, tile, "full").join(extra, tile, "full").fillna(0)


def scene_inventory(df: DataFrame, tile: str, scene: str, used: str, score: str, n: int) -> DataFrame:
    """Per tile scenes, repeated ids, and whether the n used first are the n with the best score."""
    w = lambda c: Window.partitionBy(tile).orderBy(c, scene)
    one = df.groupBy(tile, scene).agg(F.count("*").alias("_n"), F.min(used).alias("_u"), F.min(score).alias("_s"))
    ranked = one.withColumns({"_a": F.row_number().over(w("_u")), "_b": F.row_number().over(w("_s"))})
    pick = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) <= n, F.col(scene))))
    rows = ranked.groupBy(tile).agg(F.count("*").alias("scenes"), F.count_if(F.col("_n") > 1).alias("repeated"), pick("_a").alias("_x"), pick("_b").alias("_y"))
    return rows.select(tile, "scenes", "repeated", (F.col("_x") != F.col("_y")).alias("differs"))


def transfer_remaining(ledger: DataFrame, remote: DataFrame, key: str, n_files: int) -> DataFrame:
    """Finished keys that are not fully uploaded."""
    done = ledger.where(F.col("status") == "done").select(key).distinct()
    have = remote.groupBy(key).agg(F.count("*").alias("files"))
    return done.join(have, key, "left").fillna(0, ["files"]).where(F.col("files") < n_files)


def prunable(local: DataFrame, remote: DataFrame, key: str, n_files: int) -> DataFrame:
    """Keys complete on both sides (a list; nothing is deleted)."""
    full = lambda df: df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= n_files).select(key)
    return full(local).join(full(remote), key, "left_semi")


def normal_time(time: Column) -> Column:
    """Seconds since 1970 as a date and time in text; other text as it is."""
    return F.when(time.rlike(r"^\d+(\.\d+)?$"), F.date_format(F.timestamp_seconds(time.try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(time)


def ledger_fold(log: DataFrame, key: str, status: str, time: str, seq: str, reset: str = "reset") -> DataFrame:
    """Newest line per key (at equal time the later one); keys whose newest line is a reset go, as do lines without key or status."""
    lines = log.where(F.col(key).isNotNull() & F.col(status).isNotNull())
    last = lines.groupBy(key).agg(F.max_by(F.struct(status, time), F.struct(time, seq)).alias("_l"))
    return last.select(key, F.col(f"_l.{status}").alias(status), F.col(f"_l.{time}").alias(time)).where(F.col(status) != reset)


def ledger_summary(state: DataFrame, expected: DataFrame, alive: DataFrame, key: str, status: str) -> DataFrame:
    """Keys counted as done, failed, running, interrupted, never started and extra, and whether all expected are done."""
    known = expected.select(key).distinct().withColumn("_e", F.lit(1)).join(state, key, "full").join(alive.select(key).distinct().withColumn("_alive", F.lit(1)), key, "left")
    s, e = F.col(status), F.col("_e").isNotNull()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return known.agg(
        n(e & (s == "done")).alias("done"), n(e & (s == "failed")).alias("failed"), n(e & (s == "started") & F.col("_alive").isNotNull()).alias("running"),
        n(e & (s == "started") & F.col("_alive").isNull()).alias("interrupted"), n(e & s.isNull()).alias("never_started"), n(~e).alias("extra"),
        F.coalesce(F.every(F.when(e, F.coalesce(s == "done", F.lit(False)))), F.lit(True)).alias("complete"))


def ledger_numbers(log: DataFrame, info: str, pattern: str, out: str) -> DataFrame:
    """A number out of the info text."""
    return log.withColumn(out, F.regexp_extract(info, pattern, 1).try_cast("bigint"))
