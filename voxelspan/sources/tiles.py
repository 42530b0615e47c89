"""Readers and writers of tiled datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import sample_per_key


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table, or an error that lists what it has."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[a-z]+$", 1)


def read_tiles(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None, tile: str | None = "tile") -> DataFrame:
    """Parquet files of a directory, with pruned columns, a pushed-down filter and the tile from the file name."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    df = df if where is None else df.where(where)
    own = list(columns) if columns else df.columns
    return require_columns(df, own).select(*own, *([file_stem().alias(tile)] if tile else []))


def read_delimited_header(spark: SparkSession, path: str, missing: float = -999, nullable: Sequence[str] = ("HLON", "HLAT", "ZH", "CHANNEL_ZG")) -> DataFrame:
    """White-space text whose last line that starts with # names the columns; ``missing`` is null in the listed columns."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("_at"))
    heads = lines.where(F.col("value").startswith("#")).groupBy("source_file").agg(F.max_by("value", "_at").alias("_h"))
    names = [x for r in heads.select("_h").distinct().collect() for x in r["_h"].lstrip("# ").split()]  # one header per release
    names = list(dict.fromkeys(names))
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).join(heads, "source_file")
    fields, own = F.split("value", r"\s+"), F.split(F.ltrim(F.regexp_replace("_h", "^#+", "")), r"\s+")
    value = lambda c: F.try_element_at(F.map_from_arrays(F.slice(own, F.lit(1), F.least(F.size(own), F.size(fields))), F.slice(fields, F.lit(1), F.least(F.size(own), F.size(fields)))), F.lit(c)).try_cast("double")
    return rows.select("source_file", *((F.nullif(value(c), F.lit(float(missing))) if c in nullable else value(c)).alias(c) for c in names))


def read_metrics_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with names trimmed and in lower case; missing columns are an error."""
    df = spark.read.option("header", True).csv(path)
    return require_columns(df.toDF(*(c.strip().lower() for c in df.columns)), columns).select(*(F.col(c).try_cast("double").alias(c) for c in columns))


def read_geojson_csv(spark: SparkSession, path: str, geometry: str, name_pattern: str) -> DataFrame:
    """CSV with a GeoJSON point column as lon and lat, and a date out of the file name."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    point = F.from_json(geometry, "coordinates array<double>")["coordinates"]
    return df.select(*(c for c in df.columns if c != geometry), point[0].alias("lon"), point[1].alias("lat"), F.regexp_extract(F.col("_metadata.file_path"), name_pattern, 1).alias("date"))


def write_by_tile(df: DataFrame, path: str, tile: str) -> None:
    """A directory per tile; tiles not in ``df`` stay as they are. A tile is one file, unless adaptive execution splits the task of a hot one."""
    df.hint("rebalance", tile).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tile).parquet(path)


def consolidate_by_zone(df: DataFrame, path: str, tile: str, zone_chars: int = 3) -> None:
    """One dataset clustered by zone (first characters of the tile) and sorted by tile."""
    df.withColumn("zone", F.substring(tile, 1, zone_chars)).repartitionByRange("zone", tile).sortWithinPartitions("zone", tile).write.mode("overwrite").partitionBy("zone").parquet(path)


def read_items_for_tiles(spark: SparkSession, path: str, tiles: Sequence[str], tile: str, zone_chars: int = 3) -> DataFrame:
    """Rows of the wanted tiles; only their zones are read."""
    zones = sorted({t[:zone_chars] for t in tiles})
    return spark.read.parquet(path).where(F.col("zone").isin(zones) & F.col(tile).isin(list(tiles)))


def combine_tiles(df: DataFrame, group: str, most: int | None, seed: str, *ids: str) -> DataFrame:
    """All tiles' rows, at most ``most`` per group if asked (null is a group)."""
    return df if most is None else sample_per_key(df, [group], most, seed, *ids)


def dataset_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, time and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def manifest_hash(manifest: DataFrame) -> DataFrame:
    """One hash over the sorted (file, sha) lines; a line per file is gathered."""
    return manifest.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "file", "sha256"))), "\n"), 256).alias("sha256"))


def repartition_index(df: DataFrame, path_column: str, *order: str) -> DataFrame:
    """Rows renumbered from 0 within each path."""
    from pyspark.sql import Window

    return df.withColumn("number", F.row_number().over(Window.partitionBy(path_column).orderBy(*order)) - 1)
