"""Chain shards: parquet by year and date, with schema versions told apart by their column sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.session import scratch  # noqa: F401

VIEW = ("date", "expiry", "strike", "option_type", "settle", "close", "bid", "ask", "volume", "open_interest")


def check_columns(df: DataFrame, wanted) -> None:
    have, want = set(df.columns), set(wanted)
    if have != want:
        raise ValueError(f"missing columns {sorted(want - have)}, unknown columns {sorted(have - want)}")


def save(df: DataFrame, folder: str, columns=None) -> None:
    """Replaces the dates that df holds and leaves others alone. An empty table or another column set is refused."""
    if columns is not None:
        check_columns(df, columns)
    out = df.withColumns({"year": F.year("date"), "day": F.col("date")})
    if df.isEmpty():
        raise ValueError("nothing to save")
    # a date's rows meet in one task and make one file
    out.repartition("year", "day").write.partitionBy("year", "day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def load(spark: SparkSession, folder: str, start, end, columns: list[str] | None = None, versions=None) -> DataFrame:
    """Dates from start to end; years and days outside aren't listed or read.

    versions: known column sets. The files' footers are read, and their columns together must be one of these sets: files of
    an older version next to newer ones are refused where the newer ones have more columns, unless all known sets allow it.
    """
    lo, hi = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    df = spark.read.option("mergeSchema", versions is not None).parquet(folder)
    if versions is not None:
        have = set(df.columns) - {"year", "day"}
        if have not in [set(v) for v in versions]:
            raise ValueError(f"files of several layouts, or of none: {sorted(have)}")
    df = df.where(F.col("year").between(F.year(lo), F.year(hi)) & F.col("day").cast("date").between(lo, hi)).drop("year", "day")
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def dates(spark: SparkSession, folder: str) -> DataFrame:
    """Cached dates, from folder names alone; names that aren't dates are skipped, and a folder that isn't there has none."""
    if not exists(spark, folder):
        return spark.range(0).select(F.col("id").cast("string").cast("date").alias("date"))
    return read(spark, folder).select(F.col("day").cast("string").try_cast("date").alias("date")).where("date is not null").distinct()


def is_cached(spark: SparkSession, folder: str, date) -> bool:
    return not dates(spark, folder).where(F.col("date") == F.lit(str(date)).cast("date")).isEmpty()


def new_dates(df: DataFrame, cached: DataFrame) -> DataFrame:
    """The rows of dates that aren't cached yet."""
    return df.join(cached.select("date").distinct(), "date", "left_anti")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, written, date, n): rebuilt from the files."""
    df = read(spark, folder)
    m = F.col("_metadata")
    return df.select(m["file_path"].alias("path"), m["file_size"].alias("bytes"), m["file_modification_time"].alias("written"), "date").groupBy("path", "bytes", "written", "date").agg(F.count("*").alias("n"))


MANIFEST = ("path", "bytes", "written", "date", "n")


def append_manifest(spark: SparkSession, folder: str, target: str, since=None) -> DataFrame:
    """Appends the files that the manifest at target doesn't list yet (all, without one), and returns the whole manifest. A manifest with other columns is refused. since: only dates from then on are looked at."""
    found = manifest(spark, folder)
    if since is not None:
        found = found.where(F.col("date") >= F.lit(str(since)).cast("date"))
    if exists(spark, target):
        known = spark.read.parquet(target)
        check_columns(known, MANIFEST)
        found = found.join(known.select("path", "date", "written"), ["path", "date", "written"], "left_anti")
    found.select(*MANIFEST).write.mode("append").parquet(target)
    return spark.read.parquet(target)


def union(parts: list[DataFrame]) -> DataFrame:
    """Union of shards of one schema version; versions aren't mixed by filling up nulls."""
    for p in parts[1:]:
        check_columns(p, parts[0].columns)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
