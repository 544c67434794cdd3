"""Fit records on disk: parquet by year and date, parameters and attempts as JSON with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.functions import dates
from strikeflow.sources import shards

#: Columns of a shard, in order.
STORED = ("date", "expiry", "model_type", "converged", "n_points", "in_sample_rmse", "fit_time_ms", "forward", "t", "params_json", "attempts_json", "error")
PARAMS, ATTEMPTS = "map<string,double>", "array<struct<model_type:string,converged:boolean,rmse:double,error:string>>"


def sorted_json(params: Column) -> Column:
    """A map as JSON with its keys in order; null stays null."""
    return F.when(params.isNotNull(), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params)))))


def to_stored(records: DataFrame) -> DataFrame:
    """records (params: map, attempts: array) with JSON in place of both. What a record lacks of fit_time_ms, attempts and error is null."""
    have = set(records.columns)
    get = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    own = records.withColumns({"params_json": sorted_json(F.col("params")), "attempts_json": F.to_json("attempts") if "attempts" in have else F.lit(None).cast("string"), "fit_time_ms": get("fit_time_ms", "long"), "error": get("error", "string")})
    return own.select(*STORED)


def from_stored(rows: DataFrame) -> DataFrame:
    """The inverse of to_stored. JSON that isn't a map of numbers fails the query."""
    params = F.from_json("params_json", PARAMS, {"mode": "FAILFAST"})
    attempts = F.from_json("attempts_json", ATTEMPTS, {"mode": "FAILFAST"})
    return rows.withColumns({"params": params, "attempts": attempts}).drop("params_json", "attempts_json")


def checked_date(date: str) -> str:
    if not dates.ISO.fullmatch(date):
        raise ValueError(f"not an ISO date: {date!r}")
    return date


def save(records: DataFrame, folder: str, date: str) -> None:
    """Replaces one date's records. No records, or one of another date, are refused."""
    checked_date(date)
    own = to_stored(records)
    n = own.agg(F.count("*").alias("n"), F.count_if(~F.col("date").eqNullSafe(F.lit(date).cast("date"))).alias("other"), F.min(F.when(~F.col("date").eqNullSafe(F.lit(date).cast("date")), F.col("date"))).alias("first")).first()
    if not n["n"]:
        raise ValueError(f"no records for {date}")
    if n["other"]:
        raise ValueError(f"{n['other']} records have another date than {date}, the first {n['first']}")
    shards.save(own, folder, STORED)


def save_all(records: DataFrame, folder: str) -> None:
    """Replaces all dates that records hold, each in one file."""
    shards.save(to_stored(records), folder, STORED)


def load(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    """Records of the dates from start to end; dates without any are skipped. Files with other columns, and rows outside the domains of their model, fail the query."""
    from strikeflow.operators.surface import record_problem

    if checked_date(start) > checked_date(end):
        raise ValueError(f"{start} after {end}")
    stored = shards.load(spark, folder, start, end, versions=[STORED])
    own = from_stored(stored)
    text = F.concat(F.lit("record of "), F.col("date").cast("string"), F.lit(": "), F.col("problem"))
    return own.withColumn("problem", record_problem()).where(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(text).cast("boolean"))).drop("problem")


def is_cached(spark: SparkSession, folder: str, date: str) -> bool:
    return shards.is_cached(spark, folder, checked_date(date))


def cached_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates with records; folders that aren't named by an ISO date are skipped."""
    return shards.dates(spark, folder)
