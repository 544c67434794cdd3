"""Small results as files for people, and views on stored results."""

from __future__ import annotations

import json
import math
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows of a report; results of runs have one for each scenario, fold or day.
MOST = 100_000


def small(df: DataFrame, most: int = MOST) -> list[dict]:
    """All rows of a small result; more than most are refused rather than cut."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write a table instead")
    return rows


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file, with a header even if there are no rows."""
    import pandas as pd

    pd.DataFrame(small(df), columns=df.columns).to_csv(path, index=False)


def plain(value):
    """What JSON can hold: dates as ISO text, numbers that aren't finite as null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, date | datetime):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


def write_json(df: DataFrame, path: str) -> None:
    Path(path).write_text(json.dumps([plain(r) for r in small(df)], indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def cell(value, places: int = 4) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "n/a"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{value:.{places}f}"
    if isinstance(value, list | tuple):
        return "; ".join(cell(v, places) for v in value)
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown(df: DataFrame, title: str | None = None, places: int = 4) -> str:
    """A table as text, numbers to so many places."""
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(r[c], places) for c in df.columns) + " |" for r in small(df)]
    return "\n".join(lines) + "\n"


def write_markdown(sections: dict[str, DataFrame], path: str) -> None:
    Path(path).write_text("\n".join(markdown(df, title) for title, df in sections.items()))


def run_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that a run has written (see plans.runs), by name: scenarios, folds, days, trades, rejects, meta."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in ("scenarios", "folds", "days", "trades", "rejects", "meta")}


def surface_dates(spark: SparkSession, folder: str) -> DataFrame:
    """(date): the dates that fit records are stored for, from the names of their folders; a folder that isn't there has none."""
    from strikeflow.sources import records

    return records.cached_dates(spark, folder)


def surface_day(spark: SparkSession, folder: str, date: str) -> DataFrame:
    """The fit records of one ISO date; only its folder is read. A date without any is refused."""
    from strikeflow.sources import records

    if not records.is_cached(spark, folder, date):
        raise ValueError(f"no records for {date}")
    return records.load(spark, folder, date, date)


def cumulative_days(days: DataFrame, scenarios: list[str] | None = None) -> DataFrame:
    """(scenario, date, pnl, cum, drawdown) over all folds in order."""
    from strikeflow.operators.statistics import cumulative

    own = days if scenarios is None else days.where(F.col("scenario").isin(scenarios))
    return cumulative(own.groupBy("scenario", "date").agg(F.sum("daily_pnl").alias("pnl")), ["scenario"]).select("scenario", "date", "pnl", "cum", "drawdown")


def inspect(chain: DataFrame, width: float = 0.08) -> DataFrame:
    """One row for each month: dates, rows, first and last date, and the share of rows within width of the underlying that have both quotes."""
    near = F.abs(F.col("strike") / F.col("underlying") - 1) <= width
    quoted = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    return chain.groupBy(F.trunc("date", "month").alias("month")).agg(F.countDistinct("date").alias("n_dates"), F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.try_divide(F.count_if(near & quoted), F.count_if(near)).alias("quoted_near"))


def liquid(chain: DataFrame, n: int, width: float = 0.08) -> DataFrame:
    """The n rows with the largest volume among strikes within width of the underlying; ties by key."""
    return chain.where(F.abs(F.col("strike") / F.col("underlying") - 1) <= width).orderBy(F.desc_nulls_last("volume"), "date", "expiry", "strike", "option_type").limit(n)
