"""A synthetic chain: geometric Brownian spot, monthly expiries, a strike grid, quotes with random spreads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeflow.constants import DIVIDEND, RISK_FREE, TRADING_DAYS
from strikeflow.functions import bsm, dates


@dataclass(frozen=True)
class Config:
    start: str = "2026-01-01"
    end: str = "2026-03-31"
    spot: float = 16800.0
    sigma: float = 0.20
    strikes: int = 61
    step: int = 100
    max_dte: int = 90
    seed: int = 42


def uniform(seed: int, *key: str | Column) -> Column:
    """A number in (0, 1) that depends on the key alone, not on how rows are partitioned."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)


def normal(seed: int, *key: str | Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *key))) * F.cos(6.283185307179586 * uniform(seed + 1, *key))


def spot_path(spark: SparkSession, c: Config, days: DataFrame | None = None) -> DataFrame:
    """(date, underlying) on business days, or on the dates that days (date) has."""
    days = days.select("date").where("date is not null").distinct() if days is not None else spark.range(1).select(F.explode(F.sequence(F.lit(c.start).cast("date"), F.lit(c.end).cast("date"))).alias("date")).where(F.dayofweek("date").between(2, 6))
    drift = (RISK_FREE - DIVIDEND - c.sigma**2 / 2) / TRADING_DAYS
    w = Window.orderBy("date")
    move = F.when(F.row_number().over(w) == 1, 0.0).otherwise(drift + c.sigma / TRADING_DAYS**0.5 * normal(c.seed, "date"))
    return days.withColumn("move", move).select("date", (c.spot * F.exp(F.sum("move").over(w))).alias("underlying"))


def generate(spark: SparkSession, c: Config | None = None, *, days: DataFrame | None = None) -> DataFrame:
    """25 columns of raw and derived values, on business days from start to end, or on the dates that days (date) has."""
    c = c or Config()
    centre = round(c.spot / c.step) * c.step
    half = c.strikes // 2
    base = spot_path(spark, c, days).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(c.max_dte // 28 + 1))))
    base = base.withColumn("expiry", dates.third_wednesday(F.add_months(F.trunc("date", "month"), F.col("m")))).withColumn("dte", F.datediff("expiry", "date")).where(F.col("dte").between(1, c.max_dte)).drop("m")
    base = base.withColumn("strike", F.explode(F.sequence(F.lit(centre - half * c.step), F.lit(centre + half * c.step), F.lit(c.step)))).withColumn("strike", F.col("strike").cast("double")).withColumn("option_type", F.explode(F.array(F.lit("call"), F.lit("put"))))
    base = bsm.greeks(bsm.price(base.withColumn("iv", F.lit(c.sigma)), name="settle")).drop("gamma", "vega", "theta", "rho")
    key = ("date", "expiry", "strike", "option_type")
    u = lambda i: uniform(c.seed + 10 * i, *key)
    spread = F.greatest(F.col("settle") * (0.005 + 0.02 * u(1)), F.lit(0.1))
    w = Window.partitionBy("expiry", "strike", "option_type").orderBy("date")
    last = F.lag("settle").over(w)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = base.withColumns({"open": F.col("settle") * (0.98 + 0.04 * u(2)), "last": F.col("settle") * (0.99 + 0.02 * u(3)), "bid": F.greatest(F.col("settle") - spread, F.lit(0.0)), "ask": F.col("settle") + spread, "volume": F.floor(500 * u(4)).cast("long"), "open_interest": F.floor(2000 * u(5)).cast("long"), "change": F.col("settle") - last, "change_pct": F.try_divide(F.col("settle") - last, F.nullif(last, F.lit(0.0)))})
    out = out.withColumns({"high": F.greatest("open", "last"), "low": F.least("open", "last"), "historical_high": F.max("settle").over(run), "historical_low": F.min("settle").over(run)})
    return out.select("date", F.lit("TXO").alias("contract"), F.date_format("expiry", "yyyyMM").alias("contract_month_week"), "strike", "option_type", "open", "high", "low", "last", "volume", "settle", "open_interest", "bid", "ask", "historical_high", "historical_low", F.lit("regular").alias("trading_session"), "change", "change_pct", F.col("expiry").alias("contract_date"), "expiry", "iv", "delta", "dte", "underlying")
