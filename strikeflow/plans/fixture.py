"""An option chain derived by formula from orders, in Spark and as SQL text.

Quotes are rounded, so that what is computed from them starts from equal numbers
in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.constants import DIVIDEND, RISK_FREE
from strikeflow.functions import bsm, dates
from strikeflow.functions import expressions as x

STRIKES = 20


def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, underlying) of all dates of orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    return orders.where("o_orderdate is not null").groupBy(day.alias("date")).agg(F.round(17000 + (F.avg("o_totalprice") - 250000) / 1000, 9).alias("underlying"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, expiry, strike, option_type, settle, close, bid, ask, volume, open_interest, underlying, dte, iv, delta"""
    days = spot(spark, sf_dir)
    out = days.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("expiry", dates.third_wednesday(F.add_months(F.trunc("date", "month"), F.col("m")))).withColumn("dte", F.datediff("expiry", "date")).where(F.col("dte").between(1, 90))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(-STRIKES), F.lit(STRIKES)))).withColumn("strike", (17000 + 100 * F.col("i")).cast("double")).withColumn("option_type", F.explode(F.array(F.lit("call"), F.lit("put"))))
    k = F.log(F.col("strike") / F.col("underlying"))
    out = out.withColumn("k", k).withColumn("iv", F.round(0.18 - 0.30 * F.col("k") + 0.40 * F.col("k") * F.col("k"), 8))
    out = bsm.greeks(bsm.price(out, name="settle"))
    mark = F.pmod((F.col("strike") / 100).cast("int") + F.col("dte"), F.lit(5))
    out = out.withColumns({"settle": F.round("settle", 6), "delta": F.round("delta", 8)})
    return out.select(
        "date", "expiry", "strike", "option_type", "settle",
        F.when(F.pmod("i", F.lit(11)) != 5, F.col("settle")).alias("close"),
        F.when(mark != 0, F.round(F.col("settle") * 0.98, 9)).alias("bid"),
        F.when(mark != 1, F.round(F.col("settle") * 1.02, 9)).alias("ask"),
        F.pmod(F.col("i") * 7 + F.col("dte") * 13, F.lit(400)).cast("long").alias("volume"),
        F.pmod(F.col("i") * 3 + F.col("dte") * 17, F.lit(900)).cast("long").alias("open_interest"),
        "underlying", "dte", "iv", "delta",
    )


SPOT_SQL = """spot AS (
  SELECT CAST(o_orderdate AS DATE) AS date, round(17000 + (avg(o_totalprice) - 250000) / 1000, 9) AS underlying
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"""


def _chain_sql() -> str:
    r, q = RISK_FREE, x.num(DIVIDEND)
    price = x.bsm_price("underlying", "strike", "t", r, q, "iv", "option_type", "d1", "d2")
    return f"""{SPOT_SQL},
firsts AS (SELECT date, underlying, CAST(date_trunc('month', date) + to_months(CAST(m AS INTEGER)) AS DATE) AS f FROM spot, (SELECT unnest(range(0, 4)) AS m)),
expiries AS (SELECT date, underlying, CAST(f + CAST((3 - dayofweek(f) + 7) % 7 + 14 AS INTEGER) AS DATE) AS expiry FROM firsts),
grid AS (
  SELECT date, underlying, expiry, CAST(expiry - date AS INTEGER) AS dte, i, CAST(17000 + 100 * i AS DOUBLE) AS strike, option_type
  FROM expiries, (SELECT CAST(unnest(range(-{STRIKES}, {STRIKES + 1})) AS INTEGER) AS i), (VALUES ('call'), ('put')) AS types(option_type)
  WHERE expiry - date BETWEEN 1 AND 90),
vols AS (SELECT *, CAST(dte AS DOUBLE)/{x.num(365)} AS t, round(0.18 - 0.30 * ln(strike/underlying) + 0.40 * ln(strike/underlying) * ln(strike/underlying), 8) AS iv FROM grid),
ds AS (SELECT *, {x.d1("underlying", "strike", "t", r, q, "iv")} AS d1 FROM vols),
dds AS (SELECT *, {x.d2("d1", "t", "iv")} AS d2 FROM ds),
priced AS (SELECT *, round({price}, 6) AS settle, round({x.delta("t", q, "option_type", "d1")}, 8) AS delta FROM dds),
chain AS MATERIALIZED (
  SELECT date, expiry, strike, option_type, settle,
    CASE WHEN ((i % 11) + 11) % 11 <> 5 THEN settle END AS close,
    CASE WHEN (CAST(strike/100 AS INTEGER) + dte) % 5 <> 0 THEN round(settle * 0.98, 9) END AS bid,
    CASE WHEN (CAST(strike/100 AS INTEGER) + dte) % 5 <> 1 THEN round(settle * 1.02, 9) END AS ask,
    CAST((((i*7 + dte*13) % 400) + 400) % 400 AS BIGINT) AS volume, CAST((((i*3 + dte*17) % 900) + 900) % 900 AS BIGINT) AS open_interest,
    underlying, dte, iv, delta
  FROM priced)"""


CHAIN_SQL = _chain_sql()
