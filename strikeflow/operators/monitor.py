"""Audits, gates and reports over chains and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.constants import COVERAGE_MINIMUM
from strikeflow.operators.quantiles import quantiles

GREEKS = ("delta", "gamma", "vega", "theta")


def coverage(chain: DataFrame, least: float = COVERAGE_MINIMUM) -> DataFrame:
    """One row: how many quotes lack a side and a model price, how many can't be marked at all, and whether model prices cover enough."""
    lacks = F.col("bid").isNull() | F.col("ask").isNull()
    bare = lacks & F.col("model_price").isNull()
    share = F.count("model_price") / F.count("*")
    return chain.agg(F.count("*").alias("n"), F.count_if(bare).alias("n_danger"), F.count_if(bare & F.col("settle").isNull()).alias("n_unmarkable"), F.count_if(bare & F.col("settle").isNotNull()).alias("n_third"), share.alias("coverage"), (share >= least).alias("passed"))


def require_coverage(chain: DataFrame, least: float = COVERAGE_MINIMUM) -> None:
    row = coverage(chain, least).first()
    if not row["passed"] or row["n_unmarkable"]:
        raise ValueError(f"surface covers {row['coverage']:.4f} of the rows, {row['n_unmarkable']} can't be marked")


def drift(errors: DataFrame, share: float = 0.8) -> DataFrame:
    """errors (date, rmse): medians over the first share of the dates and over the rest, and their ratio. The medians are found at once."""
    days = errors.select("date").distinct().withColumn("at", F.row_number().over(Window.orderBy("date")))
    n = days.agg(F.count("*").alias("n"))
    early = F.col("at") / F.col("n") <= share
    own = errors.join(days, "date").crossJoin(n)  # one row
    medians = {r["early"]: r["median"] for r in quantiles(own.withColumn("early", early), F.col("rmse"), [0.5], "early", ["median"]).collect()}
    out = errors.sparkSession.createDataFrame([(medians.get(True), medians.get(False))], "early_rmse double, late_rmse double")
    return out.withColumn("ratio", F.col("late_rmse") / F.nullif("early_rmse", F.lit(0.0)))


def evenly_spaced(dates: DataFrame, n: int) -> DataFrame:
    """About n dates at equal distances, the first and the last included."""
    if n < 2:
        raise ValueError("two dates at least")
    w = Window.orderBy("date")
    own = dates.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("n") - 1) / F.lit(n - 1)))
    return own.where(F.array_contains(at, F.col("i").cast("long"))).select("date")


def risk_problem(new_risk: Column, *, max_loss: float, at_risk: Column, max_at_risk: float, n_open: Column | None = None, max_open: int = 1_000_000, pnl: Column | None = None, loss_cap: float | None = None) -> Column:
    """The first limit that a trade would break, or null."""
    out = F.when(new_risk > max_loss, "max_loss_per_trade").when(at_risk + new_risk > max_at_risk, "max_capital_at_risk")
    if n_open is not None:
        out = out.when(n_open >= max_open, "max_concurrent_positions")
    if pnl is not None and loss_cap is not None:
        out = out.when(pnl <= -loss_cap, "portfolio_loss_cap")
    return out


def stop_loss(unrealised: Column, entry_credit: Column, multiple: float, multiplier: int = 50) -> Column:
    return unrealised <= -entry_credit * multiple * multiplier


def stress(chain: DataFrame, condors: DataFrame, scenarios: DataFrame, multiplier: int = 50, stop_multiple: float = 2.0) -> DataFrame:
    """(date, scenario, pnl, delta_change, gamma_change, vega_change, theta_change, credit, stopped): what each date's condor makes under each shock, how far its Greeks move (per unit and per year), and whether its stop is hit."""
    from strikeflow.functions import bsm
    from strikeflow.operators import chain as ops

    names = {"short_call": -1, "long_call": 1, "short_put": -1, "long_put": 1}
    legs = F.array(*(F.struct(F.col(n)["expiry"].alias("expiry"), F.col(n)["strike"].alias("strike"), F.col(n)["option_type"].alias("option_type"), F.lit(q).alias("qty")) for n, q in names.items()))
    own = condors.select("date", "settle_credit", F.explode(legs).alias("l")).select("date", "settle_credit", "l.*").join(chain, ["date", "expiry", "strike", "option_type"])
    own = bsm.greeks(own).withColumnsRenamed({g: f"base_{g}" for g in GREEKS}).drop("rho")
    shocked = bsm.greeks(ops.shock(own.withColumn("entry", F.col("settle")), scenarios))
    change = lambda g: (F.sum(F.col("qty") * (F.col(g) - F.col(f"base_{g}"))) * multiplier).alias(f"{g}_change")
    out = shocked.groupBy("date", "scenario").agg(F.sum(F.col("qty") * (F.col("settle") - F.col("entry")) * multiplier).alias("pnl"), *(change(g) for g in GREEKS), F.first("settle_credit").alias("credit"))
    return out.withColumn("stopped", stop_loss(F.col("pnl"), F.col("credit"), stop_multiple, multiplier))
