"""Pricing and Greeks as columns of a chain (underlying, strike, dte, option_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.constants import CALENDAR_DAYS, DIVIDEND, RISK_FREE
from strikeflow.functions import expressions as x


def with_d(df: DataFrame, vol: str = "iv", q: str | None = None, s: str = "underlying", r: float = RISK_FREE) -> DataFrame:
    """Adds t, d1 and d2; null at t = 0 or where volatility isn't positive."""
    q = q or x.num(DIVIDEND)
    df = df.withColumn("t", F.expr(f"CAST(dte AS DOUBLE)/{x.num(CALENDAR_DAYS)}"))
    df = df.withColumn("d1", F.expr(f"CASE WHEN t > 0 AND {vol} > 0 THEN {x.d1(s, 'strike', 't', r, q, vol)} END"))
    return df.withColumn("d2", F.expr(x.d2("d1", "t", vol)))


def price(df: DataFrame, vol: str = "iv", name: str = "price", q: str | None = None, s: str = "underlying", r: float = RISK_FREE) -> DataFrame:
    keep = df.columns
    out = with_d(df, vol, q, s, r).withColumn(name, F.expr(x.bsm_price(s, "strike", "t", r, q or x.num(DIVIDEND), vol, "option_type", "d1", "d2")))
    return out.select(*(c for c in keep if c != name), name)


def greeks(df: DataFrame, vol: str = "iv", q: str | None = None, r: float = RISK_FREE) -> DataFrame:
    """Adds delta, gamma, vega, theta and rho, per 1.0 and per year; null where undefined."""
    names = ("delta", "gamma", "vega", "theta", "rho")
    keep = [c for c in df.columns if c not in names]
    q = q or x.num(DIVIDEND)
    s = "underlying"
    out = with_d(df, vol, q, s, r)
    formulas = {"delta": x.delta("t", q, "option_type", "d1"), "gamma": x.gamma(s, "t", q, vol, "d1"), "vega": x.vega(s, "t", q, "d1"), "theta": x.theta(s, "strike", "t", r, q, vol, "option_type", "d1", "d2"), "rho": x.rho("strike", "t", r, "option_type", "d2")}
    return out.select(*keep, *(F.expr(f).alias(n) for n, f in formulas.items()))
