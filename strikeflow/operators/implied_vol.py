"""Implied volatility: Arrow batches, all rows of a batch at once."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeflow.constants import CALENDAR_DAYS, DIVIDEND, RISK_FREE
from strikeflow.operators import chain as ops

LOW, HIGH, NEWTON, BISECTIONS = 1e-6, 5.0, 100, 60


def _cdf(x: np.ndarray) -> np.ndarray:
    """The same rational approximation as the column expressions."""
    from strikeflow.functions.expressions import HART_BELOW, HART_LIMIT, HART_TOP, ROOT_2PI

    a = np.abs(x)
    e = np.exp(-a * a / 2)
    top, below = np.polyval(HART_TOP, a), np.polyval(HART_BELOW, a)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + k / tail
    lower = np.where(a > 37, 0.0, np.where(a < HART_LIMIT, e * top / below, e / tail / ROOT_2PI))
    return np.where(x > 0, 1 - lower, lower)


def price(s, k, t, r, q, v, call):
    d1 = (np.log(s / k) + (r - q + v * v / 2) * t) / (v * np.sqrt(t))
    d2 = d1 - v * np.sqrt(t)
    fs, fk = s * np.exp(-q * t), k * np.exp(-r * t)
    c = fs * _cdf(d1) - fk * _cdf(d2)
    return np.where(call, c, c - fs + fk), fs * np.exp(-d1 * d1 / 2) / np.sqrt(2 * np.pi) * np.sqrt(t)


def solve(p, s, k, t, r, q, call) -> tuple[np.ndarray, np.ndarray]:
    """Volatilities and statuses: ok, invalid, below_bound, above_bound, noise, no_root. A price at the lower bound has volatility 0."""
    p, s, k, t, q = (np.asarray(x, float) for x in (p, s, k, t, q))
    n = len(p)
    v, status = np.full(n, np.nan), np.full(n, "invalid", object)
    with np.errstate(all="ignore"):
        valid = (s > 0) & (k > 0) & (t > 0) & np.isfinite(p) & np.isfinite(q)
        fs, fk = s * np.exp(-q * t), k * np.exp(-r * t)
        low = np.maximum(np.where(call, fs - fk, fk - fs), 0)
        high = np.where(call, fs, fk)
        status[valid & (p < low - 1e-10)] = "below_bound"
        status[valid & (p > high + 1e-10)] = "above_bound"
        live = valid & (p >= low - 1e-10) & (p <= high + 1e-10)
        at = live & (np.abs(p - low) <= 1e-10)
        v[at], status[at] = 0.0, "ok"
        live &= ~at
        noise = live & (p - low < np.maximum(1e-4, 1e-7 * s))
        status[noise] = "noise"
        rows = np.flatnonzero(live & ~noise)
        if not len(rows):
            return v, status
        a = [x[rows] for x in (p, s, k, t, q)]
        c = np.asarray(call, bool)[rows]
        guess = np.clip(np.maximum(np.sqrt(2 * np.pi / a[3]) * a[0] / a[1], 0.05), LOW, HIGH)
        lo, hi = np.full(len(rows), LOW), np.full(len(rows), HIGH)
        x = guess.copy()
        done = np.zeros(len(rows), bool)
        for step in range(NEWTON):
            got, vega = price(a[1], a[2], a[3], r, a[4], x, c)
            gap = got - a[0]
            lo, hi = np.where(gap < 0, np.maximum(lo, x), lo), np.where(gap > 0, np.minimum(hi, x), hi)
            done = np.abs(gap) < 1e-10
            if done.all() or step == NEWTON - 1:
                break
            new = x - gap / vega
            # outside the bracket, or no longer converging: halve it
            halved = ~np.isfinite(new) | (new <= lo) | (new >= hi) | (step >= NEWTON - BISECTIONS)
            x = np.where(done, x, np.where(halved, (lo + hi) / 2, new))
        got, _ = price(a[1], a[2], a[3], r, a[4], x, c)
        ok = np.abs(got - a[0]) < 1e-6 * np.maximum(1, a[0])
        v[rows[ok]], status[rows[ok]] = x[ok], "ok"
        status[rows[~ok]] = "no_root"
    return v, status


def implied_vol(p: str | Column, q: str | Column, r: float = RISK_FREE) -> Column:
    """struct(iv, status) of price p; reads underlying, strike, dte and option_type."""

    @F.pandas_udf("iv double, status string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for price_, s, k, dte, q_, kind in batches:
            v, status = solve(price_.to_numpy(float), s, k, dte.to_numpy(float) / CALENDAR_DAYS, r, q_, (kind == "call").to_numpy())
            yield pd.DataFrame({"iv": pd.Series(v).where(~np.isnan(v), None), "status": status})

    return run(p, "underlying", "strike", "dte", q, "option_type")


def add_iv(chain: DataFrame, q_source: str = "fallback", r: float = RISK_FREE) -> DataFrame:
    """iv and iv_source (mid, settle, no_price, solver_fail); q_source pit uses q_pit where it isn't null."""
    q = F.coalesce("q_pit", F.lit(DIVIDEND)) if q_source == "pit" else F.lit(DIVIDEND)
    out = ops.iv_price(chain).withColumn("__q", q)
    usable = F.when(F.col("dte") > 0, F.col("iv_price"))
    out = out.withColumn("__s", implied_vol(F.coalesce(usable, F.lit(float("nan"))), "__q", r))
    source = F.when(usable.isNull(), "no_price").when(F.col("__s.status") == "ok", F.col("iv_price_source")).otherwise("solver_fail")
    return out.withColumn("iv", F.when(usable.isNotNull() & (F.col("__s.status") == "ok"), F.col("__s.iv"))).withColumn("iv_source", source).drop("__s", "__q", "iv_price", "iv_price_source")


def enrich(view: DataFrame, spot: DataFrame, *, q_source: str = "fallback", on_q_fail: str = "null", missing_spot: str = "raise") -> DataFrame:
    """The enriched chain: dte, underlying, implied yield, volatility, delta and executability of a strategy view."""
    from strikeflow.functions import bsm

    chain = ops.add_underlying(ops.add_dte(view), spot, missing_spot)
    # one row for each date
    chain = chain.join(ops.implied_yield(chain, on_fail=on_q_fail), "date", "left")
    chain = add_iv(chain, q_source)
    chain = bsm.greeks(chain, q="__q" if q_source == "pit" else None) if q_source != "pit" else bsm.greeks(chain.withColumn("__q", F.coalesce("q_pit", F.lit(DIVIDEND))), q="__q")
    return ops.flags(chain).drop("gamma", "vega", "theta", "rho", "__q")
