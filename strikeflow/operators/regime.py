"""Regime gates: tables (date, gate, active) that one job computes for all scenarios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.constants import TRADING_DAYS

VOL_DAYS, RANK_DAYS, THRESHOLD = 30, 252, 0.30
HMM_DAYS, HMM_STEPS, HMM_LEAST_STEPS, HMM_MISSING = 504, 500, 5, 0.10
#: The gain in log likelihood under which fitting ends, and the least variance of a state.
HMM_GAIN, LEAST_VARIANCE = 1e-3, 1e-12


def log_returns(spot: DataFrame, value: str = "underlying") -> DataFrame:
    """(date, ret): the first date has none. A spot series is a few thousand rows; it is ordered in one task."""
    w = Window.orderBy("date")
    return spot.select("date", F.log(F.col(value) / F.lag(value).over(w)).alias("ret")).where("ret is not null")


def realised_vol(returns: DataFrame, days: int = VOL_DAYS) -> DataFrame:
    """Adds n (ordinal) and vol: the annualised sample deviation of the last days returns, once there are so many."""
    w = Window.orderBy("date")
    full = w.rowsBetween(-(days - 1), 0)
    return returns.withColumn("n", F.row_number().over(w)).withColumn("vol", F.when(F.count("ret").over(full) == days, F.stddev_samp("ret").over(full) * F.sqrt(F.lit(float(TRADING_DAYS)))))


def vol_percentile_gate(returns: DataFrame, days: int = VOL_DAYS, rank_days: int = RANK_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """Active where volatility is at or above the percentile of its last rank_days values, today's included; closed with less history."""
    w = Window.orderBy("date").rowsBetween(-(rank_days - 1), 0)
    out = realised_vol(returns, days).withColumn("bar", F.percentile("vol", F.lit(threshold)).over(w))
    enough = F.col("n") >= days + rank_days
    return out.select("date", F.lit("vol_percentile").alias("gate"), F.coalesce(enough & (F.col("vol") >= F.col("bar")), F.lit(False)).alias("active"), "vol", "bar")


def fit_hmm(x: np.ndarray, steps: int = HMM_STEPS, tol: float = HMM_GAIN) -> tuple[dict, np.ndarray]:
    """Two Gaussian states by expectation and maximisation in scaled form, of each row of x, all rows a step at a time.

    Parameters (mean, var, start: rows x 2; move: rows x 2 x 2) and each row's number of steps. A row stops once a step gains less than tol.
    """
    rows, n = x.shape
    away = np.abs(x - np.median(x, 1, keepdims=True))
    low = away <= np.median(away, 1, keepdims=True)
    high = np.where(low.all(1, keepdims=True), True, ~low)
    m = {"mean": np.stack([_mean(x, low), _mean(x, high)], 1), "start": np.full((rows, 2), 0.5), "move": np.tile([[0.95, 0.05], [0.05, 0.95]], (rows, 1, 1))}
    m["var"] = np.maximum(np.stack([_mean((x - m["mean"][:, [0]]) ** 2, low), _mean((x - m["mean"][:, [1]]) ** 2, high)], 1), LEAST_VARIANCE)
    taken, last, open_ = np.zeros(rows, int), np.full(rows, -np.inf), np.arange(rows)
    for step in range(1, steps + 1):
        own = {k: v[open_] for k, v in m.items()}
        new, total = _step(x[open_], own)
        for k, v in new.items():
            m[k][open_] = v
        taken[open_] = step
        # as a step of a row that isn't finite gains nothing, it stops
        more = total - last[open_] >= tol
        last[open_] = total
        open_ = open_[more]
        if not len(open_):
            break
    return m, taken


def _mean(x: np.ndarray, where: np.ndarray) -> np.ndarray:
    return np.where(where, x, 0).sum(1) / np.maximum(where.sum(1), 1)


def _densities(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each time, state and row, over the largest of the two states; and the logarithm of that one."""
    logs = -0.5 * (np.log(2 * np.pi * m["var"].T)[None] + (x.T[:, None] - m["mean"].T[None]) ** 2 / m["var"].T[None])
    top = logs.max(1)
    return np.exp(logs - top[:, None]), top


def _step(x: np.ndarray, m: dict) -> tuple[dict, np.ndarray]:
    n, move = x.shape[1], m["move"]
    (stay0, go0), (go1, stay1) = ((move[:, i, 0], move[:, i, 1]) for i in (0, 1))
    p, top = _densities(x, m)
    ahead, behind, scale = np.empty_like(p), np.ones_like(p), np.empty_like(top)
    a, b = m["start"][:, 0] * p[0, 0], m["start"][:, 1] * p[0, 1]
    for i in range(n):
        if i:
            a, b = (a * stay0 + b * go1) * p[i, 0], (a * go0 + b * stay1) * p[i, 1]
        scale[i] = a + b
        a, b = a / scale[i], b / scale[i]
        ahead[i, 0], ahead[i, 1] = a, b
    for i in range(n - 2, -1, -1):
        c, d = p[i + 1, 0] * behind[i + 1, 0] / scale[i + 1], p[i + 1, 1] * behind[i + 1, 1] / scale[i + 1]
        behind[i, 0], behind[i, 1] = stay0 * c + go0 * d, go1 * c + stay1 * d
    own = ahead * behind
    own /= own.sum(1, keepdims=True)
    pair = np.einsum("tir,rij,tjr->rij", ahead[:-1], move, p[1:] * behind[1:] / scale[1:, None], optimize=True)
    weight = own.sum(0)
    mean = (own * x.T[:, None]).sum(0) / weight
    var = np.maximum((own * (x.T[:, None] - mean[None]) ** 2).sum(0) / weight, LEAST_VARIANCE)
    return {"start": own[0].T, "move": pair / pair.sum(2, keepdims=True), "mean": mean.T, "var": var.T}, (np.log(scale) + top).sum(0)


def last_state(x: np.ndarray, m: dict) -> np.ndarray:
    """Where the most likely path of each row ends."""
    p, _ = _densities(x, m)
    with np.errstate(divide="ignore"):
        logs, move, best = np.log(p), np.log(m["move"]), np.log(m["start"].T) + np.log(p[0])
    for i in range(1, len(p)):
        best = np.stack([np.maximum(best[0] + move[:, 0, k], best[1] + move[:, 1, k]) for k in (0, 1)]) + logs[i]
    return best.argmax(0)


#: What became of a date's fit; all but the first two are closed gates.
OK, SHORT, UNSTEADY, FAILED = "ok", "short", "unsteady", "failed"


def regimes_today(windows: list[np.ndarray], least: int = HMM_DAYS) -> tuple[np.ndarray, np.ndarray]:
    """Of each history: whether its last least returns end in the state of higher variance, and what became of the fit. Closed (False) with too short or patchy a history (short), too few steps (unsteady), or a fit that isn't finite (failed)."""
    out, status = np.zeros(len(windows), bool), np.full(len(windows), SHORT, object)
    by_length: dict[int, list[int]] = {}
    kept = {}
    for i, history in enumerate(windows):
        x = np.asarray(history, float)[-least:]
        good = x[np.isfinite(x)]
        if len(history) >= least and len(good) >= least * (1 - HMM_MISSING) and good.std() > 0:
            kept[i] = good
            by_length.setdefault(len(good), []).append(i)
    for rows in by_length.values():
        x = np.stack([kept[i] for i in rows])
        with np.errstate(all="ignore"):
            m, steps = fit_hmm(x)
            state = last_state(x, m)
        whole = np.isfinite(m["var"]).all(1) & np.isfinite(m["move"]).all((1, 2))
        status[rows] = np.where(whole, np.where(steps >= HMM_LEAST_STEPS, OK, UNSTEADY), FAILED)
        out[rows] = whole & (steps >= HMM_LEAST_STEPS) & (state == m["var"].argmax(1))
    return out, status


def high_vol_today(windows: list[np.ndarray], least: int = HMM_DAYS) -> np.ndarray:
    return regimes_today(windows, least)[0]


def hmm_fits(returns: DataFrame, dates: DataFrame | None = None, days: int = HMM_DAYS) -> DataFrame:
    """(date, gate, active, status): active on dates whose most likely path ends in the state of higher variance. Each date's window is one row; a task fits all rows of a batch together."""
    w = Window.orderBy("date").rowsBetween(-(days - 1), 0)
    # in a structure, so that a missing return keeps its place
    rows = returns.select("date", F.collect_list(F.struct("ret")).over(w)["ret"].alias("history"))
    if dates is not None:
        rows = rows.join(dates.select("date").distinct(), "date", "left_semi")

    @F.pandas_udf("active boolean, status string")
    def told(history: pd.Series) -> pd.DataFrame:
        active, status = regimes_today([np.array([np.nan if v is None else v for v in h], float) for h in history], days)
        return pd.DataFrame({"active": active, "status": status})

    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "date")
    return spread.select("date", F.lit("hmm").alias("gate"), told("history").alias("t")).select("date", "gate", "t.active", "t.status")


def hmm_gate(returns: DataFrame, dates: DataFrame | None = None, days: int = HMM_DAYS) -> DataFrame:
    """The gates of hmm_fits alone."""
    return hmm_fits(returns, dates, days).select("date", "gate", "active")


def always(dates: DataFrame) -> DataFrame:
    return dates.select("date").distinct().select("date", F.lit("none").alias("gate"), F.lit(True).alias("active"))
