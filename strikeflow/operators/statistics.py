"""Judging daily profit and loss: Sharpe, drawdown, Calmar, resampling, roll-ups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.constants import EULER, TRADING_DAYS
from strikeflow.functions import expressions as x


def sharpe(pnl: str = "pnl", rf: float = 0.015, capital: float | None = None) -> Column:
    """Annualised, above the risk-free rate; 0 with fewer than two values or no deviation."""
    v = F.col(pnl) / capital if capital else F.col(pnl)
    dev = F.stddev_samp(v)
    return F.when((F.count(v) < 2) | (F.coalesce(dev, F.lit(0.0)) == 0), F.lit(0.0)).otherwise((F.avg(v) - rf / TRADING_DAYS) / dev * math.sqrt(TRADING_DAYS))


def plain_sharpe(pnl: str = "pnl") -> Column:
    """Without a risk-free rate; null with no deviation."""
    return math.sqrt(TRADING_DAYS) * F.avg(pnl) / F.nullif(F.stddev_samp(pnl), F.lit(0.0))


def cumulative(df: DataFrame, by: list[str], pnl: str = "pnl", order: str = "date") -> DataFrame:
    """Adds cum, peak (0 at least) and drawdown."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("cum", F.sum(pnl).over(w))
    return out.withColumn("peak", F.greatest(F.max("cum").over(w), F.lit(0.0))).withColumn("drawdown", F.col("cum") - F.col("peak"))


def max_drawdown(df: DataFrame, by: list[str], capital: float = 1.0, pnl: str = "pnl") -> DataFrame:
    return cumulative(df, by, pnl).groupBy(*by).agg((F.least(F.min("drawdown"), F.lit(0.0)) / capital).alias("max_drawdown"))


def calmar(df: DataFrame, by: list[str], capital: float, pnl: str = "pnl") -> DataFrame:
    """Annualised return over the largest percentage drawdown of equity, whose peak starts at capital; null without a drawdown."""
    c = cumulative(df, by, pnl)
    dd = F.max((F.col("peak") - F.col("cum")) / (capital + F.col("peak")))
    return c.groupBy(*by).agg((F.sum(pnl) / capital * (TRADING_DAYS / F.count(pnl)) / F.nullif(dd, F.lit(0.0))).alias("calmar"))


def win_rate(pnl: str = "realised_pnl") -> Column:
    return F.coalesce(F.avg((F.col(pnl) > 0).cast("double")), F.lit(0.0))


def expected_best(n_trials: int) -> float:
    """What the best of so many Sharpe ratios without skill is expected to be."""
    if n_trials < 2:
        raise ValueError("two trials at least")
    inv = NormalDist().inv_cdf
    return (1 - EULER) * inv(1 - 1 / n_trials) + EULER * inv(1 - 1 / (n_trials * math.e))


def deflated_sharpe(observed: str, n_trials: int, periods: str, skew: float = 0.0, kurt: float = 3.0) -> Column:
    """Columns of text in, probability out; 0 where the denominator isn't positive."""
    below = f"({x.num(1)}-{x.num(skew)}*{observed}+{x.num((kurt - 1) / 4)}*{observed}*{observed})"
    z = f"(({observed}-{x.num(expected_best(n_trials))})*sqrt(CAST({periods} AS DOUBLE)-{x.num(1)})/sqrt({below}))"
    return F.expr(f"CASE WHEN {below} <= 0 THEN {x.num(0)} ELSE {x.norm_cdf(z)} END")


Statistic = str | Callable[[np.ndarray], float]


def np_sharpe(v: np.ndarray) -> np.ndarray:
    """Of the last axis; NaN without a deviation."""
    dev = v.std(-1, ddof=1) if v.shape[-1] > 1 else np.zeros(v.shape[:-1])
    with np.errstate(all="ignore"):
        return np.where(dev > 0, math.sqrt(TRADING_DAYS) * v.mean(-1) / dev, np.nan)


_STATISTICS: dict[str, Callable] = {"sharpe": np_sharpe, "mean": lambda v: v.mean(-1), "total_return": lambda v: v.sum(-1)}
#: Multipliers of the counter-based generator.
MIX, STEP, SEED = (0x85EBCA6B, 0xC2B2AE35), 0x85EBCA77, 0x9E3779B1
#: Iterations of a group that one row asks for, and the most draws that are made at once.
BLOCK, DRAWS = 50, 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    """All bits of 32-bit numbers (held in 64 bits) mixed."""
    low = np.uint64(0xFFFFFFFF)
    h = h ^ (h >> np.uint64(16))
    h = h * np.uint64(MIX[0]) & low
    h = h ^ (h >> np.uint64(13))
    h = h * np.uint64(MIX[1]) & low
    return h ^ (h >> np.uint64(16))


def draws(seed: int, iterations: np.ndarray, n: int) -> np.ndarray:
    """Uniform 32-bit numbers: a row for each iteration, n each. A number depends on seed, iteration and place only."""
    low = np.uint64(0xFFFFFFFF)
    own = _mixed(iterations.astype(np.uint64) + np.uint64(seed * SEED & 0xFFFFFFFF) & low)
    return _mixed(own[:, None] + np.arange(n, dtype=np.uint64) * np.uint64(STEP) & low)


def draws_sql(seed: int, iteration: str, place: str, name: str) -> str:
    """The same number in DuckDB, as select items the last of which is name."""
    def mixed(x: str, k: str) -> str:
        return f"xor({x}, {x} >> 16) AS {k}1, ({k}1 * {MIX[0]}::UBIGINT) % 4294967296 AS {k}2, xor({k}2, {k}2 >> 13) AS {k}3, ({k}3 * {MIX[1]}::UBIGINT) % 4294967296 AS {k}4"

    start = f"(({iteration}::UBIGINT + {seed * SEED & 0xFFFFFFFF}::UBIGINT) % 4294967296)::UBIGINT AS {name}_s, {mixed(f'{name}_s', f'{name}_a')}, xor({name}_a4, {name}_a4 >> 16) AS {name}_h"
    return f"{start}, (({name}_h + {place}::UBIGINT * {STEP}::UBIGINT) % 4294967296)::UBIGINT AS {name}_p, {mixed(f'{name}_p', f'{name}_b')}, xor({name}_b4, {name}_b4 >> 16) AS {name}"


def resampled(df: DataFrame, by: list[str], *, pnl: str = "pnl", order: str = "date", statistic: Statistic = "sharpe", n_iter: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """For each group the bootstrap interval of a statistic, and the sign-flip test's observed Sharpe ratio and p value.

    Rows are blocks of iterations, each with the group's values (its trading days) in order, so a group's iterations are spread over all tasks. Draws
    come from a counter-based generator, so a result doesn't depend on how they are.
    """
    if n_iter < 1 or not 0 < ci < 1:
        raise ValueError("n_iter must be positive and ci in (0, 1)")
    f = _STATISTICS[statistic] if isinstance(statistic, str) else lambda v: np.array([statistic(x) for x in v])
    keys = [F.col(c).alias(f"__{i}") for i, c in enumerate(by)]
    names = [f"__{i}" for i in range(len(by))]
    values = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(pnl).cast("double").alias("v")))), lambda r: r["v"]).alias("__v"))
    asked = values.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1), F.lit(BLOCK))))
    schema = ", ".join([*(f"`__{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate(by)), "n long, observed double, boot double, `null` double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                *key, v, k = row
                v, n = np.asarray(v, float), len(v)
                observed = float(np_sharpe(v)) if n >= 2 else math.nan
                out = []
                step = max(1, DRAWS // max(1, n))
                for at in range(k, min(k + BLOCK, n_iter), step):
                    its = np.arange(at, min(at + step, k + BLOCK, n_iter))
                    if n < 2:
                        out.append(np.full((len(its), 2), np.nan))
                        continue
                    boot = f(v[(draws(seed, its, n) * np.uint64(n) >> np.uint64(32)).astype(np.int64)])
                    null = np_sharpe(np.where(draws(seed + 1, its, n) >> np.uint64(31), 1.0, -1.0) * v)
                    out.append(np.stack([boot, null], 1))
                told = np.concatenate(out)
                yield pd.DataFrame({**{c: [x] * len(told) for c, x in zip(names, key, strict=True)}, "n": n, "observed": observed, "boot": told[:, 0], "null": told[:, 1]})

    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = asked.repartition(tasks).mapInPandas(run, schema)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != math.inf), F.col(c))
    own = told.select(*names, "n", finite("observed").alias("observed"), finite("boot").alias("boot"), finite("null").alias("null"))
    # as many values as iterations
    out = own.groupBy(*names).agg(F.max("n").alias("n_obs"), F.percentile("boot", F.lit((1 - ci) / 2)).alias("ci_low"), F.percentile("boot", F.lit((1 + ci) / 2)).alias("ci_high"), F.max("observed").alias("observed"), F.count_if(F.abs("null") >= F.abs("observed")).alias("hits"), F.count("null").alias("tries"))
    p = F.when(F.col("observed").isNull(), 1.0).otherwise((F.col("hits") + 1) / (F.col("tries") + 1))
    return out.select(*(F.col(x).alias(c) for x, c in zip(names, by, strict=True)), "n_obs", "ci_low", "ci_high", "observed", p.alias("p_value"))


def resampled_sql(source: str, by: str, n_iter: int = 1000, ci: float = 0.95, seed: int = 42) -> str:
    """resampled of a relation (by, date, pnl) in DuckDB: a SELECT to follow WITH clauses."""
    return f"""
v AS (SELECT {by} AS g, pnl, row_number() OVER (PARTITION BY {by} ORDER BY date) - 1 AS j, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
drawn AS (SELECT g, k, j, n, pnl, {draws_sql(seed, "k", "j", "u")}, {draws_sql(seed + 1, "k", "j", "w")} FROM v, (SELECT unnest(range(0, {n_iter})) AS k)),
boot AS (SELECT d.g, d.k, sqrt({TRADING_DAYS}) * avg(v.pnl) / nullif(stddev_samp(v.pnl), 0) AS s FROM drawn d JOIN v ON v.g = d.g AND v.j = (d.u * d.n) >> 32 GROUP BY 1, 2),
flipped AS (SELECT g, k, sqrt({TRADING_DAYS}) * avg(f) / nullif(stddev_samp(f), 0) AS s FROM (SELECT g, k, CASE WHEN w >> 31 = 1 THEN pnl ELSE -pnl END AS f FROM drawn) GROUP BY 1, 2),
seen AS (SELECT g, count(*) AS n_obs, sqrt({TRADING_DAYS}) * avg(pnl) / nullif(stddev_samp(pnl), 0) AS observed FROM v GROUP BY 1),
ends AS (SELECT g, quantile_cont(s, {(1 - ci) / 2}) AS ci_low, quantile_cont(s, {(1 + ci) / 2}) AS ci_high FROM boot GROUP BY 1),
hits AS (SELECT f.g, count(*) FILTER (abs(f.s) >= abs(o.observed)) AS hits, count(f.s) AS tries FROM flipped f JOIN seen o ON o.g = f.g GROUP BY 1)
SELECT seen.g AS {by}, n_obs, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(observed, 6) AS observed, round(CASE WHEN observed IS NULL THEN 1.0 ELSE (hits + 1) / (tries + 1) END, 6) AS p_value
FROM seen JOIN ends ON ends.g = seen.g JOIN hits ON hits.g = seen.g"""


def mark_audit(days: DataFrame, by: list[str]) -> DataFrame:
    """Totals of marked legs and fallbacks; ratios are null without legs."""
    fall = F.col("n_fallback_settle") + F.col("n_fallback_surface")
    rate = F.when(F.col("n_legs_marked") > 0, fall / F.col("n_legs_marked")).otherwise(0.0)
    total = F.sum("n_legs_marked")
    return days.groupBy(*by).agg(F.count("*").alias("n_days"), total.alias("n_legs"), F.sum("n_fallback_settle").alias("n_settle"), F.sum("n_fallback_surface").alias("n_surface"), F.sum("n_fallback_settle_3rd").alias("n_third"), F.count_if(fall > 0).alias("days_with_fallback"), F.try_divide(F.sum(fall), total).alias("fallback_share"), F.avg(rate).alias("mean_daily_rate"))


def divergence(pnl: DataFrame, name: str = "scenario") -> DataFrame:
    """(a, b, n, l1) for each pair of scenarios: days that both have, and the sum of absolute differences (null if none)."""
    a = pnl.select(F.col(name).alias("a"), "date", F.col("pnl").alias("pa"))
    b = pnl.select(F.col(name).alias("b"), "date", F.col("pnl").alias("pb"))
    names = pnl.select(name).distinct()
    pairs = names.select(F.col(name).alias("a")).join(names.select(F.col(name).alias("b")), F.col("a") < F.col("b"))
    both = a.join(b, "date").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("l1"))
    return pairs.join(both, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fold_summary(days: DataFrame, capital: float) -> DataFrame:
    """Each fold: observations, total, Sharpe ratio and drawdown."""
    own = days.select("scenario", "fold_index", "date", F.col("daily_pnl").alias("pnl"))
    return own.groupBy("scenario", "fold_index").agg(F.count("*").alias("n_obs"), F.sum("pnl").alias("total_pnl"), sharpe("pnl", capital=capital).alias("sharpe")).join(max_drawdown(own, ["scenario", "fold_index"], capital), ["scenario", "fold_index"])


def scenario_summary(result: DataFrame, capital: float) -> DataFrame:
    """Each scenario over all folds' days in order: observations, Sharpe ratio, drawdown of the cumulative sum, Calmar ratio, trades, failed folds and exit criteria."""
    days = result.where("kind = 'day'").select("scenario", "date", F.col("daily_pnl").alias("pnl"))
    base = days.groupBy("scenario").agg(F.count("*").alias("n_obs"), sharpe("pnl", capital=capital).alias("sharpe"))
    more = result.groupBy("scenario").agg(F.count_if(F.col("kind") == "trade").alias("n_trades"), F.countDistinct("fold_index").alias("n_folds"), F.count_if(F.col("kind") == "error").alias("n_failed_folds"), F.coalesce(F.avg(F.when(F.col("kind") == "trade", (F.col("realised_pnl") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"))
    out = more.join(base, "scenario", "left").join(max_drawdown(days, ["scenario"], capital), "scenario", "left").join(calmar(days, ["scenario"], capital), "scenario", "left")
    return out.withColumns({"pass_sharpe": F.col("sharpe") >= 1, "pass_drawdown": F.abs("max_drawdown") < 0.20, "pass_calmar": F.coalesce(F.col("calmar") > 0.5, F.lit(False))})


def ablation(summary: DataFrame) -> DataFrame:
    """One row for each strategy, Sharpe ratio and trades by gate; names are <strategy>_<gate>."""
    own = summary.withColumns({"strategy": F.substring_index("scenario", "_", 1), "gate": F.expr("substring(scenario, length(substring_index(scenario, '_', 1)) + 2)")})
    return own.groupBy("strategy").pivot("gate", ["vanilla", "IV_percentile", "HMM"]).agg(F.first("sharpe").alias("sharpe"), F.first("n_trades").alias("n_trades"))
