"""Volatility smiles: SVI, SABR and polynomial fits for each date and expiry."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeflow.constants import CALENDAR_DAYS, DIVIDEND
from strikeflow.functions import bsm
from strikeflow.functions import expressions as x
from strikeflow.operators import chain as ops
from strikeflow.operators import lanes
from strikeflow.operators.lanes import MIN_POINTS, sabr_vol, svi_variance

ACCEPT_RMSE = 1.0
#: The most smiles that are fitted together.
LANES = 256
PARAMETERS = {"svi": ("a", "b", "rho", "m", "sigma"), "sabr": ("F", "alpha", "rho", "nu"), "poly": ("c0", "c1", "c2")}
RECORD = "date date, expiry date, model_type string, converged boolean, n_points long, in_sample_rmse double, fit_time_ms long, forward double, t double, params map<string,double>, attempts array<struct<model_type:string,converged:boolean,rmse:double,error:string>>, error string"


def evaluate(model: str, params: dict, k: np.ndarray, t: float) -> np.ndarray:
    if model == "svi":
        with np.errstate(invalid="ignore"):
            return np.sqrt(svi_variance(k, *(params[n] for n in PARAMETERS["svi"])) / t)
    if model == "sabr":
        return sabr_vol(params["F"], params["F"] * np.exp(k), t, params["alpha"], params["rho"], params["nu"])
    return params["c0"] + params["c1"] * k + params["c2"] * k * k


def _single(name: str, found: np.ndarray, problems: list[str | None]) -> dict[str, float]:
    if problems[0]:
        raise ValueError(problems[0])
    return dict(zip(PARAMETERS[name], found[0].tolist(), strict=True))


def _enough(name: str, points: np.ndarray) -> None:
    if len(points) < MIN_POINTS[name]:
        raise ValueError("too few points")


def fit_svi(k: np.ndarray, iv: np.ndarray, t: float, arbitrage_free: bool = True) -> dict[str, float]:
    """One smile by lanes.svi_lanes."""
    _enough("svi", k)
    return _single("svi", *lanes.svi_lanes(k[None], iv[None], np.ones((1, len(k)), bool), np.array([t]), arbitrage_free))


def fit_sabr(f: float, strike: np.ndarray, iv: np.ndarray, t: float) -> dict[str, float]:
    _enough("sabr", strike)
    return _single("sabr", *lanes.sabr_lanes(np.array([f]), strike[None], iv[None], np.ones((1, len(strike)), bool), np.array([t])))


def fit_poly(k: np.ndarray, iv: np.ndarray) -> dict[str, float]:
    _enough("poly", k)
    return _single("poly", *lanes.poly_lanes(k[None], iv[None], np.ones((1, len(k)), bool)))


def fit_many(strikes: list[np.ndarray], ivs: list[np.ndarray], forward: np.ndarray, t: np.ndarray, arbitrage_free: bool = True) -> list[dict]:
    """For each smile SVI, then SABR, then a polynomial: the first that converges with an error below ACCEPT_RMSE. Each model is fitted to all smiles that are still open at once."""
    n = len(strikes)
    found: list[dict | None] = [None] * n
    attempts: list[list[tuple]] = [[] for _ in range(n)]
    strike, on = lanes.padded(strikes)
    iv, _ = lanes.padded(ivs)
    k = np.log(np.where(on, strike, forward[:, None]) / forward[:, None])
    points = on.sum(1)
    for model in ("svi", "sabr", "poly"):
        open_ = np.array([i for i in range(n) if found[i] is None], int)
        able = open_[points[open_] >= MIN_POINTS[model]]
        for i in open_[points[open_] < MIN_POINTS[model]].tolist():
            attempts[i].append((model, False, None, "too few points"))
        if model == "svi":
            got, problems = lanes.svi_lanes(k[able], iv[able], on[able], t[able], arbitrage_free)
        elif model == "sabr":
            got, problems = lanes.sabr_lanes(forward[able], strike[able], iv[able], on[able], t[able])
        else:
            got, problems = lanes.poly_lanes(k[able], iv[able], on[able])
        for i, values, problem in zip(able.tolist(), got.tolist(), problems, strict=True):
            if problem:
                attempts[i].append((model, False, None, problem))
                continue
            params, own = dict(zip(PARAMETERS[model], values, strict=True)), on[i]
            rmse = float(np.sqrt(np.mean((evaluate(model, params, k[i, own], float(t[i])) - iv[i, own]) ** 2)))
            ok = math.isfinite(rmse) and rmse < ACCEPT_RMSE
            attempts[i].append((model, ok, rmse if math.isfinite(rmse) else None, None))
            if ok:
                found[i] = {"model_type": model, "converged": True, "in_sample_rmse": rmse, "params": params, "error": None}
    failed = lambda tried: {"model_type": "all_failed", "converged": False, "in_sample_rmse": None, "params": {}, "error": "; ".join(f"{m}: {e}" for m, _, _, e in tried if e)}
    return [(x or failed(tried)) | {"attempts": tried} for x, tried in zip(found, attempts, strict=True)]


def fit_with_fallback(strike: np.ndarray, iv: np.ndarray, forward: float, t: float, arbitrage_free: bool = True) -> dict:
    """fit_many of one smile."""
    return fit_many([strike], [iv], np.array([forward]), np.array([t]), arbitrage_free)[0]


def smiles(chain: DataFrame, forward: Column | None = None) -> DataFrame:
    """(date, expiry, strike, iv, forward, dte): the median volatility of each strike and the forward of each smile."""
    own = ops.usable_iv(chain)
    points = own.groupBy("date", "expiry", "strike").agg(F.median("iv").alias("iv"))
    level = own.groupBy("date", "expiry").agg((forward if forward is not None else F.median("underlying")).alias("forward"))
    return points.join(level, ["date", "expiry"]).withColumn("dte", F.datediff("expiry", "date"))


def fit_surface(chain: DataFrame, *, min_strikes: int = 5, arbitrage_free: bool = True, forward: Column | None = None) -> DataFrame:
    """One record for each date and expiry; a smile that can't be fitted gives a record that says so, never an error. Smiles of a batch are fitted together, LANES at a time; fit_time_ms is a smile's share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), LANES):
                began, own = time.perf_counter(), batch.iloc[at : at + LANES].reset_index(drop=True)
                strikes, ivs = ([np.asarray(v, float) for v in own[c]] for c in ("strikes", "ivs"))
                n, t, level = np.array([len(v) for v in strikes]), own["dte"].to_numpy(float) / CALENDAR_DAYS, own["forward"].to_numpy(float)
                able = np.flatnonzero((n >= min_strikes) & (t > 0) & np.isfinite(level) & (level > 0))
                fitted = dict(zip(able.tolist(), fit_many([strikes[i] for i in able], [ivs[i] for i in able], level[able], t[able], arbitrage_free) if len(able) else [], strict=True))
                none = lambda i: {"model_type": "insufficient_data", "converged": False, "in_sample_rmse": None, "params": {}, "attempts": [], "error": f"{n[i]} usable strikes, t {t[i]:.6f}"}  # noqa: B023, E731
                found = [fitted.get(i) or none(i) for i in range(len(own))]
                took = int(1000 * (time.perf_counter() - began) / len(own))
                tried = [[{"model_type": m, "converged": c, "rmse": r, "error": e} for m, c, r, e in x.pop("attempts")] for x in found]
                yield pd.DataFrame(found).assign(date=own["date"], expiry=own["expiry"], n_points=n, fit_time_ms=took, forward=level, t=t, attempts=tried)[[c.split()[0] for c in RECORD.split(", ")]]

    points = smiles(chain, forward).groupBy("date", "expiry", "forward", "dte").agg(F.array_sort(F.collect_list(F.struct("strike", "iv"))).alias("points"))
    own = points.select("date", "expiry", "forward", "dte", F.col("points.strike").alias("strikes"), F.col("points.iv").alias("ivs"))
    # few bytes but much work in each row: a fixed number of tasks, not one by size
    tasks = max(4 * own.sparkSession.sparkContext.defaultParallelism, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return own.repartition(tasks, "date", "expiry").mapInPandas(run, RECORD)


def poly_coefficients(chain: DataFrame) -> DataFrame:
    """(date, expiry, n, c0, c1, c2): the degree-2 least-squares smile from sums, by Cramer's rule, in one aggregation."""
    p = smiles(chain).withColumn("k", F.log(F.col("strike") / F.col("forward")))
    sums = p.groupBy("date", "expiry").agg(F.count("*").cast("double").alias("n"), *(F.sum(F.pow("k", F.lit(i))).alias(f"s{i}") for i in range(1, 5)), *(F.sum(F.pow("k", F.lit(i)) * F.col("iv")).alias(f"y{i}") for i in range(3)))
    det = lambda a: f"({a[0]}*({a[4]}*{a[8]}-{a[5]}*{a[7]})-{a[1]}*({a[3]}*{a[8]}-{a[5]}*{a[6]})+{a[2]}*({a[3]}*{a[7]}-{a[4]}*{a[6]}))"
    base = ["n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4"]
    with_y = lambda j: [f"y{i // 3}" if i % 3 == j else c for i, c in enumerate(base)]
    return sums.where("n >= 3").select("date", "expiry", F.col("n").cast("long").alias("n"), *(F.expr(f"{det(with_y(j))}/nullif({det(base)}, {x.num(0)})").alias(f"c{j}") for j in range(3)))


def record_problem() -> Column:
    """What is wrong with a record, or null: value ranges, the key set of each model and its parameters' domain."""
    keys = F.array_sort(F.map_keys("params"))
    p = lambda n: F.col("params")[n]
    wanted = {m: F.array(*(F.lit(k) for k in sorted(PARAMETERS[m]))) for m in PARAMETERS}
    lee = p("b") * (1 + F.abs(p("rho"))) > 4 / F.col("t") + 1e-4
    return (
        F.when(~F.col("model_type").isin("svi", "sabr", "poly", "all_failed", "insufficient_data"), "unknown model")
        .when(F.col("expiry") < F.col("date"), "expiry before date")
        .when(F.col("n_points") < 0, "negative point count")
        .when(F.col("converged") & (F.col("in_sample_rmse").isNull() | (F.col("in_sample_rmse") < 0)), "converged without error")
        .when(F.col("converged") & F.col("model_type").isin("all_failed", "insufficient_data"), "converged failure")
        .when(~F.col("converged") & (F.size("params") > 0), "parameters without convergence")
        .when(F.col("converged") & ((F.col("t") <= 0) | (F.col("forward") <= 0)), "no positive time or forward")
        .when(F.col("converged") & (F.col("model_type") == "svi") & (keys != wanted["svi"]), "wrong parameters")
        .when(F.col("converged") & (F.col("model_type") == "sabr") & (keys != wanted["sabr"]), "wrong parameters")
        .when(F.col("converged") & (F.col("model_type") == "poly") & (keys != wanted["poly"]), "wrong parameters")
        .when((F.col("model_type") == "svi") & ((p("b") < 0) | (F.abs(p("rho")) >= 1) | (p("sigma") <= 0) | lee), "outside the domain")
        .when((F.col("model_type") == "sabr") & ((p("alpha") <= 0) | (F.abs(p("rho")) >= 1) | (p("nu") < 0)), "outside the domain")
    )


def validate(records: DataFrame) -> DataFrame:
    """records; the first bad one fails the query."""
    bad = record_problem()
    return records.where(F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("bad record:"), bad, F.col("date").cast("string"), F.col("expiry").cast("string"))).cast("boolean")))


def surface_iv(k: str = "k") -> Column:
    """Volatility at log strike k from a record's columns; null unless converged and the variance isn't negative."""
    p = lambda n: f"params['{n}']"
    w = x.svi(k, p("a"), p("b"), p("rho"), p("m"), p("sigma"))
    sabr = x.sabr(p("F"), f"({p('F')}*exp({k}))", "fit_t", p("alpha"), p("rho"), p("nu"))
    poly = f"{p('c0')}+{p('c1')}*{k}+{p('c2')}*{k}*{k}"
    return F.expr(f"CASE WHEN NOT converged THEN NULL WHEN model_type = 'svi' THEN CASE WHEN {w} >= 0 THEN sqrt({w}/fit_t) END WHEN model_type = 'sabr' THEN {sabr} WHEN model_type = 'poly' THEN {poly} END")


def add_model_price(chain: DataFrame, records: DataFrame) -> DataFrame:
    """Joins the smile of each (date, expiry) and reprices at its volatility, with the fallback yield."""
    own = records.select("date", "expiry", "model_type", "converged", "params", F.col("t").alias("fit_t"))
    out = chain.drop("model_price").join(own, ["date", "expiry"], "left").withColumn("k", F.log(F.col("strike") / F.col("underlying"))).withColumn("model_iv", surface_iv())
    out = bsm.price(out.withColumn("model_iv", F.when(F.col("model_iv") > 0, F.col("model_iv"))), vol="model_iv", name="model_price", q=x.num(DIVIDEND))
    return out.drop("model_type", "converged", "params", "fit_t", "k", "model_iv")
