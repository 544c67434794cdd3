"""Whole runs: from a strategy view to judged scenarios, with what each phase took."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strikeflow.operators import results as rs
from strikeflow.operators import statistics as st
from strikeflow.operators.implied_vol import enrich
from strikeflow.operators.monitor import require_coverage
from strikeflow.operators.regime import FAILED, OK, UNSTEADY, hmm_fits, log_returns, vol_percentile_gate
from strikeflow.operators.surface import add_model_price, fit_surface
from strikeflow.plans import simulation as sim
from strikeflow.sources import records as store


@dataclass(frozen=True)
class Windows:
    """Training, test and step in trading days."""

    train: int = 252
    test: int = 63
    step: int = 63


@dataclass(frozen=True)
class Scope:
    """What of a run is done: dates, scenarios by name, with or without costs. A smoke run has short windows, and only it may skip the test of coverage."""

    start: str | None = None
    end: str | None = None
    scenarios: tuple[str, ...] | None = None
    costs: bool = True
    smoke: bool = False
    skip_coverage: bool = False

    def __post_init__(self):
        if self.start and self.end and self.start > self.end:
            raise ValueError(f"{self.start} is after {self.end}")
        if self.skip_coverage and not self.smoke:
            raise ValueError("only a smoke run may skip the test of coverage")

    def dates(self, df: DataFrame, start: bool = True) -> DataFrame:
        out = df.where(F.col("date") >= F.lit(self.start).cast("date")) if start and self.start else df
        return out.where(F.col("date") <= F.lit(self.end).cast("date")) if self.end else out

    def todo(self, scenarios: list[sim.Scenario]) -> list[sim.Scenario]:
        if unknown := {*(self.scenarios or ())} - {s.name for s in scenarios}:
            raise ValueError(f"no such scenarios: {sorted(unknown)}")
        own = [s for s in scenarios if self.scenarios is None or s.name in self.scenarios]
        return own if self.costs else [replace(s, slip_bps=0.0, commission=0.0, tax_bps=0.0) for s in own]


#: Windows of a smoke run.
SMOKE = Windows(63, 21, 21)


def gates(spot: DataFrame, status: bool = False) -> DataFrame:
    """Both regime gates for all dates of spot (date, underlying); status: with what became of the fits."""
    returns = log_returns(spot)
    columns = ["date", "gate", "active", *(["status"] if status else [])]
    return vol_percentile_gate(returns).withColumn("status", F.lit(OK)).select(*columns).unionByName(hmm_fits(returns).select(*columns))


def mark_policy_scenarios(base: sim.Scenario) -> dict[str, tuple[sim.Scenario, bool]]:
    """The four ways to mark, each with whether its chain has quotes taken away."""
    return {n: (replace(base, name=n, mark_policy=p), forced) for n, p, forced in (("A_strict_mid", "strict", False), ("B_settle_fallback", "settle", False), ("C_surface_fallback", "surface", False), ("D_surface_forced_missing", "surface", True))}


def whole_window(chain: DataFrame) -> DataFrame:
    """One fold over all dates."""
    ends = chain.agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"))
    return ends.select(F.lit(0).alias("fold_index"), F.col("test_start").alias("train_start"), F.col("test_start").alias("train_end"), "test_start", "test_end")


def mark_policies(spark: SparkSession, chain: DataFrame, base: sim.Scenario | None = None) -> DataFrame:
    """One row for each way to mark, over all dates of a chain with model prices: completed or raised, trades, results and fallbacks. An error ends its scenario only, and is its row's error."""
    todo = mark_policy_scenarios(base or sim.Scenario("base", **sim.CONDOR))
    fold = whole_window(chain)
    plain = sim.walk_forward(spark, chain, [s for s, forced in todo.values() if not forced], fold)
    thinned = sim.walk_forward(spark, rs.force_missing(chain), [s for s, forced in todo.values() if forced], fold)
    result = plain.unionByName(thinned)
    days = result.where("kind = 'day'")
    audit = st.mark_audit(days, ["scenario"]).select("scenario", "n_legs", "n_settle", "n_surface", "mean_daily_rate")
    capital = next(iter(todo.values()))[0].capital
    summary = st.scenario_summary(result, capital).select("scenario", "n_trades", "n_failed_folds", "win_rate", "sharpe", "max_drawdown")
    totals = result.groupBy("scenario").agg(F.sum(F.when(F.col("kind") == "day", F.col("daily_pnl"))).alias("cum_pnl"), F.max(F.when(F.col("kind") == "error", F.col("reason"))).alias("error"))
    out = summary.join(totals, "scenario").join(audit, "scenario", "left")
    raised = F.col("n_failed_folds") > 0
    void = {c: F.when(~raised, F.col(c)) for c in ("cum_pnl", "win_rate", "sharpe", "max_drawdown", "mean_daily_rate")}
    return out.withColumns(void).withColumn("status", F.when(raised, "raised").otherwise("completed")).drop("n_failed_folds")


def run(spark: SparkSession, view: DataFrame, spot: DataFrame, folder: str, todo: list[sim.Scenario], windows: Windows = Windows(), *, records: str | None = None, n_iter: int = 1000, coverage: float | None = 0.95, scope: Scope | None = None, progress: Callable[[str, dict], None] | None = None) -> dict[str, DataFrame]:
    """Enriches a view, fits or loads its smiles, prices, simulates all scenarios and judges them. Tables go to folder (see sources.reports.run_tables).

    records: a folder of fit records, filled with the dates that it lacks. coverage: the least share of rows
    with a model price, else the run fails; None doesn't check. The phases' seconds, rows, shares of nulls and warnings are in the table meta; they are
    observed while a phase's table is written, not counted afterwards. progress(phase, what was observed) is called after each.
    """
    folder, began, meta = folder.rstrip("/"), time.perf_counter(), []
    scope = scope or Scope()
    todo, windows, coverage = scope.todo(todo), SMOKE if scope.smoke else windows, None if scope.skip_coverage else coverage
    view, spot = scope.dates(view), scope.dates(spot, start=False)  # gates look back beyond the first date

    def phase(name: str, df: DataFrame | None, rows: int | None = None, warning: Column | None = None) -> DataFrame | None:
        nonlocal began
        told: dict = {"rows": rows, "nulls": {}, "warnings": 0}
        if df is not None:
            seen = Observation(name)
            nulls = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in df.columns]
            warned = F.count_if(F.coalesce(warning if warning is not None else F.lit(False), F.lit(False))).alias("warnings")
            df.observe(seen, F.count(F.lit(1)).alias("rows"), warned, *nulls).write.mode("overwrite").parquet(f"{folder}/{name}")
            df, found = spark.read.parquet(f"{folder}/{name}"), seen.get
            told = {"rows": found["rows"], "warnings": found["warnings"], "nulls": {c[5:]: n / found["rows"] for c, n in found.items() if c.startswith("null ") and found["rows"] and n}}
        meta.append((len(meta), name, told["rows"], time.perf_counter() - began, told["nulls"], told["warnings"]))
        began = time.perf_counter()
        if progress is not None:
            progress(name, told)
        return df

    enriched = phase("enriched", enrich(view, spot))
    if records is None:
        fits = phase("records", fit_surface(enriched))
    else:
        have = enriched.select("date").distinct()
        try:
            have = have.join(store.cached_dates(spark, records), "date", "left_anti")
        except Exception as e:  # no folder before the first run
            if "PATH_NOT_FOUND" not in str(e):
                raise
        missing = phase("fitted", fit_surface(enriched.join(have, "date", "left_semi")))
        if not missing.isEmpty():
            store.save_all(missing, records)
        ends = enriched.agg(F.min("date"), F.max("date")).first()
        fits = store.load(spark, records, str(ends[0]), str(ends[1]))
    chain = phase("chain", add_model_price(enriched, fits))
    if coverage is not None:
        require_coverage(chain, coverage)
    gate_rows = phase("gates", gates(spot, status=True), warning=F.col("status").isin(UNSTEADY, FAILED))
    folds = phase("windows", sim.fold_windows(chain.select("date"), windows.train, windows.test, windows.step))
    result = phase("result", sim.walk_forward(spark, chain, todo, folds, gate_rows))
    capital = todo[0].capital
    days = phase("days", result.where("kind = 'day'").select("scenario", "fold_index", "date", "daily_pnl", "cum_pnl", "n_legs_marked", "n_fallback_settle", "n_fallback_surface", "n_fallback_settle_3rd"))
    phase("trades", result.where("kind = 'trade'").select("scenario", "fold_index", "date", "open_date", "realised_pnl", "n_legs", "adjusted"))
    phase("rejects", result.where("kind IN ('reject', 'error')").select("scenario", "fold_index", "kind", "date", "path", "reason"))
    phase("folds", st.fold_summary(days, capital))
    summary = st.scenario_summary(result, capital)
    tested = st.resampled(days.select("scenario", "date", F.col("daily_pnl").alias("pnl")), ["scenario"], n_iter=n_iter)
    judged = summary.join(tested.drop("n_obs"), "scenario", "left").join(rs.scorecard(summary, tested), "scenario", "left").join(rs.hedge_failures(result), "scenario", "left")
    phase("scenarios", judged.join(sim.scenario_table(spark, todo).withColumnRenamed("name", "scenario"), "scenario", "left"))
    phase("meta", None, len(todo))
    spark.createDataFrame(meta, "step int, phase string, n_rows long, seconds double, nulls map<string,double>, n_warnings long").write.mode("overwrite").parquet(f"{folder}/meta")
    names = ("scenarios", "folds", "days", "trades", "rejects", "meta")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
