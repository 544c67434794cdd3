"""Strategies of one's own, gates, records, reports and whole runs on small chains."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strikeflow.functions import bsm, checks, dates
from strikeflow.functions import expressions as x
from strikeflow.operators import chain as ops
from strikeflow.operators import feasibility, regime
from strikeflow.operators import results as rs
from strikeflow.plans import runs
from strikeflow.plans import simulation as sim
from strikeflow.session import checkpoint_dir
from strikeflow.sources import records, reports, shards
from test_engine import day


def small_chain(spark, n_days=40, start="2026-01-05"):
    """Two expiries, eleven strikes, a spot that drifts."""
    checkpoint_dir(spark)
    days = pd.bdate_range(start, periods=n_days)
    rows = []
    for i, d in enumerate(days):
        spot = 17000.0 + 10 * i
        for e in ("2026-02-18", "2026-03-18", "2026-04-15"):
            dte = (pd.Timestamp(e) - d).days
            for k in range(15000, 19501, 100):
                for kind in ("call", "put"):
                    if dte >= 1:
                        rows.append((d.date(), pd.Timestamp(e).date(), float(k), kind, spot, dte, 0.2))
    own = spark.createDataFrame(pd.DataFrame(rows, columns=["date", "expiry", "strike", "option_type", "underlying", "dte", "iv"]))
    own = bsm.greeks(bsm.price(own, name="settle"))
    return own.select("date", "expiry", "strike", "option_type", "settle", F.col("settle").alias("close"), (F.col("settle") * 0.99).alias("bid"), (F.col("settle") * 1.01).alias("ask"), F.lit(1).cast("long").alias("volume"), F.lit(1).cast("long").alias("open_interest"), "underlying", "dte", "iv", "delta")


# mathematics, against other sources than the SQL text


def test_normal_distribution_and_greeks(spark):
    z = spark.range(-800, 801).select((F.col("id") / 100).alias("z")).select("z", F.expr(x.norm_cdf("z")).alias("cdf"), F.expr(x.norm_pdf("z")).alias("pdf")).collect()
    assert all(abs(r["cdf"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-14 and abs(r["pdf"] - math.exp(-r["z"] ** 2 / 2) / math.sqrt(2 * math.pi)) < 1e-15 for r in z)
    rng = np.random.default_rng(2)
    rows = [(float(s), float(k), int(t), float(v), kind) for s, k, t, v in zip(rng.uniform(15000, 19000, 60), rng.uniform(15000, 19000, 60), rng.integers(5, 400, 60), rng.uniform(0.1, 0.5, 60), strict=True) for kind in ("call", "put")]
    base = spark.createDataFrame(rows, "underlying double, strike double, dte int, iv double, option_type string")
    price = lambda df: np.array([r["price"] for r in bsm.price(df).collect()])
    p = price(base)
    s, k, t = (np.array([r[i] for r in rows], float) for i in range(3))
    t /= 365
    parity = s * np.exp(-0.035 * t) - k * np.exp(-0.015 * t)
    assert np.abs(p[::2] - p[1::2] - parity[::2]).max() < 1e-7
    g = {n: np.array([r[n] for r in bsm.greeks(base).collect()]) for n in ("delta", "gamma", "vega")}
    up, down = (price(base.withColumn("underlying", F.col("underlying") + h)) for h in (1.0, -1.0))
    assert np.abs((up - down) / 2 - g["delta"]).max() < 1e-4 and np.abs(up - 2 * p + down - g["gamma"]).max() < 1e-6
    more = price(base.withColumn("iv", F.col("iv") + 1e-4))
    assert np.abs((more - p) / 1e-4 - g["vega"] * (100 if np.abs((more - p) / 1e-4).max() > 20 * np.abs(g["vega"]).max() else 1)).max() < 0.01 * np.abs((more - p) / 1e-4).max()


# gates


def test_hidden_states_in_lanes(spark):
    rng = np.random.default_rng(3)
    calm, wild = rng.normal(0, 0.005, 400), rng.normal(0, 0.03, 104)
    holed = np.concatenate([calm, wild])
    holed[[3, 50, 200]] = np.nan
    patchy = holed.copy()
    patchy[:60] = np.nan
    windows = [np.concatenate([calm, wild]), np.concatenate([wild, calm]), calm, holed, patchy, np.zeros(504)]
    got = regime.high_vol_today(windows)
    assert got.tolist() == [True, False, False, True, False, False]
    # rows don't touch each other
    assert [bool(regime.high_vol_today([w])[0]) for w in windows] == got.tolist()
    m, steps = regime.fit_hmm(windows[0][None])
    assert sorted(np.sqrt(m["var"][0]).round(3)) == pytest.approx([0.005, 0.03], abs=2e-3) and steps[0] >= 5
    assert np.allclose(m["move"].sum(2), 1)
    series = spark.createDataFrame(pd.DataFrame({"date": pd.bdate_range("2024-01-01", periods=504).date, "ret": [None if math.isnan(v) else float(v) for v in holed]}))
    rows = {r["date"]: r["active"] for r in regime.hmm_gate(series).collect()}
    assert len(rows) == 504 and rows[max(rows)] is True and sum(rows.values()) == 1


# the state machine


def test_credit_is_that_of_the_condor():
    hedge = [{"strike": 17000.0, "option_type": "call", "leg": 4, "qty": -1}, {"strike": 17000.0, "option_type": "call", "leg": 5, "qty": 1, "expiry": pd.Timestamp("2026-03-18").date()}]
    first = day("2026-01-15")
    base = first[first.row == "c"].iloc[0].to_dict()
    more = pd.DataFrame([base | h | {"row": r, "bid": 50.0, "ask": 52.0} for h in hedge for r in "qc"])
    s = sim.Scenario("x", strategy="hedged_condor")
    seen = []
    strategy = sim.Strategy(None, should_close=lambda book, p, today, quotes: seen.append((p.entry_credit, len(p.legs), len(book.snapshot()["positions"]))) or False, credit_legs=4)
    rows = pd.concat([first, more, day("2026-01-16")])
    sim.simulate(s, 0, rows[rows.date <= pd.Timestamp("2026-01-15").date()], strategy)
    out = sim.simulate(s, 0, pd.concat([first, more, first.assign(date=pd.Timestamp("2026-01-16").date()), more.assign(date=pd.Timestamp("2026-01-16").date())]), strategy)
    assert seen[0] == (pytest.approx(2 * 11.1 - 2 * 1.1), 6, 1) and set(out.kind) == {"day"}
    # without a mid the credit is unknown, and only time closes
    book = sim.Book(sim.Scenario("y"))
    p = sim.Position([sim.Leg(pd.Timestamp("2026-02-18").date(), 17000.0, "call", -1, None, 10.0)], None, math.nan, 1.0)
    quotes = {p.legs[0].key: {"bid": 0.1, "ask": 0.2, "settle": 0.1, "model_price": None}}
    assert not sim.should_close(book, p, pd.Timestamp("2026-01-20").date(), quotes) and sim.should_close(book, p, pd.Timestamp("2026-02-10").date(), quotes)
    with pytest.raises(ValueError):
        sim.Position([], None, 0.0, 0.0)


def test_own_strategy_fill_and_factory(spark):
    chain = small_chain(spark)
    folds = sim.fold_windows(chain.select("date"), 10, 10, 10)

    def one_put(own, s):
        put = own.where((F.col("strike") == 17000.0) & (F.col("option_type") == "put") & (F.col("expiry") == F.lit("2026-04-15").cast("date")))
        return put.select("date", F.lit(0).alias("leg"), "expiry", "strike", "option_type", F.lit(-1).alias("qty"), "bid", "ask", F.lit(100.0).alias("max_risk"), F.lit(None).cast("string").alias("note"))

    strategies = {"short_put": sim.Strategy(one_put, should_close=lambda book, p, today, quotes: False)}
    todo = [sim.Scenario("own", strategy="short_put", fill="model")]
    returns = regime.log_returns(chain.groupBy("date").agg(F.first("underlying").alias("underlying")))
    seen = spark.sparkContext.accumulator(0)

    def factory(s, train):
        seen.add(len(train))
        return s if len(train) else s

    out = sim.walk_forward(spark, chain, todo, folds, strategies=strategies, fills={"model": lambda q, side: q["settle"]}, factory=factory, returns=returns).checkpoint()
    days = out.where("kind = 'day'")
    assert days.count() == 10 * folds.count() and out.where("kind = 'error'").count() == 0
    assert days.where("n_open = 1").count() == days.count() and seen.value > 0
    # sold at the settlement: the first day's result is its mark against it
    assert days.where("fold_index = 0").orderBy("date").first()["daily_pnl"] == pytest.approx(0.0, abs=1e-6)


def test_hedged_condors_tell_why_a_hedge_is_missing(spark):
    chain = small_chain(spark)
    gone = chain.withColumn("ask", F.when(~((F.col("expiry") > F.lit("2026-02-18").cast("date")) & F.col("strike").between(16900, 17300) & (F.day("date") % 2 == 0)), F.col("ask")))
    todo = [v for v in sim.hedged_scenarios(costs=False) if v.gate == "none"]
    fold = runs.whole_window(gone)
    out = sim.walk_forward(spark, gone, todo, fold).checkpoint()
    rejects = out.where("kind = 'reject' and path = 'hedge_attach'")
    assert {r["reason"] for r in rejects.collect()} <= {"hedge_build_fail", "hedge_gate_fail: sell front", "hedge_gate_fail: buy back"}
    got = rs.hedge_failures(out).collect()
    assert len(got) == 1 and got[0]["n_failed"] == rejects.count() and len(got[0]["reasons"]) == min(5, rejects.count())
    legs = sim.hedged_candidates(gone, todo[0]).groupBy("date").agg(F.count("*").alias("n"), F.first("note", True).alias("note")).collect()
    assert {(r["n"], r["note"] is None) for r in legs} <= {(6, True), (4, False)}
    kinds = rs.rejected(out).collect()
    assert all(r["n"] > 0 for r in kinds)


def test_mark_policies(spark):
    chain = small_chain(spark).withColumn("model_price", F.col("settle"))
    got = {r["scenario"]: r for r in runs.mark_policies(spark, chain).collect()}
    assert set(got) == {"A_strict_mid", "B_settle_fallback", "C_surface_fallback", "D_surface_forced_missing"}
    assert all(r["status"] == "completed" or r["error"] for r in got.values()) and got["A_strict_mid"]["status"] == "completed"
    assert got["A_strict_mid"]["cum_pnl"] == pytest.approx(got["C_surface_fallback"]["cum_pnl"])
    thin = rs.force_missing(chain, 0.3)
    share = thin.where("bid is null").count() / chain.count()
    assert 0.25 < share < 0.35 and thin.where("can_sell <> (bid is not null)").count() == 0
    assert thin.exceptAll(rs.force_missing(chain.repartition(7), 0.3)).count() == 0


def test_whole_run(spark, tmp_path):
    chain = small_chain(spark)
    spot = chain.groupBy("date").agg(F.first("underlying").alias("underlying"))
    view = chain.select("date", "expiry", "strike", "option_type", "settle", F.when(F.col("strike") != 15000, F.col("close")).alias("close"), "bid", "ask", "volume", "open_interest")
    todo = [v for v in sim.scenarios() if v.gate == "none"]
    out = runs.run(spark, view, spot, str(tmp_path / "run"), todo, runs.Windows(20, 10, 10), records=str(tmp_path / "fits"), n_iter=50)
    assert {r["scenario"] for r in out["scenarios"].collect()} == {"IC_vanilla", "Vertical_vanilla"}
    assert {r["phase"] for r in out["meta"].collect()} >= {"enriched", "chain", "gates", "result", "scenarios"}
    fits = records.load(spark, str(tmp_path / "fits"), "2026-01-05", "2026-12-31")
    assert fits.where("converged").count() > 0
    meta = {r["phase"]: r for r in out["meta"].collect()}
    enriched = spark.read.parquet(str(tmp_path / "run" / "enriched"))
    assert meta["enriched"]["n_rows"] == enriched.count() and meta["days"]["n_rows"] == out["days"].count()
    shares = enriched.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in enriched.columns)).first().asDict()
    assert meta["enriched"]["nulls"] == pytest.approx({c: v for c, v in shares.items() if v})
    gate_rows = spark.read.parquet(str(tmp_path / "run" / "gates"))
    assert meta["gates"]["n_warnings"] == gate_rows.where("status in ('unsteady', 'failed')").count()
    told = []
    scope = runs.Scope(start="2026-01-12", scenarios=("IC_vanilla",), costs=False)
    small = runs.run(spark, view, spot, str(tmp_path / "small"), todo, runs.Windows(20, 10, 10), n_iter=20, scope=scope, progress=lambda phase, seen: told.append((phase, seen["rows"])))
    assert [r["scenario"] for r in small["scenarios"].collect()] == ["IC_vanilla"] and told[0] == ("enriched", enriched.where("date >= '2026-01-12'").count())
    for bad in ({"start": "2026-02-01", "end": "2026-01-01"}, {"skip_coverage": True}):
        with pytest.raises(ValueError):
            runs.Scope(**bad)
    with pytest.raises(ValueError, match="no such scenarios"):
        runs.Scope(scenarios=("other",)).todo(todo)
    again = runs.run(spark, view, spot, str(tmp_path / "again"), todo, runs.Windows(20, 10, 10), records=str(tmp_path / "fits"), n_iter=50)
    assert again["days"].exceptAll(out["days"]).count() == 0
    reports.write_json(out["scenarios"], str(tmp_path / "s.json"))
    assert {r["scenario"] for r in json.loads((tmp_path / "s.json").read_text())} == {"IC_vanilla", "Vertical_vanilla"}
    reports.write_markdown({"Scenarios": out["scenarios"].select("scenario", "sharpe", "calmar", "reasons")}, str(tmp_path / "s.md"))
    text = (tmp_path / "s.md").read_text()
    assert text.startswith("## Scenarios") and text.count("\n|") == 4
    reports.write_csv(out["trades"].limit(0), str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_text().startswith("scenario,fold_index,date")
    tables = reports.run_tables(spark, str(tmp_path / "run"))
    cum = reports.cumulative_days(tables["days"], ["IC_vanilla"])
    assert cum.count() == tables["days"].where("scenario = 'IC_vanilla'").select("date").distinct().count()
    with pytest.raises(ValueError):
        runs.run(spark, view.withColumn("bid", F.lit(None).cast("double")).where("strike = 17000"), spot, str(tmp_path / "bad"), todo, runs.Windows(20, 10, 10))


# results and feasibility


def test_comparisons_and_criteria(spark):
    rows = [("a", 1.2, -0.1, 0.8, 40), ("b", 0.5, -0.3, None, 3), ("c", 1.0, -0.05, 0.6, 0)]
    summary = spark.createDataFrame(rows, "scenario string, sharpe double, max_drawdown double, calmar double, n_trades long")
    ci = spark.createDataFrame([("a", 0.1), ("b", None)], "scenario string, ci_low double")
    got = {r["scenario"]: r["n_passed"] for r in rs.scorecard(summary, ci).collect()}
    assert got == {"a": 4, "b": 0, "c": 3}
    diff = {r["scenario"]: r for r in rs.cost_comparison(summary, summary.withColumn("sharpe", F.col("sharpe") - 0.2)).collect()}
    assert diff["a"]["sharpe_diff"] == pytest.approx(-0.2) and diff["b"]["calmar_diff"] is None
    gap = rs.sharpe_gap(summary, "a", "c").first()
    assert gap["gap"] == pytest.approx(0.2 / 1.2) and gap["passed"]
    assert {r["note"] for r in rs.evidence(summary).collect()} == {"enough", "3 trades, under 30", "no trades"}


def test_decisions(spark):
    e = lambda mean, p10: spark.createDataFrame([(float(mean), float(p10))], "mean_n double, p10 double")
    r = lambda c, s: spark.createDataFrame([("calendar", c), ("straddle", s)], "mode string, median double")
    cov = lambda v: spark.createDataFrame([(v,)], "coverage double")
    cases = [((0.5, 0, 1.0, 1.0, 1.0), "no_go"), ((5, 4, 1.0, 1.0, 0.5), "no_go"), ((5, 4, 6.0, 6.0, 1.0), "no_go"), ((5, 4, 6.0, 1.5, 1.0), "go_5"), ((5, 4, None, 3.0, 1.0), "go_5_dear"), ((3, 2, None, None, 1.0), "go_3"), ((2, 1, 1.0, 1.0, 1.0), "go_1")]
    for (mean, p10, c, s, v), want in cases:
        assert feasibility.decision(e(mean, p10), r(c, s), cov(v)).first()["verdict"] == want
    days = spark.range(50).select(F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    one = feasibility.sample_dates(days, 10)
    assert one.count() == 10 and one.exceptAll(feasibility.sample_dates(days.repartition(5), 10)).count() == 0


# stores and checks


def test_records_round_trip(spark, tmp_path):
    rows = [("2026-01-05", "2026-02-18", "svi", True, 11, 0.001, 17000.0, 0.12, {"a": 0.001, "b": 0.02, "rho": -0.4, "m": 0.02, "sigma": 0.1}), ("2026-01-05", "2026-03-18", "all_failed", False, 3, None, 17000.0, 0.2, {})]
    own = spark.createDataFrame(rows, "date string, expiry string, model_type string, converged boolean, n_points long, in_sample_rmse double, forward double, t double, params map<string,double>").withColumns({c: F.col(c).cast("date") for c in ("date", "expiry")})
    folder = str(tmp_path / "fits")
    records.save(own, folder, "2026-01-05")
    records.save(own.withColumn("date", F.lit("2026-01-06").cast("date")), folder, "2026-01-06")
    got = records.load(spark, folder, "2026-01-05", "2026-01-05")
    assert got.count() == 2 and got.where("model_type = 'svi'").first()["params"] == rows[0][-1]
    assert records.is_cached(spark, folder, "2026-01-06") and not records.is_cached(spark, folder, "2026-01-07")
    assert [str(r["date"]) for r in records.cached_dates(spark, folder).orderBy("date").collect()] == ["2026-01-05", "2026-01-06"]
    assert records.to_stored(own).where("model_type = 'svi'").first()["params_json"].startswith('{"a":0.001,"b":0.02,"m"')
    for bad, date in ((own, "2026-01-07"), (own.limit(0), "2026-01-05"), (own, "05.01.2026")):
        with pytest.raises(ValueError):
            records.save(bad, folder, date)
    with pytest.raises(ValueError):
        records.load(spark, folder, "2026-02-01", "2026-01-01")
    records.save(own.withColumn("params", F.create_map(F.lit("a"), F.lit(1.0))), folder, "2026-01-05")
    with pytest.raises(Exception, match="wrong parameters|parameters without"):
        records.load(spark, folder, "2026-01-05", "2026-01-05").collect()


def test_layouts_and_manifest(spark, tmp_path):
    make = lambda d, **more: spark.createDataFrame([(d, 1)], "d string, a int").select(F.to_date("d").alias("date"), "a", *(F.lit(v).alias(k) for k, v in more.items()))
    folder, target = str(tmp_path / "s"), str(tmp_path / "m")
    shards.save(make("2024-01-02"), folder)
    assert shards.append_manifest(spark, folder, target).count() == 1
    shards.save(make("2024-01-03"), folder)
    assert shards.append_manifest(spark, folder, target).count() == 2 == shards.append_manifest(spark, folder, target).count()
    assert shards.load(spark, folder, "2024-01-01", "2024-12-31", versions=[("date", "a")]).count() == 2
    shards.save(make("2024-01-04", b=2), folder)
    with pytest.raises(ValueError):
        shards.load(spark, folder, "2024-01-01", "2024-12-31", versions=[("date", "a")])
    make("2024-01-02").write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        shards.append_manifest(spark, folder, str(tmp_path / "other"))


def test_domains(spark):
    df = spark.createDataFrame([(1, "call", "buy", 0.0, 0.0), (0, "call", "buy", 0.0, 0.0), (1, "x", "buy", 0.0, 0.0), (1, "put", None, 0.0, 0.0), (1, "put", "sell", -1.0, 0.0)], "qty int, option_type string, side string, commission double, tax double")
    assert [r[0] for r in df.select(checks.problem("fill")).collect()] == [None, "qty", "option_type", "side", "commission"]
    assert checks.require(df.limit(1), "fill").count() == 1
    for kind, row in (("qty", "qty = 0"), ("option_type", "option_type = 'x'"), ("side", "side IS NULL"), ("commission", "commission < 0")):
        with pytest.raises(Exception, match=f"fill: bad {kind}"):
            checks.require(df.where(row), "fill").collect()
    signals = spark.createDataFrame([("hold", []), ("hold", [1]), ("open", []), ("open", [1]), ("wait", [1])], "action string, orders array<int>")
    assert [r[0] for r in signals.select(checks.problem("signal")).collect()] == [None, "orders", "orders", None, "action"]
    risk = spark.createDataFrame([(1.0, 1.0, 1, 1.0, 0.5), (1.0, 1.0, 1, 1.0, 1.0), (0.0, 1.0, 1, 1.0, 0.5)], "max_loss_per_trade_twd double, max_capital_at_risk_twd double, max_concurrent_positions int, stop_loss_multiple double, portfolio_loss_cap_pct double")
    assert [r[0] for r in risk.select(checks.problem("risk")).collect()] == [None, "portfolio_loss_cap_pct", "max_loss_per_trade_twd"]
    for bad in ({"max_loss": 0.0}, {"loss_cap": 2.0}, {"stop_loss": -1.0}, {"mark_policy": "none"}):
        with pytest.raises(ValueError):
            sim.Scenario("x", **bad)


def test_days_off_and_odd_numbers(spark):
    days = spark.createDataFrame([("2026-01-09",), ("2026-02-16",), (None,)], "d string").select(F.to_date("d").alias("d"))
    off = spark.range(30).select(F.date_add(F.lit("2026-02-16").cast("date"), F.col("id").cast("int")).alias("date"))
    got = {str(r["d"]): str(r["expiry"]) for r in dates.rolled(days, "d", off).collect()}
    assert got == {"2026-01-09": "2026-01-09", "2026-02-16": "2026-03-18", "None": "None"}
    odd = spark.createDataFrame([(float("nan"),), (20240117.0,), (None,)], "n double")
    assert [str(r[0]) for r in odd.select(dates.compact_date(F.col("n"))).collect()] == ["None", "2024-01-17", "None"]
    quote = spark.createDataFrame([(float("nan"), 1.0, 2.0)], "bid double, ask double, settle double")
    assert ops.mark(quote, "settle").first()["basis"] == "settle_fallback"
