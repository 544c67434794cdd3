"""Every registered engine query against its SQL on the smallest tables."""

import glob
import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pandas as pd
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strikeflow.operators import implied_vol
from strikeflow.plans import fixture
from strikeflow.plans import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with half a year of orders, as all queries on the chain take all dates of orders."""
    to = tmp_path_factory.mktemp("tables")
    for f in glob.glob(f"{SF}/*.parquet"):
        if f.endswith("orders.parquet"):
            day = pc.field("o_orderdate")
            pq.write_table(pq.read_table(f, filters=(day >= datetime(1997, 1, 1)) & (day < datetime(1997, 7, 1))), to / "orders.parquet")
        else:
            (to / os.path.basename(f)).symlink_to(f)
    return str(to)


def views(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def sides(folder):
    """By whether a query needs the chain or its dates: the tables and their views. The others have whole tables."""
    return {True: (folder, views(folder)), False: (SF, views(SF))}


def plain(column: pd.Series) -> pd.Series:
    """Values that both engines have alike: numbers, and all else as text; NaN and null are one."""
    if pd.api.types.is_bool_dtype(column) or pd.api.types.is_numeric_dtype(column):
        return column.astype(float)
    if pd.api.types.is_datetime64_any_dtype(column):
        return column.astype(str).str.slice(0, 19).str.removesuffix(" 00:00:00").where(column.notna(), None)
    kinds = {type(v) for v in column[column.notna()].head(1000)}
    if kinds <= {bool, int, float, Decimal}:
        return column.astype(float)
    return column.map(lambda v: None if v is None or v is pd.NaT or v != v else str(v)[:40].removesuffix(" 00:00:00"))


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query(spark, sides, name):
    tables, db = sides["spot AS" in engine.ORACLE_SQL[name]]
    got = engine.QUERIES[name](spark, tables)
    want = db.sql(engine.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    frames = [f[columns].apply(plain) for f in (got.toPandas(), want.df())]
    frames = [f.sort_values(columns, ignore_index=True, na_position="first") for f in frames]
    pd.testing.assert_frame_equal(*frames, check_dtype=False, check_exact=True)


def test_prices_at_their_bound(spark, tmp_path):
    # one order a date: its spot puts a price (calls and puts, mids and settles) within 1e-10 of its lower bound
    totals = {datetime(1987, 11, 15): 268191.68, datetime(1989, 1, 17): 328359.22, datetime(1972, 2, 11): 76718.40, datetime(1985, 6, 15): 199621.31}
    days = pd.Series(list(totals)).astype("datetime64[us]")
    pd.DataFrame({"o_orderkey": range(len(days)), "o_orderdate": days, "o_totalprice": list(totals.values())}).to_parquet(tmp_path / "orders.parquet")
    solved = implied_vol.add_iv(fixture.chain(spark, str(tmp_path))).select("date", "iv", "iv_source").collect()
    assert {(r["date"], r["iv_source"]) for r in solved if r["iv"] == 0} == {(d.date(), "settle" if d.year in (1985, 1989) else "mid") for d in totals}
    test_query(spark, {True: (str(tmp_path), views(tmp_path))}, "M03_M05_implied_volatility")


def test_no_other_price_has_volatility_zero(spark, folder, monkeypatch):
    add_iv = implied_vol.add_iv
    monkeypatch.setattr(implied_vol, "add_iv", lambda chain: add_iv(chain).withColumn("iv", F.when(F.col("iv").isNotNull(), 0.0)))
    own = engine.QUERIES["M03_M05_implied_volatility"](spark, folder).toPandas()
    easy = own[own["iv_source"].isin(["mid", "settle"])]
    assert len(easy) and not easy["sound"].any()


def test_fitted(spark, folder):
    chain = engine.QUERIES["P10_enrich_pipeline"](spark, folder)
    dates = chain.select("date").distinct().count()
    assert chain.where("iv > 0").count() > 0.8 * chain.count() > 0
    assert engine.QUERIES["K05_mark_policies"](spark, folder).count() == 4
    fits = engine.QUERIES["M10_M15_surface_fit"](spark, folder)
    assert fits.where("converged").count() > 0.9 * fits.count() > 0 and fits.select("date").distinct().count() == dates
    gates = engine.QUERIES["G02_hidden_markov_gate"](spark, folder)
    assert gates.count() == gates.select("date").distinct().count() > 0


def test_simulated(spark):
    # windows of a year need more dates than the folder has
    run = lambda name: engine.QUERIES[name](spark, SF)
    days = run("B01_B10_walk_forward")
    names = {r[0] for r in days.select("scenario").distinct().collect()}
    assert len(names) == 6
    totals = {r["scenario"]: r for r in run("A12_A21_run_totals").collect()}
    summary = {r["scenario"]: r for r in run("B11_scenario_summary").collect()}
    assert totals.keys() == summary.keys() == names == {r["scenario"] for r in run("K11_scorecard").collect()}
    for n in names:
        own = days.where(days.scenario == n)
        assert totals[n]["n_trades"] == summary[n]["n_trades"] == own.where("kind = 'trade'").count()
        assert (totals[n]["n_rejected"] or 0) == own.where("kind = 'reject'").count() and summary[n]["n_obs"] == own.where("kind = 'day'").count()
    hedged = run("X12_hedged_condor")
    failures = {r["scenario"]: r for r in run("K12_hedge_failures").collect()}
    for n, r in failures.items():
        assert r["n_failed"] == hedged.where((hedged.scenario == n) & (hedged.path == "hedge_attach")).count() and len(r["reasons"]) == min(5, r["n_failed"])
