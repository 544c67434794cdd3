"""Known cases of operators that SQL can't express, and argument checks."""

import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strikeflow.operators import chain as ops
from strikeflow.operators import implied_vol, lanes, regime, surface
from strikeflow.operators import statistics as st
from strikeflow.plans import simulation as sim
from strikeflow.sources import bulletin, shards, synthetic


def test_volatility_round_trip():
    rng = np.random.default_rng(1)
    n = 500
    s, k, t, v = np.full(n, 17000.0), rng.uniform(15500, 18500, n), rng.uniform(0.05, 1, n), rng.uniform(0.1, 0.6, n)
    call = rng.random(n) < 0.5
    p, _ = implied_vol.price(s, k, t, 0.015, 0.035, v, call)
    got, status = implied_vol.solve(p, s, k, t, 0.015, np.full(n, 0.035), call)
    ok = status == "ok"
    assert ok.mean() > 0.98 and np.abs(got[ok] - v[ok]).max() < 1e-6


def test_volatility_statuses():
    p = np.array([1e9, -1.0, math.nan, 0.0])
    _, status = implied_vol.solve(p, np.full(4, 100.0), np.array([100.0, 100.0, 100.0, 300.0]), np.full(4, 0.1), 0.0, np.zeros(4), np.full(4, True))
    assert list(status) == ["above_bound", "below_bound", "invalid", "ok"]


def test_normal_distribution():
    z = np.linspace(-8, 8, 1001)
    want = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    assert np.abs(implied_vol._cdf(z) - want).max() < 1e-15


def test_smiles_recover_parameters():
    k, t = np.linspace(-0.3, 0.3, 31), 30 / 365
    params = (0.04, 0.4, -0.3, 0.05, 0.1)
    iv = np.sqrt(surface.svi_variance(k, *params) / t)
    got = surface.fit_svi(k, iv, t)
    assert np.abs(surface.evaluate("svi", got, k, t) - iv).max() < 1e-4
    f, strike = 17000.0, np.arange(15000, 19001, 100.0)
    vol = surface.sabr_vol(f, strike, t, 0.2, -0.4, 0.9)
    got = surface.fit_sabr(f, strike, vol, t)
    assert abs(got["rho"] + 0.4) < 1e-3 and abs(got["nu"] - 0.9) < 1e-3
    got = surface.fit_poly(k, 0.18 - 0.3 * k + 0.4 * k * k)
    assert abs(got["c1"] + 0.3) < 1e-9
    with pytest.raises(ValueError):
        surface.fit_svi(k[:4], iv[:4], t)


def test_fallback_goes_on_to_the_next_model():
    strike = np.array([16800.0, 17000.0, 17200.0, 17400.0])
    got = surface.fit_with_fallback(strike, np.array([0.2, 0.19, 0.185, 0.19]), 17000.0, 0.1)
    assert got["model_type"] == "sabr" and [a[0] for a in got["attempts"]] == ["svi", "sabr"]
    assert surface.fit_with_fallback(strike[:2], np.array([0.2, 0.19]), 17000.0, 0.1)["model_type"] == "all_failed"


def test_smiles_are_fitted_together_as_alone():
    rng = np.random.default_rng(4)
    f, strikes, ivs, times = 17000.0, [], [], []
    for i in range(60):
        n, t = int(rng.integers(3, 30)), float(rng.choice([10, 30, 90])) / 365
        k = np.sort(rng.uniform(-0.35, 0.35, n))
        w = surface.svi_variance(k, rng.uniform(0, 0.03) * t, rng.uniform(0.02, 0.5) * t, rng.uniform(-0.8, 0.5), rng.uniform(-0.1, 0.1), rng.uniform(0.05, 0.4))
        strikes.append(f * np.exp(k))
        ivs.append(np.sqrt(w / t) * (1 + (i % 2) * 0.02 * rng.normal(size=n)))
        times.append(t)
    got = surface.fit_many(strikes, ivs, np.full(60, f), np.array(times), False)
    alone = [surface.fit_with_fallback(s, v, f, t, False) for s, v, t in zip(strikes, ivs, times, strict=True)]
    for i, (a, b, k, v, t) in enumerate(zip(got, alone, strikes, ivs, times, strict=True)):
        assert a["model_type"] == b["model_type"] == ("svi" if len(k) > 4 else "sabr" if len(k) > 3 else "poly")
        assert a["in_sample_rmse"] == pytest.approx(b["in_sample_rmse"], rel=0.02 if i % 2 else 0, abs=1e-7)
        p = a["params"]
        if a["model_type"] == "svi":
            assert p["b"] >= 0 and abs(p["rho"]) < 1 and p["sigma"] > 0 and p["b"] * (1 + abs(p["rho"])) <= 4 / t + 1e-9
            assert p["a"] + p["b"] * p["sigma"] * math.sqrt(1 - p["rho"] ** 2) >= -1e-12
            assert i % 2 or np.abs(surface.evaluate("svi", p, np.log(k / f), t) - v).max() < 1e-6
    # smiles that break every bound still have admissible fits
    w = np.array([[0.5, 0.1, 0.0, 0.1, 0.5], [1e-9, 0.0, 0.2, 0.0, 1e-9], [0.0, 0.0, 0.0, 0.0, 3.0]])
    k = np.tile(np.linspace(-0.2, 0.2, 5), (3, 1))
    found, problems = lanes.svi_lanes(k, np.sqrt(w / 0.1), np.ones((3, 5), bool), np.full(3, 0.1), False)
    a, b, rho, m, sigma = found.T
    assert problems == [None] * 3 and (b >= 0).all() and (b * (1 + np.abs(rho)) <= 40 + 1e-9).all() and (a + b * sigma * np.sqrt(1 - rho**2) >= -1e-12).all()
    assert lanes.svi_lanes(k[:0], k[:0], k[:0] > 0, np.zeros(0))[1] == []


def test_the_inner_problem_is_solved_exactly():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(40, 12)), rng.normal(size=(40, 12))
    target = rng.normal(size=(40, 12)) * 2
    dot = lambda a, b: (a * b).sum(1)
    reach = rng.uniform(0.1, 1.5, 40)
    d, c = lanes.in_polygon(dot(x, x), dot(x, y), dot(y, y), dot(x, target), dot(y, target), reach)
    assert (np.abs(d) <= 0.999 * c + 1e-12).all() and (c + np.abs(d) <= reach + 1e-12).all()
    error = lambda i, d, c: ((d * x[i] + c * y[i] - target[i]) ** 2).sum()
    for i in range(40):
        grid = [(u * v * reach[i], v * reach[i]) for u in np.linspace(-0.999, 0.999, 41) for v in np.linspace(0, 1, 41) if v + abs(u * v) <= 1]
        assert error(i, d[i], c[i]) <= min(error(i, *p) for p in grid) + 1e-9


def test_two_regimes_are_found():
    rng = np.random.default_rng(3)
    calm, wild = rng.normal(0, 0.005, 400), rng.normal(0, 0.03, 104)
    assert regime.high_vol_today([np.concatenate([calm, wild]), np.concatenate([wild, calm]), calm]).tolist() == [True, False, False]


def day(date, bid=1.0, ask=1.2, **more):
    expiry = pd.Timestamp("2026-02-18").date()
    rows = []
    for leg, (strike, kind, qty) in enumerate(((17200.0, "call", -1), (17400.0, "call", 1), (16800.0, "put", -1), (16600.0, "put", 1))):
        base = {"scenario": "x", "gate": "none", "fold_index": 0, "date": pd.Timestamp(date).date(), "underlying": 17000.0, "expiry": expiry, "strike": strike, "option_type": kind, "settle": 1.1, "model_price": None, "bid": None if bid is None else bid + 10 * (qty < 0), "ask": ask + 10 * (qty < 0), "active": True} | more
        rows += [base | {"row": "q", "leg": None, "qty": None, "max_risk": None}, base | {"row": "c", "leg": leg, "qty": qty, "max_risk": 9000.0}]
    return pd.DataFrame(rows)


def test_simulation_conserves_money():
    s = sim.Scenario("x", target_dte=30, exit_dte=14)
    out = sim.simulate(s, 0, pd.concat([day("2026-01-15"), day("2026-01-16"), day("2026-02-10")]))
    days, trades = out[out.kind == "day"], out[out.kind == "trade"]
    assert len(days) == 3 and len(trades) == 1
    # sold at 11 and 11, bought at 1.2 and 1.2; bought back at 11.2 and 11.2, sold at 1 and 1; opened again on the last day
    assert trades.realised_pnl.iloc[0] == pytest.approx((22 - 2.4 - 22.4 + 2) * 50)
    assert days.daily_pnl.sum() == pytest.approx(days.cum_pnl.iloc[-1])


def test_simulation_rejects_and_settles():
    s = sim.Scenario("x", target_dte=30, exit_dte=14)
    out = sim.simulate(s, 0, day("2026-01-15", bid=None))
    assert list(out.kind) == ["reject", "day"]
    out = sim.simulate(sim.Scenario("x", max_loss=100.0), 0, day("2026-01-15"))
    assert out[out.kind == "reject"].reason.iloc[0] == "max_loss_per_trade"
    out = sim.simulate(sim.Scenario("x", mark_policy="strict"), 0, pd.concat([day("2026-01-15"), day("2026-01-16", bid=None)]))
    assert out[out.kind == "error"].shape[0] == 1
    # expired without quotes: intrinsic value
    last = day("2026-02-18", underlying=17300.0)
    out = sim.simulate(sim.Scenario("x", exit_dte=1), 0, pd.concat([day("2026-01-15"), last[last.row == "c"]]))
    trade = out[out.kind == "trade"].iloc[0]
    assert trade.realised_pnl == pytest.approx((22 - 2.4 - 100) * 50)


def test_arguments_are_checked(spark):
    df = spark.createDataFrame([(1,)], "dte int")
    for args in ((-1, 5), (9, 5)):
        with pytest.raises(ValueError):
            ops.filter_by_dte(df, *args)
    with pytest.raises(ValueError):
        ops.check_target(0.2, "put", None)
    for bad in ({"wing_delta": 0.2}, {"profit_target": 0.0}, {"exit_dte": 40}):
        with pytest.raises(ValueError):
            sim.Scenario("x", **bad)
    with pytest.raises(ValueError):
        st.expected_best(1)
    late = spark.createDataFrame([("2026-01-02", "2026-01-01")], "date string, expiry string").select(*(F.col(c).cast("date") for c in ("date", "expiry")))
    with pytest.raises(Exception, match="expiry before date"):
        ops.add_dte(late).collect()


def test_synthetic_chain(spark):
    df = synthetic.generate(spark, synthetic.Config(end="2026-01-15"))
    assert len(df.columns) == 25
    assert df.where("bid > ask or settle < 0 or dte < 1 or high < low").count() == 0
    again = synthetic.generate(spark, synthetic.Config(end="2026-01-15"))
    assert df.exceptAll(again).count() == 0


HEADER = list(bulletin.COLUMNS)


def row(contract="TXO", month="202401", session="一般", kind="買權", bid="-"):
    return ["2024/01/02", contract, month, "17000", kind, "1", "2", "0.5", "1.5", "10", "1.6", "20", bid, "1.7", "3", "0.1", "", session, "0.1", "3%", "20240117"]


def test_bulletins(spark, tmp_path):
    rows = [row(), row(month="202401W1"), row(session="盤後"), row(contract="CAO"), row(kind="賣權", bid="1.4")]
    for n, name in ((18, "a"), (20, "b"), (21, "c")):
        lines = [HEADER[:n]] + [r[:n] + ([""] if n == 20 else []) for r in rows]
        (tmp_path / f"{name}.csv").write_bytes("\r\n".join(",".join(x) for x in lines).encode("cp950"))
        raw = bulletin.parse(spark, str(tmp_path / f"{name}.csv"))
        assert len(raw.columns) == n and raw.count() == 5
        view = bulletin.strategy_view(raw).collect()
        assert {(v["option_type"], v["bid"], str(v["expiry"])) for v in view} == {("call", None, "2024-01-17"), ("put", 1.4, "2024-01-17")}
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.write(tmp_path / "c.csv", "2024_opt_01.csv")
    assert bulletin.parse_zip(spark, str(tmp_path / "y.zip")).exceptAll(bulletin.parse(spark, str(tmp_path / "c.csv"))).count() == 0
    # several archives: a task for each member, stored or deflated, and a damaged one is refused
    for name, how, months in (("p", zipfile.ZIP_DEFLATED, 3), ("q", zipfile.ZIP_STORED, 2)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", how) as z:
            for m in range(months):
                z.writestr(f"2024_opt_{m:02d}.CSV", ((tmp_path / "c.csv").read_bytes() + b"\r\n") * (1 + 3000 * m))
            z.writestr("readme.txt", "no")
    both = str(tmp_path / "[pq].zip")
    packed = bulletin.zip_members(spark, both)
    assert packed.rdd.getNumPartitions() == packed.count() == 5
    assert bulletin.parse_zip(spark, both).count() == 5 * (1 + 3001 + 6001 + 1 + 3001)
    assert bulletin.parse_zip(spark, both).distinct().exceptAll(bulletin.parse(spark, str(tmp_path / "c.csv"))).count() == 0
    raw = bytearray((tmp_path / "q.zip").read_bytes())
    raw[200] ^= 1
    (tmp_path / "bad.zip").write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        bulletin.parse_zip(spark, str(tmp_path / "bad.zip")).count()
    whole = bulletin.parse(spark, str(tmp_path / "c.csv"))
    assert bulletin.strategy_view(whole, strict=True).count() == 2
    for part, what in (("false", "no rows"), ("contract = 'CAO'", "no rows of TXO"), ("trading_session = 'after_hours'", "no monthly regular rows of TXO")):
        with pytest.raises(ValueError, match=what):
            bulletin.strategy_view(whole.where(part), strict=True)
    (tmp_path / "spot.csv").write_text("Date,open,close\n2024-01-02,1,17000.5\n2024-01-03,1,\n2024-01-04,1,17010\n")
    assert [r["underlying"] for r in bulletin.spot(spark, str(tmp_path / "spot.csv")).orderBy("date").collect()] == [17000.5, None, 17010.0]
    assert bulletin.spot(spark, str(tmp_path / "spot.csv"), "2024-01-03", "2024-01-04").count() == 2
    with pytest.raises(ValueError):
        bulletin.version_of([*HEADER, "別的"])
    with pytest.raises(ValueError):
        bulletin.version_of(HEADER[:17])
    folders = str(tmp_path / "raw"), str(tmp_path / "view")
    assert bulletin.backfill(spark, [str(tmp_path / "c.csv")], *folders).collect()[0]["n"] == 5
    assert bulletin.backfill(spark, [str(tmp_path / "c.csv")], *folders).count() == 0
    assert shards.is_cached(spark, folders[0], "2024-01-02") and not shards.is_cached(spark, folders[0], "2024-01-03")
    assert shards.manifest(spark, folders[0]).collect()[0]["n"] == 5


def test_fetch(tmp_path):
    calls = []

    def get(url, form):
        calls.append(url)
        if len(calls) == 1:
            raise ConnectionError
        return b"PK" + bytes(200)

    to = str(tmp_path / "x.zip")
    assert bulletin.fetch(get, to, "u", {}, annual=True, wait=0) == "fetched" and len(calls) == 2
    assert bulletin.fetch(get, to, "u", {}, annual=True) == "cached"
    with pytest.raises(ValueError):
        bulletin.fetch(lambda u, f: b"no", str(tmp_path / "y"), "u", {})


def test_shards_refuse_other_schemas(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02", 1)], "date string, a int").withColumn("date", F.col("date").cast("date"))
    with pytest.raises(ValueError):
        shards.save(df, str(tmp_path / "s"), ["date", "b"])
    with pytest.raises(ValueError):
        shards.save(df.limit(0), str(tmp_path / "s"))
    with pytest.raises(ValueError):
        shards.union([df, df.withColumnRenamed("a", "b")])


def test_resampling(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 60 + ["b"] * 3, "date": list(range(60)) + [0, 1, 2], "pnl": [*rng.normal(1, 1, 60), 2.0, 2.0, 2.0]}))
    got = {r["g"]: r for r in st.resampled(df, ["g"], n_iter=200).collect()}
    assert got["a"]["ci_low"] < got["a"]["observed"] < got["a"]["ci_high"] and got["a"]["p_value"] < 0.05
    assert got["b"]["p_value"] == 1.0 and got["b"]["observed"] is None


def test_shard_stream(spark, tmp_path):
    from strikeflow.streaming import events

    schema = "date date, v int"
    src, to, cp = (str(tmp_path / n) for n in ("src", "to", "cp"))
    make = lambda d, v: spark.createDataFrame([(d, v)], "d string, v int").select(F.col("d").cast("date").alias("date"), "v")
    make("2024-01-02", 1).unionByName(make(None, 9)).write.parquet(src)
    events.ingest_shards(spark, src, to, spark.createDataFrame([], schema).schema, cp)
    make("2024-01-03", 2).write.mode("append").parquet(src)
    events.ingest_shards(spark, src, to, spark.createDataFrame([], schema).schema, cp)
    assert sorted(r["v"] for r in spark.read.parquet(to).collect()) == [1, 2]
    assert spark.read.parquet(f"{to}-rejected").count() == 1


def test_shock_prices_every_scenario(spark):
    from strikeflow.operators.chain import shock
    from strikeflow.plans import fixture

    rows = fixture.chain(spark, "/root/testdata/sf0.001").orderBy("date", "expiry", "strike", "option_type").limit(2)
    scenarios = spark.range(1200).selectExpr("cast(id as string) scenario", "id / 10000 vol_shift", "0.0D spot_shift")
    assert shock(rows, scenarios).select("scenario").distinct().count() == 1200
    assert shock(rows, scenarios).count() == 2400 and shock(rows, scenarios.limit(3)).count() == 6
