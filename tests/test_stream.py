"""The walk-forward as a stream against the one over all days, restarts, late shards; joins of points and intervals."""

import random

import pytest
from pyspark.sql import functions as F

from strikeflow.operators.intervals import bin_join
from strikeflow.plans import fixture
from strikeflow.plans import simulation as sim
from strikeflow.streaming.walk import Walk

SF = "/root/testdata/sf0.001"
TODO = [sim.Scenario("condor", **sim.CONDOR, **sim.COSTS), sim.Scenario("vertical", **sim.VERTICAL, gate="odd"), sim.Scenario("hedged", **{**sim.CONDOR, "strategy": "hedged_condor"}), sim.Scenario("strict", **sim.CONDOR, mark_policy="strict")]


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_shards_one_by_one_give_the_whole_walk(spark, tmp_path):
    chain = fixture.chain(spark, SF).where("date between '1997-01-01' and '1997-06-30'").checkpoint()
    folds = sim.fold_windows(chain.select("date"), 21, 21, 30).checkpoint()
    gates = chain.select("date").distinct().select("date", F.lit("odd").alias("gate"), (F.dayofmonth("date") % 2 == 1).alias("active")).checkpoint()
    want = ordered(sim.walk_forward(spark, chain, TODO, folds, gates))
    assert {r[2] for r in want} >= {"day", "trade", "reject", "error"}
    source, folder = str(tmp_path / "shards"), str(tmp_path / "walk")
    new = lambda: Walk(spark, source, chain.schema, folder, TODO, folds, gates)
    walk, edges = new(), ["1997-01-01", "1997-03-10", "1997-05-07", "1997-07-01"]
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        chain.where((F.col("date") >= a) & (F.col("date") < b)).repartition(2).write.mode("append").parquet(source)
        if k == 1:
            # a step that breaks off after its rows were written, and another process that goes on
            broken = new()
            broken._take(spark.read.parquet(source).where((F.col("date") >= a) & (F.col("date") < b)), 1)
            walk = new()
        walk.step()
    walk.step()  # nothing new
    assert ordered(walk.result()) == want
    assert walk.rejects().count() == 0
    # a shard that comes late changes nothing but the rejects
    late = chain.where(F.col("date") == F.lit(chain.where("date >= '1997-03-10'").agg(F.min("date")).first()[0]))
    late.unionByName(late.limit(3).withColumn("date", F.lit(None).cast("date"))).write.mode("append").parquet(source)
    walk = new()
    assert ordered(walk.step()) == want
    rejects = walk.rejects()
    assert rejects.count() == late.count() + 3 and [str(r[0]) for r in rejects.select("taken_until").distinct().collect()] == [str(max(r[3] for r in want if r[3]))]


def test_machines_can_be_written_and_read(spark):
    import datetime

    machine = sim.Machine(TODO[0], 3)
    day = datetime.date(2026, 1, 5)
    leg = sim.Leg(day, 17000.0, "call", -1, day, 12.345678901234567)
    machine.book.positions = [sim.Position([leg], day, float("nan"), 1e4), sim.Position([leg], day, 3.0, 1e4, day, 0.1 + 0.2, True)]
    machine.book.positions[1].legs = []
    machine.book.cash, machine.before = 0.1, -0.0
    again = sim.Machine(TODO[0], 3).read(machine.written())
    assert str(vars(again.book)) == str(vars(machine.book)) and again.before == machine.before and again.written() == machine.written()


def test_points_meet_the_intervals_that_hold_them(spark):
    rnd = random.Random(3)
    points = [(k, rnd.uniform(-50, 50)) for k in range(200)] + [(200, None), (201, 10.0), (202, -10.0)]
    spans = [(k, a, a + rnd.choice([0.0, 0.5, 7, 60])) for k, a in enumerate([rnd.uniform(-60, 50) for _ in range(80)])] + [(80, 10.0, 10.0), (81, 5.0, 4.0), (82, None, 3.0), (83, -1e3, 1e3)]
    want = sorted((p, i) for p, x in points for i, a, b in spans if x is not None and a is not None and a <= x <= b)
    p, i = spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "i int, a double, b double")
    for width in (1, 10.0, 1000):
        got = bin_join(p, i, "x", "a", "b", width)
        assert sorted((r["p"], r["i"]) for r in got.collect()) == want and got.columns == ["p", "x", "i", "a", "b"]
    plan = bin_join(p, i, "x", "a", "b", 10)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="columns of both"):
        bin_join(p, i.withColumnRenamed("i", "x"), "x", "a", "b", 1)
    with pytest.raises(ValueError, match="width"):
        bin_join(p, i, "x", "a", "b", 0)


def test_expanding_and_rolling_windows_by_bins(spark):
    days = spark.range(200).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7 / 5).cast("int")).alias("date"))
    for expanding in (False, True):
        folds = sim.fold_windows(days, 60, 20, 20, expanding)
        got = bin_join(days, folds, "date", "train_start", "train_end", sim.BIN_DAYS)
        want = days.join(folds, F.col("date").between(F.col("train_start"), F.col("train_end")))
        assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count() > 0
        assert {r["count"] for r in got.groupBy("fold_index").count().collect()} == ({60} if not expanding else {60 + 20 * k for k in range(folds.count())})
