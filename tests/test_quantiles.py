"""Exact quantiles and first rows of groups against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strikeflow.operators import quantiles as qs
from strikeflow.operators import results as rs

R = random.Random(9)


def plain(values, p):
    own = sorted(v for v in values if v is not None)
    if not own:
        return None
    at = p * (len(own) - 1)
    a, b = own[math.floor(at)], own[math.ceil(at)]
    return a if a == b else (1 - at % 1) * a + at % 1 * b


def test_quantiles_match_sorting(spark, monkeypatch):
    groups = {
        "even": [R.random() for _ in range(1000)],
        "odd": [R.gauss(0, 1e-9) for _ in range(777)],
        "tails": [R.choice([1, -1]) * 10 ** R.uniform(-300, 300) for _ in range(500)] + [1.7e308, -1.7e308, 5e-324, 0.0, -0.0],
        "ties": [3.0] * 400 + [2.0] * 400,
        "one": [7.5],
        "none": [None, None],
        "edges": [-math.inf] * 3 + [math.inf] * 5 + [1.0, 2.0, 2.0],
        None: [float(k * k % 101) for k in range(300)] + [None] * 7,
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    probabilities = [0.0, 0.1, 0.5, 0.9, 1.0]
    for bins in (1 << 14, 64):
        monkeypatch.setattr(qs, "BINS", bins)
        got = {r[0]: r for r in qs.quantiles(df, F.col("v"), probabilities, "g").collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            assert got[g]["n"] == sum(v is not None for v in vs)
            assert list(got[g][2:]) == [plain(vs, p) for p in probabilities]
    whole = qs.quantiles(df, F.col("v"), [0.5], names=["m"]).first()
    assert whole["m"] == plain([v for vs in groups.values() for v in vs], 0.5)
    assert whole["n"] == df.where("v is not null").count()


def test_quantiles_of_nan_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.nan,), (0.0,)], "v double")
    low, middle, high = qs.quantiles(df, F.col("v"), [0.0, 1 / 3, 1.0]).drop("n").first()
    assert (low, middle) == (0.0, 1.0) and math.isnan(high)
    assert qs.quantiles(df.limit(0), F.col("v"), [0.5]).collect() == [(0, None)]
    assert qs.quantiles(df.limit(0).withColumn("g", F.lit(1)), F.col("v"), [0.5], "g").count() == 0
    for bad in ([], [1.5]):
        with pytest.raises(ValueError):
            qs.quantiles(df, F.col("v"), bad)
    with pytest.raises(ValueError, match="groups"):
        qs.quantiles(spark.range(2000).withColumn("v", F.lit(1.0)), F.col("v"), [0.5], "id")


def test_first_rows_of_groups(spark):
    rows = [(R.choice("ab"), R.randrange(500), f"r{k}") for k in range(3000)] + [("c", 1, "x"), ("c", 1, "x"), ("c", 0, None)]
    df = spark.createDataFrame(rows, "g string, o int, r string").repartition(6)
    got = {r["g"]: [tuple(x) for x in r["first"]] for r in rs.first_of(df, ["g"], F.struct("o", "r"), 5, "first").collect()}
    want = {g: sorted(((o, r) for h, o, r in rows if h == g), key=lambda x: (x[0], x[1] or ""))[:5] for g in "abc"}
    assert got == want
    result = spark.createDataFrame([("s", "reject", "hedge_attach", "2026-01-05", 0, f"why{k}") for k in range(9)] + [("t", "day", None, "2026-01-05", 0, None)], "scenario string, kind string, path string, date string, fold_index int, reason string")
    assert {r[0]: (r[1], r[2]) for r in rs.hedge_failures(result).collect()} == {"s": (9, [f"why{k}" for k in range(5)]), "t": (0, [])}
