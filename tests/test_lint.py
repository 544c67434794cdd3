"""Lint of text lines, and what a stored surface's loaders refuse."""

import re

import pytest
from pyspark.sql import functions as F

from strikeflow.functions import dates
from strikeflow.operators import lint
from strikeflow.sources import reports, shards, synthetic

RULES = (
    lint.Rule("old", r"run [0-9]+", unless="run 7"),
    lint.Rule("old", r"see run", where="kind = 'note'"),
    lint.Rule("claim", "never", warning=True),
    lint.Rule("mixed", "proof", text_has=("proof", "mock"), text_lacks="plumbing"),
)
ROWS = [
    (1, "note", "see run 3\r\nrun 7 is done\nnever run 3"),
    (2, "plan", "see run\nproof of a mock"),
    (3, None, "see run\nproof of\nmock\nproof"),
    (4, "note", None),
    (5, "note", ""),
    (6, "note", "proof by mock, plumbing"),
    (6, "note", "proof by mock, plumbing never"),
    (7, "note", "x" * 200_000 + " never"),
]


def brute(rows, rules):
    out = set()
    for key, kind, text in rows:
        for no, line in enumerate((text or "").split("\n") if text is not None else [], 1):
            line = line.removesuffix("\r")
            for r in rules:
                holds = (r.where == "true" or kind == "note") and all(re.search(p, text) for p in r.text_has) and not (r.text_lacks and re.search(r.text_lacks, text))
                if holds and re.search(r.pattern, line) and not (r.unless and re.search(r.unless, line)):
                    out.add((key, no, r.category, r.warning, line))
    return sorted(out)


def test_lint_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "id long, kind string, text string").withColumn("pos", F.lit(0))
    hits = lint.lint(docs, RULES, "id")
    assert sorted(map(tuple, hits.collect())) == brute(ROWS, RULES)
    assert {tuple(r) for r in lint.totals(hits, "id").collect()} == {("old", False, 2, 1), ("claim", True, 3, 3), ("mixed", False, 3, 2)}
    assert not lint.passes(hits) and lint.passes(hits.where("id = 7"))
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()


def test_lint_of_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, kind string, text string")
    assert lint.lint(empty, RULES, "id").count() == 0 and lint.passes(lint.lint(empty, RULES, "id"))
    with pytest.raises(ValueError, match="no rules"):
        lint.lint(empty, (), "id")
    with pytest.raises(ValueError, match="named as results"):
        lint.lint(empty.withColumn("Line", F.lit(1)), RULES, "Line")
    twice = spark.createDataFrame([ROWS[1]] * 2, "id long, kind string, text string")
    assert lint.lint(twice, RULES, "id").count() == 2 * len(brute(ROWS[1:2], RULES))


def test_surface_loaders_refuse(spark, tmp_path):
    with pytest.raises(ValueError, match="no records for 2024-01-02"):
        reports.surface_day(spark, str(tmp_path / "none"), "2024-01-02")
    with pytest.raises(ValueError, match="not an ISO date"):
        reports.surface_day(spark, str(tmp_path), "2024-1-2")
    assert shards.dates(spark, str(tmp_path / "none")).count() == reports.surface_dates(spark, str(tmp_path / "none")).count() == 0


def test_days_of_a_table(spark):
    span = spark.sql("select date'2024-11-30' lo, date'2025-01-01' hi union all select null, date'2025-01-01'")
    assert [(str(a), str(b)) for a, b in dates.monthly_calendar(span, "lo", "hi").orderBy("month").collect()] == [("2024-11-01", "2024-11-20"), ("2024-12-01", "2024-12-18"), ("2025-01-01", "2025-01-15")]
    days = spark.sql("select explode(array(date'2024-11-30', date'2024-11-30', date'2024-12-03', null)) as date")
    made = synthetic.generate(spark, synthetic.Config(strikes=3, max_dte=30), days=days)
    assert {str(r[0]) for r in made.select("date").distinct().collect()} == {"2024-11-30", "2024-12-03"}
