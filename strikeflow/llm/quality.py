"""Quality rules: learned decision lists, in DataFrame expressions only.

One pass over the texts computes statistics of each document with SQL functions.
A decision list is learned from those of labelled documents by sequential
covering: a rule is grown, one threshold condition at a time by information
gain, on two thirds of the rows; conditions are pruned from its end while that
raises its worth on the other third; it is kept if it is right there often
enough, its rows are taken away, and the next one is grown. The list becomes one
ordered CASE expression.

Learning takes the statistics of about SAMPLE labelled documents to the driver,
those with hashes under a threshold. Rules only reject; what no rule covers is
kept.

Results: a null text has no words and fails the base. A text of any length is
read whole; time is n log n in its words. Without labels the list is empty and all
that pass the base are kept. Repeated rows are judged each; labels with a null
doc_id or quality are ignored, the smallest of several counts. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import shared

SAMPLE = 20_000
CUTS, CONDITIONS, RULES = 32, 3, 12
#: Least share of rejected rows that must be bad, and least number of them, on the pruning rows.
PRECISION, SUPPORT = 0.9, 3

SPACE = "[\\x20\\x09-\\x0D]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(grams: Column, width: int = 3) -> Column:
    """How many words stand in a window whose hash occurs twice or more, given the windows' hashes in order."""

    def positions(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = lambda i, j: F.element_at(pairs, j + 1)["h"] == F.element_at(pairs, i + 1)["h"]
        mark = lambda p, i: F.when(((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))) | ((i < last) & same(i, F.least(i + 1, last))), p["i"]).otherwise(F.lit(-1))
        return F.sort_array(F.filter(F.transform(pairs, mark), lambda x: x >= 0))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.when(i + 1 < F.size(at), F.least(F.lit(width), F.element_at(at, F.least(i + 2, F.size(at))) - x)).otherwise(F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, lambda p: let(positions(p), covered)))


def statistics(docs: DataFrame) -> DataFrame:
    """One row of statistics for each of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"),
        F.regexp_replace("text", "[^#*$%&|<>!A-Z]+", "").alias("marks"),
    )
    windows = F.when(F.size("words") >= 3, let(F.transform("words", lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2])))).otherwise(F.array().cast("array<long>"))
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("marks", "[!A-Z]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("marks", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("marks", "[^!]+", "")).cast("long").alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    return counted.select(*(c for c in counted.columns if c != "windows"), repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"))


def share(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))


#: What conditions test, computed from statistics.
FEATURES: dict[str, Column] = {}


def feature_columns() -> dict[str, Column]:
    if not FEATURES:
        FEATURES.update(
            symbols_per_word=share("n_symbols", "n_words"),
            upper_share=share("n_upper", "word_chars"),
            bangs_per_word=share("n_bangs", "n_words"),
            repeat_share=share("n_repeat_words", "n_words"),
            dup_line_share=share("n_dup_lines", "n_lines"),
            mean_word=share("word_chars", "n_words"),
            n_words=F.col("n_words").cast("double"),
        )
    return FEATURES


#: Columns of the rows to learn from.
Rows = dict[str, np.ndarray]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: Rows) -> np.ndarray:
        return rows[self.feature] >= self.threshold if self.above else rows[self.feature] <= self.threshold

    def column(self) -> Column:
        c = feature_columns()[self.feature]
        return c >= self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, rows: Rows) -> np.ndarray:
    mask = np.ones(len(rows["bad"]), bool)
    for c in rule:
        mask &= c.holds(rows)
    return mask


def only(rows: Rows, mask: np.ndarray) -> Rows:
    return {k: v[mask] for k, v in rows.items()}


def count(rule: Rule, rows: Rows) -> tuple[int, int]:
    """Bad and good rows that the rule covers."""
    bad = rows["bad"][covers(rule, rows)]
    return int(bad.sum()), int(len(bad) - bad.sum())


def candidates(rows: Rows, names: list[str]) -> list[Condition]:
    """Thresholds halfway between neighbouring quantiles."""
    out = []
    for name in names:
        values = np.sort(rows[name])
        marks = np.unique(values[np.minimum(len(values) - 1, len(values) * np.arange(CUTS + 1) // CUTS)]).tolist() if len(values) else []
        for a, b in zip(marks[:-1], marks[1:], strict=True):
            out += [Condition(name, True, (a + b) / 2), Condition(name, False, (a + b) / 2)]
    return out


def grow(rows: Rows, names: list[str]) -> Rule:
    rule: Rule = ()
    own = rows
    while len(rule) < CONDITIONS:
        n0, p0 = len(own["bad"]), int(own["bad"].sum())
        if not p0 or p0 == n0:
            break
        start, best, gain = math.log2(p0 / n0), None, 0.0
        # quantiles of the bad rows too: what is rare among all has marks there
        for c in candidates(own, names) + candidates(only(own, own["bad"] == 1), names):
            p, n = count((c,), own)
            if p and (g := p * (math.log2(p / (p + n)) - start)) > gain + 1e-9:
                best, gain = c, g
        if best is None:
            break
        rule = (*rule, best)
        own = only(own, best.holds(own))
    return rule


def prune(rule: Rule, rows: Rows) -> Rule:
    def worth(r: Rule) -> float:
        p, n = count(r, rows)
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def cover(rows: Rows, names: list[str]) -> list[Rule]:
    """An ordered list of rules that reject. rows: features, bad (0 or 1), fold (0 to 2; 0 prunes)."""
    rules: list[Rule] = []
    while len(rules) < RULES:
        rule = grow(only(rows, rows["fold"] > 0), names)
        if not rule:
            break
        held = only(rows, rows["fold"] == 0)
        rule = prune(rule, held)
        p, n = count(rule, held)
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(rule)
        rows = only(rows, ~covers(rule, rows))
    return rules


def learn(stats: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list[Rule]:
    names = list(feature_columns())
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.join(labels, "doc_id").withColumn("h", F.xxhash64(*stats.columns)).select((F.col("quality") == 0).cast("int").alias("bad"), F.pmod("h", F.lit(3)).alias("fold"), "h", *(c.alias(n) for n, c in feature_columns().items())).checkpoint()
    # a threshold on the hash takes about limit rows, the same ones however they are partitioned; equal rows count once
    least = min(1.0, limit / max(1, rows.count()))
    found = rows.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < least).distinct().toArrow().sort_by("h")
    return cover({k: found.column(k).to_numpy().astype(float) for k in ("bad", "fold", *names)}, names)


def rejecting(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row of statistics, from 1; 0 if none does."""
    found = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        found = F.when(test, k) if found is None else found.when(test, k)
    return F.lit(0) if found is None else found.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE) -> DataFrame:
    """Statistics and verdicts of docs (doc_id, text)."""
    shared.checkpoint_dir(docs.sparkSession)
    stats = statistics(docs).checkpoint()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ruled = stats.withColumn("base_failed", failed).withColumn("rule", rejecting(learn(stats, labels, limit)).cast("int"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
