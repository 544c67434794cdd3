"""Lint of text lines: which lines of a table's texts a set of rules finds, by category.

A rule is a regular expression for lines, with what exempts a line, the rows that it holds for, and what else their
texts must or must not hold. All of it stays in generated code: a text's lines are exploded once for all rules, one
alternation of the rules' patterns marks lines, and only marked lines meet the rules one by one. Nothing is shuffled;
texts that no rule holds for aren't split.

Results: lines end at line feeds and are numbered from 1; a carriage return before the feed is no part of a line. A null
text has no lines, an empty one has one empty line. A condition that is null doesn't hold. A line that several rules find
gives a row for each, rules of one category give one. Equal rows of the table give their rows each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """category: of the lines that match `pattern` and not `unless`, in rows for which `where` (SQL) is true and whose whole text matches each of `text_has` and not `text_lacks`. A warning doesn't fail a table."""

    category: str
    pattern: str
    unless: str | None = None
    where: str = "true"
    text_has: Sequence[str] = ()
    text_lacks: str | None = None
    warning: bool = False


def live(rule: Rule, text: Column) -> Column:
    """Whether a rule holds for a row."""
    out = F.expr(rule.where)
    for pattern in rule.text_has:
        out = out & text.rlike(pattern)
    if rule.text_lacks:
        out = out & ~text.rlike(rule.text_lacks)
    return F.coalesce(out, F.lit(False))


def lint(docs: DataFrame, rules: Sequence[Rule], *keys: str, text: str = "text") -> DataFrame:
    """(*keys, line_no, category, warning, line): the lines of docs that rules find."""
    if not rules:
        raise ValueError("no rules")
    lower = {k.lower() for k in keys}
    if clash := lower & {"line_no", "category", "warning", "line"}:
        raise ValueError(f"keys named as results: {sorted(clash)}")
    body = F.col(text).cast("string")
    own = docs.select(*(F.col(k) for k in keys), body.alias("__text"), F.array(*(live(r, body) for r in rules)).alias("__live"))
    own = own.where(F.exists("__live", lambda x: x))
    lines = own.select(*keys, "__live", F.posexplode(F.split("__text", "\n")).alias("__pos", "__line"))
    line = F.regexp_replace("__line", "\r$", "")
    lines = lines.select(*keys, "__live", (F.col("__pos") + 1).alias("line_no"), line.alias("line")).where(F.col("line").rlike("|".join(f"(?:{r.pattern})" for r in rules)))

    def told(i: int, rule: Rule) -> Column:
        found = F.col("__live")[i] & F.col("line").rlike(rule.pattern)
        if rule.unless:
            found = found & ~F.col("line").rlike(rule.unless)
        return F.when(found, F.struct(F.lit(rule.category).alias("category"), F.lit(rule.warning).alias("warning")))

    hits = F.array_distinct(F.array_compact(F.array(*(told(i, r) for i, r in enumerate(rules)))))
    return lines.select(*keys, "line_no", "line", F.explode(hits).alias("__hit")).select(*keys, "line_no", "__hit.category", "__hit.warning", "line")


def totals(hits: DataFrame, *keys: str) -> DataFrame:
    """(category, warning, n_lines, n_texts): what lint() found, counted; keys: what names a text."""
    return hits.groupBy("category", "warning", *keys).agg(F.count("*").alias("n")).groupBy("category", "warning").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_texts"))


def passes(hits: DataFrame) -> bool:
    """Whether lint() found nothing but warnings."""
    return hits.where(~F.col("warning")).isEmpty()
