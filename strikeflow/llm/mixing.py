"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a schedule of its weight over the run, straight between knots of time
(0 to 1) and weight. Its integral is the source's weight in the whole mix: sources share
a budget of SHARE times all words by these weights, a target stops at MOST times its
source's words, and what it can't take is shared again by the others. The targets are
min(MOST * words, level * weight) for the one level that uses up the budget, and the level
is found by a few sums over the sources.

Within a source, documents stand in the order of a hash. The words before a document,
plus the source's words for each earlier epoch, are its demand; the time at which the
integral of the schedule reaches this part of the target is when it is due. So a
piecewise quadratic is inverted, for each copy by itself, and the copies are sorted by the word of
the run at which they are due (range partitions, no task holds a source).

Words before a document come from sums at three levels of the hash (two of 10 bits, then
the rest), so that no window holds a source: 1,024 sums, 1,024 sums, and the rows of
a millionth of a source. Rows alike in source, hash and size are one row with a number until the last join.

Results: all rows of docs, with size, source_size, target, taken and copies added
(underscores behind where docs has such a column). Every document is taken as
often as the target holds its whole source, and once more while words are left; the
document at which they end gives its first words only, so a source's taken words are its
target, rounded. n rows that are alike in source, doc_id and text share that end evenly,
so up to n - 1 words stay away. A null text counts as empty; documents without words
are taken 0 words and have copies at the places where they are due only. A null source is a source of its own, the last. A null doc_id is like any other value.
Targets of sources without words are 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeflow.llm import shared

Schedule = Sequence[tuple[float, float]]
#: Knots (time, weight), repeated over the sources; their integrals are 3, 1 and 2.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)))
#: The budget over all words, and the most copies of a source.
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVEL = 60, 10


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pairwise(schedule))


def due(schedule: Schedule, area: Column) -> Column:
    """The time at which the schedule's integral reaches area."""
    begun, out = 0.0, F.lit(float(schedule[0][0]))
    for (t0, w0), (t1, w1) in pairwise(schedule):
        slope, q = (w1 - w0) / (t1 - t0), F.greatest(area - begun, F.lit(0.0))
        root = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * q, F.lit(0.0)))
        out = F.when(area >= begun, F.least(F.lit(t1), t0 + F.when(root > 0, 2 * q / root).otherwise(0.0))).otherwise(out)
        begun += (t1 - t0) * (w0 + w1) / 2
    return out


def by_schedule(schedules: Sequence[Schedule], rank: Column, value) -> Column:
    """value(schedule) of the schedule that a source of this rank has."""
    out = value(schedules[0])
    for k, schedule in enumerate(schedules[1:], 1):
        out = F.when(rank % len(schedules) == k, value(schedule)).otherwise(out)
    return out


def ranked(sources: DataFrame, key: list[str]) -> DataFrame:
    """sources with their rank (from 0) in the order of key, from range partitions and the numbers in those before."""
    dealt = sources.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("at", 33).alias("part")
    # a row for each partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = dealt.groupBy(part).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return dealt.withColumn("part", part).join(first, "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "before")


def targets(sources: DataFrame, schedules: Sequence[Schedule], share: float, most: float) -> tuple[DataFrame, float]:
    """sources (rank, source_size) with their targets, and the budget."""
    if share > most:
        raise ValueError("the budget is more than all sources may give")
    weighed = sources.withColumn("weight", by_schedule(schedules, F.col("rank"), lambda s: F.lit(float(integral(s))))).withColumn("cap", most * F.col("source_size").cast("double")).checkpoint()
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    budget, level, last = share * total, 0.0, -1.0
    while weight > 0 and level > last:
        last, level = level, max(level, (budget - capped) / weight) if last >= 0 else budget / weight
        full = level * F.col("weight") >= F.col("cap")
        capped, weight = weighed.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
    return weighed.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))), budget


def place(docs: DataFrame, *, schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, taken (words, repeats counted) and copies: the epoch, the words and the position of each copy, the word of the run at which it is due."""
    shared.checkpoint_dir(docs.sparkSession)
    names = {x: shared.free(docs.columns, x) for x in ("size", "source_size", "target", "taken", "copies")}
    source, text = F.col("source").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)), 1, BITS // 4), 16, 10).cast("long")
    keys = {"__none": source.isNull(), "__source": F.coalesce(source, F.lit("")), "__h": order, "__size": F.regexp_count(text, F.lit(WORD)).cast("long")}
    own = {k: shared.free(docs.columns, k) for k in keys}
    keyed = docs.withColumns({own[k]: c for k, c in keys.items()})
    src = ["__none", "__source"]
    units = shared.written(keyed.groupBy(*(F.col(own[k]).alias(k) for k in keys)).agg(F.count("*").alias("n")).withColumn("words", F.col("n") * F.col("__size")))
    hi, lo = F.shiftright("__h", BITS - LEVEL).alias("hi"), F.shiftright("__h", BITS - 2 * LEVEL).bitwiseAND((1 << LEVEL) - 1).alias("lo")
    before = lambda keys, order: F.coalesce(F.sum("words").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = units.groupBy(*src, hi, lo).agg(F.sum("words").alias("words")).checkpoint()
    coarse = fine.groupBy(*src, "hi").agg(F.sum("words").alias("words")).checkpoint()
    sources, budget = targets(ranked(coarse.groupBy(*src).agg(F.sum("words").alias("source_size")), src), schedules, share, most)
    # the words to take, as so many whole epochs and a rest
    take = F.round("target").cast("long")
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(take / F.col("source_size"))).otherwise(0)).withColumn("rest", take - F.col("epochs") * F.col("source_size"))
    coarse = coarse.select(*src, "hi", before(src, ["hi"]).alias("start")).join(sources, src)
    fine = fine.select(*src, "hi", "lo", before([*src, "hi"], ["lo"]).alias("within")).join(coarse, [*src, "hi"]).withColumn("start", F.col("start") + F.col("within")).drop("within").checkpoint()
    spread = units.withColumns({"hi": hi, "lo": lo}).join(fine, [*src, "hi", "lo"])
    placed = spread.withColumn("start", F.col("start") + before([*src, "hi", "lo"], ["__h", "__size"]))
    more = F.floor(F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0)), F.col("words")) / F.col("n"))
    placed = placed.withColumn("more", more).withColumn("n_copies", F.col("epochs") + F.when((F.col("more") > 0) | (F.col("__size") == 0) & (F.col("start") < F.col("rest")), 1).otherwise(0))
    # of the whole target, what is taken before copy k, and when that is reached
    part = lambda k: (k * F.col("source_size") + F.col("start")).cast("double") / F.col("target")
    when = lambda k: by_schedule(schedules, F.col("rank"), lambda s: due(s, float(integral(s)) * part(k)))
    copy = lambda k: F.struct(k.cast("int").alias("epoch"), F.when(k < F.col("epochs"), F.col("__size")).otherwise(F.col("more")).alias("words"), F.floor(when(k) * float(math.floor(budget + 0.5))).alias("position"))
    copies = F.when(F.col("n_copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1), copy)).otherwise(F.array())
    told = placed.select(*(F.col(k).alias(own[k]) for k in keys), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]), (F.col("epochs") * F.col("__size") + F.col("more")).alias(names["taken"]), copies.alias(names["copies"]))
    out = keyed.join(told.hint("merge"), list(own.values()))  # no size bound on either side
    return out.select(*docs.columns, F.col(own["__size"]).alias(names["size"]), *(names[x] for x in ("source_size", "target", "taken", "copies")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy of docs, with epoch, words and position added (of the last epoch's last document words may be fewer than it has), sorted by position."""
    copies = shared.free(docs.columns, "copies")
    placed = place(docs, **options).select(*docs.columns, F.explode(copies).alias(copies))
    names = {x: shared.free(docs.columns, x) for x in ("epoch", "words", "position")}
    return placed.select(*docs.columns, *(F.col(f"{copies}.{x}").alias(name) for x, name in names.items())).orderBy(names["position"], "doc_id")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    first = F.get("copies", F.lit(0))["position"]
    return placed.select("doc_id", "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("n_copies"), first.alias("first_position"), F.get("copies", F.size("copies") - 1)["position"].alias("last_position")).orderBy("first_position", "doc_id")


def _due_sql(schedule: Schedule, area: str) -> str:
    begun, out = 0.0, f"{schedule[0][0]}::DOUBLE"
    for (t0, w0), (t1, w1) in pairwise(schedule):
        slope, q = (w1 - w0) / (t1 - t0), f"greatest({area} - {begun!r}::DOUBLE, 0::DOUBLE)"
        root = f"({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {q}, 0::DOUBLE)))"
        out = f"CASE WHEN {area} >= {begun!r}::DOUBLE THEN least({t1!r}::DOUBLE, {t0!r}::DOUBLE + CASE WHEN {root} > 0 THEN 2 * {q} / {root} ELSE 0 END) ELSE {out} END"
        begun += (t1 - t0) * (w0 + w1) / 2
    return out


def _sql(schedules: Sequence[Schedule], share: float, most: float) -> str:
    """The query in DuckDB's SQL: one window for each source, and the level from sources sorted by where they are full."""
    weight = "CASE rank % {n} {whens} END".format(n=len(schedules), whens=" ".join(f"WHEN {k} THEN {integral(s)!r}::DOUBLE" for k, s in enumerate(schedules)))
    part = "({k} * source_size + start)::DOUBLE / target"
    when = lambda k: "floor(({cases}) * round({share!r}::DOUBLE * total))::BIGINT".format(share=share, cases="CASE rank % {n} {whens} END".format(n=len(schedules), whens=" ".join(f"WHEN {i} THEN {_due_sql(s, f'({integral(s)!r}::DOUBLE * ({part.format(k=k)}))')}" for i, s in enumerate(schedules))))
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, {BITS // 4}) AS BIGINT) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, CAST(sum(sum(size)) OVER () AS BIGINT) AS total FROM sized GROUP BY source),
weighed AS (SELECT *, {weight} AS weight, {float(most)!r}::DOUBLE * source_size AS cap FROM sources),
sorted AS (
  SELECT *, row_number() OVER o AS k, count(*) OVER () AS n_sources, sum(cap) OVER o AS caps, sum(weight) OVER () - sum(weight) OVER o AS free,
         lead(cap) OVER o AS next_cap, lead(weight) OVER o AS next_weight
  FROM weighed WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
levels AS (
  SELECT 0 AS k, {share!r}::DOUBLE * any_value(total) / sum(weight) AS level, arg_min(cap, cap / weight) AS next_cap, arg_min(weight, cap / weight) AS next_weight FROM weighed
  UNION ALL SELECT k, ({share!r}::DOUBLE * total - caps) / free, next_cap, next_weight FROM sorted WHERE k < n_sources),
level AS (SELECT max(level) AS level FROM (SELECT level FROM levels WHERE level * next_weight < next_cap ORDER BY k LIMIT 1)),
aimed AS (SELECT source, source_size, rank, total, least(cap, coalesce(level, 1e300) * weight) AS target FROM weighed, level),
taken AS (
  SELECT *, CAST(round(target) AS BIGINT) AS take, CASE WHEN source_size > 0 THEN CAST(floor(CAST(round(target) AS BIGINT) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM aimed),
units AS (SELECT source, h, size, count(*) AS n FROM sized GROUP BY source, h, size),
starts AS (SELECT *, CAST(coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM units),
placed AS (
  SELECT s.source, s.h, s.size, s.start, t.source_size, t.target, t.rank, t.total, t.epochs, t.take - t.epochs * t.source_size AS rest,
         CAST(floor(least(greatest(t.take - t.epochs * t.source_size - s.start, 0), s.n * s.size) / s.n) AS BIGINT) AS more
  FROM starts s JOIN taken t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, epochs + CASE WHEN more > 0 OR (size = 0 AND start < rest) THEN 1 ELSE 0 END AS n_copies FROM placed)
SELECT d.doc_id, d.size, c.source_size, c.target, c.epochs * c.size + c.more AS taken, CAST(c.n_copies AS BIGINT) AS n_copies,
       CASE WHEN n_copies > 0 THEN {when("0")} END AS first_position, CASE WHEN n_copies > 0 THEN {when("(n_copies - 1)")} END AS last_position
FROM sized d JOIN counted c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h AND d.size = c.size
"""


ORACLE = _sql(SCHEDULES, SHARE, MOST)
