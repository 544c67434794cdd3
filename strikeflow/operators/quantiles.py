"""Exact quantiles over all rows, by refining histograms.

Each pass counts the values of an interval in equal bins, with each bin's least and greatest value. The bin that holds
the sought rank is the next interval, from its least to its greatest value, until both are one. A bin's number never falls as the value
rises, whatever rounding does to it, so the selection is exact. Bins are equal in the logarithm as long as an interval spans
magnitudes, so three or four passes do. What leaves the tasks is counts: a few thousand rows a pass, however many
rows or distinct values there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strikeflow.session import checkpoint_dir

#: Bins of all intervals of a pass together, the fewest of one interval, and the most groups.
BINS, LEAST, MOST_GROUPS = 1 << 14, 16, 1 << 10
#: Added to logarithms of magnitudes, all of which are over -745.
LOGS = 750.0


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    """The ranks (from 0) that a quantile of n values lies between, and how far from the first."""
    at = p * (n - 1)
    return math.floor(at), math.ceil(at), at - math.floor(at)


def _between(low: float, high: float, part: float) -> float:
    return low if part == 0 or low == high else (1 - part) * low + part * high


def quantiles(rows: DataFrame, value: Column, probabilities: Sequence[float], by: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """One row for each value of by (one row without it): its number of values that aren't null (n), and the quantile of each of probabilities, linear between ranks. NaN is greater than all other values, as Spark orders it.

    A group without a value has nulls; without by there is a row even for an empty table. At most MOST_GROUPS groups. rows is read once and its values
    are kept in the checkpoint folder; this runs jobs at once.
    """
    if not probabilities or not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie in [0, 1]")
    names = list(names or (f"q{p:g}" for p in probabilities))
    spark = rows.sparkSession
    checkpoint_dir(spark)
    key = F.col(by) if by else F.lit(None).cast("string")
    values = rows.select(key.alias("g"), value.cast("double").alias("v")).checkpoint()
    v, finite = F.col("v"), ~F.isnan("v") & (F.abs("v") != math.inf)
    of = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    first = values.groupBy("g").agg(F.count("v").alias("n"), of(v == -math.inf).alias("below"), of(finite).alias("finite"), of(v == math.inf).alias("above"), F.min(F.when(finite, v)).alias("low"), F.max(F.when(finite, v)).alias("high"))
    groups = first.limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    # for each group and rank: the interval that holds it, and the finite values below that
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[float, float, int]] = {}
    for i, r in enumerate(groups):
        for p in probabilities:
            for rank in _ranks(r["n"], p)[:2] if r["n"] else ():
                at = rank - r["below"]
                if at < 0 or at >= r["finite"]:
                    found[i, rank] = -math.inf if at < 0 else math.inf if at < r["finite"] + r["above"] else math.nan
                else:
                    open_[i, rank] = (r["low"], r["high"], 0)
    while True:
        for k in [k for k, (low, high, _) in open_.items() if low == high]:
            found[k] = open_.pop(k)[0]
        if not open_:
            break
        spans = sorted({(i, low, high) for (i, _), (low, high, _) in open_.items()})
        bins = max(LEAST, BINS // len(spans))
        # a row for each open interval
        table = spark.createDataFrame([(s, groups[i]["g"], low, high) for s, (i, low, high) in enumerate(spans)], StructType([StructField("s", LongType()), StructField("h", values.schema["g"].dataType), StructField("low", DoubleType()), StructField("high", DoubleType())]))
        # logarithms (which never fall either) where an interval spans magnitudes; else the numbers, or halves of large ones, so that no width is infinite or 0
        far = (F.col("low") * F.signum("high") < 0) | (F.least(F.abs("low"), F.abs("high")) * 16 < F.greatest(F.abs("low"), F.abs("high")))
        scale = F.when(F.greatest(F.abs("low"), F.abs("high")) > 1e300, 0.5).otherwise(1.0)
        place_of = lambda c: F.when(far, F.when(c == 0, 0.0).otherwise(F.signum(c) * (F.log(F.abs(c)) + LOGS))).otherwise(c * scale)  # noqa: B023, E731
        part = (place_of(v) - place_of(F.col("low"))) / (place_of(F.col("high")) - place_of(F.col("low")))
        bin_ = F.least(F.floor(part * bins), F.lit(bins - 1))
        told = values.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("low"), F.col("high")))
        counts: dict[int, list] = {}
        for r in told.groupBy("s", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("s", "bin").collect():
            counts.setdefault(r["s"], []).append(r)
        place = {span: s for s, span in enumerate(spans)}
        for (i, rank), (low, high, below) in list(open_.items()):
            at = rank - groups[i]["below"] - below
            for r in counts[place[i, low, high]]:
                if at < r["n"]:
                    open_[i, rank] = (r["low"], r["high"], below)
                    break
                at, below = at - r["n"], below + r["n"]
    out = []
    for i, r in enumerate(groups):
        own = []
        for p in probabilities:
            a, b, part = _ranks(r["n"], p)
            own.append(_between(found[i, a], found[i, b], part) if r["n"] else None)
        out.append((*([r["g"]] if by else []), r["n"], *own))
    fields = [*([StructField(by, rows.schema[by].dataType)] if by else []), StructField("n", LongType()), *(StructField(n, DoubleType()) for n in names)]
    return spark.createDataFrame(out if by or out else [(0, *[None] * len(names))], StructType(fields))
