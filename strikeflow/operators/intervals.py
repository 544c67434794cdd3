"""Joins of points with the intervals that hold them, as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


def _bin(df: DataFrame, name: str, width: float) -> Column:
    value = F.unix_date(name) if isinstance(df.schema[name].dataType, DateType) else F.col(name)
    return F.floor(value / width).cast("long")


def bin_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """All pairs of a point and an interval (both ends included) that holds it; columns of both sides.

    An interval has a row for each bin of width (days, for dates) that it covers, and a point one in its own bin, so each pair meets
    once, whatever the intervals overlap; the exact test follows. A null point or end joins nothing, nor does an interval whose end comes before its start.
    """
    if width <= 0:
        raise ValueError("bins need a width")
    clash = {*points.columns} & {*intervals.columns}
    if clash or "__bin" in {*points.columns, *intervals.columns}:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    low, high = _bin(intervals, start, width), _bin(intervals, end, width)
    covered = intervals.where(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(F.sequence(low, high)))
    return points.withColumn("__bin", _bin(points, at, width)).join(covered, "__bin").where(F.col(at).between(F.col(start), F.col(end))).drop("__bin")
