"""Dates, contract names and small conversions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])")


def third_wednesday(first_of_month: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(first_of_month, 1), "WED"), 14)


def monthly_calendar(span: DataFrame, first: str, last: str) -> DataFrame:
    """(month, expiry): the third Wednesday of each month from that of one date of span to that of the other; a null date gives none."""
    months = span.select(F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.select("month", third_wednesday(F.col("month")).alias("expiry"))


def rolled(df: DataFrame, day: str, holidays: DataFrame, name: str = "expiry") -> DataFrame:
    """Moves day on to the next one that is neither a weekend nor in holidays (date); a null day stays null. Only days off are looked up."""
    off = holidays.select(F.col("date").alias("try")).where("try is not null").distinct()
    weekday = F.dayofweek("try").between(2, 6)
    days = df.select(day).where(F.col(day).isNotNull()).distinct()
    closed = off.where(weekday).unionByName(days.select(F.col(day).alias("try")).where(~weekday)).distinct().join(days, F.col("try") == F.col(day)).select(day)
    # of any run of days off, two in seven and two more at most are weekends
    longest = off.count() * 7 // 5 + 4
    tries = closed.withColumn("try", F.explode(F.sequence(F.col(day), F.date_add(F.col(day), longest))))
    free = tries.where(weekday).join(off, "try", "left_anti").groupBy(day).agg(F.min("try").alias("__free"))
    return df.join(free, day, "left").withColumn(name, F.coalesce("__free", F.col(day))).drop("__free")


def contract_id(expiry: str = "expiry", option_type: str = "option_type", strike: str = "strike", root: str = "TXO") -> Column:
    return F.concat(F.lit(root), F.date_format(expiry, "yyyyMMdd"), F.when(F.col(option_type) == "call", "C").otherwise("P"), F.col(strike).cast("long").cast("string"))


def parse_contract(name: str = "contract", root: str = "TXO") -> dict[str, Column]:
    """expiry, option_type and strike; all null unless the whole name is well formed."""
    own = f"^{root}([0-9]{{8}})([CP])([0-9]+)$"
    ok = (F.length(name) >= 13) & F.col(name).rlike(own)
    expiry = F.try_to_timestamp(F.regexp_extract(name, own, 1), F.lit("yyyyMMdd")).cast("date")
    ok = ok & expiry.isNotNull()
    return {
        "expiry": F.when(ok, expiry),
        "option_type": F.when(ok, F.when(F.regexp_extract(name, own, 2) == "C", "call").otherwise("put")),
        "strike": F.when(ok, F.regexp_extract(name, own, 3).try_cast("double")),
    }


def compact_date(number: Column) -> Column:
    """A number like 20240117.0 as a date; null if it isn't one."""
    return F.try_to_timestamp(number.try_cast("long").cast("string"), F.lit("yyyyMMdd")).cast("date")


def is_iso_date(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def to_grid(value: Column, step: int) -> Column:
    """Nearest multiple of step, halves to even."""
    return F.bround(value / step) * step
