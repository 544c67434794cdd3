"""Whether a strategy can be run on a chain at all: expiries at hand, premium ratios, and the decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.operators import chain as ops
from strikeflow.operators.quantiles import quantiles
from strikeflow.session import checkpoint_dir


def expiries_per_day(chain: DataFrame, low: int = 21, high: int = 63) -> DataFrame:
    """One row: distinct expiries per date within a range of days to expiry, their distribution and the shares of dates with 2, 3, 4 and 5 or more."""
    n = ops.filter_by_dte(chain, low, high).groupBy("date").agg(F.countDistinct("expiry").alias("n"))
    share = lambda k: F.avg((F.col("n") >= k).cast("double")).alias(f"share_{k}")
    checkpoint_dir(chain.sparkSession)
    n = n.checkpoint()
    found = quantiles(n, F.col("n"), [0.5, 0.1, 0.9], names=["median_n", "p10", "p90"]).drop("n")
    out = n.agg(F.avg("n").alias("mean_n"), F.max("n").alias("max_n"), *(share(k) for k in (2, 3, 4, 5))).crossJoin(F.broadcast(found))  # one row each
    return out.select("mean_n", "median_n", "p10", "p90", "max_n", *(f"share_{k}" for k in (2, 3, 4, 5)))


def sample_dates(dates: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n of the dates, those with the smallest hashes: a choice without replacement that the order of rows doesn't change."""
    if n < 1:
        raise ValueError("one date at least")
    return dates.select("date").distinct().orderBy(F.xxhash64("date", F.lit(seed)), "date").limit(n)


def premium_ratios(chain: DataFrame, low: int = 25, high: int = 35, back: tuple[int, int] = (55, 65)) -> DataFrame:
    """(date, credit, straddle_ratio, calendar_ratio): what a straddle and a calendar at the money cost, in terms of a condor's credit, in the first expiry of the range.

    Missing settlements count as 0. A date without the legs, or whose condor has no positive credit, has no row; without a back expiry or a positive premium its ratio is null.
    """
    front = ops.filter_by_dte(chain, low, high).where("option_type IN ('call', 'put')")
    first = front.groupBy("date").agg(F.min("expiry").alias("expiry"))
    front = front.join(first, ["date", "expiry"])
    own = ops.legs(front, {"sp": (-0.16, "put"), "wp": (-0.08, "put"), "sc": (0.16, "call"), "wc": (0.08, "call")}, tolerance=None)
    settle = lambda n: F.coalesce(F.col(f"{n}.settle"), F.lit(0.0))
    credit = own.select("date", (settle("sp") - settle("wp") + settle("sc") - settle("wc")).alias("credit"), F.col("sc.expiry").alias("expiry")).where("credit > 0")
    away = F.struct(F.abs(F.col("strike") - F.col("underlying")), "strike")
    atm = front.groupBy("date").agg(F.min_by("strike", away).alias("strike"))
    at = lambda df, name: df.groupBy("date", "strike", "option_type").agg(F.min(F.struct(F.col("settle").isNull(), F.coalesce("settle", F.lit(0.0)).alias("s")))["s"].alias(name))
    near = at(front, "s").join(atm, ["date", "strike"]).groupBy("date").agg(F.max(F.when(F.col("option_type") == "call", F.col("s"))).alias("call"), F.max(F.when(F.col("option_type") == "put", F.col("s"))).alias("put")).where("call IS NOT NULL AND put IS NOT NULL")
    later = chain.where(F.col("dte").between(*back) & (F.col("option_type") == "call"))
    later = later.join(later.groupBy("date").agg(F.min("expiry").alias("expiry")), ["date", "expiry"])
    back_call = at(later, "back").join(atm, ["date", "strike"]).select("date", "back")
    both = credit.join(near, "date").join(back_call, "date", "left")
    ratio = lambda premium: F.when(premium > 0, premium / F.col("credit"))
    return both.select("date", "credit", ratio(F.col("call") + F.col("put")).alias("straddle_ratio"), ratio(F.col("back") - F.col("call")).alias("calendar_ratio"))


def ratio_distribution(ratios: DataFrame) -> DataFrame:
    """(mode, n, median, mean, p10, p90) of the ratios of calendars and straddles."""
    long = ratios.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"{m}_ratio").alias("ratio")) for m in ("calendar", "straddle")))).alias("r")).select("r.*")
    checkpoint_dir(ratios.sparkSession)
    long = long.checkpoint()
    found = quantiles(long, F.col("ratio"), [0.5, 0.1, 0.9], "mode", ["median", "p10", "p90"])
    return found.join(long.groupBy("mode").agg(F.avg("ratio").alias("mean")), "mode").select("mode", "n", "median", "mean", "p10", "p90")


def decision(expiries: DataFrame, ratios: DataFrame, coverage: DataFrame) -> DataFrame:
    """(verdict, reason) from the rows of expiries_per_day, ratio_distribution and monitor.coverage, by the first rule that holds."""
    pick = lambda m: F.max(F.when(F.col("mode") == m, F.col("median"))).alias(m)
    one = expiries.select("mean_n", "p10").crossJoin(ratios.agg(pick("calendar"), pick("straddle"))).crossJoin(coverage.select("coverage"))  # one row each
    mean, p10 = F.col("mean_n"), F.col("p10")
    dear = (F.col("calendar") > 5.0) & (F.col("straddle") > 5.0)
    cheap = reduce(lambda a, b: a | b, (F.coalesce(F.col(m) < 2.0, F.lit(False)) for m in ("calendar", "straddle")))
    rules = [
        (mean < 1.0, "no_go", "too few expiries a day"),
        (F.col("coverage") < 0.95, "no_go", "the surface covers too little"),
        (F.coalesce(dear, F.lit(False)), "no_go", "both hedges cost over five times the credit"),
        ((mean >= 4.0) & (p10 >= 3.0) & cheap, "go_5", "expiries for five cohorts, a hedge under twice the credit"),
        ((mean >= 4.0) & (p10 >= 3.0), "go_5_dear", "expiries for five cohorts, no hedge under twice the credit"),
        ((mean >= 3.0) & (p10 >= 2.0), "go_3", "expiries for three cohorts"),
        (mean >= 1.0, "go_1", "expiries for one cohort"),
    ]
    verdict, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, v, r in rules[1:]:
        verdict, reason = verdict.when(test, v), reason.when(test, r)
    return one.select(verdict.otherwise("undecided").alias("verdict"), reason.otherwise("review by hand").alias("reason"))


def stress_entries(chain: DataFrame, low: int = 21, high: int = 45) -> DataFrame:
    """The condor that each date would open for a stress run: nearest deltas without a tolerance, anywhere in the range of days to expiry."""
    out = ops.legs(ops.filter_by_dte(chain, low, high), {"short_call": (0.16, "call"), "long_call": (0.08, "call"), "short_put": (-0.16, "put"), "long_put": (-0.08, "put")}, tolerance=None)
    out = out.withColumns(ops.credits(["short_call", "short_put"], ["long_call", "long_put"]))
    wing = lambda a, b: F.col(f"{a}.strike") - F.col(f"{b}.strike")
    out = out.withColumns({"call_wing": wing("long_call", "short_call"), "put_wing": wing("short_put", "long_put")})
    return out.withColumn("max_defined_risk", (F.greatest("call_wing", "put_wing") - F.col("worst_credit")) * 50)
