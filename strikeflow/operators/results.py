"""Tables over the results of runs and over fit records: breakdowns, comparisons and exit criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.operators.quantiles import quantiles

KEY = ("date", "expiry", "strike", "option_type")
#: Parts of a group that are ranked apart.
SLICES = 64


def model_breakdown(records: DataFrame) -> DataFrame:
    """For each model of fit records: how many there are and converged, the share, and the median error."""
    medians = quantiles(records, F.col("in_sample_rmse"), [0.5], "model_type", ["median_rmse"]).select(F.col("model_type").alias("of"), "median_rmse")
    counts = records.groupBy("model_type").agg(F.count("*").alias("n"), F.count_if("converged").alias("n_converged"), F.avg(F.col("converged").cast("double")).alias("rate"))
    return counts.join(F.broadcast(medians), F.col("model_type").eqNullSafe(F.col("of"))).select("model_type", "n", "n_converged", "median_rmse", "rate")


def converged_error(records: DataFrame) -> DataFrame:
    """One row: the median error of converged records."""
    median = quantiles(records.where("converged"), F.col("in_sample_rmse"), [0.5], names=["median_rmse"]).drop("n")
    return records.where("converged").agg(F.count("*").alias("n")).crossJoin(F.broadcast(median)).select("median_rmse", "n")  # one row each


def fill_rates(chain: DataFrame) -> DataFrame:
    """One row: the shares of rows with both quotes, a volatility and a model price, and of those without both quotes the share that a model price fills (null if all have them)."""
    lacks = F.col("bid").isNull() | F.col("ask").isNull()
    share = lambda c: F.avg(c.cast("double"))
    return chain.agg(share(~lacks).alias("quoted"), share(F.col("iv").isNotNull()).alias("with_iv"), share(F.col("model_price").isNotNull()).alias("with_model"), F.try_divide(F.count_if(lacks & F.col("model_price").isNotNull()), F.count_if(lacks)).alias("filled"))


def force_missing(chain: DataFrame, share: float = 0.30, seed: int = 42) -> DataFrame:
    """Takes both quotes from about this share of the rows that have both, by a hash of the row's key (its strike in hundredths); can_buy and can_sell are set anew."""
    from strikeflow.operators.chain import flags

    if not 0 <= share <= 1:
        raise ValueError(f"not a share: {share}")
    gone = F.col("bid").isNotNull() & F.col("ask").isNotNull() & (F.conv(F.substring(F.md5(F.concat_ws("|", "date", "expiry", F.round(F.col("strike") * 100).cast("long"), "option_type", F.lit(seed))), 1, 8), 16, 10).cast("long") / float(1 << 32) < share)
    return flags(chain.withColumns({c: F.when(~gone, F.col(c)) for c in ("bid", "ask")}))


def scenario_totals(result: DataFrame) -> DataFrame:
    """For each scenario of a run: trades, folds and failed folds."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return result.groupBy("scenario").agg(kind("trade").alias("n_trades"), F.countDistinct("fold_index").alias("n_folds"), F.countDistinct(F.when(F.col("kind") == "error", F.col("fold_index"))).alias("n_failed"))


def rejected(*results: DataFrame) -> DataFrame:
    """(scenario, path, reason, n) of the rejects of runs."""
    own = [r.where("kind = 'reject'").select("scenario", "path", "reason") for r in results]
    out = own[0]
    for r in own[1:]:
        out = out.unionByName(r)
    return out.groupBy("scenario", "path", "reason").agg(F.count("*").alias("n"))


def first_of(rows: DataFrame, by: list[str], order: Column, k: int, name: str) -> DataFrame:
    """(by, name): for each group the k smallest values of order as a sorted array.

    Lists are merged and cut at k in two steps: within slices of a group by a hash, each of which ranks its own rows and keeps k, and then over
    what the slices kept, SLICES times k rows at most. So no task holds a group's rows, and a row beyond the k first of its slice goes no further.
    """
    slice_ = F.pmod(F.xxhash64(order), F.lit(SLICES)).alias("slice")
    own = rows.select(*by, slice_, order.alias("o"))
    w = Window.partitionBy(*by, "slice").orderBy("o")
    kept = own.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k)
    return kept.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("o")), 1, k).alias(name))


def hedge_failures(result: DataFrame, sample: int = 5) -> DataFrame:
    """For each scenario how many positions opened without their hedge, and the reasons of the first ones. Scenarios without one are listed with 0."""
    hit = (F.col("kind") == "reject") & (F.col("path") == "hedge_attach")
    first = first_of(result.where(hit), ["scenario"], F.struct("date", "fold_index", "reason"), sample, "first")
    reasons = F.transform(F.coalesce("first", F.array().cast(first.schema["first"].dataType)), lambda r: r["reason"])
    return result.groupBy("scenario").agg(F.count_if(hit).alias("n_failed")).join(first, "scenario", "left").select("scenario", "n_failed", reasons.alias("reasons"))


def cost_comparison(free: DataFrame, paid: DataFrame, columns: tuple[str, ...] = ("sharpe", "max_drawdown", "calmar", "n_trades")) -> DataFrame:
    """Summaries of one set of scenarios without and with cost, and their differences."""
    side = lambda df, n: df.select("scenario", *(F.col(c).alias(f"{c}_{n}") for c in columns))
    both = side(free, "free").join(side(paid, "paid"), "scenario")
    return both.withColumns({f"{c}_diff": F.col(f"{c}_paid") - F.col(f"{c}_free") for c in columns})


def relative_gap(a: Column, b: Column) -> Column:
    """How far two ratios are apart, in terms of the larger one; null if both are 0."""
    return F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b)))


def sharpe_gap(summary: DataFrame, one: str, other: str, most: float = 0.30) -> DataFrame:
    """One row: the relative gap between two scenarios' Sharpe ratios, and whether it is under most."""
    pick = lambda n: F.max(F.when(F.col("scenario") == n, F.col("sharpe")))
    return summary.agg(pick(one).alias("one"), pick(other).alias("other")).withColumn("gap", relative_gap(F.col("one"), F.col("other"))).withColumn("passed", F.col("gap") < most)


def scorecard(summary: DataFrame, intervals: DataFrame) -> DataFrame:
    """The four exit criteria of each scenario, from its summary and the bootstrap interval (scenario, ci_low) of its Sharpe ratio; what is unknown doesn't pass."""
    own = summary.join(intervals.select("scenario", "ci_low"), "scenario", "left")
    tests = {"sharpe_ok": F.col("sharpe") >= 1.0, "interval_ok": F.col("ci_low") > 0, "drawdown_ok": F.abs("max_drawdown") < 0.20, "calmar_ok": F.col("calmar") > 0.5}
    own = own.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in tests.items()})
    return own.select("scenario", *tests, sum((F.col(n).cast("int") for n in tests), F.lit(0)).alias("n_passed"))


def evidence(summary: DataFrame, least_trades: int = 30) -> DataFrame:
    """(scenario, n_trades, note): whether a scenario has trades enough to judge it by."""
    n = F.col("n_trades")
    return summary.select("scenario", "n_trades", F.when(n == 0, "no trades").when(n < least_trades, F.format_string("%d trades, under %d", n, F.lit(least_trades))).otherwise("enough").alias("note"))
