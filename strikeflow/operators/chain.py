"""Filters, joins, selection and derived columns of option chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.constants import DELTA_TOLERANCE, DIVIDEND, DTE_BAND, Q_CAP, RISK_FREE
from strikeflow.functions import expressions as x


def filter_by_dte(chain: DataFrame, low: int, high: int) -> DataFrame:
    if low < 0 or high < 0:
        raise ValueError(f"bounds must be at least 0, got [{low}, {high}]")
    if low > high:
        raise ValueError(f"lower bound {low} above upper bound {high}")
    if "dte" not in chain.columns:
        raise KeyError("the chain has no dte")
    return chain.where(F.col("dte").between(low, high))


def add_dte(df: DataFrame, strict: bool = True) -> DataFrame:
    """Whole days to expiry; strict: a negative one fails the query."""
    dte = F.datediff("expiry", "date")
    if strict:
        dte = F.when(dte >= 0, dte).otherwise(F.raise_error(F.concat(F.lit("expiry before date: "), F.col("date").cast("string"))).cast("int"))
    return df.withColumn("dte", dte)


def drop_expired(df: DataFrame) -> DataFrame:
    return df.where(F.col("expiry") >= F.col("date"))


def date_window(df: DataFrame, start, end) -> DataFrame:
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def usable_iv(df: DataFrame) -> DataFrame:
    iv = F.col("iv")
    return df.where(iv.isNotNull() & ~F.isnan(iv) & (iv > 0) & (iv < float("inf")))


def flags(df: DataFrame) -> DataFrame:
    """A quote of zero counts as a quote."""
    return df.withColumns({"can_buy": F.col("ask").isNotNull(), "can_sell": F.col("bid").isNotNull()})


def iv_price(df: DataFrame) -> DataFrame:
    """Mid if both sides are there and it is positive, settle only if a side is missing."""
    both = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    mid = (F.col("bid") + F.col("ask")) / 2
    settled = ~both & (F.col("settle") > 0)
    source = F.when(both & (mid > 0), "mid").when(settled, "settle").otherwise("no_price")
    return df.withColumns({"iv_price": F.when(both & (mid > 0), mid).when(settled, F.col("settle")), "iv_price_source": source})


def parity_price() -> Column:
    return F.coalesce((F.col("bid") + F.col("ask")) / 2, F.col("close"))


def finite(c: str) -> Column:
    v = F.col(c)
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def mark(df: DataFrame, mode: str = "strict", on_missing: str = "null") -> DataFrame:
    """mark and its basis. Modes: strict (mid only), settle, surface (model price, then settle)."""
    mid = (finite("bid") + finite("ask")) / 2
    settle = finite("settle")
    price, basis = F.when(mid.isNotNull(), mid), F.when(mid.isNotNull(), F.lit("mid"))
    if mode == "settle":
        price, basis = price.when(settle.isNotNull(), settle), basis.when(settle.isNotNull(), F.lit("settle_fallback"))
    elif mode == "surface":
        model = finite("model_price")
        price = price.when(model.isNotNull(), model).when(settle.isNotNull(), settle)
        basis = basis.when(model.isNotNull(), F.lit("surface_fallback")).when(settle.isNotNull(), F.lit("settle_3rd_fallback"))
    elif mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    if on_missing == "raise":
        price = price.otherwise(F.raise_error(F.concat(F.lit("unmarkable row on "), F.col("date").cast("string"))).cast("double"))
    return df.withColumns({"mark": price, "basis": basis})


# joins


def add_underlying(chain: DataFrame, spot: DataFrame, missing: str = "raise") -> DataFrame:
    """Left join with spot (date, underlying). missing: raise, skip (drop the rows), forward_fill (last earlier spot).

    Spot has a row for each trading date. It is joined as it is; Spark
    broadcasts it where its measured size allows.
    """
    chain = chain.drop("underlying")
    if missing == "skip":
        return chain.join(spot, "date")
    if missing == "forward_fill":
        return asof_backward(chain, spot, "underlying", required=True)
    if missing != "raise":
        raise ValueError(f"unknown policy {missing!r}")
    failed = F.raise_error(F.concat(F.lit("no spot on "), F.col("date").cast("string"))).cast("double")
    return chain.join(spot, "date", "left").withColumn("underlying", F.coalesce("underlying", failed))


def missing_dates(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """(date, n): what skip drops."""
    return chain.join(spot, "date", "left_anti").groupBy("date").agg(F.count("*").alias("n"))


def asof_backward(left: DataFrame, right: DataFrame, value: str, on: str = "date", required: bool = False) -> DataFrame:
    """The last value of right at or before each date of left. Only distinct dates pass the window; rows join back by date."""
    days = left.select(on).distinct().join(right.select(on, value), on, "full_outer")
    # a month's last value starts the next one, so that no window holds all dates
    days = days.withColumn("__m", F.trunc(on, "month"))
    ends = days.groupBy("__m").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(on))).alias("__last"))
    before = ends.select("__m", F.last("__last", True).over(Window.orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    own = Window.partitionBy("__m").orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    filled = days.join(before, "__m").select(on, F.coalesce(F.last(value, True).over(own), F.col("__before")).alias(value))
    out = left.drop(value).join(filled, on, "left")
    if required:
        out = out.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit("nothing before "), F.col(on).cast("string"))).cast("double")))
    return out


def call_put_pairs(chain: DataFrame) -> DataFrame:
    """One row for each date, expiry and strike that has both types, with their parity prices."""
    price = parity_price()
    own = lambda kind: F.max(F.when(F.col("option_type") == kind, price))
    has = lambda kind: F.max((F.col("option_type") == kind).cast("int"))
    return chain.groupBy("date", "expiry", "strike").agg(F.first("underlying").alias("underlying"), own("call").alias("call"), own("put").alias("put"), (has("call") + has("put")).alias("sides")).where("sides = 2").drop("sides")


def atm_pair(chain: DataFrame) -> DataFrame:
    """For each date the shared strike nearest the underlying, in the first expiry that has shared strikes."""
    order = F.struct("expiry", F.abs(F.col("strike") - F.col("underlying")), "strike")
    pick = F.min_by(F.struct("expiry", "strike", "underlying", "call", "put"), order)
    return call_put_pairs(chain).groupBy("date").agg(pick.alias("p")).select("date", "p.*")


def implied_yield(chain: DataFrame, r: float = RISK_FREE, on_fail: str = "null") -> DataFrame:
    """(date, q_pit, q_pit_source, q_pit_audit_flags): the dividend yield that put-call parity implies at the money.

    Negative yields and ones over the cap are kept and flagged.
    """
    pairs = chain.select("date").distinct().join(atm_pair(chain), "date", "left").withColumn("t", F.datediff("expiry", "date") / 365)
    inner = (F.col("call") - F.col("put") + F.col("strike") * F.exp(-r * F.col("t"))) / F.col("underlying")
    q = F.when((F.col("t") > 0) & (inner > 0), -F.log(inner) / F.col("t"))
    flag = F.when(F.col("strike").isNull(), "no_atm_pair").when(F.col("call").isNull() | F.col("put").isNull(), "missing_quote").when(F.col("q").isNull(), "pcp_invalid").when(F.col("q") < 0, "negative_q").when(F.col("q") > Q_CAP, "out_of_range").otherwise("ok")
    bad = F.lit(DIVIDEND) if on_fail == "fallback" else F.lit(None).cast("double")
    source = F.when(F.col("q").isNotNull(), "pcp").otherwise("fallback" if on_fail == "fallback" else "solve_failed")
    return pairs.withColumn("q", q).select("date", F.coalesce("q", bad).alias("q_pit"), source.alias("q_pit_source"), flag.alias("q_pit_audit_flags"))


def lookup(left: DataFrame, chain: DataFrame, columns: list[str]) -> DataFrame:
    """Left join with the first chain row of each (date, expiry, strike, option_type)."""
    key = ["date", "expiry", "strike", "option_type"]
    return left.join(first_per_key(chain, key).select(*key, *columns), key, "left")


def first_per_key(df: DataFrame, key: list[str], strict: bool = False) -> DataFrame:
    """One row for each key, the least of the other columns; strict: a second one fails the query."""
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r"), F.count("*").alias("__n"))
    if strict:
        out = out.withColumn("__n", F.when(F.col("__n") == 1, 1).otherwise(F.raise_error(F.lit("repeated key")).cast("int")))
        out = out.where("__n = 1")
    return out.select(*key, "__r.*").select(*df.columns)


# selection


def check_target(target: float, option_type: str, tolerance: float | None) -> None:
    if option_type not in ("call", "put"):
        raise ValueError(f"unknown option type {option_type!r}")
    if (target < 0) if option_type == "call" else (target > 0):
        raise ValueError(f"the sign of {target} doesn't fit a {option_type}")
    if tolerance is not None and tolerance < 0:
        raise ValueError(f"negative tolerance {tolerance}")


def select_by_delta(chain: DataFrame, target: float, option_type: str, tolerance: float | None = None, veto_null: bool = True, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """For each date the row of this type with the nearest delta; ties go to the first expiry, then strike.

    veto_null: a date with a null delta among the candidates has no row. One
    aggregation, without sorting.
    """
    check_target(target, option_type, tolerance)
    own = chain.where(F.col("option_type") == option_type)
    rest = [c for c in chain.columns if c not in by]
    away = F.abs(F.col("delta") - target)
    agg = own.groupBy(*by).agg(F.min_by(F.struct(*rest), F.when(F.col("delta").isNotNull(), F.struct(away, "expiry", "strike"))).alias("r"), F.count_if(F.col("delta").isNull()).alias("nulls"))
    if veto_null:
        agg = agg.where("nulls = 0")
    out = agg.where("r is not null").select(*by, "r.*")
    if tolerance is not None:
        out = out.where(F.abs(F.col("delta") - target) <= tolerance)
    return out.select(*chain.columns)


def legs(chain: DataFrame, wanted: dict[str, tuple[float, str]], tolerance: float | None = DELTA_TOLERANCE, whole: bool = True) -> DataFrame:
    """(date, underlying, <name> struct...): nearest-delta rows of several targets in one pass. Dates that lack one are left out, or with whole=False have null for it."""
    rest = ["expiry", "strike", "option_type", "settle", "bid", "ask", "delta", "iv", "dte"]
    picks, nulls = [], []
    for name, (target, kind) in wanted.items():
        check_target(target, kind, tolerance)
        own = F.col("option_type") == kind
        away = F.struct(F.abs(F.col("delta") - target), "expiry", "strike")
        picks.append(F.min_by(F.struct(*rest), F.when(own & F.col("delta").isNotNull(), away)).alias(name))
        nulls.append(F.count_if(own & F.col("delta").isNull()).alias(f"{name}_nulls"))
    out = chain.groupBy("date").agg(F.first("underlying").alias("underlying"), *picks, *nulls)
    ok = {n: F.col(n).isNotNull() & (F.col(f"{n}_nulls") == 0) for n in wanted}
    if tolerance is not None:
        ok = {n: ok[n] & (F.abs(F.col(n)["delta"] - t) <= tolerance) for n, (t, _) in wanted.items()}
    if whole:
        return out.where(reduce(lambda a, b: a & b, ok.values())).select("date", "underlying", *wanted)
    return out.select("date", "underlying", *(F.when(ok[n], F.col(n)).alias(n) for n in wanted))


def credits(sell: list[str], buy: list[str]) -> dict[str, Column]:
    def total(price) -> Column:
        return reduce(lambda a, b: a + b, [price(F.col(n), "sell") for n in sell] + [-price(F.col(n), "buy") for n in buy])

    return {
        "settle_credit": total(lambda c, _: c["settle"]),
        "mid_credit": total(lambda c, _: (c["bid"] + c["ask"]) / 2),
        "worst_credit": total(lambda c, side: c["bid"] if side == "sell" else c["ask"]),
    }


def iron_condors(chain: DataFrame, short: float = 0.16, wing: float = 0.08, dte: int = 45, multiplier: int = 50) -> DataFrame:
    """The condor that each date would open: four legs, credits and defined risk."""
    if not 0 < wing < short:
        raise ValueError(f"wing delta {wing} must lie between 0 and the short delta {short}")
    own = filter_by_dte(chain, max(dte - DTE_BAND, 0), dte + DTE_BAND)
    out = legs(own, {"short_call": (short, "call"), "long_call": (wing, "call"), "short_put": (-short, "put"), "long_put": (-wing, "put")})
    out = out.where((F.col("long_call.strike") > F.col("short_call.strike")) & (F.col("long_put.strike") < F.col("short_put.strike")))
    width = F.greatest(F.col("long_call.strike") - F.col("short_call.strike"), F.col("short_put.strike") - F.col("long_put.strike"))
    out = out.withColumns(credits(["short_call", "short_put"], ["long_call", "long_put"]))
    return out.withColumn("max_defined_risk", (width - F.col("worst_credit")) * multiplier)


def skews(chain: DataFrame, delta: float = 0.25, dte: int = 45, threshold: float = 0.01) -> DataFrame:
    """(date, skew, side): put less call volatility at this delta; a bull put spread above the threshold, a bear call spread below its negative."""
    own = filter_by_dte(chain, max(dte - DTE_BAND, 0), dte + DTE_BAND)
    two = legs(own, {"c": (delta, "call"), "p": (-delta, "put")})
    skew = F.col("p.iv") - F.col("c.iv")
    return two.select("date", skew.alias("skew"), F.when(skew > threshold, "bull_put").when(skew < -threshold, "bear_call").otherwise("none").alias("side"))


def verticals(chain: DataFrame, short: float = 0.25, wing: float = 0.10, dte: int = 45, threshold: float = 0.01, multiplier: int = 50) -> DataFrame:
    """The two-leg spread that each date would open by its skew, in one pass over the chain."""
    own = filter_by_dte(chain, max(dte - DTE_BAND, 0), dte + DTE_BAND)
    out = legs(own, {"sc": (short, "call"), "sp": (-short, "put"), "lc": (wing, "call"), "lp": (-wing, "put")}, whole=False)
    skew = F.col("sp.iv") - F.col("sc.iv")
    out = out.withColumn("skew", skew).withColumn("side", F.when(skew > threshold, "bull_put").when(skew < -threshold, "bear_call"))
    put = F.col("side") == "bull_put"
    out = out.where("side is not null").select("date", "underlying", F.when(put, F.col("sp")).otherwise(F.col("sc")).alias("short_leg"), F.when(put, F.col("lp")).otherwise(F.col("lc")).alias("long_leg"), "skew", "side")
    out = out.where(F.when(F.col("side") == "bull_put", F.col("long_leg.strike") < F.col("short_leg.strike")).otherwise(F.col("long_leg.strike") > F.col("short_leg.strike")))
    out = out.withColumns(credits(["short_leg"], ["long_leg"]))
    return out.withColumn("max_defined_risk", (F.abs(F.col("long_leg.strike") - F.col("short_leg.strike")) - F.col("worst_credit")) * multiplier)


def calendars(chain: DataFrame, front: DataFrame, offset: int = 30, step: int = 50, use_settle: bool = True) -> DataFrame:
    """For front (date, front_expiry): a short call at the money in the front expiry and a long one in the expiry nearest to offset days later.

    The strike is the underlying on the grid, halves to even; dates without both
    quotes are left out. Candidates are found by an equi-join on date.
    """
    expiries = chain.groupBy("date", "expiry").agg(F.first("underlying").alias("underlying"))
    later = front.join(expiries, "date").where(F.col("expiry") > F.col("front_expiry"))
    away = F.abs(F.datediff("expiry", "front_expiry") - offset)
    picked = later.groupBy("date", "front_expiry").agg(F.min_by("expiry", F.struct(away, "expiry")).alias("back_expiry"), F.first("underlying").alias("underlying"))
    picked = picked.withColumn("strike", F.bround(F.col("underlying") / step) * step)
    calls = first_per_key(chain.where("option_type = 'call'"), ["date", "expiry", "strike", "option_type"])
    side = lambda name: calls.select("date", F.col("expiry").alias(f"{name}_expiry"), "strike", *(F.col(c).alias(f"{name}_{c}") for c in ("settle", "bid", "ask")))
    out = picked.join(side("front"), ["date", "front_expiry", "strike"]).join(side("back"), ["date", "back_expiry", "strike"])
    premium = F.col("back_settle") - F.col("front_settle") if use_settle else (F.col("back_bid") + F.col("back_ask") - F.col("front_bid") - F.col("front_ask")) / 2
    return out.withColumn("premium", premium)


#: The most scenarios that are broadcast; more are joined without a hint.
FEW_SCENARIOS = 1000


def shock(chain: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each row under each scenario (scenario, vol_shift, spot_shift): price, quotes at their old proportion to it, floored."""
    from strikeflow.functions import bsm

    few = scenarios.limit(FEW_SCENARIOS + 1).count() <= FEW_SCENARIOS
    both = chain.join(F.broadcast(scenarios) if few else scenarios, how="cross").withColumns({"base_underlying": F.col("underlying"), "underlying": F.col("underlying") * (1 + F.col("spot_shift")), "iv": F.greatest(F.col("iv") + F.col("vol_shift"), F.lit(0.01))})
    out = bsm.price(both, name="shocked")
    ratio = F.col("shocked") / F.nullif(F.col("settle"), F.lit(0.0))
    bid = F.greatest(F.col("bid") * ratio, F.lit(0.01))
    return out.withColumns({"settle": F.greatest("shocked", F.lit(0.01)), "bid": F.when(F.col("bid").isNotNull(), bid), "ask": F.when(F.col("ask").isNotNull(), F.greatest(F.col("ask") * ratio, F.coalesce(bid, F.lit(0.01)) + 0.01))}).drop("shocked")


def position_greeks(positions: DataFrame, chain: DataFrame, multiplier: int = 50) -> DataFrame:
    """Sums of qty * multiplier * Greek over open legs (date, expiry, strike, option_type, qty)."""
    from strikeflow.functions import bsm

    own = bsm.greeks(lookup(positions, chain, ["underlying", "iv"]).withColumn("dte", F.greatest(F.datediff("expiry", "date"), F.lit(0))))
    return own.groupBy("date").agg(*(F.sum(F.col("qty") * multiplier * F.col(g)).alias(g) for g in ("delta", "gamma", "theta", "vega")))


def with_fill(df: DataFrame, model: str, side: str = "side", *, commission: float = 0.0, tax_bps: float = 0.0, slip_bps: float = 0.0, model_bps: float = 10.0, base: str = "mid", multiplier: int = 50) -> DataFrame:
    """fill_price, commission and tax of orders (side, qty, quotes). A retail slip comes on top of the model's; status tells orders without the quote they need."""
    df = df.withColumn("raw", F.expr(x.fill_price(model, side, model_bps, base)))
    slip = F.when(F.col(side) == "sell", 1 - slip_bps / 1e4).otherwise(1 + slip_bps / 1e4)
    price = F.col("raw") * slip
    return df.withColumns({"fill_price": price, "commission": commission * F.col("qty"), "tax": F.abs(price) * multiplier * F.col("qty") * (tax_bps / 1e4), "status": F.when(F.col("raw").isNull(), "not_executable").otherwise("filled")}).drop("raw")
