"""The registered queries of the engine's operators, each with the SQL that checks it.

Every query runs over its whole tables: the chain is derived from all dates of orders. Names start with the operator's
identifier in the inventory.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeflow.constants import DIVIDEND, RISK_FREE
from strikeflow.functions import bsm, dates
from strikeflow.functions import expressions as x
from strikeflow.operators import chain as ops
from strikeflow.operators import feasibility as fs
from strikeflow.operators import lint
from strikeflow.operators import results as rs
from strikeflow.operators import statistics as st
from strikeflow.operators.regime import log_returns, realised_vol, vol_percentile_gate
from strikeflow.plans import fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["date", "expiry", "strike", "option_type"]
CH = f"WITH {fixture.CHAIN_SQL}\n"


def unsigned_zero(sql: str) -> str:
    """Adds zero to what round() gives: one engine keeps the sign of zero, the other doesn't."""
    out, at = [], 0
    for m in re.finditer(r"(?<![A-Za-z_])round\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at : m.start()], f"({sql[m.start() : end]} + 0.0e0)"]
        at = end
    return "".join([*out, sql[at:]])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = unsigned_zero(sql)
        return f

    return put


def chain(spark, d):
    return fixture.chain(spark, d)


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# filters


@query("F01_filter_by_dte", CH + "SELECT date, expiry, strike, option_type, dte FROM chain WHERE dte BETWEEN 23 AND 37")
def _(s, d):
    return ops.filter_by_dte(chain(s, d), 23, 37).select(*KEY, "dte")


@query("F02_date_window", CH + "SELECT date, count(*) AS n FROM chain WHERE date BETWEEN DATE '1997-02-01' AND DATE '1997-03-15' GROUP BY 1")
def _(s, d):
    return ops.date_window(chain(s, d), "1997-02-01", "1997-03-15").groupBy("date").agg(F.count("*").alias("n"))


SHIPS = "SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS date, CAST(l_shipdate AS DATE) AS expiry FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def ships(s, d):
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("expiry")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("F03_drop_expired", f"SELECT l_orderkey, l_linenumber, CAST(expiry - date AS INTEGER) AS dte FROM ({SHIPS}) WHERE expiry >= date")
def _(s, d):
    return ops.add_dte(ops.drop_expired(ships(s, d))).select("l_orderkey", "l_linenumber", "dte")


@query("F03_expired_counts", f"SELECT count(*) FILTER (expiry < date) AS n_expired, count(*) FILTER (expiry >= date) AS n_kept FROM ({SHIPS})")
def _(s, d):
    late = F.col("expiry") < F.col("date")
    return ships(s, d).agg(F.count_if(late).alias("n_expired"), F.count_if(~late).alias("n_kept"))


CONTRACT_MONTH = "CASE WHEN p_partkey % 3 = 0 THEN '2024' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || 'W' || CAST(p_partkey % 5 + 1 AS VARCHAR) ELSE '2024' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') END"


@query("F04_monthly_contracts", f"SELECT p_partkey, {CONTRACT_MONTH} AS contract_month FROM part WHERE regexp_full_match({CONTRACT_MONTH}, '\\d{{6}}')")
def _(s, d):
    month = F.concat(F.lit("2024"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"))
    weekly = F.concat(month, F.lit("W"), (F.col("p_partkey") % 5 + 1).cast("string"))
    own = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, weekly).otherwise(month).alias("contract_month"))
    return own.where(F.col("contract_month").rlike(r"^\d{6}$"))


RETURNS = f"WITH {fixture.SPOT_SQL}, returns AS (SELECT date, r AS ret FROM (SELECT date, ln(underlying / lag(underlying) OVER (ORDER BY date)) AS r FROM spot) WHERE r IS NOT NULL)"


@query("F06_point_in_time_slice", RETURNS + " SELECT a.date, count(*) AS n_seen, round(avg(b.ret), 9) AS mean_ret FROM (SELECT max(date) AS date FROM returns GROUP BY date_trunc('month', date)) a JOIN returns b ON b.date <= a.date GROUP BY 1")
def _(s, d):
    r = log_returns(fixture.spot(s, d))
    ends = r.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("date", F.count("*").over(w).alias("n_seen"), F.round(F.avg("ret").over(w), 9).alias("mean_ret")).join(ends.select("date"), "date", "left_semi")


BROKEN_IV = "CASE WHEN open_interest % 7 = 0 THEN NULL WHEN open_interest % 7 = 1 THEN 0.0 WHEN open_interest % 7 = 2 THEN -iv ELSE iv END"


@query("F07_usable_iv", CH + f"SELECT date, expiry, count(*) AS n FROM (SELECT date, expiry, {BROKEN_IV} AS iv FROM chain) WHERE iv > 0 GROUP BY 1, 2")
def _(s, d):
    return ops.usable_iv(chain(s, d).withColumn("iv", F.expr(BROKEN_IV))).groupBy("date", "expiry").agg(F.count("*").alias("n"))


HOLED = "CASE WHEN open_interest = 17 THEN NULL ELSE delta END"
PICK = "SELECT date, expiry, strike, delta FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(delta - {t}), expiry, strike) AS rn{more} FROM {src} WHERE option_type = '{kind}'{where}) WHERE rn = 1{after}"


@query("F08_null_veto", CH + ", holed AS (SELECT date, expiry, strike, option_type, " + HOLED + " AS delta FROM chain), ok AS (SELECT date FROM holed WHERE option_type = 'call' GROUP BY 1 HAVING count(*) = count(delta)) " + PICK.format(t=0.16, more="", src="holed", kind="call", where=" AND date IN (SELECT date FROM ok)", after=""))
def _(s, d):
    return ops.select_by_delta(chain(s, d).withColumn("delta", F.expr(HOLED)), 0.16, "call").select("date", "expiry", "strike", "delta")


# projections


@query("P03_expiry_with_holidays", f"""WITH days AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS f FROM orders),
 w AS (SELECT f, CAST(f + CAST((3 - dayofweek(f) + 7) % 7 + 14 AS INTEGER) AS DATE) AS wed FROM days)
 SELECT f AS month, wed, CASE WHEN month(f) % 4 = 1 THEN CAST(wed + 1 AS DATE) WHEN month(f) % 4 = 2 THEN CAST(wed + 5 AS DATE) ELSE wed END AS expiry FROM w""")
def _(s, d):
    months = table(s, d, "orders").select(F.trunc("o_orderdate", "month").alias("month")).distinct().withColumn("wed", dates.third_wednesday(F.col("month")))
    m = F.month("month") % 4
    off = months.select(F.explode(F.when(m == 1, F.array("wed")).when(m == 2, F.array(*(F.date_add("wed", i) for i in range(3)))).otherwise(F.array().cast("array<date>"))).alias("date"))
    return dates.rolled(months, "wed", off).select("month", "wed", "expiry")


@query("P04_executability_flags", CH + "SELECT date, count(*) FILTER (ask IS NOT NULL) AS n_buy, count(*) FILTER (bid IS NOT NULL) AS n_sell, count(*) AS n FROM chain GROUP BY 1")
def _(s, d):
    return ops.flags(chain(s, d)).groupBy("date").agg(F.count_if("can_buy").alias("n_buy"), F.count_if("can_sell").alias("n_sell"), F.count("*").alias("n"))


CONTRACT = "'TXO' || strftime(expiry, '%Y%m%d') || CASE WHEN option_type = 'call' THEN 'C' ELSE 'P' END || CAST(CAST(strike AS BIGINT) AS VARCHAR)"


@query("P05_contract_id", CH + f"SELECT {CONTRACT} AS contract, count(*) AS n_days FROM chain GROUP BY 1")
def _(s, d):
    return chain(s, d).groupBy(dates.contract_id().alias("contract")).agg(F.count("*").alias("n_days"))


@query("P06_parse_contract", CH + f"SELECT DISTINCT {CONTRACT} AS contract, expiry, option_type, strike FROM chain UNION ALL SELECT * FROM (VALUES ('TXO20249999C17000', NULL, NULL, NULL), ('XYZ20240117C17000', NULL, NULL, NULL), ('TXO2024C1', NULL, NULL, NULL)) v")
def _(s, d):
    names = chain(s, d).select(dates.contract_id().alias("contract")).distinct().unionByName(s.createDataFrame([("TXO20249999C17000",), ("XYZ20240117C17000",), ("TXO2024C1",)], "contract string"))
    return names.select("contract", *(c.alias(n) for n, c in dates.parse_contract().items()))


PICKED = "CASE WHEN bid IS NOT NULL AND ask IS NOT NULL AND (bid + ask) / 2 > 0 THEN 'mid' WHEN (bid IS NULL OR ask IS NULL) AND settle > 0 THEN 'settle' ELSE 'no_price' END"


@query("P07_price_for_volatility", CH + f"SELECT date, {PICKED} AS iv_price_source, count(*) AS n, round(sum(CASE {PICKED} WHEN 'mid' THEN (bid + ask) / 2 WHEN 'settle' THEN settle END), 4) AS total FROM chain GROUP BY 1, 2")
def _(s, d):
    return rounded(ops.iv_price(chain(s, d)).groupBy("date", "iv_price_source").agg(F.count("*").alias("n"), F.sum("iv_price").alias("total")), "total", places=4)


@query("P08_price_for_parity", CH + "SELECT date, expiry, strike, option_type, round(coalesce((bid + ask) / 2, close), 6) AS price FROM chain")
def _(s, d):
    return chain(s, d).select(*KEY, F.round(ops.parity_price(), 6).alias("price"))


MODEL = "CASE WHEN open_interest % 3 = 0 THEN NULL ELSE settle * 1.01 END"
SETTLED = "CASE WHEN open_interest % 5 = 0 THEN NULL ELSE settle END"


def marks_sql(mode: str) -> str:
    price, basis = "WHEN bid IS NOT NULL AND ask IS NOT NULL THEN (bid + ask) / 2", "WHEN bid IS NOT NULL AND ask IS NOT NULL THEN 'mid'"
    if mode == "settle":
        price, basis = price + " WHEN s IS NOT NULL THEN s", basis + " WHEN s IS NOT NULL THEN 'settle_fallback'"
    if mode == "surface":
        price, basis = price + " WHEN m IS NOT NULL THEN m WHEN s IS NOT NULL THEN s", basis + " WHEN m IS NOT NULL THEN 'surface_fallback' WHEN s IS NOT NULL THEN 'settle_3rd_fallback'"
    return CH + f"SELECT date, expiry, strike, option_type, round(CASE {price} END, 9) AS mark, CASE {basis} END AS basis FROM (SELECT *, {MODEL} AS m, {SETTLED} AS s FROM chain)"


for _mode in ("strict", "settle", "surface"):

    @query(f"P09_mark_{_mode}", marks_sql(_mode))
    def _(s, d, mode=_mode):
        own = chain(s, d).withColumns({"model_price": F.expr(MODEL), "settle": F.expr(SETTLED)})
        return ops.mark(own, mode).select(*KEY, F.round("mark", 9).alias("mark"), "basis")


MISSING = "CAST('0x' || substr(md5(concat_ws('|', date, expiry, CAST(round(strike * 100) AS BIGINT), option_type, 42)), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 AND bid IS NOT NULL AND ask IS NOT NULL"


@query("P11_forced_missing", CH + f"SELECT date, count(*) FILTER (({MISSING}) OR ask IS NULL) AS n_no_buy, count(*) FILTER (({MISSING}) OR bid IS NULL) AS n_no_sell FROM chain GROUP BY 1")
def _(s, d):
    return rs.force_missing(chain(s, d)).groupBy("date").agg(F.count_if(~F.col("can_buy")).alias("n_no_buy"), F.count_if(~F.col("can_sell")).alias("n_no_sell"))


SHOCKS = [("vol_up", 0.10, 0.0), ("vol_down", -0.05, 0.0), ("crash", 0.15, -0.10), ("rally", -0.02, 0.05)]


def priced_sql(source: str, vol: str = "iv", out: str = "p") -> str:
    """CTEs <out>_d and <out>: source with t, d1, d2 and price."""
    r, q = RISK_FREE, x.num(DIVIDEND)
    one = f"{out}_c AS (SELECT *, CAST(dte AS DOUBLE)/{x.num(365)} AS t FROM {source}), {out}_d AS (SELECT *, CASE WHEN t > 0 AND {vol} > 0 THEN {x.d1('underlying', 'strike', 't', r, q, vol)} END AS d1 FROM {out}_c), {out}_e AS (SELECT *, {x.d2('d1', 't', vol)} AS d2 FROM {out}_d)"
    return f"{one}, {out} AS (SELECT *, {x.bsm_price('underlying', 'strike', 't', r, q, vol, 'option_type', 'd1', 'd2')} AS price FROM {out}_e)"


@query("P12_shock_chain", CH + f""", sc AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {v}::DOUBLE, {u}::DOUBLE)" for n, v, u in SHOCKS)}) v(scenario, vs, us)),
 base AS (SELECT date, expiry, strike, option_type, dte, settle, bid, ask, scenario, underlying * (1 + us) AS underlying, greatest(iv + vs, 0.01) AS iv FROM chain, sc), {priced_sql('base')}
 SELECT date, scenario, count(bid) AS n_bid, count(ask) AS n_ask, round(sum(greatest(price, 0.01)), 3) AS settle FROM p GROUP BY 1, 2""")
def _(s, d):
    own = ops.shock(chain(s, d), s.createDataFrame(SHOCKS, "scenario string, vol_shift double, spot_shift double"))
    return rounded(own.groupBy("date", "scenario").agg(F.count("bid").alias("n_bid"), F.count("ask").alias("n_ask"), F.sum("settle").alias("settle")), "settle", places=3)


# joins

HOLES = "date IN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM spot) WHERE n % 7 <> 0)"


def holed_spot(s, d):
    return fixture.spot(s, d).withColumn("n", F.row_number().over(Window.orderBy("date"))).where("n % 7 <> 0").drop("n")


@query("J01_left_join_spot", CH + "SELECT c.date, c.expiry, c.strike, c.option_type, s.underlying FROM chain c LEFT JOIN spot s ON c.date = s.date")
def _(s, d):
    return ops.add_underlying(chain(s, d), fixture.spot(s, d)).select(*KEY, "underlying")


@query("J02_inner_join_skip", CH + f"SELECT date, count(*) AS n, min(underlying) AS underlying FROM chain WHERE {HOLES} GROUP BY 1")
def _(s, d):
    return ops.add_underlying(chain(s, d), holed_spot(s, d), "skip").groupBy("date").agg(F.count("*").alias("n"), F.min("underlying").alias("underlying"))


@query("J02_anti_join_audit", CH + f"SELECT date, count(*) AS n FROM chain WHERE NOT {HOLES} GROUP BY 1")
def _(s, d):
    return ops.missing_dates(chain(s, d), holed_spot(s, d))


@query("J03_asof_join", CH + f", held AS (SELECT * FROM spot WHERE {HOLES}) SELECT c.date, c.expiry, c.strike, c.option_type, h.underlying FROM chain c ASOF JOIN held h ON c.date >= h.date")
def _(s, d):
    return ops.add_underlying(chain(s, d), holed_spot(s, d), "forward_fill").select(*KEY, "underlying")


@query("J05_surface_lookup", CH + ", rec AS (SELECT DISTINCT date, expiry, 0.18 AS c0 FROM chain WHERE dte > 20) SELECT c.date, c.expiry, count(*) AS n, count(c0) AS n_found FROM chain c LEFT JOIN rec r ON c.date = r.date AND c.expiry = r.expiry GROUP BY 1, 2")
def _(s, d):
    own = chain(s, d)
    rec = own.where("dte > 20").select("date", "expiry").distinct().withColumn("c0", F.lit(0.18))
    return own.join(rec, ["date", "expiry"], "left").groupBy("date", "expiry").agg(F.count("*").alias("n"), F.count("c0").alias("n_found"))


CONDOR_LEGS = {"short_call": (0.16, "call"), "long_call": (0.08, "call"), "short_put": (-0.16, "put"), "long_put": (-0.08, "put")}


def legs_sql(wanted: dict, low: int, high: int, tolerance: float = 0.05) -> str:
    parts = [f"{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(delta - ({t})), expiry, strike) AS rn FROM chain WHERE option_type = '{k}' AND dte BETWEEN {low} AND {high}) WHERE rn = 1 AND abs(delta - ({t})) <= {tolerance})" for n, (t, k) in wanted.items()]
    return ", " + ", ".join(parts)


@query("J06_leg_lookup", CH + legs_sql({"c": (0.16, "call")}, 23, 37) + ", days AS MATERIALIZED (SELECT DISTINCT date FROM chain), held AS MATERIALIZED (SELECT c.date AS opened, days.date, c.expiry, c.strike, c.option_type FROM c JOIN days ON days.date >= c.date AND days.date < c.expiry) SELECT h.opened, h.date, h.expiry, h.strike, h.option_type, q.bid, q.ask, q.settle FROM held h LEFT JOIN chain q ON q.date = h.date AND q.expiry = h.expiry AND q.strike = h.strike AND q.option_type = h.option_type")
def _(s, d):
    own = chain(s, d)
    leg = ops.select_by_delta(ops.filter_by_dte(own, 23, 37), 0.16, "call", 0.05).select(F.col("date").alias("opened"), "expiry", "strike", "option_type")
    # the days of each leg by an equi-join on date
    held = leg.withColumn("date", F.explode(F.sequence("opened", F.date_sub("expiry", 1)))).join(own.select("date").distinct(), "date", "left_semi")
    return ops.lookup(held, own, ["bid", "ask", "settle"]).select("opened", *KEY, "bid", "ask", "settle")


PAIRS = "pairs AS (SELECT date, expiry, strike, max(underlying) AS underlying, max(CASE WHEN option_type = 'call' THEN coalesce((bid + ask) / 2, close) END) AS c, max(CASE WHEN option_type = 'put' THEN coalesce((bid + ask) / 2, close) END) AS p FROM chain GROUP BY 1, 2, 3)"
ATM = "atm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY expiry, abs(strike - underlying), strike) AS rn FROM pairs) WHERE rn = 1)"


@query("J07_call_put_self_join", CH + f", {PAIRS} SELECT date, expiry, strike, round(c, 6) AS call, round(p, 6) AS put FROM pairs")
def _(s, d):
    return rounded(ops.call_put_pairs(chain(s, d)).select("date", "expiry", "strike", "call", "put"), "call", "put")


PNL = "pnl AS (SELECT date, scenario, round(s - avg(s) OVER (PARTITION BY scenario), 6) AS pnl FROM (SELECT CAST(ts AS DATE) AS date, event_type AS scenario, sum(value) AS s FROM events GROUP BY 1, 2))"


def pnl(s, d):
    own = table(s, d, "events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("scenario")).agg(F.sum("value").alias("s"))
    return own.select("date", "scenario", F.round(F.col("s") - F.avg("s").over(Window.partitionBy("scenario")), 6).alias("pnl"))


@query("J08_scenario_divergence", f"WITH {PNL} SELECT a.scenario AS a, b.scenario AS b, count(*) AS n, round(sum(abs(a.pnl - b.pnl)), 4) AS l1 FROM pnl a JOIN pnl b ON a.date = b.date AND a.scenario < b.scenario GROUP BY 1, 2")
def _(s, d):
    return rounded(st.divergence(pnl(s, d)), "l1", places=4)


@query("J09_date_coverage", CH + f"SELECT count(*) AS n_both FROM (SELECT date FROM chain INTERSECT SELECT date FROM spot WHERE {HOLES})")
def _(s, d):
    return chain(s, d).select("date").intersect(holed_spot(s, d).select("date")).agg(F.count("*").alias("n_both"))


FOLDS = "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM {t})), folds AS (SELECT CAST(s // {step} AS INTEGER) AS fold_index, s, {start} AS a, s + {train} - 1 AS b, s + {train} AS c, s + {train} + {test} - 1 AS e FROM (SELECT unnest(range(0, (SELECT count(*) FROM days) - {train} - {test} + 1, {step})) AS s))"


def folds_sql(t: str, train: int, test: int, step: int, expanding: bool = False) -> str:
    return FOLDS.format(t=t, train=train, test=test, step=step, start="0" if expanding else "s")


for _expanding in (False, True):

    @query("W08_fold_windows" + ("_expanding" if _expanding else ""), f"WITH {fixture.SPOT_SQL}, {folds_sql('spot', 63, 21, 21, _expanding)} SELECT fold_index, w.date AS train_start, x.date AS train_end, y.date AS test_start, z.date AS test_end FROM folds JOIN days w ON w.i = a JOIN days x ON x.i = b JOIN days y ON y.i = c JOIN days z ON z.i = e")
    def _(s, d, expanding=_expanding):
        from strikeflow.plans.simulation import fold_windows

        return fold_windows(fixture.spot(s, d), 63, 21, 21, expanding)


@query("J10_interval_join_folds", CH + f", {folds_sql('spot', 63, 21, 21)} SELECT fold_index, count(*) AS n, count(DISTINCT c.date) AS n_days FROM folds JOIN days w ON w.i >= c AND w.i <= e JOIN chain c ON c.date = w.date GROUP BY 1")
def _(s, d):
    from strikeflow.operators.intervals import bin_join
    from strikeflow.plans.simulation import BIN_DAYS, fold_windows

    own = chain(s, d).groupBy("date").agg(F.count("*").alias("k"))
    folds = fold_windows(fixture.spot(s, d), 63, 21, 21)
    return bin_join(own, folds, "date", "test_start", "test_end", BIN_DAYS).groupBy("fold_index").agg(F.sum("k").alias("n"), F.count("*").alias("n_days"))


@query("J11_scenario_cross_join", CH + "SELECT scenario, count(*) AS n, round(sum(settle * f), 2) AS total FROM chain, (VALUES ('low', 0.5), ('high', 2.0)) v(scenario, f) GROUP BY 1")
def _(s, d):
    few = s.createDataFrame([("low", 0.5), ("high", 2.0)], "scenario string, f double")
    return rounded(chain(s, d).crossJoin(F.broadcast(few)).groupBy("scenario").agg(F.count("*").alias("n"), F.sum(F.col("settle") * F.col("f")).alias("total")), "total", places=2)


@query("J12_nearest_back_expiry", CH + ", fr AS (SELECT date, min(expiry) AS front FROM chain GROUP BY 1), ex AS (SELECT DISTINCT date, expiry FROM chain) SELECT date, front, expiry AS back FROM (SELECT fr.date, front, expiry, row_number() OVER (PARTITION BY fr.date ORDER BY abs(expiry - front - 30), expiry) AS rn FROM fr JOIN ex ON fr.date = ex.date AND expiry > front) WHERE rn = 1")
def _(s, d):
    own = chain(s, d).groupBy("date").agg(F.min("expiry").alias("front"), F.collect_set("expiry").alias("all"))
    later = own.select("date", "front", F.explode("all").alias("expiry")).where("expiry > front")
    return later.groupBy("date", "front").agg(F.min_by("expiry", F.struct(F.abs(F.datediff("expiry", "front") - 30), "expiry")).alias("back"))


def priced_summary(s, d, cost: float):
    """A summary of the scenarios of pnl with a cost on each day's move."""
    own = pnl(s, d).withColumn("pnl", F.col("pnl") - cost * F.abs("pnl"))
    return own.groupBy("scenario").agg(st.plain_sharpe("pnl").alias("sharpe"), F.sum("pnl").alias("total"), F.count_if(F.col("pnl") > 0).alias("n_trades"))


PRICED = "SELECT scenario, sqrt(252) * avg(p) / nullif(stddev_samp(p), 0) AS sharpe, sum(p) AS total, count(*) FILTER (p > 0) AS n_trades FROM (SELECT scenario, pnl - {cost} * abs(pnl) AS p FROM pnl) GROUP BY 1"


@query("J13_cost_comparison", f"WITH {PNL}, w AS ({PRICED.format(cost='0.0')}), c AS ({PRICED.format(cost='0.01')}) SELECT w.scenario, round(w.sharpe, 6) AS sharpe_free, round(c.sharpe, 6) AS sharpe_paid, round(c.sharpe - w.sharpe, 6) AS sharpe_diff, round(w.total, 5) AS total_free, round(c.total, 5) AS total_paid, round(c.total - w.total, 5) AS total_diff, w.n_trades AS n_trades_free, c.n_trades AS n_trades_paid, c.n_trades - w.n_trades AS n_trades_diff FROM w JOIN c ON w.scenario = c.scenario")
def _(s, d):
    out = rs.cost_comparison(priced_summary(s, d, 0.0), priced_summary(s, d, 0.01), ("sharpe", "total", "n_trades"))
    sides = ("free", "paid", "diff")
    return rounded(rounded(out, *(f"sharpe_{x}" for x in sides)), *(f"total_{x}" for x in sides), places=5)


# aggregations


@query("A01_median_smile", CH + "SELECT date, expiry, strike, round(median(iv), 8) AS iv FROM chain WHERE iv > 0 GROUP BY 1, 2, 3")
def _(s, d):
    from strikeflow.operators.surface import smiles

    return rounded(smiles(chain(s, d)).select("date", "expiry", "strike", "iv"), "iv", places=8)


@query("A02_forward", CH + "SELECT date, expiry, round(median(underlying), 9) AS forward, count(DISTINCT strike) AS n FROM chain WHERE iv > 0 GROUP BY 1, 2")
def _(s, d):
    from strikeflow.operators.surface import smiles

    return rounded(smiles(chain(s, d)).groupBy("date", "expiry").agg(F.first("forward").alias("forward"), F.count("*").alias("n")), "forward", places=9)


@query("A06_fill_rates", CH + f"SELECT round(avg(CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS quoted, round(count(iv) / count(*), 9) AS with_iv, round(count({MODEL}) / count(*), 9) AS with_model, round(count(*) FILTER ((bid IS NULL OR ask IS NULL) AND {MODEL} IS NOT NULL) / count(*) FILTER (bid IS NULL OR ask IS NULL), 9) AS filled FROM chain")
def _(s, d):
    return rounded(rs.fill_rates(chain(s, d).withColumn("model_price", F.expr(MODEL))), "quoted", "with_iv", "with_model", "filled", places=9)


@query("A07_coverage_gate", CH + f", t AS (SELECT bid IS NULL OR ask IS NULL AS lacks, {MODEL} AS m, {SETTLED} AS s FROM chain) SELECT count(*) AS n, count(*) FILTER (lacks AND m IS NULL) AS n_danger, count(*) FILTER (lacks AND m IS NULL AND s IS NULL) AS n_unmarkable, count(*) FILTER (lacks AND m IS NULL AND s IS NOT NULL) AS n_third, round(count(m) / count(*), 9) AS coverage, count(m) / count(*) >= 0.95 AS passed FROM t")
def _(s, d):
    from strikeflow.operators.monitor import coverage

    return rounded(coverage(chain(s, d).withColumns({"model_price": F.expr(MODEL), "settle": F.expr(SETTLED)})), "coverage", places=9)


@query("A08_expiries_per_day", CH + ", n AS (SELECT date, count(DISTINCT expiry) AS n FROM chain WHERE dte BETWEEN 21 AND 63 GROUP BY 1) SELECT round(avg(n), 6) AS mean_n, median(n) AS median_n, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.9) AS p90, max(n) AS max_n, " + ", ".join(f"round(avg(CASE WHEN n >= {k} THEN 1.0 ELSE 0.0 END), 6) AS share_{k}" for k in (2, 3, 4, 5)) + " FROM n")
def _(s, d):
    return rounded(fs.expiries_per_day(chain(s, d)), "mean_n", *(f"share_{k}" for k in (2, 3, 4, 5)))


@query("A09_short_dated_density", CH + "SELECT date, round(count(DISTINCT CASE WHEN dte <= 14 THEN expiry END) / count(DISTINCT expiry), 9) AS density FROM chain GROUP BY 1")
def _(s, d):
    return chain(s, d).groupBy("date").agg(F.round(F.countDistinct(F.when(F.col("dte") <= 14, F.col("expiry"))) / F.countDistinct("expiry"), 9).alias("density"))


AUDIT = "SELECT event_type AS scenario, CAST(ts AS DATE) AS date, count(*) AS n_legs_marked, count(*) FILTER (event_id % 7 = 0) AS n_fallback_settle, count(*) FILTER (event_id % 11 = 1) AS n_fallback_surface, count(*) FILTER (event_id % 21 = 0) AS n_fallback_settle_3rd FROM events GROUP BY 1, 2"


@query("A10_mark_audit", f"SELECT scenario, count(*) AS n_days, CAST(sum(n_legs_marked) AS BIGINT) AS n_legs, CAST(sum(n_fallback_settle) AS BIGINT) AS n_settle, CAST(sum(n_fallback_surface) AS BIGINT) AS n_surface, CAST(sum(n_fallback_settle_3rd) AS BIGINT) AS n_third, count(*) FILTER (n_fallback_settle + n_fallback_surface > 0) AS days_with_fallback, round(sum(n_fallback_settle + n_fallback_surface) / sum(n_legs_marked), 9) AS fallback_share, round(avg((n_fallback_settle + n_fallback_surface) / n_legs_marked), 9) AS mean_daily_rate FROM ({AUDIT}) GROUP BY 1")
def _(s, d):
    e = F.col("event_id")
    own = table(s, d, "events").groupBy(F.col("event_type").alias("scenario"), F.col("ts").cast("date").alias("date")).agg(F.count("*").alias("n_legs_marked"), F.count_if(e % 7 == 0).alias("n_fallback_settle"), F.count_if(e % 11 == 1).alias("n_fallback_surface"), F.count_if(e % 21 == 0).alias("n_fallback_settle_3rd"))
    return rounded(st.mark_audit(own, ["scenario"]), "fallback_share", "mean_daily_rate", places=9)


@query("A11_win_rate", f"WITH {PNL} SELECT scenario, round(coalesce(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 0), 9) AS win_rate FROM pnl GROUP BY 1")
def _(s, d):
    return pnl(s, d).groupBy("scenario").agg(F.round(st.win_rate("pnl"), 9).alias("win_rate"))


def event_runs(s, d):
    """Events as rows of runs: by value trades, errors, rejects at opening or closing, and days; a user is a fold."""
    kind = F.when(F.col("value") < 1, "error").when(F.col("value") < 20, "reject").when(F.col("value") > 80, "reject").when(F.col("value") > 50, "trade").otherwise("day")
    path = F.when((F.col("value") >= 1) & (F.col("value") < 20), "open").when(F.col("value") > 80, "close")
    return table(s, d, "events").select(F.col("event_type").alias("scenario"), kind.alias("kind"), F.col("user_id").alias("fold_index"), path.alias("path"), F.concat_ws(" ", F.lit("user"), F.col("user_id") % 3).alias("reason"))


RUNS_SQL = "SELECT event_type AS scenario, CASE WHEN value < 1 THEN 'error' WHEN value < 20 OR value > 80 THEN 'reject' WHEN value > 50 THEN 'trade' ELSE 'day' END AS kind, user_id AS fold_index, CASE WHEN value >= 1 AND value < 20 THEN 'open' WHEN value > 80 THEN 'close' END AS path, 'user ' || (user_id % 3) AS reason FROM events"


@query("A12_scenario_totals", f"SELECT scenario, count(*) FILTER (kind = 'trade') AS n_trades, count(DISTINCT fold_index) AS n_folds, count(DISTINCT fold_index) FILTER (kind = 'error') AS n_failed FROM ({RUNS_SQL}) GROUP BY 1")
def _(s, d):
    return rs.scenario_totals(event_runs(s, d))


GATES = {"1": "vanilla", "2": "IV_percentile", "3": "HMM"}


@query("A14_ablation_pivot", "SELECT o_orderstatus AS strategy, " + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderpriority LIKE '{k}%'), 4) AS {g}_sharpe, nullif(count(*) FILTER (o_orderpriority LIKE '{k}%'), 0) AS {g}_n_trades" for k, g in GATES.items()) + " FROM orders WHERE o_orderpriority < '4' GROUP BY 1")
def _(s, d):
    own = table(s, d, "orders").where("o_orderpriority < '4'")
    gate = F.create_map(*(F.lit(x) for pair in GATES.items() for x in pair))[F.substring("o_orderpriority", 1, 1)]
    summary = own.groupBy(F.concat_ws("_", "o_orderstatus", gate).alias("scenario")).agg(F.avg("o_totalprice").alias("sharpe"), F.count("*").alias("n_trades"))
    return rounded(st.ablation(summary), *(f"{g}_sharpe" for g in GATES.values()), places=4)


@query("A15_settle_pivot", CH + ", one AS (SELECT * FROM chain WHERE date = (SELECT min(date) FROM chain)), e AS (SELECT min(expiry) AS e FROM one) SELECT strike, max(CASE WHEN option_type = 'call' THEN settle END) AS call, max(CASE WHEN option_type = 'put' THEN settle END) AS put FROM one, e WHERE expiry = e GROUP BY 1")
def _(s, d):
    own = chain(s, d)
    first = own.agg(F.min(F.struct("date", "expiry")).alias("f"))
    one = own.join(F.broadcast(first), (F.col("date") == F.col("f.date")) & (F.col("expiry") == F.col("f.expiry")))
    return one.groupBy("strike").pivot("option_type", ["call", "put"]).agg(F.first("settle"))


SVI = {"a": "(0.01 + 0.0001 * dte)", "b": "0.1", "rho": "(-0.4)", "m": "0.02", "sigma": "0.1"}
SVI_W = x.svi("k", *(SVI[n] for n in ("a", "b", "rho", "m", "sigma")))
SVI_1 = x.svi_first("k", SVI["b"], SVI["rho"], SVI["m"], SVI["sigma"])
SVI_2 = x.svi_second("k", SVI["b"], SVI["m"], SVI["sigma"])


def _doubles(text: str) -> str:
    """The same text with double literals, for Spark."""
    for v in ("0.01", "0.0001", "0.1", "0.4", "0.02"):
        text = text.replace(f"({v} ", f"({x.num(float(v))} ").replace(f" {v} *", f" {x.num(float(v))} *").replace(f"(-{v})", x.num(-float(v)))
    return text


@query("A17_arbitrage_pass_rate", CH + f", g AS (SELECT DISTINCT expiry, dte, date FROM chain), k AS (SELECT *, CAST(i AS DOUBLE) / 20 AS k FROM g, (SELECT unnest(range(-20, 21)) AS i)), w AS (SELECT *, {SVI_W} AS w, {SVI_1} AS w1, {SVI_2} AS w2 FROM k) SELECT date, expiry, round(avg(CASE WHEN {x.butterfly('k', 'w', 'w1', 'w2')} >= 0 THEN 1.0 ELSE 0.0 END), 9) AS pass_rate FROM w GROUP BY 1, 2")
def _(s, d):
    grid = chain(s, d).select("date", "expiry", "dte").distinct().withColumn("i", F.explode(F.sequence(F.lit(-20), F.lit(20)))).withColumn("k", F.col("i").cast("double") / 20)
    w = grid.withColumns({"w": F.expr(SVI_W), "w1": F.expr(SVI_1), "w2": F.expr(SVI_2)}).withColumns({n: F.col(n).cast("double") for n in ("w", "w1", "w2")})
    ok = F.expr(x.butterfly("k", "w", "w1", "w2")) >= 0
    return w.groupBy("date", "expiry").agg(F.round(F.avg(F.coalesce(ok, F.lit(False)).cast("double")), 9).alias("pass_rate"))


@query("A18_temporal_drift", CH + ", r AS (SELECT date, stddev_samp(iv) AS rmse FROM chain GROUP BY 1), k AS (SELECT *, dense_rank() OVER (ORDER BY date) / count(*) OVER () <= 0.8 AS early FROM r) SELECT round(median(rmse) FILTER (early), 8) AS early_rmse, round(median(rmse) FILTER (NOT early), 8) AS late_rmse, round(median(rmse) FILTER (NOT early) / median(rmse) FILTER (early), 6) AS ratio FROM k")
def _(s, d):
    from strikeflow.operators.monitor import drift

    return rounded(drift(chain(s, d).groupBy("date").agg(F.stddev_samp("iv").alias("rmse"))).withColumn("ratio", F.round("ratio", 6)), "early_rmse", "late_rmse", places=8)


@query("A20_position_greeks", CH + f", pos AS (SELECT date, expiry, strike, option_type, CASE WHEN option_type = 'call' THEN -1 ELSE 2 END AS qty FROM chain WHERE strike = 17000), c AS (SELECT p.*, c.underlying, c.iv, c.dte FROM pos p JOIN chain c USING (date, expiry, strike, option_type)), {priced_sql('c')} SELECT date, round(sum(qty * 50 * {x.delta('t', x.num(DIVIDEND), 'option_type', 'd1')}), 5) AS delta, round(sum(qty * 50 * {x.gamma('underlying', 't', x.num(DIVIDEND), 'iv', 'd1')}), 8) AS gamma, round(sum(qty * 50 * {x.theta('underlying', 'strike', 't', RISK_FREE, x.num(DIVIDEND), 'iv', 'option_type', 'd1', 'd2')}), 1) AS theta, round(sum(qty * 50 * {x.vega('underlying', 't', x.num(DIVIDEND), 'd1')}), 2) AS vega FROM p GROUP BY 1")
def _(s, d):
    own = chain(s, d)
    pos = own.where("strike = 17000").select(*KEY, F.when(F.col("option_type") == "call", -1).otherwise(2).alias("qty"))
    g = ops.position_greeks(pos, own)
    return g.select("date", F.round("delta", 5).alias("delta"), F.round("gamma", 8).alias("gamma"), F.round("theta", 1).alias("theta"), F.round("vega", 2).alias("vega"))


@query("A21_rejected_reasons", f"SELECT scenario, path, reason, count(*) AS n FROM ({RUNS_SQL}) WHERE kind = 'reject' GROUP BY 1, 2, 3")
def _(s, d):
    own = event_runs(s, d)
    return rs.rejected(own.where("path = 'open'"), own.where("path = 'close'"))


@query("A22_sharpe_difference", f"WITH {PNL}, s AS ({PRICED.format(cost='0.0')}), e AS (SELECT min(scenario) AS one, max(scenario) AS other FROM s), t AS (SELECT (SELECT sharpe FROM s, e WHERE scenario = one) AS one, (SELECT sharpe FROM s, e WHERE scenario = other) AS other) SELECT round(one, 6) AS one, round(other, 6) AS other, round(abs(one - other) / greatest(abs(one), abs(other)), 6) AS gap, abs(one - other) / greatest(abs(one), abs(other)) < 0.30 AS passed FROM t")
def _(s, d):
    summary = priced_summary(s, d, 0.0)
    one, other = summary.agg(F.min("scenario"), F.max("scenario")).first()
    return rounded(rs.sharpe_gap(summary, one, other), "one", "other", "gap")


# windows

CONTRACT_W = "PARTITION BY expiry, strike, option_type ORDER BY date"


@query("W01_lag_change", CH + f"SELECT date, expiry, strike, option_type, round(settle - lag(settle) OVER w, 6) AS change, round(CASE WHEN lag(settle) OVER w > 1 THEN (settle - lag(settle) OVER w) / lag(settle) OVER w END, 9) AS change_pct FROM chain WINDOW w AS ({CONTRACT_W})")
def _(s, d):
    last = F.lag("settle").over(Window.partitionBy("expiry", "strike", "option_type").orderBy("date"))
    change = F.col("settle") - last
    return chain(s, d).select(*KEY, F.round(change, 6).alias("change"), F.round(F.when(last > 1, F.try_divide(change, last)), 9).alias("change_pct"))


@query("W02_running_extremes", CH + f"SELECT date, expiry, strike, option_type, max(settle) OVER w AS high, min(settle) OVER w AS low FROM chain WINDOW w AS ({CONTRACT_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(s, d):
    w = Window.partitionBy("expiry", "strike", "option_type").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return chain(s, d).select(*KEY, F.max("settle").over(w).alias("high"), F.min("settle").over(w).alias("low"))


CUM = f"WITH {PNL}, cum AS (SELECT *, sum(pnl) OVER (PARTITION BY scenario ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM pnl), dd AS (SELECT *, greatest(max(cum) OVER (PARTITION BY scenario ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS peak FROM cum)"


@query("W03_W04_cumulative_drawdown", CUM + " SELECT date, scenario, round(cum, 4) AS cum, round(peak, 4) AS peak, round(cum - peak, 4) AS drawdown FROM dd")
def _(s, d):
    return rounded(st.cumulative(pnl(s, d), ["scenario"]).select("date", "scenario", "cum", "peak", "drawdown"), "cum", "peak", "drawdown", places=4)


@query("W05_log_returns", RETURNS + " SELECT date, round(ret, 9) AS ret FROM returns")
def _(s, d):
    return rounded(log_returns(fixture.spot(s, d)), "ret", places=9)


WIDE = f"WITH {fixture.SPOT_SQL}, returns AS (SELECT date, r AS ret FROM (SELECT date, ln(underlying / lag(underlying) OVER (ORDER BY date)) AS r FROM spot) WHERE r IS NOT NULL), vols AS (SELECT date, row_number() OVER (ORDER BY date) AS n, CASE WHEN count(*) OVER f = 30 THEN stddev_samp(ret) OVER f * sqrt(252) END AS vol FROM returns WINDOW f AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), bars AS (SELECT *, quantile_cont(vol, 0.3) OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS bar FROM vols)"


def wide_returns(s, d):
    return log_returns(fixture.spot(s, d))


@query("W06_rolling_volatility", WIDE + " SELECT date, round(vol, 8) AS vol FROM vols")
def _(s, d):
    return rounded(realised_vol(wide_returns(s, d)).select("date", "vol"), "vol", places=8)


@query("W07_G01_volatility_percentile_gate", WIDE + " SELECT date, coalesce(n >= 282 AND vol >= bar, false) AS active, round(bar, 8) AS bar FROM bars")
def _(s, d):
    return rounded(vol_percentile_gate(wide_returns(s, d)).select("date", "active", "bar"), "bar", places=8)


@query("W09_daily_difference", CUM + " SELECT date, scenario, round(cum - coalesce(lag(cum) OVER (PARTITION BY scenario ORDER BY date), 0), 4) AS daily FROM cum")
def _(s, d):
    c = st.cumulative(pnl(s, d), ["scenario"])
    return c.select("date", "scenario", F.round(F.col("cum") - F.coalesce(F.lag("cum").over(Window.partitionBy("scenario").orderBy("date")), F.lit(0.0)), 4).alias("daily"))


@query("W10_equity_drawdown", CUM + " SELECT scenario, round(max((peak - cum) / (10000 + peak)), 8) AS max_dd_pct FROM dd GROUP BY 1")
def _(s, d):
    c = st.cumulative(pnl(s, d), ["scenario"])
    return c.groupBy("scenario").agg(F.round(F.max((F.col("peak") - F.col("cum")) / (10000 + F.col("peak"))), 8).alias("max_dd_pct"))


# selection and sorting


@query("T01_select_by_delta", CH + PICK.format(t=0.16, more="", src="chain", kind="call", where=" AND dte BETWEEN 23 AND 37", after=" AND abs(delta - 0.16) <= 0.05"))
def _(s, d):
    return ops.select_by_delta(ops.filter_by_dte(chain(s, d), 23, 37), 0.16, "call", 0.05).select("date", "expiry", "strike", "delta")


@query("T02_select_by_absolute_delta", CH + "SELECT date, option_type, expiry, strike FROM (SELECT *, row_number() OVER (PARTITION BY date, option_type ORDER BY abs(abs(delta) - 0.25), expiry, strike) AS rn FROM chain) WHERE rn = 1")
def _(s, d):
    away = F.struct(F.abs(F.abs("delta") - 0.25), "expiry", "strike")
    return chain(s, d).groupBy("date", "option_type").agg(F.min_by(F.struct("expiry", "strike"), away).alias("r")).select("date", "option_type", "r.*")


@query("T03_at_the_money_pair", CH + f", {PAIRS}, {ATM} SELECT date, expiry, strike FROM atm")
def _(s, d):
    return ops.atm_pair(chain(s, d)).select("date", "expiry", "strike")


@query("T04_first_per_key", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(s, d):
    own = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n = own.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return ops.first_per_key(own, ["l_orderkey", "l_linenumber"]).join(n, ["l_orderkey", "l_linenumber"])


@query("T06_sorted_output", CH + "SELECT date, expiry, count(*) AS n FROM chain GROUP BY 1, 2 ORDER BY date, expiry")
def _(s, d):
    return chain(s, d).groupBy("date", "expiry").agg(F.count("*").alias("n")).orderBy("date", "expiry")


@query("T07_most_liquid", CH + "SELECT date, expiry, strike, option_type, volume FROM chain ORDER BY volume DESC, date, expiry, strike, option_type LIMIT 20")
def _(s, d):
    return chain(s, d).orderBy(F.desc("volume"), *KEY).limit(20).select(*KEY, "volume")


@query("T08_evenly_spaced_dates", CH + ", days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM chain)) SELECT DISTINCT date FROM days JOIN (SELECT unnest(range(0, 10)) AS k) ON i = (k * (n - 1)) // 9")
def _(s, d):
    from strikeflow.operators.monitor import evenly_spaced

    return evenly_spaced(chain(s, d).select("date").distinct(), 10)


# sets


@query("U01_union_of_shards", CH + "SELECT month(date) AS month, count(*) AS n FROM chain GROUP BY 1")
def _(s, d):
    from strikeflow.sources import shards

    own = chain(s, d).withColumn("month", F.month("date"))
    return shards.union([own.where(F.col("month") == m) for m in range(1, 13)]).groupBy("month").agg(F.count("*").alias("n"))


@query("U03_strike_intersection", CH + "SELECT date, expiry, count(*) AS n FROM (SELECT date, expiry, strike FROM chain WHERE option_type = 'call' AND bid IS NOT NULL INTERSECT SELECT date, expiry, strike FROM chain WHERE option_type = 'put' AND close IS NOT NULL) GROUP BY 1, 2")
def _(s, d):
    own, k = chain(s, d), ["date", "expiry", "strike"]
    both = own.where("option_type = 'call' AND bid IS NOT NULL").select(*k).intersect(own.where("option_type = 'put' AND close IS NOT NULL").select(*k))
    return both.groupBy("date", "expiry").agg(F.count("*").alias("n"))


@query("U05_distinct_expiries", CH + "SELECT DISTINCT expiry FROM chain")
def _(s, d):
    return chain(s, d).select("expiry").distinct()


# scalar functions


@query("H01_enum_map", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'call' WHEN 1 THEN 'put' ELSE 'other' END AS kind FROM nation")
def _(s, d):
    names = F.create_map(F.lit(0), F.lit("call"), F.lit(1), F.lit("put"))
    return table(s, d, "nation").select("n_nationkey", F.coalesce(F.try_element_at(names, F.col("n_regionkey")), F.lit("other")).alias("kind"))


@query("H03_compact_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS contract_date FROM orders")
def _(s, d):
    number = F.when(F.col("o_orderkey") % 10 == 0, F.lit(20249999.0)).otherwise(F.date_format("o_orderdate", "yyyyMMdd").cast("double"))
    return table(s, d, "orders").select("o_orderkey", dates.compact_date(number).alias("contract_date"))


@query("H04_monthly_calendar", "WITH span AS (SELECT CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP) AS lo, CAST(date_trunc('month', max(o_orderdate)) AS TIMESTAMP) AS hi FROM orders), m AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS f FROM span) SELECT f AS month, CAST(f + CAST((3 - dayofweek(f) + 7) % 7 + 14 AS INTEGER) AS DATE) AS expiry FROM m")
def _(s, d):
    span = table(s, d, "orders").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    return dates.monthly_calendar(span, "lo", "hi")


@query("H05_iso_dates", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS ok FROM orders")
def _(s, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 != 0, iso).when(F.col("o_orderkey") % 2 == 0, F.lit("2024-13-01")).otherwise(F.replace(iso, F.lit("-"), F.lit("/")))
    return table(s, d, "orders").select("o_orderkey", dates.is_iso_date(text).alias("ok"))


@query("H06_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"a\":' || CAST(event_id AS VARCHAR) || ',\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS canonical FROM events")
def _(s, d):
    k = F.from_json("props", "k bigint")["k"]
    both = F.map_from_arrays(F.array(F.lit("k"), F.lit("a")), F.array(k, F.col("event_id")))
    return table(s, d, "events").select("event_id", k.alias("k"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both)))).alias("canonical"))


@query("H07_round_to_grid", "SELECT o_orderkey, CAST(round_even(CAST(o_orderkey * 25 AS DOUBLE) / 50, 0) * 50 AS DOUBLE) AS strike FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", dates.to_grid((F.col("o_orderkey") * 25).cast("double"), 50).alias("strike"))


@query("H08_map_merge", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'base' END AS tag, n_regionkey IN (1, 3) AS held FROM nation")
def _(s, d):
    base, more = F.create_map(F.lit("tag"), F.lit("base")), F.create_map(F.lit("other"), F.lit("x"))
    merged = F.when(F.col("n_nationkey") % 2 == 0, F.map_from_entries(F.array(F.struct(F.lit("tag"), F.lit("even"))))).otherwise(F.map_concat(base, more))
    return table(s, d, "nation").select("n_nationkey", merged["tag"].alias("tag"), F.array_contains(F.array(F.lit(1), F.lit(3)), F.col("n_regionkey")).alias("held"))


# mathematics


_Z = "((CAST(l_extendedprice AS DOUBLE) - 5.0e4) / 1.0e4)"


@query("M01_normal_distribution", f"SELECT l_orderkey, l_linenumber, round({x.norm_cdf(_Z)}, 10) AS cdf, round({x.norm_pdf(_Z)}, 10) AS pdf FROM lineitem")
def _(s, d):
    z = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_extendedprice").cast("double") - 50000) / 10000).alias("z"))
    return z.select("l_orderkey", "l_linenumber", F.round(F.expr(x.norm_cdf("z")), 10).alias("cdf"), F.round(F.expr(x.norm_pdf("z")), 10).alias("pdf"))


@query("M02_price", CH + f", {priced_sql('chain')} SELECT date, expiry, strike, option_type, round(price, 6) AS price FROM p")
def _(s, d):
    return rounded(bsm.price(chain(s, d)).select(*KEY, "price"), "price")


_Q = x.num(DIVIDEND)


@query("M04_greeks", CH + f", {priced_sql('chain')} SELECT date, expiry, strike, option_type, round({x.delta('t', _Q, 'option_type', 'd1')}, 8) AS delta, round({x.gamma('underlying', 't', _Q, 'iv', 'd1')}, 9) AS gamma, round({x.vega('underlying', 't', _Q, 'd1')}, 4) AS vega, round({x.theta('underlying', 'strike', 't', RISK_FREE, _Q, 'iv', 'option_type', 'd1', 'd2')}, 4) AS theta, round({x.rho('strike', 't', RISK_FREE, 'option_type', 'd2')}, 4) AS rho FROM p")
def _(s, d):
    g = bsm.greeks(chain(s, d))
    return g.select(*KEY, F.round("delta", 8).alias("delta"), F.round("gamma", 9).alias("gamma"), *(F.round(n, 4).alias(n) for n in ("vega", "theta", "rho")))


BOUND = f"greatest(CASE WHEN option_type = 'call' THEN 1 ELSE -1 END * (underlying * exp(-{_Q} * dte / 365) - strike * exp(-{x.num(RISK_FREE)} * dte / 365)), 0)"


EASY = f"settle - {BOUND} > 0.05"


@query("M03_M05_implied_volatility", CH + f"SELECT date, expiry, strike, option_type, CASE WHEN {EASY} THEN {PICKED} END AS iv_source, CASE WHEN {EASY} THEN true END AS recovered, true AS sound FROM chain")
def _(s, d):
    from strikeflow.operators.implied_vol import add_iv

    # where next to no time value is left, a price says nothing about volatility: there only what the solver says of itself is checked
    own = add_iv(chain(s, d).withColumnRenamed("iv", "true_iv")).withColumn("easy", F.expr(EASY))
    # a price at its lower bound (within 1e-10 for the solver) has volatility 0, no other has
    at_bound = F.abs(F.coalesce((F.col("bid") + F.col("ask")) / 2, F.col("settle")) - F.expr(BOUND)) < 1e-9
    sound = F.col("iv_source").isin("mid", "settle") == F.coalesce((F.col("iv") > 0) | ((F.col("iv") == 0) & at_bound), F.lit(False))
    return own.select(*KEY, F.when(F.col("easy"), F.col("iv_source")).alias("iv_source"), F.when(F.col("easy"), F.coalesce(F.abs(F.col("iv") - F.col("true_iv")) < 1e-3, F.lit(False))).alias("recovered"), sound.alias("sound"))


@query("M07_implied_yield", CH + f", {PAIRS}, {ATM}, q AS (SELECT date, c, p, -ln((c - p + strike * exp(-0.015 * (expiry - date) / 365.0)) / underlying) / ((expiry - date) / 365.0) AS q FROM atm) SELECT date, round(q, 7) AS q_pit, CASE WHEN q IS NULL THEN 'solve_failed' ELSE 'pcp' END AS q_pit_source, CASE WHEN c IS NULL OR p IS NULL THEN 'missing_quote' WHEN q IS NULL THEN 'pcp_invalid' WHEN q < 0 THEN 'negative_q' WHEN q > 0.15 THEN 'out_of_range' ELSE 'ok' END AS q_pit_audit_flags FROM q")
def _(s, d):
    return rounded(ops.implied_yield(chain(s, d)), "q_pit", places=7)


@query("M08_M09_svi_butterfly", CH + f", k AS (SELECT date, expiry, strike, option_type, dte, ln(strike / underlying) AS k FROM chain), w AS (SELECT *, {SVI_W} AS w, {SVI_1} AS w1, {SVI_2} AS w2 FROM k) SELECT date, expiry, strike, option_type, round(w, 9) AS w, round({x.butterfly('k', 'w', 'w1', 'w2')}, 7) AS g FROM w")
def _(s, d):
    own = chain(s, d).withColumn("k", F.log(F.col("strike") / F.col("underlying")))
    w = own.withColumns({n: F.expr(t).cast("double") for n, t in (("w", SVI_W), ("w1", SVI_1), ("w2", SVI_2))})
    return w.select(*KEY, F.round("w", 9).alias("w"), F.round(F.expr(x.butterfly("k", "w", "w1", "w2")), 7).alias("g"))


SABR = x.sabr("underlying", "strike", "t", x.num(0.18), x.num(-0.35), x.num(0.9))


@query("M11_sabr", CH + f"SELECT date, expiry, strike, option_type, round({SABR}, 8) AS vol FROM (SELECT *, CAST(dte AS DOUBLE) / {x.num(365)} AS t FROM chain)")
def _(s, d):
    return chain(s, d).withColumn("t", F.col("dte").cast("double") / 365).select(*KEY, F.round(F.expr(SABR), 8).alias("vol"))


@query("M13_polynomial_smile", CH + ", sm AS (SELECT date, expiry, strike, median(iv) AS iv, ln(strike / median(underlying)) AS k FROM chain GROUP BY 1, 2, 3), z AS (SELECT date, expiry, count(*)::DOUBLE AS n, sum(k) AS s1, sum(k*k) AS s2, sum(k*k*k) AS s3, sum(k*k*k*k) AS s4, sum(iv) AS y0, sum(k*iv) AS y1, sum(k*k*iv) AS y2 FROM sm GROUP BY 1, 2), t AS (SELECT *, n*(s2*s4-s3*s3)-s1*(s1*s4-s3*s2)+s2*(s1*s3-s2*s2) AS det FROM z) SELECT date, expiry, CAST(n AS BIGINT) AS n, round((y0*(s2*s4-s3*s3)-s1*(y1*s4-s3*y2)+s2*(y1*s3-s2*y2))/det, 5) AS c0, round((n*(y1*s4-s3*y2)-y0*(s1*s4-s3*s2)+s2*(s1*y2-y1*s2))/det, 5) AS c1, round((n*(s2*y2-y1*s3)-s1*(s1*y2-y1*s2)+y0*(s1*s3-s2*s2))/det, 4) AS c2 FROM t")
def _(s, d):
    from strikeflow.operators.surface import poly_coefficients

    p = poly_coefficients(chain(s, d))
    return p.select("date", "expiry", "n", F.round("c0", 5).alias("c0"), F.round("c1", 5).alias("c1"), F.round("c2", 4).alias("c2"))


RECORDS = "SELECT DISTINCT date, expiry, dte, CASE month(expiry) % 3 WHEN 0 THEN 'svi' WHEN 1 THEN 'sabr' ELSE 'poly' END AS model_type FROM chain WHERE day(date) % 2 = 0"


def records(s, d):
    """Made-up fit records of all three models, for half of the dates."""
    own = chain(s, d).where("day(date) % 2 = 0").groupBy("date", "expiry", "dte").agg(F.first("underlying").alias("forward"))
    m = F.month("expiry") % 3
    lit = lambda v: F.lit(float(v))
    make = lambda *kv: F.create_map(*(c for k, v in kv for c in (F.lit(k), v)))
    params = F.when(m == 0, make(("a", lit(0.001)), ("b", lit(0.02)), ("rho", lit(-0.4)), ("m", lit(0.02)), ("sigma", lit(0.1)))).when(m == 1, make(("F", F.col("forward")), ("alpha", lit(0.18)), ("rho", lit(-0.35)), ("nu", lit(0.9)))).otherwise(make(("c0", lit(0.18)), ("c1", lit(-0.3)), ("c2", lit(0.4))))
    kind = F.when(m == 0, "svi").when(m == 1, "sabr").otherwise("poly")
    return own.select("date", "expiry", kind.alias("model_type"), F.lit(True).alias("converged"), F.lit(41).cast("long").alias("n_points"), F.lit(0.001).alias("in_sample_rmse"), "forward", (F.col("dte").cast("double") / 365).alias("t"), params.alias("params"))


CONVERGED, RMSE = "(day(date) % 5 <> 1)", "(dte * 0.00001 + month(date) * 0.0001)"


def mixed_records(s, d):
    """Made-up records with errors of their own, some not converged."""
    return records(s, d).withColumns({"converged": F.day("date") % 5 != 1, "in_sample_rmse": F.datediff("expiry", "date") * F.lit(0.00001) + F.month("date") * F.lit(0.0001)})


@query("A04_model_breakdown", CH + f", rec AS ({RECORDS}) SELECT model_type, count(*) AS n, count(*) FILTER (converged) AS n_converged, round(median(rmse), 9) AS median_rmse, round(avg(CASE WHEN converged THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT model_type, {CONVERGED} AS converged, {RMSE} AS rmse FROM rec) GROUP BY 1")
def _(s, d):
    return rounded(rs.model_breakdown(mixed_records(s, d)), "rate").withColumn("median_rmse", F.round("median_rmse", 9))


@query("A05_converged_median", CH + f", rec AS ({RECORDS}) SELECT round(median({RMSE}), 9) AS median_rmse, count(*) AS n FROM rec WHERE {CONVERGED}")
def _(s, d):
    return rounded(rs.converged_error(mixed_records(s, d)), "median_rmse", places=9)


_SVI_IV = f"sqrt({x.svi('k', x.num(0.001), x.num(0.02), x.num(-0.4), x.num(0.02), x.num(0.1))}/t0)"
_SABR_IV = x.sabr("underlying", "(underlying*exp(k))", "t0", x.num(0.18), x.num(-0.35), x.num(0.9))


@query("M17_M18_model_price", CH + f", rec AS ({RECORDS}), j AS (SELECT c.*, r.model_type, ln(strike / underlying) AS k, CAST(c.dte AS DOUBLE) / {x.num(365)} AS t0 FROM chain c LEFT JOIN rec r ON c.date = r.date AND c.expiry = r.expiry), v AS (SELECT * EXCLUDE (iv), CASE model_type WHEN 'svi' THEN {_SVI_IV} WHEN 'sabr' THEN {_SABR_IV} WHEN 'poly' THEN 0.18 - 0.3 * k + 0.4 * k * k END AS iv FROM j), {priced_sql('v')} SELECT date, expiry, strike, option_type, round(price, 5) AS model_price FROM p")
def _(s, d):
    from strikeflow.operators.surface import add_model_price

    return rounded(add_model_price(chain(s, d), records(s, d)).select(*KEY, "model_price"), "model_price", places=5)


FAULTS = {1: "negative point count", 2: "converged without error", 3: "wrong parameters", 4: "expiry before date", 5: "unknown model", 6: "no positive time or forward", 7: "parameters without convergence"}
_FAULT = " ".join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items())


@query("M16_record_validation", CH + f", rec AS ({RECORDS}) SELECT model_type, CASE day(date) // 2 % 9 {_FAULT} WHEN 8 THEN CASE WHEN model_type <> 'poly' THEN 'outside the domain' END END AS problem, count(*) AS n FROM rec GROUP BY 1, 2")
def _(s, d):
    from strikeflow.operators.surface import record_problem

    own = records(s, d).withColumns({"kind": F.col("model_type"), "fault": (F.day("date") / 2).cast("int") % 9})
    at = lambda k, bad, c: F.when(F.col("fault") == k, bad).otherwise(F.col(c))
    spoiled = F.transform_values("params", lambda k, v: F.when((k == "rho") & (F.col("fault") == 8), F.lit(1.5)).otherwise(v))
    spoiled = F.when(F.col("fault") == 3, F.map_filter(spoiled, lambda k, _: ~k.isin("a", "alpha", "c0"))).otherwise(spoiled)
    own = own.withColumns({"n_points": at(1, F.lit(-1).cast("long"), "n_points"), "in_sample_rmse": at(2, F.lit(None), "in_sample_rmse"), "params": spoiled, "expiry": at(4, F.date_sub("date", 1), "expiry"), "model_type": at(5, F.lit("spline"), "model_type"), "t": at(6, F.lit(0.0), "t"), "converged": at(7, F.lit(False), "converged")})
    return own.groupBy(F.col("kind").alias("model_type"), record_problem().alias("problem")).agg(F.count("*").alias("n"))


@query("M19_intrinsic", CH + "SELECT date, expiry, strike, option_type, round(CASE WHEN option_type = 'call' THEN greatest(underlying - strike, 0) ELSE greatest(strike - underlying, 0) END, 9) AS payoff FROM chain")
def _(s, d):
    return chain(s, d).select(*KEY, F.round(F.expr(x.intrinsic("underlying", "strike", "option_type")), 9).alias("payoff"))


# fills, strategies, risk


def fills_sql(price: str) -> str:
    return CH + f", o AS (SELECT date, expiry, strike, option_type, side, bid, ask, settle FROM chain, (VALUES ('buy'), ('sell')) v(side)), f AS (SELECT *, ({price}) AS raw FROM o), g AS (SELECT *, raw * CASE WHEN side = 'sell' THEN 1 - 0.0015 ELSE 1 + 0.0015 END AS px FROM f) SELECT date, side, count(px) AS n_filled, count(*) - count(px) AS n_refused, round(sum(px), 2) AS paid, round(sum(CASE WHEN px IS NOT NULL THEN abs(px) * 50 * 2 * 0.001 END), 3) AS tax FROM g GROUP BY 1, 2"


_FILLS = {
    "settle": ("settle", {}),
    "mid": ("(bid + ask) / 2", {}),
    "worst": ("CASE WHEN side = 'sell' THEN bid ELSE ask END", {}),
    "slippage": ("(bid + ask) / 2 * CASE WHEN side = 'sell' THEN 1 - 0.001 ELSE 1 + 0.001 END", {}),
    "slippage_settle": ("CASE WHEN side = 'sell' AND bid IS NOT NULL OR side = 'buy' AND ask IS NOT NULL THEN settle END * CASE WHEN side = 'sell' THEN 1 - 0.001 ELSE 1 + 0.001 END", {"base": "settle"}),
}
for _name, (_price, _more) in _FILLS.items():

    @query(f"B07_B09_fill_{_name}", fills_sql(_price))
    def _(s, d, name=_name, more=_more):
        orders = chain(s, d).withColumn("side", F.explode(F.array(F.lit("buy"), F.lit("sell")))).withColumn("qty", F.lit(2))
        f = ops.with_fill(orders, name.split("_")[0], commission=12.0, tax_bps=10.0, slip_bps=15.0, **more)
        return f.groupBy("date", "side").agg(F.count("fill_price").alias("n_filled"), F.count_if(F.col("status") == "not_executable").alias("n_refused"), F.round(F.sum("fill_price"), 2).alias("paid"), F.round(F.sum("tax"), 3).alias("tax"))


CONDOR_JOIN = " FROM short_call sc JOIN long_call lc USING (date) JOIN short_put sp USING (date) JOIN long_put lp USING (date) WHERE lc.strike > sc.strike AND lp.strike < sp.strike"
CREDITS = "round(sc.settle + sp.settle - lc.settle - lp.settle, 6) AS settle_credit, round((sc.bid + sc.ask) / 2 + (sp.bid + sp.ask) / 2 - (lc.bid + lc.ask) / 2 - (lp.bid + lp.ask) / 2, 6) AS mid_credit, round(sc.bid + sp.bid - lc.ask - lp.ask, 6) AS worst_credit, round((greatest(lc.strike - sc.strike, sp.strike - lp.strike) - (sc.bid + sp.bid - lc.ask - lp.ask)) * 50, 4) AS max_defined_risk"


@query("X01_iron_condor", CH + legs_sql(CONDOR_LEGS, 23, 37) + f" SELECT date, sc.strike AS short_call, lc.strike AS long_call, sp.strike AS short_put, lp.strike AS long_put, {CREDITS}" + CONDOR_JOIN)
def _(s, d):
    c = ops.iron_condors(chain(s, d), 0.16, 0.08, 30)
    return c.select("date", *(F.col(n)["strike"].alias(n) for n in CONDOR_LEGS), *(F.round(n, 6).alias(n) for n in ("settle_credit", "mid_credit", "worst_credit")), F.round("max_defined_risk", 4).alias("max_defined_risk"))


SKEW = legs_sql({"c": (0.25, "call"), "p": (-0.25, "put")}, 38, 52) + ", sk AS (SELECT date, p.iv - c.iv AS skew FROM c JOIN p USING (date)), sd AS (SELECT date, skew, CASE WHEN skew > 0.01 THEN 'bull_put' WHEN skew < -0.01 THEN 'bear_call' ELSE 'none' END AS side FROM sk)"


@query("X05_skew", CH + SKEW + " SELECT date, round(skew, 7) AS skew, side FROM sd")
def _(s, d):
    return rounded(ops.skews(chain(s, d), 0.25, 45), "skew", places=7)


_SPREAD = "SELECT date, side, {a}.strike AS short_strike, {b}.strike AS long_strike, round({a}.settle - {b}.settle, 6) AS settle_credit, round({a}.bid - {b}.ask, 6) AS worst_credit FROM sd JOIN {a} USING (date) JOIN {b} USING (date) WHERE side = '{side}' AND {b}.strike {than} {a}.strike"


@query("X06_vertical", CH + SKEW + legs_sql({"ss": (-0.25, "put"), "ll": (-0.10, "put"), "cs": (0.25, "call"), "cl": (0.10, "call")}, 38, 52) + " " + _SPREAD.format(a="ss", b="ll", side="bull_put", than="<") + " UNION ALL " + _SPREAD.format(a="cs", b="cl", side="bear_call", than=">"))
def _(s, d):
    v = ops.verticals(chain(s, d), 0.25, 0.10, 45)
    return v.select("date", "side", F.col("short_leg.strike").alias("short_strike"), F.col("long_leg.strike").alias("long_strike"), F.round("settle_credit", 6).alias("settle_credit"), F.round("worst_credit", 6).alias("worst_credit"))


@query("X08_explicit_spread", CH + "SELECT a.date, a.expiry, round(a.settle - b.settle, 6) AS debit FROM chain a JOIN chain b ON a.date = b.date AND a.expiry = b.expiry AND a.option_type = b.option_type WHERE a.option_type = 'call' AND a.strike = 17000 AND b.strike = 17500")
def _(s, d):
    own = chain(s, d).where("option_type = 'call'")
    leg = lambda k: ops.first_per_key(own.where(F.col("strike") == float(k)), KEY).select("date", "expiry", F.col("settle").alias(f"s{k}"))
    return leg(17000).join(leg(17500), ["date", "expiry"]).select("date", "expiry", F.round(F.col("s17000") - F.col("s17500"), 6).alias("debit"))


@query("X09_calendar_hedge", CH + ", fr AS (SELECT date, min(expiry) AS front FROM chain GROUP BY 1), ex AS (SELECT date, expiry, min(underlying) AS u FROM chain GROUP BY 1, 2), b AS (SELECT * FROM (SELECT fr.date, front, expiry AS back, u, row_number() OVER (PARTITION BY fr.date ORDER BY abs(expiry - front - 30), expiry) AS rn FROM fr JOIN ex ON fr.date = ex.date AND expiry > front) WHERE rn = 1), k AS (SELECT date, front, back, round_even(u / 100, 0) * 100 AS strike FROM b) SELECT k.date, front AS front_expiry, back AS back_expiry, k.strike, round(y.settle - x.settle, 6) AS premium FROM k JOIN chain x ON x.date = k.date AND x.expiry = front AND x.strike = k.strike AND x.option_type = 'call' JOIN chain y ON y.date = k.date AND y.expiry = back AND y.strike = k.strike AND y.option_type = 'call'")
def _(s, d):
    own = chain(s, d)
    front = own.groupBy("date").agg(F.min("expiry").alias("front_expiry"))
    return rounded(ops.calendars(own, front, 30, 100).select("date", "front_expiry", "back_expiry", "strike", "premium"), "premium")


@query("R01_risk_limits", CH + legs_sql(CONDOR_LEGS, 23, 37) + ", m AS (SELECT date, (greatest(lc.strike - sc.strike, sp.strike - lp.strike) - (sc.bid + sp.bid - lc.ask - lp.ask)) * 50 AS r, day(date) % 4 AS n_open, (day(date) - 15) * 20000.0 AS pnl" + CONDOR_JOIN + ") SELECT date, CASE WHEN r > 30000 THEN 'max_loss_per_trade' WHEN r + 10000 > 35000 THEN 'max_capital_at_risk' WHEN n_open >= 3 THEN 'max_concurrent_positions' WHEN pnl <= -200000 THEN 'portfolio_loss_cap' END AS problem FROM m")
def _(s, d):
    from strikeflow.operators.monitor import risk_problem

    c = ops.iron_condors(chain(s, d), 0.16, 0.08, 30)
    day = F.day("date")
    return c.select("date", risk_problem(F.col("max_defined_risk"), max_loss=30000.0, at_risk=F.lit(10000.0), max_at_risk=35000.0, n_open=day % 4, max_open=3, pnl=(day - 15) * 20000.0, loss_cap=200000.0).alias("problem"))


GREEK_SQL = ", ".join(f"{f} AS {n}" for n, f in {"delta": x.delta("t", x.num(DIVIDEND), "option_type", "d1"), "gamma": x.gamma("underlying", "t", x.num(DIVIDEND), "iv", "d1"), "vega": x.vega("underlying", "t", x.num(DIVIDEND), "d1"), "theta": x.theta("underlying", "strike", "t", RISK_FREE, x.num(DIVIDEND), "iv", "option_type", "d1", "d2")}.items())


@query("K01_stress_pnl", CH + legs_sql(CONDOR_LEGS, 23, 37) + f""", l AS (SELECT date, expiry, strike, option_type, dte, underlying, iv, settle, -1 AS qty FROM short_call UNION ALL SELECT date, expiry, strike, option_type, dte, underlying, iv, settle, 1 FROM long_call UNION ALL SELECT date, expiry, strike, option_type, dte, underlying, iv, settle, -1 FROM short_put UNION ALL SELECT date, expiry, strike, option_type, dte, underlying, iv, settle, 1 FROM long_put),
 full_days AS (SELECT date, sum(-qty * settle) AS credit FROM l GROUP BY 1 HAVING count(*) = 4), sc AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {v}::DOUBLE, {u}::DOUBLE)" for n, v, u in SHOCKS)}) v(scenario, vs, us)),
 b AS (SELECT l.date, expiry, strike, option_type, dte, settle, qty, credit, scenario, underlying * (1 + us) AS underlying, greatest(iv + vs, 0.01) AS iv FROM l JOIN full_days USING (date), sc), {priced_sql('b')}, {priced_sql('l', out='o')},
 g AS (SELECT *, {GREEK_SQL} FROM p), h AS (SELECT *, {GREEK_SQL} FROM o),
 t AS (SELECT g.date, g.scenario, any_value(g.credit) AS credit, sum(g.qty * (greatest(g.price, 0.01) - g.settle) * 50) AS pnl, {', '.join(f"sum(g.qty * (g.{x} - h.{x})) * 50 AS {x}_change" for x in ('delta', 'gamma', 'vega', 'theta'))}
   FROM g JOIN h ON g.date = h.date AND g.expiry = h.expiry AND g.strike = h.strike AND g.option_type = h.option_type AND g.qty = h.qty GROUP BY 1, 2)
 SELECT date, scenario, round(pnl, 2) AS pnl, round(delta_change, 5) AS delta_change, round(gamma_change, 6) AS gamma_change, round(vega_change, 2) AS vega_change, round(theta_change, 2) AS theta_change, pnl <= -credit * 2 * 50 AS stopped FROM t""")
def _(s, d):
    from strikeflow.operators.monitor import stress

    own = chain(s, d)
    out = stress(own, ops.iron_condors(own, 0.16, 0.08, 30), s.createDataFrame(SHOCKS, "scenario string, vol_shift double, spot_shift double")).drop("credit")
    return rounded(rounded(rounded(out, "pnl", "vega_change", "theta_change", places=2), "delta_change", places=5), "gamma_change")


RATIOS = ", f AS (SELECT date, min(expiry) AS expiry FROM chain WHERE dte BETWEEN 25 AND 35 GROUP BY 1), fc AS (SELECT c.* FROM chain c JOIN f ON c.date = f.date AND c.expiry = f.expiry), sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(delta - (-0.16)), strike) AS rn FROM fc WHERE option_type = 'put') WHERE rn = 1), wp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(delta - (-0.08)), strike) AS rn FROM fc WHERE option_type = 'put') WHERE rn = 1), sc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(delta - (0.16)), strike) AS rn FROM fc WHERE option_type = 'call') WHERE rn = 1), wc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(delta - (0.08)), strike) AS rn FROM fc WHERE option_type = 'call') WHERE rn = 1), cr AS (SELECT sp.date, sp.settle - wp.settle + sc.settle - wc.settle AS credit FROM sp JOIN wp ON sp.date = wp.date JOIN sc ON sp.date = sc.date JOIN wc ON sp.date = wc.date), atm AS (SELECT date, strike FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(strike - underlying), strike) AS rn FROM fc) WHERE rn = 1), nr AS (SELECT fc.date, max(CASE WHEN option_type = 'call' THEN settle END) AS call, max(CASE WHEN option_type = 'put' THEN settle END) AS put FROM fc JOIN atm ON fc.date = atm.date AND fc.strike = atm.strike GROUP BY 1), l AS (SELECT date, min(expiry) AS expiry FROM chain WHERE dte BETWEEN 55 AND 65 AND option_type = 'call' GROUP BY 1), bk AS (SELECT c.date, c.settle AS back FROM chain c JOIN l ON c.date = l.date AND c.expiry = l.expiry JOIN atm ON c.date = atm.date AND c.strike = atm.strike WHERE c.option_type = 'call'), ra AS (SELECT cr.date, credit, CASE WHEN call + put > 0 THEN (call + put) / credit END AS straddle_ratio, CASE WHEN back - call > 0 THEN (back - call) / credit END AS calendar_ratio FROM cr JOIN nr ON cr.date = nr.date LEFT JOIN bk ON cr.date = bk.date WHERE credit > 0)"


@query("K03_premium_ratios", CH + RATIOS + " SELECT date, round(credit, 6) AS credit, round(straddle_ratio, 6) AS straddle_ratio, round(calendar_ratio, 6) AS calendar_ratio FROM ra")
def _(s, d):
    return rounded(fs.premium_ratios(chain(s, d)), "credit", "straddle_ratio", "calendar_ratio")


_DIST = ", ".join(f"round({f}, 6) AS {n}" for n, f in (("median", "median(r)"), ("mean", "avg(r)"), ("p10", "quantile_cont(r, 0.1)"), ("p90", "quantile_cont(r, 0.9)")))


@query("A16_premium_ratio_distribution", CH + RATIOS + f" SELECT mode, count(r) AS n, {_DIST} FROM (SELECT 'calendar' AS mode, calendar_ratio AS r FROM ra UNION ALL SELECT 'straddle', straddle_ratio FROM ra) GROUP BY 1")
def _(s, d):
    return rounded(fs.ratio_distribution(fs.premium_ratios(chain(s, d))), "median", "mean", "p10", "p90")


@query("K02_stress_entries", CH + legs_sql(CONDOR_LEGS, 21, 45, 99.0) + f" SELECT date, sc.strike AS short_call, lc.strike AS long_call, sp.strike AS short_put, lp.strike AS long_put, round((sc.bid + sc.ask) / 2 + (sp.bid + sp.ask) / 2 - (lc.bid + lc.ask) / 2 - (lp.bid + lp.ask) / 2, 6) AS mid_credit, round((greatest(lc.strike - sc.strike, sp.strike - lp.strike) - (sc.bid + sp.bid - lc.ask - lp.ask)) * 50, 4) AS max_defined_risk FROM short_call sc JOIN long_call lc USING (date) JOIN short_put sp USING (date) JOIN long_put lp USING (date)")
def _(s, d):
    e = fs.stress_entries(chain(s, d))
    return e.select("date", *(F.col(n)["strike"].alias(n) for n in CONDOR_LEGS), F.round("mid_credit", 6).alias("mid_credit"), F.round("max_defined_risk", 4).alias("max_defined_risk"))


@query("K04_decision_ladder", CH + RATIOS + f", n AS (SELECT count(DISTINCT expiry) AS k FROM chain WHERE dte BETWEEN 21 AND 63 GROUP BY date), v AS (SELECT (SELECT avg(k) FROM n) AS m, (SELECT quantile_cont(k, 0.1) FROM n) AS p, (SELECT median(calendar_ratio) FROM ra) AS c, (SELECT median(straddle_ratio) FROM ra) AS st, (SELECT count({MODEL}) / count(*) FROM chain) AS cov), w AS (SELECT unnest(['as it is', 'covered']) AS scale, unnest([1.0, 1.5]) AS f) SELECT scale, CASE WHEN m < 1 OR cov * f < 0.95 OR (c > 5 AND st > 5) THEN 'no_go' WHEN m >= 4 AND p >= 3 AND (c < 2 OR st < 2) THEN 'go_5' WHEN m >= 4 AND p >= 3 THEN 'go_5_dear' WHEN m >= 3 AND p >= 2 THEN 'go_3' ELSE 'go_1' END AS verdict FROM v, w")
def _(s, d):
    from strikeflow.operators.monitor import coverage

    own = chain(s, d).withColumn("model_price", F.expr(MODEL))
    expiries, ratios, covered = fs.expiries_per_day(own), fs.ratio_distribution(fs.premium_ratios(own)), coverage(own)
    out = [fs.decision(expiries, ratios, covered.withColumn("coverage", F.col("coverage") * f)).select(F.lit(n).alias("scale"), "verdict") for n, f in (("as it is", 1.0), ("covered", 1.5))]
    return out[0].unionByName(out[1])


# statistics


@query("Q01_Q02_sharpe", f"WITH {PNL} SELECT scenario, round((avg(pnl / 1000) - 0.015 / 252) / stddev_samp(pnl / 1000) * sqrt(252), 6) AS sharpe, round(sqrt(252) * avg(pnl + 1) / stddev_samp(pnl + 1), 6) AS plain FROM pnl GROUP BY 1")
def _(s, d):
    return pnl(s, d).withColumn("up", F.col("pnl") + 1).groupBy("scenario").agg(F.round(st.sharpe("pnl", capital=1000.0), 6).alias("sharpe"), F.round(st.plain_sharpe("up"), 6).alias("plain"))


@query("Q05_deflated_sharpe", f"WITH {PNL}, s AS (SELECT scenario, avg(pnl + 20) / stddev_samp(pnl + 20) AS sr, count(*) AS n FROM pnl GROUP BY 1), z AS (SELECT scenario, (sr - {x.num(st.expected_best(6))}) * sqrt(n - 1) / sqrt(1 + 0.5 * sr * sr) AS z FROM s) SELECT scenario, round({x.norm_cdf('z')}, 9) AS dsr FROM z")
def _(s, d):
    own = pnl(s, d).withColumn("up", F.col("pnl") + 20).groupBy("scenario").agg((F.avg("up") / F.stddev_samp("up")).alias("sr"), F.count("*").alias("n"))
    return own.select("scenario", F.round(st.deflated_sharpe("sr", 6, "n"), 9).alias("dsr"))


@query("Q06_calmar", CUM + " SELECT scenario, round(sum(pnl + 0) / 10000 * (252.0 / count(*)) / nullif(max((peak - cum) / (10000 + peak)), 0), 6) AS calmar FROM dd GROUP BY 1")
def _(s, d):
    return rounded(st.calmar(pnl(s, d), ["scenario"], 10000.0), "calmar")


@query("Q07_max_drawdown", CUM + " SELECT scenario, round(least(min(cum - peak), 0) / 10000, 8) AS max_drawdown FROM dd GROUP BY 1")
def _(s, d):
    return rounded(st.max_drawdown(pnl(s, d), ["scenario"], 10000.0), "max_drawdown", places=8)


@query("Q03_Q04_resampling", f"WITH {PNL}, {st.resampled_sql('pnl', 'scenario')}")
def _(s, d):
    return rounded(st.resampled(pnl(s, d), ["scenario"]), "ci_low", "ci_high", "observed", "p_value")


# fitted and stateful operators: checked by tests on known cases


@query("M10_M15_surface_fit")
def _(s, d):
    from strikeflow.operators.surface import fit_surface

    return fit_surface(chain(s, d))


YIELDS = """q AS (SELECT date, c, p, -ln((c - p + strike * exp(-0.015 * (expiry - date) / 365.0)) / underlying) / ((expiry - date) / 365.0) AS q FROM atm),
y AS (SELECT date, round(q, 7) AS q_pit, CASE WHEN q IS NULL THEN 'solve_failed' ELSE 'pcp' END AS q_pit_source, CASE WHEN c IS NULL OR p IS NULL THEN 'missing_quote' WHEN q IS NULL THEN 'pcp_invalid' WHEN q < 0 THEN 'negative_q' WHEN q > 0.15 THEN 'out_of_range' ELSE 'ok' END AS q_pit_audit_flags FROM q)"""


def enriched(s, d):
    from strikeflow.operators.implied_vol import enrich

    view = chain(s, d).select("date", "expiry", "strike", "option_type", "settle", "close", "bid", "ask", "volume", "open_interest")
    return enrich(view, fixture.spot(s, d))


@query("P10_enrich_checked", CH + f", {PAIRS}, {ATM}, {YIELDS} SELECT chain.date, expiry, strike, option_type, dte, round(underlying, 6) AS underlying, q_pit, q_pit_source, q_pit_audit_flags, ask IS NOT NULL AS can_buy, bid IS NOT NULL AS can_sell, CASE WHEN {EASY} THEN {PICKED} END AS iv_source, CASE WHEN {EASY} THEN true END AS iv_found, CASE WHEN {EASY} THEN true END AS delta_found FROM chain LEFT JOIN y ON y.date = chain.date")
def _(s, d):
    # the volatility and delta that the quotes were made from must come out again, where the price still tells them
    true = chain(s, d).select(*KEY, F.col("iv").alias("true_iv"), F.col("delta").alias("true_delta"))
    own = enriched(s, d).join(true, list(KEY)).withColumn("easy", F.expr(EASY))
    close = lambda a, b, most: F.when(F.col("easy"), F.coalesce(F.abs(F.col(a) - F.col(b)) < most, F.lit(False)))
    out = own.select(*KEY, "dte", F.round("underlying", 6).alias("underlying"), F.round("q_pit", 7).alias("q_pit"), "q_pit_source", "q_pit_audit_flags", "can_buy", "can_sell", F.when(F.col("easy"), F.col("iv_source")).alias("iv_source"), close("iv", "true_iv", 1e-3).alias("iv_found"), close("delta", "true_delta", 1e-3).alias("delta_found"))
    return out


@query("P10_enrich_pipeline")
def _(s, d):
    return enriched(s, d)


@query("G02_hidden_markov_gate")
def _(s, d):
    from strikeflow.operators.regime import hmm_gate

    return hmm_gate(wide_returns(s, d))


#: Where a session has written the result of a walk-forward, by session, tables and scenarios.
WALKS: dict[tuple, str] = {}


def simulated(s, d, todo=None, anew=False):
    """The published windows over all dates and all scenarios, both regime gates included; written once a session, and read by the queries that judge it."""
    from strikeflow.plans import runs
    from strikeflow.plans import simulation as sim
    from strikeflow.session import scratch

    todo = todo or sim.scenarios()
    key = (s.sparkContext.applicationId, d, tuple(x.name for x in todo))
    if anew or key not in WALKS:
        folder = scratch(s, "walk")
        own = chain(s, d).checkpoint()
        sim.walk_forward(s, own, todo, sim.fold_windows(own.select("date"), 252, 63, 63), runs.gates(fixture.spot(s, d))).write.parquet(folder)
        WALKS[key] = folder
    return s.read.schema(sim.OUT).parquet(WALKS[key])


@query("B01_B10_walk_forward")
def _(s, d):
    return simulated(s, d, anew=True)


@query("B01_B13_stream")
def _(s, d):
    from strikeflow.plans import simulation as sim
    from strikeflow.session import scratch
    from strikeflow.streaming.walk import Walk

    own, folder = chain(s, d).withColumn("model_price", F.expr(MODEL)).checkpoint(), scratch(s, "walk")
    folds = sim.fold_windows(own.select("date"), 252, 63, 63).checkpoint()
    walk = Walk(s, f"{folder}/shards", own.schema, folder, [x for x in sim.scenarios() if x.gate == "none"], folds)
    low, high = own.agg(F.min("date"), F.max("date")).first()
    # three shards, one after another
    for k in range(3):
        third = F.floor(F.datediff("date", F.lit(low)) * 3 / (F.datediff(F.lit(high), F.lit(low)) + 1))
        own.where(third == k).write.mode("append").parquet(f"{folder}/shards")
        walk.step()
    return walk.result()


@query("B11_scenario_summary")
def _(s, d):
    return st.scenario_summary(simulated(s, d), 1_000_000.0)


@query("X12_hedged_condor")
def _(s, d):
    from strikeflow.plans import simulation as sim

    return simulated(s, d, sim.hedged_scenarios(), anew=True)


@query("K12_hedge_failures")
def _(s, d):
    from strikeflow.plans import simulation as sim

    return rs.hedge_failures(simulated(s, d, sim.hedged_scenarios()))


@query("A12_A21_run_totals")
def _(s, d):
    own = simulated(s, d)
    return rs.scenario_totals(own).join(rs.rejected(own).groupBy("scenario").agg(F.sum("n").alias("n_rejected")), "scenario", "left")


@query("K05_mark_policies")
def _(s, d):
    from strikeflow.plans import runs
    from strikeflow.session import checkpoint_dir

    checkpoint_dir(s)
    return runs.mark_policies(s, chain(s, d).withColumn("model_price", F.expr(MODEL)).checkpoint())


@query("K11_scorecard")
def _(s, d):
    own = simulated(s, d)
    days = own.where("kind = 'day'").select("scenario", "date", F.col("daily_pnl").alias("pnl"))
    return rs.scorecard(st.scenario_summary(own, 1_000_000.0), st.resampled(days, ["scenario"]))


# sources and streams


@query("S07_S08_shard_round_trip", CH + "SELECT date, expiry, strike, option_type, settle FROM chain WHERE date BETWEEN DATE '1997-02-01' AND DATE '1997-02-28'")
def _(s, d):
    from strikeflow.sources import shards

    folder = shards.scratch(s, "chain")
    shards.save(chain(s, d), folder)
    return shards.load(s, folder, "1997-02-01", "1997-02-28", columns=[*KEY, "settle"])


@query("S09_cached_dates", CH + "SELECT DISTINCT date FROM chain")
def _(s, d):
    from strikeflow.sources import shards

    folder = shards.scratch(s, "dates")
    shards.save(chain(s, d), folder)
    return shards.dates(s, folder)


@query("S12_synthetic_chain")
def _(s, d):
    from strikeflow.sources.synthetic import generate

    return generate(s, days=table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")))


@query("STREAM_event_windows", "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    from strikeflow.streaming.events import daily_totals

    return daily_totals(s, d)


@query("S10_S11_record_round_trip", CH + f", rec AS ({RECORDS}) SELECT date, expiry, model_type, round(CASE model_type WHEN 'svi' THEN 0.001 WHEN 'sabr' THEN 0.18 ELSE 0.18 END, 6) AS first_parameter, true AS cached FROM rec WHERE date BETWEEN DATE '1997-02-01' AND DATE '1997-12-31'")
def _(s, d):
    from strikeflow.sources import records as store
    from strikeflow.sources import shards

    folder = shards.scratch(s, "records")
    store.save_all(records(s, d), folder)
    first = F.coalesce(*(F.col("params")[k] for k in ("a", "alpha", "c0")))
    cached = store.cached_dates(s, folder).withColumn("cached", F.lit(True))
    return store.load(s, folder, "1997-02-01", "1997-12-31").join(cached, "date", "left").select("date", "expiry", "model_type", F.round(first, 6).alias("first_parameter"), "cached")


@query("S17_surface_day", CH + f", rec AS ({RECORDS}) SELECT expiry, model_type, CAST(dte AS DOUBLE) / 365 AS t, (SELECT count(DISTINCT date) FROM rec) AS n_dates, (SELECT max(date) FROM rec WHERE date < DATE '1997-03-04') AS before FROM rec WHERE date = DATE '1997-03-04'")
def _(s, d):
    from strikeflow.sources import records as store
    from strikeflow.sources import reports, shards

    folder = shards.scratch(s, "records")
    store.save_all(records(s, d), folder)
    days = reports.surface_dates(s, folder).agg(F.count("*").alias("n_dates"), F.max(F.when(F.col("date") < F.lit("1997-03-04").cast("date"), F.col("date"))).alias("before"))
    return reports.surface_day(s, folder, "1997-03-04").select("expiry", "model_type", "t").crossJoin(F.broadcast(days))  # one row


#: Rules for the texts of documents, and for the markup of pages.
TEXT_RULES = (
    lint.Rule("mail", "[a-z0-9]@[a-z0-9]"),
    lint.Rule("marks", "[#*%&|]{3}", unless="^[A-Z][a-z]+ "),
    lint.Rule("number", "[0-9]{7,}", unless="[+(]"),
    lint.Rule("number_near_mail", "[0-9]{3}", text_has=("@", "[0-9]{3}"), text_lacks="[#*]{3}"),
    lint.Rule("doubled_word", " (the|of|and) (the|of|and) ", where="lang = 'en'", warning=True),
    lint.Rule("fragment", "^[^ ]{1,8}$", where="source <> 'src0'", warning=True),
)
PAGE_RULES = (
    lint.Rule("script", "<script>", unless="track[(]0[)]"),
    lint.Rule("advert", "<!-- ad [0-9]+ -->", where="url LIKE 'http:%'"),
    lint.Rule("query_link", "href=\"/[^\"]*[.,]\"", text_has=("lang=\"en\"",), warning=True),
)


@query("H09_text_lint", """
WITH texts AS (SELECT doc_id, lang, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, lang, source, text, unnest(range(1, len(parts) + 1)) AS line_no, regexp_replace(unnest(parts), chr(13) || '$', '') AS line FROM texts),
hits AS (
  SELECT doc_id, line_no, line, 'mail' AS category, false AS warning FROM lines WHERE regexp_matches(line, '[a-z0-9]@[a-z0-9]')
  UNION ALL SELECT doc_id, line_no, line, 'marks', false FROM lines WHERE regexp_matches(line, '[#*%&|]{3}') AND NOT regexp_matches(line, '^[A-Z][a-z]+ ')
  UNION ALL SELECT doc_id, line_no, line, 'number', false FROM lines WHERE regexp_matches(line, '[0-9]{7,}') AND NOT regexp_matches(line, '[+(]')
  UNION ALL SELECT doc_id, line_no, line, 'number_near_mail', false FROM lines WHERE regexp_matches(line, '[0-9]{3}') AND contains(text, '@') AND NOT regexp_matches(text, '[#*]{3}')
  UNION ALL SELECT doc_id, line_no, line, 'doubled_word', true FROM lines WHERE lang = 'en' AND regexp_matches(line, ' (the|of|and) (the|of|and) ')
  UNION ALL SELECT doc_id, line_no, line, 'fragment', true FROM lines WHERE source <> 'src0' AND regexp_matches(line, '^[^ ]{1,8}$'))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, category, warning, line FROM hits""")
def _(s, d):
    return lint.lint(table(s, d, "documents"), TEXT_RULES, "doc_id")


@query("H09_page_lint_totals", """
WITH texts AS (SELECT page_id, url, html, string_split(html, chr(10)) AS parts FROM pages),
lines AS (SELECT page_id, url, html, unnest(parts) AS line FROM texts),
hits AS (
  SELECT page_id, 'script' AS category, false AS warning FROM lines WHERE contains(line, '<script>') AND NOT contains(line, 'track(0)')
  UNION ALL SELECT page_id, 'advert', false FROM lines WHERE url LIKE 'http:%' AND regexp_matches(line, '<!-- ad [0-9]+ -->')
  UNION ALL SELECT page_id, 'query_link', true FROM lines WHERE regexp_matches(line, 'href="/[^"]*[.,]"') AND contains(html, 'lang="en"'))
SELECT category, warning, count(*) AS n_lines, count(DISTINCT page_id) AS n_texts FROM hits GROUP BY 1, 2""")
def _(s, d):
    return lint.totals(lint.lint(table(s, d, "pages"), PAGE_RULES, "page_id", text="html"), "page_id")


@query("S18_inspect", CH + "SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(DISTINCT date) AS n_dates, count(*) AS n, min(date) AS first, max(date) AS last, round(count(*) FILTER (abs(strike / underlying - 1) <= 0.08 AND bid IS NOT NULL AND ask IS NOT NULL) / count(*) FILTER (abs(strike / underlying - 1) <= 0.08), 9) AS quoted_near FROM chain GROUP BY 1")
def _(s, d):
    from strikeflow.sources import reports

    return rounded(reports.inspect(chain(s, d)), "quoted_near", places=9)


@query("R03_R04_checks", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 10 THEN 'qty' WHEN l_returnflag = 'R' THEN 'option_type' WHEN l_linestatus = 'F' THEN 'side' WHEN l_discount > 0.05 THEN 'commission' WHEN l_tax > 0.05 THEN 'tax' END AS problem, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    from strikeflow.functions import checks

    own = table(s, d, "lineitem").withColumns({"qty": F.col("l_quantity") - 10, "option_type": F.when(F.col("l_returnflag") == "R", "other").otherwise("call"), "side": F.when(F.col("l_linestatus") == "F", "hold").otherwise("buy"), "commission": 0.05 - F.col("l_discount"), "tax": 0.05 - F.col("l_tax")})
    return own.groupBy("l_orderkey", "l_linenumber", "l_partkey", checks.problem("fill").alias("problem")).agg(F.count("*").alias("n"))
