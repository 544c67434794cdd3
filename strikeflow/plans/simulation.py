"""The portfolio state machine, and its distribution over scenarios and folds.

Everything that can be decided for all days at once is: candidate legs, quotes,
marks and gates are DataFrame queries. What depends on the position held, open,
close, adjust and cash, runs day by day in one group for each scenario and fold,
which gets only the quotes of contracts that some candidate of the fold holds.

A strategy is a Strategy: a query that finds each date's candidate legs, and two
functions that the state machine asks. A fill model is a function of a quote and a side. walk_forward
takes further ones by name, and a factory that sets a fold's scenario from its training returns.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import date
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.constants import MULTIPLIER
from strikeflow.operators import chain as ops
from strikeflow.operators.intervals import bin_join

Key = tuple  # (expiry, strike, option_type)
#: Bins in which dates meet the windows that hold them.
BIN_DAYS = 32


@dataclass(frozen=True)
class Scenario:
    """One parameter set of a strategy."""

    name: str
    strategy: str = "condor"  # condor, vertical, hedged_condor
    short_delta: float = 0.16
    wing_delta: float = 0.08
    target_dte: int = 30
    exit_dte: int = 14
    profit_target: float = 0.5
    gate: str = "none"
    fill: str = "worst"
    slip_bps: float = 0.0
    commission: float = 0.0
    tax_bps: float = 0.0
    mark_policy: str = "settle"
    gated: bool = True
    stop_loss: float = 0.0  # multiple of the entry credit; 0: none
    max_loss: float = math.inf
    max_capital_at_risk: float = math.inf
    max_positions: int = 1_000_000
    loss_cap: float = 1.0  # share of the initial capital
    capital: float = 1_000_000.0

    def __post_init__(self):
        if not 0 < self.wing_delta < self.short_delta:
            raise ValueError("the wing delta must lie between 0 and the short delta")
        if not 0 < self.profit_target <= 1:
            raise ValueError("the profit target must lie in (0, 1]")
        if not 0 < self.exit_dte < self.target_dte:
            raise ValueError("exit must come after entry and before expiry")
        if self.capital <= 0:
            raise ValueError("capital must be positive")
        if self.max_loss <= 0 or self.max_capital_at_risk <= 0 or self.max_positions <= 0:
            raise ValueError("risk limits must be positive")
        if self.stop_loss < 0 or not 0 < self.loss_cap <= 1:
            raise ValueError("the stop must not be negative, and the loss cap must be a share of the capital")
        if self.mark_policy not in ("strict", "settle", "surface"):
            raise ValueError(f"unknown mark policy {self.mark_policy!r}")


#: The parameter sets of the published runs.
CONDOR = {"short_delta": 0.16, "wing_delta": 0.08, "target_dte": 30, "exit_dte": 14}
VERTICAL = {"strategy": "vertical", "short_delta": 0.25, "wing_delta": 0.10, "target_dte": 45, "exit_dte": 21}
COSTS = {"slip_bps": 15.0, "commission": 12.0, "tax_bps": 10.0}


def scenarios(costs: bool = True) -> list[Scenario]:
    own = COSTS if costs else {}
    return [Scenario(f"{n}_{g}", gate=gate, **params, **own) for n, params in (("IC", CONDOR), ("Vertical", VERTICAL)) for g, gate in (("vanilla", "none"), ("IV_percentile", "vol_percentile"), ("HMM", "hmm"))]


def hedged_scenarios(costs: bool = True) -> list[Scenario]:
    own = COSTS if costs else {}
    return [Scenario(f"HedgedIC_{g}", gate=gate, **{**CONDOR, "strategy": "hedged_condor"}, **own) for g, gate in (("vanilla", "none"), ("IV_percentile", "vol_percentile"), ("HMM", "hmm"))]


@dataclass
class Leg:
    expiry: object
    strike: float
    kind: str
    qty: int
    entry_date: object
    entry_price: float

    @property
    def key(self) -> Key:
        return (self.expiry, self.strike, self.kind)


@dataclass
class Position:
    legs: list[Leg]
    opened: object
    entry_credit: float
    max_risk: float
    closed: object = None
    realised: float = 0.0
    adjusted: bool = False

    def __post_init__(self):
        if not self.legs:
            raise ValueError("a position needs a leg")


Fill = Callable[[dict, str], float | None]


def _mid(quote: dict) -> float | None:
    return None if quote["bid"] is None or quote["ask"] is None else (quote["bid"] + quote["ask"]) / 2


def _slipped(quote: dict, side: str) -> float | None:
    mid = _mid(quote)
    return mid if mid is None else mid * (1 - 10 / 1e4 if side == "sell" else 1 + 10 / 1e4)


#: The price of a side before retail costs, None where it isn't executable.
FILLS: dict[str, Fill] = {
    "settle": lambda q, side: q["settle"],
    "worst": lambda q, side: q["bid"] if side == "sell" else q["ask"],
    "mid": lambda q, side: _mid(q),
    "slippage": _slipped,
}


class Unmarkable(ValueError):
    pass


@dataclass
class Book:
    s: Scenario
    cash: float = 0.0
    realised: float = 0.0
    positions: list[Position] = field(default_factory=list)
    fills: dict[str, Fill] = field(default_factory=lambda: FILLS)

    def open_positions(self) -> list[Position]:
        return [p for p in self.positions if p.closed is None]

    def snapshot(self, unrealised: float = 0.0) -> dict:
        """What a strategy may see: cash, results and the open positions only."""
        return {"cash": self.cash, "realised": self.realised, "unrealised": unrealised, "capital": self.s.capital, "positions": self.open_positions()}

    def fill(self, quote: dict, side: str, qty: int) -> tuple[float, float] | None:
        """Price and cost, or None where the side isn't executable."""
        raw = self.fills[self.s.fill](quote, side)
        if raw is None:
            return None
        price = raw * (1 - self.s.slip_bps / 1e4 if side == "sell" else 1 + self.s.slip_bps / 1e4)
        return price, self.s.commission * qty + abs(price) * MULTIPLIER * qty * self.s.tax_bps / 1e4

    def mark(self, quote: dict) -> tuple[float, str]:
        if quote["bid"] is not None and quote["ask"] is not None:
            return (quote["bid"] + quote["ask"]) / 2, "mid"
        if self.s.mark_policy == "surface" and quote.get("model_price") is not None:
            return quote["model_price"], "surface"
        if self.s.mark_policy != "strict" and quote["settle"] is not None:
            return quote["settle"], "third" if self.s.mark_policy == "surface" else "settle"
        raise Unmarkable("unmarkable leg")

    def settle_legs(self, position: Position, legs: list[Leg], day, quotes: dict, spot: float) -> bool:
        """Closes legs at the market, or at intrinsic value once expired without a quote; False if one can't be."""
        plan = []
        for leg in legs:
            quote = quotes.get(leg.key)
            if quote is None:
                if day < leg.expiry:
                    raise Unmarkable("no quote before expiry")
                plan.append((leg, max(spot - leg.strike, 0.0) if leg.kind == "call" else max(leg.strike - spot, 0.0), 0.0))
                continue
            got = self.fill(quote, "buy" if leg.qty < 0 else "sell", abs(leg.qty))
            if got is None:
                if day >= leg.expiry:  # on its last day a leg without quote settles
                    got = (max(spot - leg.strike, 0.0) if leg.kind == "call" else max(leg.strike - spot, 0.0), 0.0)
                else:
                    return False
            plan.append((leg, *got))
        for leg, price, cost in plan:
            pnl = leg.qty * (price - leg.entry_price) * MULTIPLIER - cost
            self.cash += leg.qty * price * MULTIPLIER - cost
            self.realised += pnl
            position.realised += pnl
        return True

    def unrealised(self, day, quotes: dict, spot: float, audit: dict) -> float:
        total = 0.0
        audit.update(n_legs_marked=0, n_fallback_settle=0, n_fallback_surface=0, n_fallback_settle_3rd=0)
        for p in self.positions:
            if p.closed is not None:
                continue
            for leg in p.legs:
                quote = quotes.get(leg.key)
                if quote is None:
                    if day < leg.expiry:
                        raise Unmarkable("no quote before expiry")
                    value = max(spot - leg.strike, 0.0) if leg.kind == "call" else max(leg.strike - spot, 0.0)
                else:
                    value, basis = self.mark(quote)
                    audit["n_legs_marked"] += 1
                    audit["n_fallback_surface"] += basis == "surface"
                    audit["n_fallback_settle"] += basis in ("settle", "third")
                    audit["n_fallback_settle_3rd"] += basis == "third"
                total += leg.qty * (value - leg.entry_price) * MULTIPLIER
        return total

    def risk_problem(self, max_risk: float, unrealised: float) -> str | None:
        own = self.open_positions()
        return check_risk(self.s, len(own), sum(p.max_risk for p in own), self.realised + unrealised, max_risk)


def should_close(book: Book, p: Position, day, quotes: dict) -> bool:
    """Near expiry, or once the mids show the profit target or the stop; without all mids, at opening or now, only time counts."""
    vertical = book.s.strategy == "vertical"
    if min((leg.expiry - day).days for leg in (p.legs[:1] if vertical else p.legs)) <= book.s.exit_dte:
        return True
    if vertical and p.entry_credit <= 0:
        return False
    now = 0.0
    for leg in p.legs:
        mid = _mid(quotes[leg.key]) if leg.key in quotes else None
        if mid is None:
            return False
        now -= leg.qty * mid
    gained = p.entry_credit - now
    if gained >= p.entry_credit * book.s.profit_target:
        return True
    return not vertical and book.s.stop_loss > 0 and gained <= -p.entry_credit * book.s.stop_loss


def breached(book: Book, p: Position, spot: float) -> str | None:
    """The side whose short strike the underlying has reached; calls first, once for each position."""
    if p.adjusted:
        return None
    for kind in ("call", "put"):
        for leg in p.legs:
            if leg.kind == kind and leg.qty < 0 and (spot >= leg.strike if kind == "call" else spot <= leg.strike):
                return kind
    return None


def check_risk(s: Scenario, n_open: int, at_risk: float, pnl: float, new_risk: float) -> str | None:
    """The first limit that opening would break."""
    if new_risk > s.max_loss:
        return "max_loss_per_trade"
    if at_risk + new_risk > s.max_capital_at_risk:
        return "max_capital_at_risk"
    if n_open >= s.max_positions:
        return "max_concurrent_positions"
    if pnl <= -s.loss_cap * s.capital:
        return "portfolio_loss_cap"
    return None


OUT = "scenario string, fold_index int, kind string, date date, daily_pnl double, cum_pnl double, n_open int, n_legs_marked int, n_fallback_settle int, n_fallback_surface int, n_fallback_settle_3rd int, open_date date, realised_pnl double, n_legs int, adjusted boolean, path string, reason string"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def none_if_nan(v):
    return None if v is None or v != v else v


class Machine:
    """The state machine of one scenario and fold, day by day. What it knows can be written down and read back between any two days."""

    def __init__(self, s: Scenario, fold: int, strategy: Strategy | None = None, fills: dict[str, Fill] | None = None):
        self.s, self.fold, self.strategy = s, fold, strategy or STRATEGIES[s.strategy]
        self.book, self.before, self.failed = Book(s, cash=s.capital, fills=fills or FILLS), 0.0, False

    def written(self) -> str:
        """The state as JSON text."""
        plain = lambda v: v.isoformat() if isinstance(v, date) else v
        positions = [{k: plain(v) for k, v in vars(p).items() if k != "legs"} | {"legs": [{k: plain(v) for k, v in vars(leg).items()} for leg in p.legs]} for p in self.book.positions]
        return json.dumps({"cash": self.book.cash, "realised": self.book.realised, "before": self.before, "failed": self.failed, "positions": positions})

    def read(self, text: str) -> Machine:
        """This machine, in a state that was written."""
        state = json.loads(text)
        day = lambda v: v if v is None else date.fromisoformat(v)
        self.book.cash, self.book.realised, self.before, self.failed = (state[k] for k in ("cash", "realised", "before", "failed"))
        self.book.positions = []
        for p in state["positions"]:
            legs = [Leg(**leg | {"expiry": day(leg["expiry"]), "entry_date": day(leg["entry_date"])}) for leg in p.pop("legs")]
            # a position whose last leg is gone has none
            position = Position(legs or [Leg(None, 0.0, "", 0, None, 0.0)], **p | {"opened": day(p["opened"]), "closed": day(p["closed"])})
            position.legs = legs
            self.book.positions.append(position)
        return self

    def days(self, rows: pd.DataFrame) -> list[dict]:
        """Day, trade, reject and error rows of all days of rows, in order: quotes (row = 'q') and candidate legs (row = 'c'); note: why legs are missing from a candidate."""
        out: list[dict] = []
        if self.failed:
            return out
        try:
            for day, today in rows.sort_values("date", kind="stable").groupby("date", sort=True):
                self._day(day, today, out)
        except Unmarkable as e:
            self.failed = True
            self._emit(out, "error", reason=str(e))
        return out

    def _emit(self, out: list[dict], kind: str, **values) -> None:
        out.append({"scenario": self.s.name, "fold_index": self.fold, "kind": kind, **values})

    def _day(self, day, today: pd.DataFrame, out: list[dict]) -> None:
        book, strategy = self.book, self.strategy
        emit = partial(self._emit, out)
        quotes, legs, risk, note = {}, [], 0.0, None
        spot, active = float(today["underlying"].iloc[0]), bool(today["active"].iloc[0])
        for r in today.itertuples(index=False):
            if r.row == "d":
                continue
            if r.row == "q":
                quotes.setdefault((r.expiry, r.strike, r.option_type), {"bid": none_if_nan(r.bid), "ask": none_if_nan(r.ask), "settle": none_if_nan(r.settle), "model_price": none_if_nan(r.model_price)})
            else:
                legs.append((int(r.leg), (r.expiry, r.strike, r.option_type), int(r.qty)))
                risk = float(none_if_nan(r.max_risk) or 0.0)
                note = none_if_nan(getattr(r, "note", None))
        audit: dict = {}
        for p in book.positions:
            if p.closed is None and strategy.should_close(book, p, day, quotes):
                if book.settle_legs(p, p.legs, day, quotes, spot):
                    p.closed = day
                    emit("trade", date=day, open_date=p.opened, realised_pnl=p.realised, n_legs=len(p.legs), adjusted=p.adjusted)
                else:
                    emit("reject", date=day, path="close", reason="not_executable")
        for p in book.positions:
            side = strategy.should_adjust(book, p, spot) if p.closed is None and strategy.should_adjust else None
            if side:
                gone = [leg for leg in p.legs if leg.kind == side]
                if book.settle_legs(p, gone, day, quotes, spot):
                    p.legs = [leg for leg in p.legs if leg.kind != side]
                    p.adjusted = True
                    if not p.legs:
                        p.closed = day
                        emit("trade", date=day, open_date=p.opened, realised_pnl=p.realised, n_legs=0, adjusted=True)
                else:
                    emit("reject", date=day, path="adjust", reason="not_executable")
        unrealised = book.unrealised(day, quotes, spot, audit)
        if legs and active and all(p.closed is not None for p in book.positions):
            legs.sort()
            if note:
                emit("reject", date=day, path="hedge_attach", reason=note)
            filled = [(key, qty, book.fill(quotes[key], "sell" if qty < 0 else "buy", abs(qty)) if key in quotes else None) for _, key, qty in legs]
            problem = book.risk_problem(risk, unrealised)
            if any(f is None for _, _, f in filled):
                emit("reject", date=day, path="open", reason="not_executable")
            elif problem:
                emit("reject", date=day, path="open", reason=problem)
            else:
                own = [Leg(*key, qty, day, f[0]) for key, qty, f in filled]
                # the credit is that of the legs without their hedge; unknown if one of them has no mid
                mids = [(_mid(quotes[leg.key]), leg.qty) for leg in own[: strategy.credit_legs]]
                p = Position(own, day, math.nan if any(m is None for m, _ in mids) else -sum(q * m for m, q in mids), risk)
                cost = sum(f[1] for _, _, f in filled)
                book.cash += -sum(leg.qty * leg.entry_price for leg in own) * MULTIPLIER - cost
                book.realised -= cost
                p.realised -= cost
                book.positions.append(p)
        unrealised = book.unrealised(day, quotes, spot, audit)
        total = book.realised + unrealised
        emit("day", date=day, daily_pnl=total - self.before, cum_pnl=total, n_open=sum(p.closed is None for p in book.positions), **audit)
        self.before = total


def framed(out: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=_COLUMNS).astype(object)
    return frame.where(frame.notna(), None)


def simulate(s: Scenario, fold: int, rows: pd.DataFrame, strategy: Strategy | None = None, fills: dict[str, Fill] | None = None) -> pd.DataFrame:
    """All days of one scenario and fold by Machine."""
    return framed(Machine(s, fold, strategy, fills).days(rows))


def _leg_rows(found: DataFrame, legs: list[tuple[str, int]], more: list) -> DataFrame:
    structs = F.array(*(F.struct(F.lit(i).alias("leg"), *(F.col(n)[c].alias(c) for c in ("expiry", "strike", "option_type")), F.lit(q).alias("qty"), F.col(n)["bid"].alias("bid"), F.col(n)["ask"].alias("ask")) for i, (n, q) in enumerate(legs)))
    return found.select("date", F.explode(structs).alias("l"), *more).select("date", "l.*", "max_risk", "note")


CONDOR_LEGS = [("short_call", -1), ("long_call", 1), ("short_put", -1), ("long_put", 1)]


def condor_candidates(chain: DataFrame, s: Scenario) -> DataFrame:
    found = ops.iron_condors(chain, s.short_delta, s.wing_delta, s.target_dte)
    return _leg_rows(found, CONDOR_LEGS, [F.col("max_defined_risk").alias("max_risk"), F.lit(None).cast("string").alias("note")])


def vertical_candidates(chain: DataFrame, s: Scenario) -> DataFrame:
    found = ops.verticals(chain, s.short_delta, s.wing_delta, s.target_dte)
    return _leg_rows(found, [("short_leg", -1), ("long_leg", 1)], [F.col("max_defined_risk").alias("max_risk"), F.lit(None).cast("string").alias("note")])


def hedged_candidates(chain: DataFrame, s: Scenario) -> DataFrame:
    """A condor with a calendar at the money where one can be built and, if gated, executed; else the condor alone, with the reason."""
    found = ops.iron_condors(chain, s.short_delta, s.wing_delta, s.target_dte)
    hedge = ops.calendars(chain, found.select("date", F.col("short_call")["expiry"].alias("front_expiry")))
    leg = lambda n: F.struct(F.col(f"{n}_expiry").alias("expiry"), F.col("strike").alias("strike"), F.lit("call").alias("option_type"), F.col(f"{n}_bid").alias("bid"), F.col(f"{n}_ask").alias("ask"))
    both = found.join(hedge.select("date", leg("front").alias("front"), leg("back").alias("back")), "date", "left")
    note = F.when(F.col("front").isNull(), "hedge_build_fail")
    if s.gated:
        note = note.when(F.col("front")["bid"].isNull(), "hedge_gate_fail: sell front").when(F.col("back")["ask"].isNull(), "hedge_gate_fail: buy back")
    more = [F.col("max_defined_risk").alias("max_risk"), note.alias("note")]
    rows = _leg_rows(both, [*CONDOR_LEGS, ("front", -1), ("back", 1)], more)
    return rows.where("leg < 4 or note is null")


@dataclass(frozen=True)
class Strategy:
    """candidates(chain, scenario) -> (date, leg, expiry, strike, option_type, qty, bid, ask, max_risk, note): the legs that each date would open.

    should_close(book, position, day, quotes) and should_adjust(book, position, spot), which names the side to close, run on the worker.
    The first credit_legs legs make the entry credit.
    """

    candidates: Callable[[DataFrame, Scenario], DataFrame]
    should_close: Callable[[Book, Position, object, dict], bool] = should_close
    should_adjust: Callable[[Book, Position, float], str | None] | None = None
    credit_legs: int | None = None


STRATEGIES = {"condor": Strategy(condor_candidates, should_adjust=breached), "vertical": Strategy(vertical_candidates), "hedged_condor": Strategy(hedged_candidates, credit_legs=4)}


def fold_windows(dates: DataFrame, train: int, test: int, step: int, expanding: bool = False) -> DataFrame:
    """(fold_index, train_start, train_end, test_start, test_end) by trading-day ordinals; a fold whose test would pass the end isn't made."""
    if min(train, test, step) <= 0 or step < test:
        raise ValueError("windows must be positive and tests must not overlap")
    from pyspark.sql import Window

    days = dates.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    count = days.agg(F.count("*").alias("n"))
    folds = count.where(F.col("n") >= train + test).select(F.posexplode(F.sequence(F.lit(0), F.col("n") - train - test, F.lit(step))).alias("fold_index", "s"))
    ends = {"train_start": F.lit(0) if expanding else F.col("s"), "train_end": F.col("s") + train - 1, "test_start": F.col("s") + train, "test_end": F.col("s") + train + test - 1}
    out = folds
    for name, at in ends.items():
        out = out.withColumn("__i", at.cast("int")).join(days.select(F.col("date").alias(name), F.col("i").alias("__i")), "__i").drop("__i")
    return out.select("fold_index", *ends)


def by_name(todo: list[Scenario]) -> dict[str, Scenario]:
    out = {s.name: s for s in todo}
    if len(out) != len(todo):
        raise ValueError("scenario names must differ")
    return out


def fold_days(chain: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold_index, date, underlying): one row for each date in a fold's test window."""
    dates = chain.groupBy("date").agg(F.first("underlying").alias("underlying"))
    return bin_join(dates, folds.select("fold_index", "test_start", "test_end"), "date", "test_start", "test_end", BIN_DAYS).select("fold_index", "date", "underlying")


def candidate_legs(chain: DataFrame, todo: list[Scenario], days: DataFrame, kinds: dict[str, Strategy]) -> DataFrame:
    """The candidate legs of all scenarios and folds by date. Each kind's candidates are found once, whatever the scenarios and folds that use them."""
    legs = None
    seen: dict[tuple, DataFrame] = {}
    for s in todo:
        kind = (s.strategy, s.short_delta, s.wing_delta, s.target_dte, s.gated)
        if kind not in seen:
            seen[kind] = kinds[s.strategy].candidates(chain, s).checkpoint()
        own = seen[kind].withColumn("scenario", F.lit(s.name)).withColumn("gate", F.lit(s.gate))
        legs = own if legs is None else legs.unionByName(own)
    return legs.join(days, "date").checkpoint()


CONTRACT = ["expiry", "strike", "option_type"]
HOLDER = ["scenario", "gate", "fold_index"]


def day_rows(chain: DataFrame, todo: list[Scenario], days: DataFrame, legs: DataFrame, held: DataFrame, gates: DataFrame | None) -> DataFrame:
    """What the state machines read: for each scenario and fold a row for each day, its candidate legs, and the quotes of the contracts that it may hold (held)."""
    chain = chain if "model_price" in chain.columns else chain.withColumn("model_price", F.lit(None).cast("double"))
    # a contract's quotes are read once and then given to the folds that may hold it
    quoted = chain.join(held.select(*CONTRACT).distinct(), CONTRACT, "left_semi").select("date", *CONTRACT, "bid", "ask", "settle", "model_price")
    quotes = held.select(*HOLDER, *CONTRACT).distinct().join(quoted, CONTRACT).join(days, ["fold_index", "date"])
    quotes = quotes.withColumns({"row": F.lit("q"), "leg": F.lit(None).cast("int"), "qty": F.lit(None).cast("int"), "max_risk": F.lit(None).cast("double"), "note": F.lit(None).cast("string")})
    columns = [*HOLDER, "date", "underlying", "row", "leg", *CONTRACT, "qty", "bid", "ask", "settle", "model_price", "max_risk", "note"]
    # a day without a candidate or a quote of a held contract is a day of the fold, too, for every scenario (a few rows)
    names = F.explode(F.array(*(F.struct(F.lit(s.name).alias("scenario"), F.lit(s.gate).alias("gate")) for s in todo)))
    empty = days.withColumn("of", names).select("*", "of.*").withColumns({"row": F.lit("d")} | {c: F.lit(None).cast(quotes.schema[c].dataType) for c in columns if c not in (*HOLDER, "date", "underlying", "row")})
    rows = quotes.select(*columns).unionByName(legs.withColumns({"row": F.lit("c"), "settle": F.lit(None).cast("double"), "model_price": F.lit(None).cast("double")}).select(*columns)).unionByName(empty.select(*columns))
    if gates is not None:
        rows = rows.join(gates.select("date", "gate", "active"), ["date", "gate"], "left")
        return rows.withColumn("active", F.coalesce("active", F.col("gate") == "none"))
    return rows.withColumn("active", F.col("gate") == "none")


def walk_forward(spark: SparkSession, chain: DataFrame, todo: list[Scenario], folds: DataFrame, gates: DataFrame | None = None, *, strategies: dict[str, Strategy] | None = None, fills: dict[str, Fill] | None = None, factory: Callable[[Scenario, np.ndarray], Scenario] | None = None, returns: DataFrame | None = None) -> DataFrame:
    """All scenarios over the test windows of all folds: rows as OUT. An error ends a group and is a row of it.

    factory(scenario, training returns) makes a fold's own scenario from the returns (date, ret) of its training window;
    it may change what the state machine reads, while candidates are those of the given scenario.
    """
    named = by_name(todo)
    kinds = STRATEGIES | (strategies or {})
    prices = FILLS | (fills or {})
    days = fold_days(chain, folds)
    legs = candidate_legs(chain, todo, days, kinds)
    rows = day_rows(chain, todo, days, legs, legs, gates)
    if factory is not None:
        if returns is None:
            raise ValueError("a factory needs returns")
        past = bin_join(returns.select("date", "ret"), folds.select("fold_index", "train_start", "train_end"), "date", "train_start", "train_end", BIN_DAYS)
        past = past.groupBy("fold_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "ret"))), lambda r: r["ret"]).alias("train"))
        first = rows.groupBy("scenario", "fold_index").agg(F.min("date").alias("date")).join(past, "fold_index", "left")
        rows = rows.join(first.withColumn("row", F.lit("d")), ["scenario", "fold_index", "date", "row"], "left")

    def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = named[key_[0]]
        if factory is not None:
            found = pdf["train"].dropna()
            s = factory(s, np.array([], float) if found.empty else np.asarray(found.iloc[0], float))
        return simulate(s, int(key_[1]), pdf, kinds[s.strategy], prices)

    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "scenario", "fold_index").groupBy("scenario", "fold_index").applyInPandas(run, OUT)


def scenario_table(spark: SparkSession, todo: list[Scenario]) -> DataFrame:
    rows = [{k: (v if not isinstance(v, float) or math.isfinite(v) else None) for k, v in asdict(s).items()} for s in todo]
    return spark.createDataFrame(pd.DataFrame(rows))
