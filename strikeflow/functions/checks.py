"""Domains of record columns: what a row of a table must satisfy, as columns that name the first problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed sets of values.
OPTION_TYPES, SIDES, ACTIONS = ("call", "put"), ("buy", "sell"), ("open", "close", "adjust", "hold")
GREEKS = ("delta", "gamma", "theta", "vega")

Rules = dict[str, Column]


def _one_of(c: str, values: tuple[str, ...]) -> Column:
    return F.col(c).isin(*values)


def rules(kind: str) -> Rules:
    """What rows of a table of this kind must satisfy, by name of the problem. A condition that is null doesn't hold."""
    c = F.col
    known: dict[str, Rules] = {
        "quote": {"option_type": _one_of("option_type", OPTION_TYPES)},
        "order": {"qty": c("qty") > 0, "option_type": _one_of("option_type", OPTION_TYPES), "side": _one_of("side", SIDES)},
        "fill": {"qty": c("qty") > 0, "option_type": _one_of("option_type", OPTION_TYPES), "side": _one_of("side", SIDES), "commission": c("commission") >= 0, "tax": c("tax") >= 0},
        "leg": {"qty": c("qty") != 0, "option_type": _one_of("option_type", OPTION_TYPES)},
        "position": {"legs": F.size("legs") > 0},
        "signal": {"action": _one_of("action", ACTIONS), "orders": (c("action") == "hold") == (F.size("orders") == 0)},
        "state": {"greeks": (F.size("greeks") == 0) | (F.array_sort(F.map_keys("greeks")) == F.array(*(F.lit(g) for g in sorted(GREEKS))))},
        "risk": {
            "max_loss_per_trade_twd": c("max_loss_per_trade_twd") > 0,
            "max_capital_at_risk_twd": c("max_capital_at_risk_twd") > 0,
            "max_concurrent_positions": c("max_concurrent_positions") > 0,
            "stop_loss_multiple": c("stop_loss_multiple") > 0,
            "portfolio_loss_cap_pct": (c("portfolio_loss_cap_pct") > 0) & (c("portfolio_loss_cap_pct") < 1),
        },
    }
    if kind not in known:
        raise ValueError(f"unknown kind of record {kind!r}")
    return known[kind]


def problem(kind: str) -> Column:
    """The name of the first rule that a row breaks, or null."""
    out = None
    for name, holds in rules(kind).items():
        bad = ~F.coalesce(holds, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def require(df: DataFrame, kind: str) -> DataFrame:
    """df, whose reading fails at a row outside the domain, if there is one; of several, whichever task comes to one first."""
    text = F.concat(F.lit(f"{kind}: bad "), problem(kind), F.lit(" in "), F.to_json(F.struct("*")))
    return df.where(F.when(problem(kind).isNull(), True).otherwise(F.raise_error(text).cast("boolean")))
