"""Option mathematics as SQL expression text.

Each function takes SQL texts and returns one, so a formula is written once and
stays inside whole-stage code generation. Arguments that are used more than once
should be column names: compute d1 and d2 as columns first (see bsm.py).
"""

from __future__ import annotations

Sql = str


def num(x: float) -> Sql:
    """A double literal; a plain decimal would be of decimal type."""
    return f"{x:.17e}" if x >= 0 else f"(-{-x:.17e})"


# The rational approximation of the normal distribution by Hart (1968), double precision.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_LIMIT = 7.07106781186547
ROOT_2PI = 2.506628274631


def horner(coefficients, x: Sql) -> Sql:
    out = num(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}*{x}+{num(c)})"
    return out


def norm_pdf(x: Sql) -> Sql:
    return f"(exp(-{x}*{x}/{num(2)})/{num(2.5066282746310002)})"


def norm_cdf(x: Sql) -> Sql:
    a = f"abs({x})"
    tail = a
    for k in (0.65, 4, 3, 2, 1):
        tail = f"({a}+{num(0.65)})" if k == 0.65 else f"({a}+{num(k)}/{tail})"
    lower = f"CASE WHEN {a} > {num(37)} THEN {num(0)} WHEN {a} < {num(HART_LIMIT)} THEN exp(-{x}*{x}/{num(2)})*{horner(HART_TOP, a)}/{horner(HART_BELOW, a)} ELSE exp(-{x}*{x}/{num(2)})/{tail}/{num(ROOT_2PI)} END"
    return f"(CASE WHEN {x} > {num(0)} THEN {num(1)}-({lower}) ELSE {lower} END)"


def d1(s: Sql, k: Sql, t: Sql, r: float, q: Sql, v: Sql) -> Sql:
    return f"((ln({s}/{k})+({num(r)}-{q}+{v}*{v}/{num(2)})*{t})/({v}*sqrt({t})))"


def d2(d1_name: Sql, t: Sql, v: Sql) -> Sql:
    return f"({d1_name}-{v}*sqrt({t}))"


def intrinsic(s: Sql, k: Sql, kind: Sql) -> Sql:
    return f"(CASE WHEN {kind} = 'call' THEN greatest({s}-{k}, {num(0)}) ELSE greatest({k}-{s}, {num(0)}) END)"


def bsm_price(s: Sql, k: Sql, t: Sql, r: float, q: Sql, v: Sql, kind: Sql, d1_name: Sql, d2_name: Sql) -> Sql:
    """Null for invalid input; spot intrinsic at t = 0; discounted forward intrinsic at v = 0."""
    fs, fk = f"{s}*exp(-{q}*{t})", f"{k}*exp(-{num(r)}*{t})"
    live = f"CASE WHEN {kind} = 'call' THEN {fs}*{norm_cdf(d1_name)}-{fk}*{norm_cdf(d2_name)} ELSE {fk}*{norm_cdf(f'(-{d2_name})')}-{fs}*{norm_cdf(f'(-{d1_name})')} END"
    return f"(CASE WHEN {s} <= 0 OR {k} <= 0 OR {t} < 0 OR {v} < 0 THEN NULL WHEN {t} = 0 THEN {intrinsic(s, k, kind)} WHEN {v} = 0 THEN {intrinsic(fs, fk, kind)} ELSE {live} END)"


def delta(t: Sql, q: Sql, kind: Sql, d1_name: Sql) -> Sql:
    return f"(exp(-{q}*{t})*({norm_cdf(d1_name)}-CASE WHEN {kind} = 'call' THEN {num(0)} ELSE {num(1)} END))"


def gamma(s: Sql, t: Sql, q: Sql, v: Sql, d1_name: Sql) -> Sql:
    return f"(exp(-{q}*{t})*{norm_pdf(d1_name)}/({s}*{v}*sqrt({t})))"


def vega(s: Sql, t: Sql, q: Sql, d1_name: Sql) -> Sql:
    return f"({s}*exp(-{q}*{t})*{norm_pdf(d1_name)}*sqrt({t}))"


def theta(s: Sql, k: Sql, t: Sql, r: float, q: Sql, v: Sql, kind: Sql, d1_name: Sql, d2_name: Sql) -> Sql:
    """Per year."""
    decay = f"-{s}*exp(-{q}*{t})*{norm_pdf(d1_name)}*{v}/({num(2)}*sqrt({t}))"
    call = f"-{num(r)}*{k}*exp(-{num(r)}*{t})*{norm_cdf(d2_name)}+{q}*{s}*exp(-{q}*{t})*{norm_cdf(d1_name)}"
    put = f"+{num(r)}*{k}*exp(-{num(r)}*{t})*{norm_cdf(f'(-{d2_name})')}-{q}*{s}*exp(-{q}*{t})*{norm_cdf(f'(-{d1_name})')}"
    return f"(CASE WHEN {kind} = 'call' THEN {decay}{call} ELSE {decay}{put} END)"


def rho(k: Sql, t: Sql, r: float, kind: Sql, d2_name: Sql) -> Sql:
    return f"(CASE WHEN {kind} = 'call' THEN {k}*{t}*exp(-{num(r)}*{t})*{norm_cdf(d2_name)} ELSE -{k}*{t}*exp(-{num(r)}*{t})*{norm_cdf(f'(-{d2_name})')} END)"


def svi(k: Sql, a: Sql, b: Sql, rho_: Sql, m: Sql, sigma: Sql) -> Sql:
    """Total variance of the raw parametrisation."""
    return f"({a}+{b}*({rho_}*({k}-{m})+sqrt(({k}-{m})*({k}-{m})+{sigma}*{sigma})))"


def svi_first(k: Sql, b: Sql, rho_: Sql, m: Sql, sigma: Sql) -> Sql:
    return f"({b}*({rho_}+({k}-{m})/sqrt(({k}-{m})*({k}-{m})+{sigma}*{sigma})))"


def svi_second(k: Sql, b: Sql, m: Sql, sigma: Sql) -> Sql:
    return f"({b}*{sigma}*{sigma}/power(({k}-{m})*({k}-{m})+{sigma}*{sigma}, {num(1.5)}))"


def butterfly(k: Sql, w: Sql, w1: Sql, w2: Sql) -> Sql:
    """Density indicator g(k); null where total variance isn't positive."""
    lead = f"({num(1)}-{k}*{w1}/({num(2)}*{w}))"
    return f"(CASE WHEN {w} > 0 THEN {lead}*{lead}-{w1}*{w1}/{num(4)}*({num(1)}/{w}+{num(0.25)})+{w2}/{num(2)} END)"


def sabr(f: Sql, k: Sql, t: Sql, alpha: Sql, rho_: Sql, nu: Sql) -> Sql:
    """Lognormal volatility for beta = 1; the limit at the money."""
    z = f"({nu}/{alpha}*ln({f}/{k}))"
    x = f"ln((sqrt({num(1)}-{num(2)}*{rho_}*{z}+{z}*{z})+{z}-{rho_})/({num(1)}-{rho_}))"
    more = f"({num(1)}+({rho_}*{nu}*{alpha}/{num(4)}+({num(2)}-{num(3)}*{rho_}*{rho_})*{nu}*{nu}/{num(24)})*{t})"
    return f"(CASE WHEN abs(ln({f}/{k})) < {num(1e-9)} OR {nu} < {num(1e-12)} THEN {alpha}*{more} ELSE {alpha}*{z}/({x})*{more} END)"


def fill_price(model: str, side: Sql, bps: float = 10.0, base: str = "mid") -> Sql:
    """settle, mid, worst (sell at bid, buy at ask) or slippage; null where the needed quote is missing."""
    if model == "settle":
        return "settle"
    if model == "mid":
        return f"((bid+ask)/{num(2)})"
    if model == "worst":
        return f"(CASE WHEN {side} = 'sell' THEN bid ELSE ask END)"
    if model == "slippage":
        own = f"((bid+ask)/{num(2)})" if base == "mid" else "settle"
        gate = own if base == "mid" else f"CASE WHEN {side} = 'sell' AND bid IS NOT NULL OR {side} = 'buy' AND ask IS NOT NULL THEN settle END"
        return f"(({gate})*(CASE WHEN {side} = 'sell' THEN {num(1 - bps / 1e4)} ELSE {num(1 + bps / 1e4)} END))"
    raise ValueError(f"unknown fill model {model!r}")
