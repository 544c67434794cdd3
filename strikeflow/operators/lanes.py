"""Fits of many smiles at once, each a lane (a row) of arrays: points are padded, and a mask tells which are there.

SVI is quasi-explicit: for given (m, sigma) total variance is linear in (a, d, c) with d = b rho sigma and
c = b sigma, so the inner problem is a least-squares problem with linear constraints, a polygon in the plane of (d, c).
Its active sets are few: none, or one of the polygon's edges; each has a closed form, and the best feasible one is exact.
Outside, Levenberg and Marquardt's method moves (m, log sigma) of all lanes together; lanes that have converged rest.
SABR (beta 1) is fitted by the same method over (log alpha, artanh rho, log nu), the parabola by its normal equations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

MIN_POINTS = {"svi": 5, "sabr": 4, "poly": 3}
#: Bounds of the SVI parameters: |rho|, sigma and |m|.
MOST_RHO, SIGMA, MOST_M = 0.999, (1e-4, 5.0), 2.0
#: Starting points: sigma of SVI (m at 0, in the middle and at the least variance), (rho, nu) of SABR.
SVI_STARTS, SABR_STARTS = (0.02, 0.1, 0.4), ((-0.3, 0.5), (0.0, 1.5), (-0.6, 2.5))
#: Where the density indicator is looked at, within the strikes of a smile; what counts as negative.
GRID, TINY = 101, -1e-9


def svi_variance(k, a, b, rho, m, sigma):
    return a + b * (rho * (k - m) + np.sqrt((k - m) ** 2 + sigma * sigma))


def butterfly(k, a, b, rho, m, sigma):
    root = np.sqrt((k - m) ** 2 + sigma * sigma)
    w = svi_variance(k, a, b, rho, m, sigma)
    w1, w2 = b * (rho + (k - m) / root), b * sigma * sigma / root**3
    with np.errstate(all="ignore"):
        return np.where(w > 0, (1 - k * w1 / (2 * w)) ** 2 - w1**2 / 4 * (1 / w + 0.25) + w2 / 2, -np.inf)


def sabr_vol(f, k, t, alpha, rho, nu):
    z = nu / alpha * np.log(f / k)
    near = (np.abs(np.log(f / k)) < 1e-9) | (np.abs(nu) < 1e-12)
    safe = np.where(near, 1e-6, z)
    ratio = np.where(near, 1.0, safe / np.log((np.sqrt(1 - 2 * rho * safe + safe * safe) + safe - rho) / (1 - rho)))
    return alpha * ratio * (1 + (rho * nu * alpha / 4 + (2 - 3 * rho * rho) * nu * nu / 24) * t)


Residual = Callable[[np.ndarray, np.ndarray], np.ndarray]


def least_squares(residual: Residual, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg and Marquardt's method for each row of start, within bounds: the parameters and the sums of squares. residual(parameters, lanes): a row for each of lanes."""
    p, lanes = np.clip(start, low, high), np.arange(len(start))
    r = residual(p, lanes)
    cost, damp = (r * r).sum(1), np.full(len(p), 1e-3)
    live, size = np.isfinite(cost), np.eye(p.shape[1]) * 1e-6
    for _ in range(steps):
        at = np.flatnonzero(live)
        if not len(at):
            break
        own = p[at]
        # a step away from the bound that a parameter is at
        signs = [np.where(own[:, i : i + 1] + 1e-6 > high[i], -1.0, 1.0) for i in range(p.shape[1])]
        jacobian = np.stack([(residual(own + s * e, at) - r[at]) / (s * 1e-6) for s, e in zip(signs, size, strict=True)], 2)
        normal = np.einsum("lni,lnj->lij", jacobian, jacobian)
        gradient = np.einsum("lni,ln->li", jacobian, r[at])
        diagonal = np.einsum("lii->li", normal)
        solvable = np.isfinite(normal).all((1, 2)) & np.isfinite(gradient).all(1)
        left = normal + np.eye(p.shape[1]) * (damp[at, None] * (diagonal + 1e-12) + 1e-14)[:, None, :]
        left[~solvable], gradient[~solvable] = np.eye(p.shape[1]), 0.0
        new = np.clip(own - np.clip(np.linalg.solve(left, gradient[:, :, None])[:, :, 0], -1, 1), low, high)
        r_new = residual(new, at)
        cost_new = (r_new * r_new).sum(1)
        better = cost_new < cost[at]
        gain = cost[at] - cost_new
        done = ~solvable | better & (gain <= 1e-9 * cost[at] + 1e-24) | ~better & (damp[at] > 1e10) | (np.abs(new - own).max(1) < 1e-13)
        p[at[better]], r[at[better]], cost[at[better]] = new[better], r_new[better], cost_new[better]
        damp[at] = np.where(better, damp[at] / 5, damp[at] * 5)
        live[at[done]] = False
    return p, cost


def in_polygon(h11, h12, h22, g1, g2, reach) -> tuple[np.ndarray, np.ndarray]:
    """The (d, c) of least (d, c) H (d, c)' - 2 g (d, c)' with |d| <= MOST_RHO c and c + |d| <= reach: the free optimum where it is feasible, else the best of the four edges."""
    quadratic = lambda d, c: h11 * d * d + 2 * h12 * d * c + h22 * c * c - 2 * (g1 * d + g2 * c)
    det = h11 * h22 - h12 * h12
    with np.errstate(all="ignore"):
        d, c = (g1 * h22 - g2 * h12) / det, (g2 * h11 - g1 * h12) / det
    free = (det > 1e-14 * h11 * h22) & (c > 0) & (np.abs(d) <= MOST_RHO * c) & (c + np.abs(d) <= reach)
    best_d, best_c, best = np.where(free, d, 0.0), np.where(free, c, 0.0), np.where(free, -np.inf, np.inf)
    corner = reach / (1 + MOST_RHO)
    zero = np.zeros_like(reach)
    for side in (-1.0, 1.0):
        tip = (side * MOST_RHO * corner, corner)
        for (d0, c0), (d1, c1) in (((zero, zero), tip), ((zero, reach), tip)):
            u, v = d1 - d0, c1 - c0
            bend = h11 * u * u + 2 * h12 * u * v + h22 * v * v
            down = u * (g1 - h11 * d0 - h12 * c0) + v * (g2 - h12 * d0 - h22 * c0)
            s = np.clip(np.divide(down, bend, out=np.zeros_like(down), where=bend > 0), 0, 1)
            d, c = d0 + s * u, c0 + s * v
            value = quadratic(d, c)
            better = value < best
            best_d, best_c, best = np.where(better, d, best_d), np.where(better, c, best_c), np.where(better, value, best)
    return best_d, best_c


def svi_inner(k, w, on, m, sigma, reach) -> tuple[np.ndarray, np.ndarray]:
    """(a, d, c) of each lane for its (m, sigma), and the residuals. The least total variance isn't negative."""
    y = (k - m[:, None]) / sigma[:, None]
    z = np.sqrt(y * y + 1)
    n = on.sum(1)
    mean = lambda x: (x * on).sum(1) / n
    centred = lambda x: (x - mean(x)[:, None]) * on
    yc, zc, wc = centred(y), centred(z), centred(w)
    dot = lambda a, b: (a * b).sum(1)
    d, c = in_polygon(dot(yc, yc), dot(yc, zc), dot(zc, zc), dot(yc, wc), dot(zc, wc), reach)
    a = mean(w) - d * mean(y) - c * mean(z)
    under = np.flatnonzero(a + np.sqrt(np.maximum(c * c - d * d, 0)) < 0)
    if len(under):
        # the bound on the least variance is active: a follows from c and rho, and c is linear for a given rho
        yu, zu, wu = (np.where(on[under], x[under], 0.0) for x in (y, z, w))
        rho = np.linspace(-MOST_RHO, MOST_RHO, 65)
        best = np.full(len(under), np.inf)
        for q in rho:
            e = np.where(on[under], -math.sqrt(1 - q * q) + q * yu + zu, 0.0)
            norm = dot(e, e)
            own = np.clip(np.divide(dot(e, wu), norm, out=np.zeros_like(norm), where=norm > 0), 0, reach[under] / (1 + abs(q)))
            err = dot(own[:, None] * e - wu, own[:, None] * e - wu)
            better = err < best
            at = under[better]
            best, c[at], d[at], a[at] = np.where(better, err, best), own[better], q * own[better], -math.sqrt(1 - q * q) * own[better]
        d0, c0 = in_polygon(dot(yu, yu), dot(yu, zu), dot(zu, zu), dot(yu, wu), dot(zu, wu), reach[under])
        r = (d0[:, None] * yu + c0[:, None] * zu - wu) * on[under]
        better = dot(r, r) < best
        at = under[better]
        a[at], d[at], c[at] = 0.0, d0[better], c0[better]
    return np.stack([a, d, c], 1), (a[:, None] + d[:, None] * y + c[:, None] * z - w) * on


def svi_lanes(k: np.ndarray, iv: np.ndarray, on: np.ndarray, t: np.ndarray, arbitrage_free: bool = True) -> tuple[np.ndarray, list[str | None]]:
    """(a, b, rho, m, sigma) of each lane, and what is wrong with it."""
    n = len(k)
    if not n:
        return np.zeros((0, 5)), []
    w = np.where(on, iv * iv * t[:, None], 0.0)
    k = np.where(on, k, 0.0)
    lowest = k[np.arange(n), np.where(on, w, np.inf).argmin(1)]
    starts = [np.stack([m, np.full(n, math.log(s))], 1) for m in (np.zeros(n), (k * on).sum(1) / on.sum(1), lowest) for s in SVI_STARTS]
    many = len(starts)
    of = np.tile(np.arange(n), many)

    def residual(p: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        i, sigma = of[lanes], np.exp(p[:, 1])
        return svi_inner(k[i], w[i], on[i], p[:, 0], sigma, 4 / t[i] * sigma)[1]

    low, high = np.array([-MOST_M, math.log(SIGMA[0])]), np.array([MOST_M, math.log(SIGMA[1])])
    p, cost = least_squares(residual, np.concatenate(starts), low, high)
    best = np.where(np.isfinite(cost), cost, np.inf).reshape(many, n).argmin(0)
    p = p.reshape(many, n, 2)[best, np.arange(n)]
    m, sigma = p[:, 0], np.exp(p[:, 1])
    a, d, c = svi_inner(k, w, on, m, sigma, 4 / t * sigma)[0].T
    rho = np.divide(d, c, out=np.zeros_like(d), where=c > 0)
    found = np.stack([a, c / sigma, rho, m, sigma], 1)
    problems: list[str | None] = [None if np.isfinite(x).all() else "no admissible fit" for x in found]
    if arbitrage_free:
        lowest, highest = np.where(on, k, np.inf).min(1), np.where(on, k, -np.inf).max(1)
        grid = lowest[:, None] + (highest - lowest)[:, None] * np.linspace(0, 1, GRID)
        bad = (butterfly(grid, *(x[:, None] for x in found.T)) < TINY).any(1)
        problems = [x or ("butterfly arbitrage" if b else None) for x, b in zip(problems, bad.tolist(), strict=True)]
    return found, problems


def sabr_lanes(f: np.ndarray, strike: np.ndarray, iv: np.ndarray, on: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """(F, alpha, rho, nu) of each lane, and what is wrong with it."""
    n = len(f)
    if not n:
        return np.zeros((0, 4)), []
    strike, iv = np.where(on, strike, f[:, None]), np.where(on, iv, 0.0)
    level = np.log(np.maximum(np.nanmedian(np.where(on, iv, np.nan), 1), 1e-3))
    starts = [np.stack([level, np.full(n, math.atanh(rho)), np.full(n, math.log(nu))], 1) for rho, nu in SABR_STARTS]
    of = np.tile(np.arange(n), len(starts))
    unpack = lambda p: (np.exp(p[:, 0]), np.tanh(p[:, 1]) * MOST_RHO, np.exp(p[:, 2]))

    def residual(p: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        i = of[lanes]
        with np.errstate(all="ignore"):
            return np.where(on[i], sabr_vol(f[i][:, None], strike[i], t[i][:, None], *(x[:, None] for x in unpack(p))) - iv[i], 0.0)

    p, cost = least_squares(residual, np.concatenate(starts), np.array([-8.0, -6.0, -5.0]), np.array([8.0, 6.0, 5.0]), 120)
    cost = np.where(np.isfinite(cost), cost, np.inf).reshape(len(starts), n)
    p = p.reshape(len(starts), n, 3)[cost.argmin(0), np.arange(n)]
    return np.stack([f, *unpack(p)], 1), [None if np.isfinite(c) else "no finite fit" for c in cost.min(0)]


def poly_lanes(k: np.ndarray, iv: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """(c0, c1, c2) of each lane by least squares, from log strikes scaled to a width of one; and what is wrong with it."""
    n = len(k)
    if not n:
        return np.zeros((0, 3)), []
    centre = (k * on).sum(1) / on.sum(1)
    spread = np.maximum(np.abs((k - centre[:, None]) * on).max(1), 1e-300)
    x = (k - centre[:, None]) / spread[:, None]
    basis = np.stack([np.ones_like(x), x, x * x], 2) * on[:, :, None]
    normal, right = np.einsum("lni,lnj->lij", basis, basis), np.einsum("lni,ln->li", basis, np.where(on, iv, 0.0))
    singular = np.linalg.matrix_rank(normal, hermitian=True) < 3
    normal[singular] = np.eye(3)
    # once more on what the first solution leaves, for the last digits
    first = np.linalg.solve(normal, right[:, :, None])
    rest = np.einsum("lni,ln->li", basis, np.where(on, iv, 0.0) - np.einsum("lni,li->ln", basis, first[:, :, 0]))
    b0, b1, b2 = (first + np.linalg.solve(normal, rest[:, :, None]))[:, :, 0].T
    c2, c1 = b2 / spread**2, b1 / spread
    return np.stack([b0 - c1 * centre + c2 * centre**2, c1 - 2 * c2 * centre, c2], 1), ["singular points" if s else None for s in singular.tolist()]


def padded(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one width, and which of their values are there."""
    width = max((len(v) for v in values), default=0)
    out, on = np.zeros((len(values), width)), np.zeros((len(values), width), bool)
    for i, v in enumerate(values):
        out[i, : len(v)], on[i, : len(v)] = v, True
    return out, on
