"""Gibbs draws of Chinese-restaurant seatings, all customers of a dish at once.

What a restaurant hands on of a dish is its number of tables t. Given everything else, t of a dish with c customers has the weight
S(c, t) * prod_{j<t} (strength + d * (others + j)) * q_j: S, a generalised Stirling number of discount d, is the weight of all
seatings of c customers at t tables; `others` are the tables of the other dishes; q_j is the parent's probability of the dish
after j more of its tables. Drawing t from these weights removes every customer of the dish and seats all of them anew.

Up to LIMIT customers the weights are summed over all t, with exact Stirling numbers (up to FEW by ratios of neighbours, without logarithms). Beyond it the weights are
looked at on a coarse grid first, then on a fine one around the most likely t; Stirling numbers come from their alternating series, and from
a saddle point where that would cancel.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

LIMIT, FEW = 1024, 32
EDGES = [2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, LIMIT]
SERIES, NEAR = 48, 2.0
COARSE, FINE = 48, 128


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers."""
    x = np.asarray(x, np.float64)
    shift, small = np.zeros_like(x), x < 8
    if small.any():
        y = np.where(small, x, 8.0)
        part = np.ones_like(y)
        for k in range(8):
            part = part * (y + k)
        shift, x = np.where(small, np.log(part), 0.0), np.where(small, x + 8, x)
    i = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / x - shift


@cache
def stirling(d: float, limit: int = LIMIT) -> np.ndarray:
    """Logarithms of S(c, t) at [t - 1, c], for c up to limit."""
    out = np.full((limit + 1, limit), -np.inf)
    out[1, 0] = 0.0
    t = np.arange(1, limit + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, limit):
            stay = np.where(t <= c, out[c] + np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
            out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
    return np.ascontiguousarray(out.T.astype(np.float32))


@cache
def _ratios(d: float) -> np.ndarray:
    """S(c, t + 1) / S(c, t) at [t - 1, c], for c up to FEW."""
    s = stirling(d)[: FEW + 1, : FEW + 1].astype(np.float64)
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(np.exp(s[1:] - s[:-1]), nan=0.0, posinf=0.0)


@cache
def _inverse(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Log of (power - 1) in rising order, and where _parts has it."""
    z = np.linspace(60, -60, 24_001)
    return np.log(np.maximum(_parts(z, d)[2] - 1, 1e-300)), z


def _series(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Log S(c, t) - log (c - 1)! as sum over j of (-1)^j C(t, j) gamma(c - d j) / gamma(-d j) over t! d^t; for t up to a few c^d."""
    total, way = np.zeros_like(t), np.ones_like(t)
    gammas = np.exp(log_gamma(c - d * np.arange(SERIES)) - log_gamma(c))  # a column a step
    for j in range(1, SERIES):
        way *= (j - 1 - t) / j
        if d * j != round(d * j):
            total += way * (gammas[:, j : j + 1] / math.gamma(-d * j))
    return np.log(np.maximum(total, 1e-300)) - log_gamma(t + 1) - t * math.log(d)


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Log S(c, t) - log (c - 1)! by the saddle point of ((1 - (1 - x)^d) / d)^t at the power c."""
    at, z = _inverse(d)
    x, g, m, y = _parts(np.interp(np.log(c / t - 1), at, z), d)
    spread = t * (m * (1 + (1 - d) * x / y) - m * m)
    return np.log(c) - log_gamma(t + 1) + t * np.log(g) - c * np.log(x) - 0.5 * np.log(2 * math.pi * np.maximum(spread, 1e-300))


def _parts(z: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For z = log((1 - x) / x): x, g(x) = (1 - (1 - x)^d) / d, x g'(x) / g(x), and 1 - x."""
    e = np.exp(-np.abs(z))
    x = np.where(z > 0, e, 1.0) / (1 + e)
    log_y = np.minimum(z, 0) - np.log1p(e)
    g = -np.expm1(d * log_y) / d
    return x, g, x * np.exp((d - 1) * log_y) / g, np.exp(log_y)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Log S(c, t) - log (c - 1)! for rows of more than LIMIT customers: c of shape (n, 1), t of shape (n, k)."""
    out = -log_gamma(c) + np.zeros_like(t)  # as many tables as customers
    near = t < NEAR * c**d
    wide = np.broadcast_to(c, t.shape)
    far = ~near & (t < c)
    out[far] = _saddle(wide[far], np.minimum(t, c - 0.5)[far], d)
    if near.any():
        out = np.where(near, _series(c, np.minimum(t, NEAR * c**d), d), out)
    return out


def _rising(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log of x (x + 1) ... (x + t - 1)."""
    return log_gamma(x + t) - log_gamma(x)


def draw(c: np.ndarray, others: np.ndarray, d: float, strength: float, first: np.ndarray, later: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish. others: tables of the restaurant's other dishes; first: the parent's probability of the dish before its
    tables count there; later: (base, step), q_j = (base + j * step) for the j-th further table, j from 1."""
    t = np.minimum(c, 1).astype(np.int64)
    base, step = later
    for lo, hi in zip([1, *EDGES[:-1]], EDGES, strict=True):
        at = np.flatnonzero((c > lo) & (c <= hi))
        if hi <= FEW:
            for s in range(0, len(at), 16_384):
                i = at[s : s + 16_384]
                t[i] = _draw_few(c[i], hi, strength + d * others[i], d, base[i], step, rng)
            continue
        for s in range(0, len(at), max(1, 2_000_000 // hi)):
            i = at[s : s + max(1, 2_000_000 // hi)]
            j = np.arange(hi)[:, None]  # a row a table count: all steps run along the dishes
            way = strength + d * (others[i] + j)
            way[0] *= first[i]
            way[1:] *= base[i] + step * j[1:]
            weight = np.cumsum(np.log(way, out=way), axis=0) + stirling(d)[:hi, c[i]]
            weight -= weight.max(axis=0)
            weight = np.cumsum(np.exp(weight, out=weight), axis=0)
            t[i] = 1 + (weight < rng.random(len(i)) * weight[-1]).sum(axis=0)
    at = np.flatnonzero(c > LIMIT)
    for s in range(0, len(at), 2_000):
        i = at[s : s + 2_000]
        t[i] = _draw_many(c[i].astype(np.float64), others[i].astype(np.float64), d, strength, first[i], base[i], step, rng)
    return t


def _draw_few(c: np.ndarray, hi: int, room: np.ndarray, d: float, base: np.ndarray, step: float, rng: np.random.Generator) -> np.ndarray:
    ratio, weight, q = _ratios(d), np.ones(len(c)), base
    sums = [weight]
    for j in range(1, hi):
        room, q = room + d, q + step
        weight = weight * ratio[j - 1, c] * room * q
        sums.append(sums[-1] + weight)
    mark, t = rng.random(len(c)) * sums[-1], np.ones(len(c), np.int64)
    for x in sums[:-1]:
        t += x < mark
    return t


def _draw_many(c: np.ndarray, others: np.ndarray, d: float, strength: float, first: np.ndarray, base: np.ndarray, step: float, rng: np.random.Generator) -> np.ndarray:
    def weight(t: np.ndarray) -> np.ndarray:
        """By dish and table count."""
        x = log_stirling(c[:, None], t, d) + t * math.log(d) + _rising(strength / d + others[:, None], t) + np.log(first)[:, None]
        further = t - 1
        if step > 0:
            return x + further * math.log(step) + _rising(base[:, None] / step + 1, further)
        return x + further * np.log(base)[:, None]

    grid = np.exp(np.linspace(0, 1, COARSE)[None, :] * np.log(c)[:, None])
    w = weight(grid)
    best = w.argmax(axis=1)
    row = np.arange(len(c))
    # Beyond these neighbours the weights have fallen off for good, as they have one top.
    likely = w > w[row, best][:, None] - 40
    lo = np.floor(grid[row, np.maximum(likely.argmax(axis=1) - 1, 0)])
    hi = np.ceil(grid[row, np.minimum(COARSE - likely[:, ::-1].argmax(axis=1), COARSE - 1)])
    for _ in range(2):  # once more on the part that the first fine grid found likely
        stride = np.maximum(1, np.ceil((hi - lo) / (FINE - 1)))
        fine = lo[:, None] + stride[:, None] * np.arange(FINE)
        inside = fine <= np.minimum(hi, c)[:, None]
        w = np.where(inside, weight(np.minimum(fine, c[:, None])), -np.inf)
        likely = w > w.max(axis=1, keepdims=True) - 30
        lo, hi = np.maximum(1, fine[row, likely.argmax(axis=1)] - stride), np.minimum(c, fine[row, FINE - 1 - likely[:, ::-1].argmax(axis=1)] + stride)
    p = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
    k = np.minimum((p < (rng.random(len(c)) * p[:, -1])[:, None]).sum(axis=1), FINE - 1)
    return np.clip(np.rint(fine[row, k] + (rng.random(len(c)) - 0.5) * (stride - 1)), 1, c).astype(np.int64)
