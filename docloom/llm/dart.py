"""DartMinHash: fast weighted minhash signatures for sparse sets.

Every element of the universe has darts, points (weight, rank) of a Poisson process of unit intensity;
each dart also falls on one of k coordinates. A weighted set throws the darts whose weight lies under
its element's weight. The dart of least rank on a coordinate is that coordinate's minhash: two sets
share it with a probability of their weighted Jaccard similarity. Only darts up to a rank that gives
about k (ln k + 4) of them are looked at, so a signature costs the elements plus those darts, not their
product with k. The plane is cut into strips of weight and rank; a hash of element and strip
tells how many darts are in it, and hashes of that their places.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .common import mix

FIRST_RANK, RATIO, WIDEST = 1 / 16, 1.5, 8.0


def _strip(i: int) -> tuple[float, float]:
    """Low and high rank of strip i: growing by RATIO, then of equal width."""
    low = 0.0
    high = FIRST_RANK
    for _ in range(i):
        low, high = high, min(high * RATIO, high + WIDEST)
    return low, high


@lru_cache(maxsize=4096)
def _strips(i: int) -> tuple[float, float]:
    return _strip(i)


@lru_cache(maxsize=4096)
def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in an area."""
    n = int(area + 12 * math.sqrt(area) + 20)
    k = np.arange(n)
    logs = k * math.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n)))])
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def signatures(elements: np.ndarray, weights: np.ndarray | None, bounds: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """A row of k dart numbers (uint64) for each set; set i has the distinct elements bounds[i]:bounds[i + 1].
    No weights means weights of 1. An empty set's row is zeros."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    mass = np.bincount(owner, weights, minlength=n).astype(np.float64) if n else np.zeros(0)
    out = np.zeros((n, k), np.uint64)
    todo = np.flatnonzero((sizes > 0) & (mass > 0))
    wanted = k * (math.log(k) + 4)
    while len(todo):
        here = np.zeros(n, bool)
        here[todo] = True
        pick = here[owner]
        done = _throw(elements[pick], None if weights is None else weights[pick], owner[pick], wanted / np.where(mass > 0, mass, 1), k, seed, out, todo)
        todo = todo[~done]
        wanted *= 2
    return out


def _throw(elements, weights, owner, theta, k, seed, out, todo) -> np.ndarray:
    """Fill out's rows of todo; true where every coordinate got a dart."""
    base = mix(elements ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    slot = np.full(len(theta), -1)
    slot[todo] = np.arange(len(todo))
    best = np.full(len(todo) * k, np.inf)
    names = np.zeros(len(todo) * k, np.uint64)
    top = theta[owner]
    heaviest = 1.0 if weights is None else float(weights.max())
    level, light = 0, 0.0
    while light < heaviest:
        heavy = 1.0 if level == 0 else light * 2
        strip = 0
        while True:
            low, high = _strips(strip)
            live = top > low if weights is None else (top > low) & (weights > light)
            if not live.any():
                break
            whole = bool(live.all())
            h = base if whole else base[live]
            h = mix(h + np.uint64((level * 4099 + strip + 1) * 0xD1342543DE82EF95 & (2**64 - 1)))
            steps = _poisson((heavy - light) * (high - low))
            u = _unit(h)
            some = np.flatnonzero(u >= steps[0])
            if len(some):
                counts = np.searchsorted(steps, u[some], "right")
                own = (owner if whole else owner[live])[some]
                of = np.repeat(np.arange(len(some)), counts)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                d = mix(h[some][of] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                rank = low + (high - low) * (d >> np.uint64(32)).astype(np.float64) * (1.0 / (1 << 32))
                inside = rank <= (top if whole else top[live])[some][of]
                if weights is not None and heavy > 1e-300:
                    at = light + (heavy - light) * _unit(mix(d ^ np.uint64(0xA0761D6478BD642F)))
                    inside &= at <= (weights if whole else weights[live])[some][of]
                d, rank, own = d[inside], rank[inside], own[of[inside]]
                cell = slot[own] * k + (((d & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(best, cell, rank)
                won = rank == best[cell]
                names[cell[won]] = d[won]
            strip += 1
        level, light = level + 1, heavy
    out[todo] = names.reshape(len(todo), k)
    return np.isfinite(best.reshape(len(todo), k)).all(1)
