"""Hashes of all runs of ``width`` code points of a text, and the least ones among neighbours, over numpy arrays."""

from __future__ import annotations

from typing import Any

import numpy as np

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE, _MIX = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` code points: a polynomial modulo 2**64, then mixed."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        c = codes.astype(np.uint64)
        c += np.uint64(1)
        c *= np.uint64(_MIX)
        c ^= c >> np.uint64(29)
        c *= _power("down", _INVERSE, n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.add.accumulate(c, out=sums[1:])
        h = sums[width:] - sums[: n - width + 1]
        h *= _power("up", _BASE, n)[: n - width + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def sliding(values: np.ndarray, width: int, best: Any) -> np.ndarray:
    """best (minimum or maximum) of every run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        step = width - have
        out = best(out[:-step], out[step:])
    return out


def least_of_neighbours(h: np.ndarray, span: int) -> np.ndarray:
    """The distinct hashes that are least in some run of ``span`` neighbours."""
    return np.unique(sliding(h, span, np.minimum)) if len(h) >= span else np.empty(0, np.uint64)
