"""Single-precision table arithmetic: arc tangent, sine and cosine from 4096 entries, and fused multiply-add.

Tables hold the rounded values of the functions at equally spaced arguments; all steps are in single precision, so results
are the same on every machine.
"""

from __future__ import annotations

import numpy as np

SIZE = 4096
F32 = np.float32
PI = F32(np.pi)

ATAN = np.arctan(np.arange(SIZE) / (SIZE - 1)).astype(F32)
COS = np.cos(np.arange(SIZE) / (SIZE - 1) * 2 * np.pi).astype(F32)
SIN = np.sin(np.arange(SIZE) / (SIZE - 1) * 2 * np.pi).astype(F32)


def fma(a, b, c) -> np.ndarray:
    """a * b + c in single precision, rounded once.

    The product is exact in double precision. The sum's error (two-sum) says on which side of the double result the exact
    one lies; where the double is inexact and even in its last bit it is moved to the odd neighbour on that side, after
    which rounding to single precision is right.
    """
    x, c = np.asarray(a, F32).astype(np.float64) * np.asarray(b, F32).astype(np.float64), np.asarray(c, F32).astype(np.float64)
    s = x + c
    t = s - x
    error = (x - (s - t)) + (c - t)
    even = (np.atleast_1d(s).view(np.int64) & 1).reshape(s.shape) == 0
    odd = np.where((error != 0) & even & np.isfinite(s), np.nextafter(s, np.where(error > 0, np.inf, -np.inf)), s)
    return odd.astype(F32)


def _look_up(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Linear interpolation between entries."""
    i = np.clip(place.astype(np.int64), 0, SIZE - 2)
    return fma(place - i.astype(F32), table[i + 1] - table[i], table[i])


def atan2(y, x) -> np.ndarray:
    y, x = np.asarray(y, F32), np.asarray(x, F32)
    a, b = np.abs(y), np.abs(x)
    swap = a > b
    low, high = np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(high > 0, low / np.where(high > 0, high, F32(1)), F32(0)).astype(F32)
    angle = _look_up(ATAN, ratio * F32(SIZE - 1))
    angle = np.where(swap, PI / F32(2) - angle, angle)
    angle = np.where(x < 0, PI - angle, angle)
    return np.where(y < 0, -angle, angle).astype(F32)


def cos_sin(angle) -> tuple[np.ndarray, np.ndarray]:
    turn = F32(2 * np.pi)
    a = np.asarray(angle, F32)
    a = (a - np.floor(a / turn) * turn).astype(F32)
    place = a * F32((SIZE - 1) / (2 * np.pi))
    return _look_up(COS, place), _look_up(SIN, place)
