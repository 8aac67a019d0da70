"""Drawn frames for tests and queries on pixels: no footage is needed."""

from __future__ import annotations

import numpy as np


def patch(size: int = 48) -> np.ndarray:
    """A square with texture and bright and dark lines."""
    row, col = np.mgrid[:size, :size]
    out = ((row + col) * 37 % 256).astype(np.uint8)
    out[::4], out[:, ::4] = 255, 0
    return out


def frame(x: int, y: int, width: int = 480, height: int = 270, size: int = 48) -> np.ndarray:
    """A striped background with the patch at x, y, as far as it is inside."""
    out = np.full((height, width), 50, np.uint8)
    out[6::12] = 80
    p = patch(size)
    x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + size), min(height, y + size)
    if x1 > x0 and y1 > y0:
        out[y0:y1, x0:x1] = p[y0 - y : y1 - y, x0 - x : x1 - x]
    return out


def clip(frames: int = 16, start: int = 60, pace: int = 6, y: int = 100, **size: int) -> np.ndarray:
    return np.stack([frame(start + pace * k, y, **size) for k in range(frames)])
