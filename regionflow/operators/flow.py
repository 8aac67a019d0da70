"""Sparse optical flow in numpy, from the published algorithms: Shi-Tomasi corners, pyramidal Lucas-Kanade, RANSAC similarity."""

from __future__ import annotations

import numpy as np

#: Corners at most, their least quality against the best, distance, window; steps of Lucas-Kanade and their least move.
CORNERS, QUALITY, APART, WINDOW = 64, 0.01, 4, 7
STEPS, LEAST_MOVE = 10, 0.03
RANSAC_TRIES, RANSAC_PIXELS = 100, 3.0


def _sum_window(a: np.ndarray, n: int) -> np.ndarray:
    r = n // 2
    total = np.cumsum(np.cumsum(np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge"), 0), 1)
    return total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]


def _gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(a, 1, mode="edge")
    smooth_y, smooth_x = (3 * p[:-2] + 10 * p[1:-1] + 3 * p[2:]) / 16, (3 * p[:, :-2] + 10 * p[:, 1:-1] + 3 * p[:, 2:]) / 16
    return (smooth_y[:, 2:] - smooth_y[:, :-2]) / 2, (smooth_x[2:] - smooth_x[:-2]) / 2


def corners(image: np.ndarray) -> np.ndarray:
    """(n, 2) corners as x, y, strongest first; empty in a barren image."""
    if min(image.shape) < 3:
        return np.empty((0, 2))
    gx, gy = _gradients(image.astype(np.float64))
    a, b, c = (_sum_window(g, WINDOW) for g in (gx * gx, gx * gy, gy * gy))
    weaker = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    if weaker.max() <= 1e-6:
        return np.empty((0, 2))
    p = np.pad(weaker, 1, constant_values=-np.inf)
    around = np.max([p[i : i + weaker.shape[0], j : j + weaker.shape[1]] for i in range(3) for j in range(3)], 0)
    ys, xs = np.nonzero((weaker >= around) & (weaker >= QUALITY * weaker.max()))
    order = np.lexsort((xs, ys, -weaker[ys, xs]))
    kept: list[tuple[int, int]] = []
    for x, y in zip(xs[order].tolist(), ys[order].tolist(), strict=True):
        if all((x - u) ** 2 + (y - v) ** 2 >= APART**2 for u, v in kept):
            kept.append((x, y))
            if len(kept) == CORNERS:
                break
    return np.array(kept, np.float64).reshape(-1, 2)


def pyramid(image: np.ndarray, levels: int) -> list[np.ndarray]:
    """The image and ``levels`` halvings of it, smoothed first."""
    out, k = [image.astype(np.float64)], np.array([1, 4, 6, 4, 1]) / 16
    for _ in range(levels):
        a = out[-1]
        if min(a.shape) < 8:
            break
        for axis in (0, 1):
            p = np.pad(a, [(2, 2) if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
            a = sum(w * np.take(p, range(i, i + a.shape[axis]), axis) for i, w in enumerate(k))
        out.append(a[::2, ::2])
    return out


def _at(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples; beyond the border the border repeats."""
    h, w = image.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(y.astype(int), max(0, h - 2)), np.minimum(x.astype(int), max(0, w - 2))
    fy, fx = y - i, x - j
    i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    return image[i, j] * (1 - fx) * (1 - fy) + image[i, j1] * fx * (1 - fy) + image[i1, j] * (1 - fx) * fy + image[i1, j1] * fx * fy


def track_points(before: list[np.ndarray], after: list[np.ndarray], points: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where points went between two pyramids, and which of them could be followed."""
    r = window // 2
    dy, dx = (g.ravel() for g in np.mgrid[-r : r + 1, -r : r + 1])
    shift, fine = np.zeros_like(points), np.ones(len(points), bool)
    for level in range(min(len(before), len(after)) - 1, -1, -1):
        a, b, scale = before[level], after[level], 2.0**level
        gx, gy = _gradients(a)
        px, py = (points / scale).T[:, :, None] + np.stack([dx, dy])[:, None, :]
        ax, ix, iy = _at(a, px, py), _at(gx, px, py), _at(gy, px, py)
        xx, xy, yy = (ix * ix).sum(1), (ix * iy).sum(1), (iy * iy).sum(1)
        det = xx * yy - xy * xy
        low = ((xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)) / len(dx)
        solid = (low > 1e-3) & (det > 1e-9)
        move, going = shift / scale, solid.copy()
        for _ in range(STEPS):
            if not going.any():
                break
            k = np.flatnonzero(going)
            diff = ax[k] - _at(b, px[k] + move[k, 0, None], py[k] + move[k, 1, None])
            ex, ey = (diff * ix[k]).sum(1), (diff * iy[k]).sum(1)
            d = np.stack([(yy[k] * ex - xy[k] * ey) / det[k], (xx[k] * ey - xy[k] * ex) / det[k]], 1)
            move[k] += d
            going[k] = np.hypot(*d.T) > LEAST_MOVE
        shift = move * scale
        if level == 0:
            fine &= solid
    out = points + shift
    h, w = after[0].shape
    fine &= (out[:, 0] >= 0) & (out[:, 1] >= 0) & (out[:, 0] < w) & (out[:, 1] < h) & np.isfinite(out).all(1)
    return out, fine


def similarity(src: np.ndarray, dst: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray | None, int]:
    """The rotation, uniform scale and shift (a 2x3 matrix) that most pairs agree with, and how many."""
    if len(src) < 2:
        return None, 0
    z, w = src[:, 0] + 1j * src[:, 1], dst[:, 0] + 1j * dst[:, 1]
    best = np.zeros(len(z), bool)
    for _ in range(RANSAC_TRIES):
        i, j = rng.choice(len(z), 2, replace=False)
        if z[i] == z[j]:
            continue
        a = (w[i] - w[j]) / (z[i] - z[j])
        near = np.abs(a * z + (w[i] - a * z[i]) - w) <= RANSAC_PIXELS
        if near.sum() > best.sum():
            best = near
            if best.all():
                break
    if best.sum() < 2:
        return None, 0
    zc, wc = z[best] - z[best].mean(), w[best] - w[best].mean()
    norm = (np.abs(zc) ** 2).sum()
    if norm == 0:
        return None, 0
    a = (np.conj(zc) * wc).sum() / norm
    b = w[best].mean() - a * z[best].mean()
    return np.array([[a.real, -a.imag, b.real], [a.imag, a.real, b.imag]]), int(best.sum())
