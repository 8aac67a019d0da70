"""Work on pixels in numpy: resizing, painting masks, feathering, blurring, and the operators that run it over frame tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MASKS

FILL = 114  # fixed: the grey around a letterboxed image
BoxT = tuple[int, int, int, int]


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image, rounded; gray images stay."""
    if image.ndim == 2:
        return image
    return np.rint(image.astype(np.float64) @ (0.114, 0.587, 0.299)).astype(np.uint8)


def resize_linear(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    (y0, y1, fy), (x0, x1, fx) = axis(image.shape[0], height), axis(image.shape[1], width)
    img = image.astype(np.float64).reshape(*image.shape[:2], -1)
    fy, fx = fy[:, None, None], fx[None, :, None]
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8).reshape(height, width, *image.shape[2:])


def resize_area(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel the mean of the area it stands for; for shrinking."""

    def share(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        cell = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, None) * (m / n)

    img = image.astype(np.float64).reshape(*image.shape[:2], -1)
    out = np.einsum("yY,YXc,xX->yxc", share(img.shape[0], height), img, share(img.shape[1], width), optimize=True)
    return np.rint(out).astype(np.uint8).reshape(height, width, *image.shape[2:])


def letterboxed(image: np.ndarray, size: int) -> tuple[np.ndarray, float, int, int]:
    """The image fitted into a square, with its scale and padding."""
    h, w = image.shape[:2]
    scale = size / max(h, w)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    out = np.full((size, size, *image.shape[2:]), FILL, np.uint8)
    x, y = (size - nw) // 2, (size - nh) // 2
    out[y : y + nh, x : x + nw] = (resize_area if scale < 1 else resize_linear)(image, nw, nh)
    return out, scale, x, y


def gaussian_weights(radius: int) -> np.ndarray:
    """Weights of 2 radius + 1 taps; the width follows from their number."""
    taps = 2 * radius + 1
    sigma = 0.3 * ((taps - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(taps) - radius) ** 2) / (2 * sigma**2))
    return k / k.sum()


def _along(image: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    r = len(weights) // 2
    pad = [(0, 0)] * image.ndim
    pad[axis] = (r, r)
    padded = np.pad(image, pad, mode="reflect" if image.shape[axis] > r else "edge")
    return sum(w * np.take(padded, range(k, k + image.shape[axis]), axis) for k, w in enumerate(weights))


def paint(width: int, height: int, boxes: Iterable[BoxT], feather_px: int = 0) -> np.ndarray:
    """A mask: 0 outside, 255 inside, both corners of a box in, grey where feathered."""
    mask = np.zeros((height, width), np.uint8)
    for x, y, w, h in boxes:
        mask[max(0, y) : max(0, y + h + 1), max(0, x) : max(0, x + w + 1)] = 255
    if feather_px > 0 and mask.any():
        k = gaussian_weights(feather_px)
        mask = np.rint(_along(_along(mask.astype(np.float64), k, 0), k, 1)).astype(np.uint8)
    return mask


def box_blur(image: np.ndarray, radius: int, passes: int = 2) -> np.ndarray:
    """Mean over a square, by running sums, several times; edges repeat."""
    out = image.astype(np.float64)
    for _ in range(passes):
        for axis in (0, 1):
            pad = [(0, 0)] * out.ndim
            pad[axis] = (radius + 1, radius)
            total = np.cumsum(np.pad(out, pad, mode="edge"), axis)
            n = out.shape[axis]
            out = (np.take(total, range(2 * radius + 1, 2 * radius + 1 + n), axis) - np.take(total, range(n), axis)) / (2 * radius + 1)
    return np.rint(out).astype(np.uint8)


def composite(image: np.ndarray, mask: np.ndarray, radius: int) -> np.ndarray:
    """Blurred where the mask says so; pixels outside are the same to the bit."""
    if not mask.any():
        return image
    a = mask.reshape(*mask.shape, *([1] * (image.ndim - 2))).astype(np.float64) / 255
    mixed = np.rint(image + (box_blur(image, radius) - image.astype(np.float64)) * a).astype(np.uint8)
    return np.where(a > 0, mixed, image)


def covered(mask: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> float | None:
    """Share of a rectangle under the mask, feathering included; None without area."""
    part = mask[max(0, y1) : y2, max(0, x1) : x2]
    return float((part > 0).mean()) if part.size else None


def to_image(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape((height, width, channels) if channels > 1 else (height, width))


# operators on tables
Parts = Iterator[pd.DataFrame]
#: Bytes of masks that are held at a time, one mask at least: a batch has thousands of rows, whose masks together would fill an executor.
MASK_BYTES = 16 << 20


def _pieces(p: pd.DataFrame) -> Parts:
    """The rows in order, few enough at a time for ``MASK_BYTES``."""
    total = np.cumsum([0, *(p["width"].to_numpy(np.int64) * p["height"].to_numpy(np.int64))])
    at = 0
    while at < len(p):
        till = max(at + 1, int(np.searchsorted(total, total[at] + MASK_BYTES, "right")) - 1)
        yield p.iloc[at:till]
        at = till


def _render(parts: Parts, feather_px: int, then: Callable[[Parts], Parts] | None = None) -> Parts:
    painted = (
        p.drop(columns="boxes").assign(mask=[paint(r.width, r.height, [tuple(b[c] for c in "xywh") for b in (r.boxes if r.boxes is not None else [])], feather_px).tobytes() for r in p.itertuples()])
        for whole in parts for p in _pieces(whole)
    )
    return then(painted) if then else painted


def _with_boxes(frames: DataFrame, timeline_boxes: DataFrame) -> DataFrame:
    lists = timeline_boxes.groupBy("clip_id", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("boxes"))
    return frames.join(lists, ["clip_id", "frame_idx"], "left")


def render_masks(frames: DataFrame, timeline_boxes: DataFrame, feather_px: int = 8, then: Callable[[Parts], Parts] | None = None, schema: str = MASKS) -> DataFrame:
    """A mask for every frame (clip_id, frame_idx, width, height), those without boxes too; or what ``then`` makes of the masks, a few at a
    time where they are painted, as rows of ``schema``."""
    joined = _with_boxes(frames.select("clip_id", "frame_idx", "width", "height"), timeline_boxes)
    return joined.mapInPandas(partial(_render, feather_px=feather_px, then=then), schema)


def _blur(parts: Iterator[pd.DataFrame], strength: int, base: int) -> Iterator[pd.DataFrame]:
    for p in parts:
        out = []
        for r in p.itertuples():
            image, mask = to_image(r.pixels, r.width, r.height, r.channels), np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width)
            out.append(composite(image, mask, max(2, round(strength * r.width / base))).tobytes())
        yield p.drop(columns="mask").assign(pixels=out)


def blur_frames(frames: DataFrame, masks: DataFrame, strength: int = 12, base: int = 1920) -> DataFrame:
    """Frames with what their masks hold blurred."""
    joined = frames.join(masks.select("clip_id", "frame_idx", "mask"), ["clip_id", "frame_idx"])
    return joined.mapInPandas(partial(_blur, strength=strength, base=base), frames.schema)


CABIN = ("det_id", "x", "y", "w", "h", "x1", "y1", "x2", "y2")


def _cover(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for r in p.itertuples():
            mask = np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width)
            rows += [(r.clip_id, r.frame_idx, *(c[k] for k in CABIN[:5]), covered(mask, *(c[k] for k in CABIN[5:]))) for c in r.cabins]
        yield pd.DataFrame(rows, columns=["clip_id", "frame_idx", *CABIN[:5], "coverage"])


COVERED = "clip_id string, frame_idx int, det_id long, x int, y int, w int, h int, coverage double"


def _by_frame(cabins: DataFrame) -> DataFrame:
    return cabins.groupBy("clip_id", "frame_idx").agg(F.collect_list(F.struct(*CABIN)).alias("cabins"))


def measured(cabins: DataFrame, masks: DataFrame) -> DataFrame:
    """Coverage of cabins (x1, y1, x2, y2) of vehicles (clip_id, frame_idx, det_id and a box) by painted masks. A frame's cabins are put
    together first, so that its mask moves once."""
    joined = masks.join(_by_frame(cabins), ["clip_id", "frame_idx"]).select("clip_id", "frame_idx", "width", "height", "mask", "cabins")
    return joined.mapInPandas(_cover, COVERED)


def measured_as_painted(cabins: DataFrame, frames: DataFrame, timeline_boxes: DataFrame, feather_px: int = 8) -> DataFrame:
    """As ``measured`` over the masks that ``render_masks`` gives. They are read where they are painted, and none of them moves."""
    looked = frames.select("clip_id", "frame_idx", "width", "height").join(_by_frame(cabins), ["clip_id", "frame_idx"])
    return _with_boxes(looked, timeline_boxes).mapInPandas(partial(_render, feather_px=feather_px, then=_cover), COVERED)


def check_counts(frames: DataFrame, masks: DataFrame) -> None:
    """Every clip has as many masks as frames; raises before anything is rendered otherwise."""
    n = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames")).join(masks.groupBy("clip_id").agg(F.count(F.lit(1)).alias("masks")), "clip_id", "full")
    if bad := n.where(~F.col("frames").eqNullSafe(F.col("masks"))).first():
        raise RuntimeError(f"clip {bad['clip_id']}: {bad['masks']} masks for {bad['frames']} frames")
