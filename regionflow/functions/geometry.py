"""Box algebra as Column expressions. A box is four integer columns (x, y, w, h); rounding is half to even everywhere."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | int | float


class Box(NamedTuple):
    """Four columns."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        """The columns x, y, w, h, with an affix or as fields of a struct (prefix ``s.``)."""
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in "xywh"))

    @classmethod
    def field(cls, struct: Column) -> Box:
        return cls(*(struct[c] for c in "xywh"))

    def named(self, prefix: str = "") -> list[Column]:
        return [c.cast("int").alias(f"{prefix}{n}") for c, n in zip(self, "xywh", strict=True)]


def lit(v: Number) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def even(v: Column) -> Column:
    """Rounded half to even, as an integer."""
    return F.rint(v.cast("double")).cast("int")


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the union is empty. Products are 64-bit."""
    across = F.greatest(F.lit(0), F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)).cast("long")
    down = F.greatest(F.lit(0), F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)).cast("long")
    both = across * down
    union = a.w.cast("long") * a.h.cast("long") + b.w.cast("long") * b.h.cast("long") - both
    return F.when(union > 0, both.cast("double") / union.cast("double")).otherwise(F.lit(0.0))


def center(b: Box) -> tuple[Column, Column]:
    return b.x + b.w / F.lit(2.0), b.y + b.h / F.lit(2.0)


def distance(a: Box, b: Box) -> Column:
    """Between centres."""
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def shift_clamp(b: Box, width: Number, height: Number) -> Box:
    """Into the frame. At the left and top a box moves in with its size; at the right and bottom it is cut."""
    x, y = F.greatest(F.lit(0), b.x), F.greatest(F.lit(0), b.y)
    return Box(x, y, F.greatest(F.lit(0), F.least(b.w, lit(width) - x)), F.greatest(F.lit(0), F.least(b.h, lit(height) - y)))


def dilate(b: Box, px: Number, width: Number, height: Number) -> Box:
    """Grown by px on each side, then cut to the frame on all four."""
    x, y = F.greatest(F.lit(0), b.x - px), F.greatest(F.lit(0), b.y - px)
    right, bottom = F.least(lit(width), b.x + b.w + px), F.least(lit(height), b.y + b.h + px)
    return Box(x, y, right - x, bottom - y)


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column, width: Number, height: Number) -> Box:
    """A box from any two opposite corners, rounded and cut to the frame; callers drop it unless w and h are positive."""
    left, top = F.greatest(F.lit(0), even(F.least(x1, x2))), F.greatest(F.lit(0), even(F.least(y1, y2)))
    right, bottom = F.least(lit(width), even(F.greatest(x1, x2))), F.least(lit(height), even(F.greatest(y1, y2)))
    return Box(left, top, right - left, bottom - top)


def cabin_corners(b: Box, frac: float, width: Number, height: Number) -> tuple[Column, Column, Column, Column]:
    """The upper part of a vehicle as x1, y1, x2, y2, cut to the frame after its height is taken from the whole box."""
    top = F.greatest(F.lit(1), even(b.h * F.lit(float(frac))))
    return F.greatest(F.lit(0), b.x), F.greatest(F.lit(0), b.y), F.least(lit(width), b.x + b.w), F.least(lit(height), b.y + top)


def holds_center(outer: Box, inner: Box) -> Column:
    """Whether inner's centre is in outer, borders included."""
    cx, cy = center(inner)
    return (cx >= outer.x) & (cx <= outer.x + outer.w) & (cy >= outer.y) & (cy <= outer.y + outer.h)


def at_edge(b: Box, margin: Number, width: Number, height: Number) -> Column:
    """Whether a side is within margin of the frame's, inclusive."""
    return (b.x <= margin) | (b.y <= margin) | (b.x + b.w >= lit(width) - margin) | (b.y + b.h >= lit(height) - margin)


def letterbox(width: Column, height: Column, size: Number) -> dict[str, Column]:
    """Scale, new size and padding that fit a frame into a square."""
    longest = F.greatest(width, height)
    scale = lit(size).cast("double") / longest.cast("double")
    nw, nh = F.greatest(F.lit(1), even(width * scale)), F.greatest(F.lit(1), even(height * scale))
    half = lambda n: F.floor((lit(size) - n) / F.lit(2.0)).cast("int")
    return {"scale": scale, "nw": nw, "nh": nh, "pad_x": half(nw), "pad_y": half(nh)}


def margin_floor(cls: Column, b: Box, plate_px: Number, face_frac: float) -> Column:
    """Least padding: a flat one for plates, one in proportion to the box for every other class."""
    by_size = even(F.lit(float(face_frac)) * F.greatest(b.w, b.h)) if face_frac > 0 else F.lit(0)
    return F.when(cls == "plate", lit(plate_px)).otherwise(by_size)


def motion_pad(b: Box, speed: Column, floor: Column, gain: Column | float, most: int, width: Number, height: Number) -> Box:
    """Padded by gain times speed, at most ``most`` if that is positive, and at least the floor, which comes last. A box that needs no
    padding is left alone, even beyond the frame."""
    gain = lit(gain).cast("double")
    by_speed = F.when((gain > 0) & (speed > 0), even(gain * speed)).otherwise(F.lit(0))
    pad = F.greatest(F.least(by_speed, F.lit(most)) if most > 0 else by_speed, floor)
    grown = shift_clamp(Box(b.x - pad, b.y - pad, b.w + 2 * pad, b.h + 2 * pad), width, height)
    return Box(*(F.when(pad > 0, g).otherwise(o) for g, o in zip(grown, b, strict=True)))


def emitted(cls: Column, b: Box, speed: Column, p, width: Number, height: Number) -> Box:
    """What a track shows: a vehicle its cabin without padding, any other class itself with padding. ``p`` has the tracker's
    parameters (see ``params``)."""
    face_gain = p.track_face_motion_gain if p.track_face_motion_gain > 0 else p.track_motion_gain
    gain = F.when(cls == "face", F.lit(float(face_gain))).otherwise(F.lit(float(p.track_motion_gain)))
    padded = motion_pad(b, speed, margin_floor(cls, b, p.track_plate_margin_floor_px, p.track_face_margin_frac), gain, p.track_motion_max_px, width, height)
    if p.track_cabin_frac > 0:
        cabin = shift_clamp(Box(b.x, b.y, b.w, F.greatest(F.lit(1), even(b.h * F.lit(float(p.track_cabin_frac))))), width, height)
    else:
        cabin = b
    return Box(*(F.when(cls == "vehicle", c).otherwise(o) for c, o in zip(cabin, padded, strict=True)))


def blur_radius(width: Column, strength: Number = 12) -> Column:
    """Box-blur radius for a frame width; ``strength`` is the radius at 1920."""
    return F.greatest(F.lit(2), even(lit(strength).cast("double") * width / F.lit(1920.0)))


def filter_graph(radius: Column) -> Column:
    """The video filter that blurs where the mask says so, as one string."""
    return F.concat_ws(
        ";", F.lit("[0:v]split=2[base][soft]"), F.concat(F.lit("[soft]boxblur="), radius.cast("string"), F.lit(":2[blurred]")),
        F.lit("[1:v]format=gray[m]"), F.lit("[blurred][m]alphamerge[patch]"), F.lit("[base][patch]overlay[vout]"),
    )


def timestamp(frame_idx: Column, fps: Column) -> Column:
    return F.when(fps > 0, frame_idx / fps).otherwise(frame_idx.cast("double"))
