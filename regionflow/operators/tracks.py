"""From track boxes and anchors to the dense timeline: confirmation, interpolation, pre-roll, dilation. All are windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Box, dilate, even, shift_clamp

TRACK = ("clip_id", "track_id")


def confirmed(tracks: DataFrame, anchors: DataFrame, face_min_detections: int) -> DataFrame:
    """Rows of ``tracks`` but for faces detected too rarely. Anchors have a row for each association, repeats included."""
    seen = anchors.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("detections"))
    joined = tracks.join(seen, [*TRACK], "left")
    return joined.where((F.col("cls") != "face") | (F.coalesce("detections", F.lit(0)) >= face_min_detections)).select(*tracks.columns)


def with_plates(tracks: DataFrame, plates: DataFrame) -> DataFrame:
    """Rows of ``tracks`` but for vehicles that never held a plate: one sighting counts for a track's whole life. ``plates`` are boxes
    of plates by clip and frame."""
    from .boxes import corroborated

    proven = corroborated(tracks.where("cls = 'vehicle'"), plates).select(*TRACK).distinct()
    others = tracks.where("cls <> 'vehicle'")
    return others.unionByName(tracks.where("cls = 'vehicle'").join(proven, [*TRACK], "left_semi").select(*tracks.columns))


def interpolated(anchors: DataFrame) -> DataFrame:
    """Boxes for the frames between consecutive anchors, on a straight line, rounded and not cut to the frame. Anchors are distinct,
    with their boxes."""
    order = W.partitionBy(*TRACK).orderBy("frame_idx")
    ahead = anchors.select("*", *[F.lead(c).over(order).alias(f"n_{c}") for c in ("frame_idx", *"xywh")])
    gap = F.col("n_frame_idx") - F.col("frame_idx")
    rows = ahead.where(gap > 1).withColumn("i", F.explode(F.sequence(F.lit(1), gap - 1)))
    part = F.col("i") / gap.cast("double")
    keep = [c for c in anchors.columns if c not in ("frame_idx", *"xywh")]
    return rows.select(*keep, (F.col("frame_idx") + F.col("i")).cast("int").alias("frame_idx"), *[even(F.col(c) + part * (F.col(f"n_{c}") - F.col(c))).alias(c) for c in "xywh"])


def pre_roll(anchors: DataFrame, frames: int, width: int, height: int) -> DataFrame:
    """Boxes for up to ``frames`` frames before a track's first anchor, at the pace of its first two. Empty ones go before rounding."""
    order = W.partitionBy(*TRACK).orderBy("frame_idx")
    ahead = anchors.select("*", F.row_number().over(order).alias("nth"), *[F.lead(c).over(order).alias(f"n_{c}") for c in ("frame_idx", *"xywh")])
    first = ahead.where((F.col("nth") == 1) & F.col("n_frame_idx").isNotNull() & (F.col("frame_idx") > 0) & F.lit(frames > 0))
    rows = first.withColumn("f", F.explode(F.sequence(F.greatest(F.lit(0), F.col("frame_idx") - frames), F.col("frame_idx") - 1)))
    span = (F.col("n_frame_idx") - F.col("frame_idx")).cast("double")
    moved = {c: F.col(c) + (F.col(f"n_{c}") - F.col(c)) / span * (F.col("f") - F.col("frame_idx")) for c in "xywh"}
    keep = [c for c in anchors.columns if c not in ("frame_idx", *"xywh")]
    raw = rows.select(*keep, F.col("f").cast("int").alias("frame_idx"), *[v.alias(f"r_{c}") for c, v in moved.items()]).where("r_w > 0 AND r_h > 0")
    return raw.select(*keep, "frame_idx", *shift_clamp(Box(*(even(F.col(f"r_{c}")) for c in "xywh")), width, height).named())


def frame_boxes(boxes: DataFrame, anchors: DataFrame, *, face_min_detections: int = 1, interpolate: bool = False, pre_roll_frames: int = 0, width: int = 0, height: int = 0, dedup_iou: float = 0.0) -> DataFrame:
    """Confirmed boxes of every frame (clip_id, frame_idx, ord, box): interpolation overrides, pre-roll only adds, and both start from
    the boxes as tracked. ``boxes`` are emitted boxes of confirmed classes' tracks; ``ord`` is the track's."""
    from .boxes import largest_boxes

    kept = confirmed(boxes, anchors, face_min_detections)
    out = kept.select(*TRACK, "cls", "frame_idx", *"xywh")
    at_anchors = kept.join(anchors.select(*TRACK, "frame_idx").distinct(), [*TRACK, "frame_idx"], "left_semi").select(*out.columns)
    if interpolate:
        between = interpolated(at_anchors).select(*out.columns)
        out = out.join(between, [*TRACK, "frame_idx"], "left_anti").select(*between.columns).unionByName(between)
    if pre_roll_frames > 0:
        before = pre_roll(at_anchors, pre_roll_frames, width, height).select(*out.columns)
        out = out.unionByName(before.join(out.select(*TRACK, "frame_idx"), [*TRACK, "frame_idx"], "left_anti").select(*out.columns))
    return largest_boxes(out.withColumn("ord", F.col("track_id").cast("int")), dedup_iou).select("clip_id", "frame_idx", "ord", *"xywh")


def timeline(boxes: DataFrame, px: int, width: int, height: int) -> DataFrame:
    """Dilated boxes; frames without boxes have no rows."""
    return boxes.select("clip_id", "frame_idx", "ord", *dilate(Box.of(), px, width, height).named()).where("w > 0 AND h > 0")


def active_at(frames: DataFrame, timeline_boxes: DataFrame) -> DataFrame:
    """Every frame with its list of boxes, empty where there is none."""
    lists = timeline_boxes.groupBy("clip_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("ord", *"xywh"))).alias("boxes"))
    return frames.join(lists, ["clip_id", "frame_idx"], "left").withColumn("n", F.coalesce(F.size("boxes"), F.lit(0)))


def top_speed(boxes: DataFrame) -> DataFrame:
    """Greatest distance a box of each class moved from one anchor to the next, by clip; 0 without any."""
    from ..functions.geometry import distance

    order = W.partitionBy(*TRACK).orderBy("frame_idx")
    back = boxes.select("clip_id", "cls", *"xywh", *[F.lag(c).over(order).alias(f"p_{c}") for c in "xywh"])
    return back.groupBy("clip_id", "cls").agg(F.coalesce(F.max(distance(Box.of(), Box.of("p_"))), F.lit(0.0)).alias("speed"))
