"""Relational operators on boxes: gates, cadence, greedy folds, tiles, decoding, joins. All are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Box, at_edge, distance, even, from_corners, holds_center, iou, letterbox
from ..params import Params, step
from ..schema import CLASSES

FRAME = ("clip_id", "frame_idx")


# gates
def confident(score: Column, least: float, strict: bool = False) -> Column:
    """Scores are compared in 32 bits."""
    bound = F.lit(float(least)).cast("float")
    return score.cast("float") > bound if strict else score.cast("float") >= bound


def class_confident(cls: Column, score: Column, p: Params) -> Column:
    """Each class by its own threshold."""
    least = {"face": p.face_threshold(), "plate": p.conf, "vehicle": p.vehicle_conf, "person": p.person_conf}
    case = F.when(cls == CLASSES[0], F.lit(least[CLASSES[0]]).cast("float"))
    for c in CLASSES[1:]:
        case = case.when(cls == c, F.lit(least[c]).cast("float"))
    return score.cast("float") >= case


def aspect_band(w: Column, h: Column, least: float, most: float) -> Column:
    keep = (h > 0) & (w >= F.lit(float(least)) * h)
    return keep & (w <= F.lit(float(most)) * h) if most > 0 else keep


def area_at_most(b: Box, frac: float, width: int, height: int) -> Column:
    """Of the whole frame; no limit unless frac is positive."""
    return (b.w.cast("long") * b.h <= F.lit(float(frac) * height * width)) if frac > 0 else F.lit(True)


def tall_and_high(b: Box, height: int, min_h_frac: float, ignore_bottom_frac: float = 0.0) -> Column:
    """Tall enough, and not starting in the ignored strip at the bottom (or below the frame)."""
    limit = (1 - ignore_bottom_frac) * height if ignore_bottom_frac > 0 else height
    return (b.h >= F.lit(float(min_h_frac * height))) & (b.y <= F.lit(float(limit)))


# cadence
def sampled(frame_idx: Column, every: int) -> Column:
    """Frame 0 is always looked at."""
    return frame_idx % every == 0


def boost_run(frames: DataFrame, trigger: Column, max_run: int) -> DataFrame:
    """For each frame how many more are to be looked at because of a trigger: falls by one a frame, starts anew at each trigger.
    Needs one row per frame. A trigger reaches ``max_run`` frames, so each marks those itself, and a long clip is many tasks."""
    if max_run <= 0:
        return frames.withColumn("run", F.lit(0))
    marked = frames.where(trigger).select("clip_id", "frame_idx", F.explode(F.sequence(F.lit(0), F.lit(max_run - 1))).alias("k"))
    runs = marked.groupBy("clip_id", (F.col("frame_idx") + F.col("k")).cast("int").alias("frame_idx")).agg(F.max(max_run - F.col("k")).alias("run"))
    return frames.join(runs, ["clip_id", "frame_idx"], "left").select(*frames.columns, F.coalesce("run", F.lit(0)).cast("int").alias("run"))


def samples(frames: DataFrame, fps: float, sample_fps: float) -> DataFrame:
    return frames.where(sampled(F.col("frame_idx"), step(fps, sample_fps)))


# greedy folds
def greedy(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], most: float, extra: Sequence[str] = ()) -> DataFrame:
    """Within each group, boxes in order; a box is kept unless it overlaps a kept one by more than ``most``. A box that only a dropped
    box overlaps stays, so this is a fold and no anti join. Groups are single frames, and each of a frame's boxes is compared with those kept:
    thresholds and gates come first, which leave tens of a model's thousands of raw anchors."""
    ranked = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *[F.col(c) for c in "xywh"], *[F.col(c) for c in extra])))
    lists = rows.groupBy(*groups).agg(ranked.alias("all"))
    kind = lists.schema["all"].dataType.simpleString()
    empty = F.expr(f"CAST(array() AS {kind})")
    kept = F.aggregate("all", empty, lambda got, b: F.when(F.exists(got, lambda k: iou(Box.field(b), Box.field(k)) > F.lit(float(most))), got).otherwise(F.array_append(got, b)))
    return lists.select(*groups, F.explode(kept).alias("b")).select(*groups, *[F.col(f"b.{c}").alias(c) for c in (*"xywh", *extra)])


def dedupe(dets: DataFrame, most: float = 0.5) -> DataFrame:
    """Detections of one class and frame, first come first kept."""
    return greedy(dets, (*FRAME, "cls"), [F.col("det_id")], most, ["det_id"])


def nms(dets: DataFrame, conf: float, most: float) -> DataFrame:
    """Non-maximum suppression within a frame over all classes; only scores over ``conf`` count."""
    return greedy(dets.where(confident(F.col("score"), conf, strict=True)), FRAME, [-F.col("score"), F.col("det_id")], most, ["det_id"])


def strongest_tracks(tracks: DataFrame, most: float) -> DataFrame:
    """Of tracks of one class that overlap in a frame, the one with more detections stays, then the one detected last."""
    if most <= 0:
        return tracks
    return greedy(tracks, (*FRAME, "cls"), [-F.col("detections"), -F.col("last_detect"), F.col("track_ord")], most, ["track_ord"])


def largest_boxes(boxes: DataFrame, most: float) -> DataFrame:
    """Across classes, larger boxes first."""
    if most <= 0:
        return boxes
    return greedy(boxes, FRAME, [-(F.col("w").cast("long") * F.col("h")), F.col("ord")], most, ["ord"])


# tiles
def tiles(sizes: DataFrame, tile_px: int = 1280, overlap: float = 0.15) -> DataFrame:
    """(width, height) to tiles in row-major order, half open; one tile where one is enough. Overlaps are cut to whole pixels."""
    count = lambda side: F.greatest(F.lit(1), even(F.col(side) / F.lit(float(tile_px))))
    grid = sizes.withColumns({"nx": count("width"), "ny": count("height")})
    grid = grid.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    tw, th = F.col("width") / F.col("nx").cast("double"), F.col("height") / F.col("ny").cast("double")

    def side(i: str, size: Column, whole: str) -> tuple[Column, Column]:
        pad = size * F.lit(float(overlap))
        return F.greatest(F.lit(0), (F.col(i) * size - pad).cast("int")), F.least(F.col(whole), ((F.col(i) + 1) * size + pad).cast("int"))

    (x0, x1), (y0, y1) = side("i", tw, "width"), side("j", th, "height")
    one = (F.col("nx") == 1) & (F.col("ny") == 1)
    out = {"x0": F.when(one, 0).otherwise(x0), "y0": F.when(one, 0).otherwise(y0), "x1": F.when(one, F.col("width")).otherwise(x1), "y1": F.when(one, F.col("height")).otherwise(y1)}
    return grid.select(*sizes.columns, (F.col("j") * F.col("nx") + F.col("i")).cast("int").alias("tile_ord"), *[c.cast("int").alias(n) for n, c in out.items()])


def merge_tiles(dets: DataFrame, n_tiles: Column, most: float = 0.5) -> DataFrame:
    """Detections in tile coordinates (x0, y0 are the tile's) to the frame's; duplicates go, but a frame of one tile stays as it is."""
    moved = dets.withColumns({"x": F.col("x") + F.col("x0"), "y": F.col("y") + F.col("y0")})
    several = dedupe(moved.where(n_tiles > 1), most)
    return moved.where(n_tiles <= 1).select(*several.columns).unionByName(several)


# decoding
def decode(anchors: DataFrame, values: Column, width: int, height: int, size: int, conf: float, classes: Sequence[int] | None = None) -> DataFrame:
    """Raw anchors (cx, cy, w, h, then one score or one for each class) to boxes in the frame. ``values`` is an array of floats; the
    best class is the first of the greatest score. Gates on score and class, then rounding; empty boxes go."""
    n = F.size("v")
    scores = F.slice("v", 5, n - 4)
    best = F.array_max("s")
    rows = anchors.withColumn("v", values).withColumn("s", scores).withColumn("score", best)
    rows = rows.withColumn("cls_id", F.when(F.size("s") > 1, F.array_position("s", F.col("score")).cast("int") - 1).otherwise(0))
    rows = rows.where(confident(F.col("score"), conf))
    if classes is not None:
        rows = rows.where((F.size("s") == 1) | F.col("cls_id").isin(*classes))
    box = letterbox(F.lit(width), F.lit(height), size)
    v = lambda k: F.element_at("v", k).cast("double")
    corner = {
        "x1": (v(1) - v(3) / 2 - box["pad_x"]) / box["scale"], "y1": (v(2) - v(4) / 2 - box["pad_y"]) / box["scale"],
        "x2": (v(1) + v(3) / 2 - box["pad_x"]) / box["scale"], "y2": (v(2) + v(4) / 2 - box["pad_y"]) / box["scale"],
    }
    b = from_corners(*corner.values(), width, height)
    return rows.select(*anchors.columns, *b.named(), "score", F.col("cls_id").cast("int").alias("cls_id")).where("w > 0 AND h > 0")


# joins
def corroborated(vehicles: DataFrame, plates: DataFrame) -> DataFrame:
    """Vehicles that hold a plate's centre in the same frame. The clip and frame are the join's keys, the rest its condition."""
    v, p = vehicles.alias("v"), plates.alias("p")
    on = (F.col("v.clip_id") == F.col("p.clip_id")) & (F.col("v.frame_idx") == F.col("p.frame_idx")) & holds_center(Box.of("v."), Box.of("p."))
    return v.join(p, on, "left_semi")


def associate(dets: DataFrame, tracks: DataFrame, p: Params) -> DataFrame:
    """The track each detection continues: of its class and frame, the best overlap that reaches ``iou_match``, the later track among
    equals; without one, the nearest centre within a gate that grows with size and speed, the earlier among equals. Tracks have
    track_ord and speed; a det_id tells detections of one frame and class apart. Each detection by itself; the tracker's order of events is in ``tracker``."""
    d, t = dets.alias("d"), tracks.alias("t")
    a, b = Box.of("d."), Box.of("t.")
    diag = lambda x: F.sqrt(x.w.cast("double") * x.w + x.h.cast("double") * x.h)
    gate = F.greatest(F.lit(float(p.track_assoc_motion_gain)) * F.greatest(diag(a), diag(b)), F.lit(float(p.track_assoc_min_gate_px))) + F.col("t.speed")
    near = (distance(a, b) <= gate) if p.track_assoc_motion_gain > 0 or p.track_assoc_min_gate_px > 0 else F.lit(False)
    pairs = d.join(t, [*FRAME, "cls"]).select(*FRAME, "cls", "det_id", "track_ord", iou(a, b).alias("iou"), distance(a, b).alias("dist"), near.alias("near"))
    hit = F.col("iou") >= F.lit(float(p.iou_match))
    order = W.partitionBy(*FRAME, "cls", "det_id").orderBy(F.when(hit, 0).otherwise(1), F.when(hit, -F.col("iou")), F.when(hit, -F.col("track_ord")), "dist", "track_ord")
    best = pairs.where(hit | F.col("near")).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return best.select(*FRAME, "cls", "det_id", "track_ord", F.when(F.col("iou") >= F.lit(float(p.iou_match)), "iou").otherwise("gate").alias("stage"))


def coast_horizon(cls: Column, speed: Column, p: Params) -> Column:
    """For how many frames a track lives on without a detection."""
    coast, moving = p.track_face_coast_frames, p.track_face_coast_moving_frames
    if coast <= p.track_max_horizon_frames:
        return F.lit(p.track_max_horizon_frames)
    short = (speed >= F.lit(float(p.track_coast_move_speed))) & F.lit(moving > 0)
    return F.when(cls == "face", F.when(short, moving).otherwise(coast)).otherwise(p.track_max_horizon_frames)


def alive(cls: Column, b: Box, has_points: Column, age: Column, speed: Column, p: Params, width: int, height: int, face_interval: int = 1) -> Column:
    """Whether a track goes on: anything but a face needs flow points; a face that coasts at the frame's edge ends sooner."""
    pinned = (cls == "face") & at_edge(b, p.track_retire_edge_coast_margin, width, height) & (age > face_interval) if p.track_retire_edge_coast_margin > 0 else F.lit(False)
    return (has_points | (cls == "face")) & (b.w > 0) & (b.h > 0) & (age <= coast_horizon(cls, speed, p)) & ~pinned


def superseded(stale: DataFrame, fresh: DataFrame, iou_match: float) -> DataFrame:
    """Tracks without flow points that a fresh track of their class overlaps: what to retire."""
    s, f = stale.alias("s"), fresh.alias("f")
    on = (F.col("s.clip_id") == F.col("f.clip_id")) & (F.col("s.frame_idx") == F.col("f.frame_idx")) & (F.col("s.cls") == F.col("f.cls")) & (iou(Box.of("s."), Box.of("f.")) > F.lit(float(iou_match)))
    return s.join(f, on, "left_semi")
