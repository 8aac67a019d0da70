"""Whether a mask covers what it must, worked out from boxes alone (a mask without feathering is its boxes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Box, cabin_corners

FRAME = ("clip_id", "frame_idx")


def painted(boxes: DataFrame, groups: tuple[str, ...] = FRAME) -> DataFrame:
    """Pixels that rectangles cover, each counted once. A rectangle holds its far corner: x..x+w and y..y+h. Rectangles are (x1, y1,
    x2, y2) with far corners excluded here. Between any two neighbouring edges in y a group's rectangles are the same: each such strip is
    swept from left to right, however many rows of pixels it has."""
    group = W.partitionBy(*groups)
    edges = F.array_sort(F.array_union(F.collect_set("y1").over(group), F.collect_set("y2").over(group)))
    own = boxes.where("x2 > x1 AND y2 > y1").withColumn("edges", edges)
    # of a frame's edges those inside the rectangle, each with the next
    inside = F.filter("edges", lambda y: (y >= F.col("y1")) & (y <= F.col("y2")))
    rows = own.select(*groups, "x1", "x2", inside.alias("ys")).select(*groups, "x1", "x2", "ys", F.explode(F.sequence(F.lit(1), F.size("ys") - 1)).alias("k"))
    rows = rows.select(*groups, "x1", "x2", F.element_at("ys", F.col("k")).alias("y"), (F.element_at("ys", F.col("k") + 1) - F.element_at("ys", F.col("k"))).alias("high"))
    sweep = W.partitionBy(*groups, "y").orderBy("x1", "x2").rowsBetween(W.unboundedPreceding, -1)
    reached = F.max("x2").over(sweep)
    new = F.greatest(F.lit(0), F.col("x2") - F.greatest(F.col("x1"), F.coalesce(reached, F.col("x1"))))
    return rows.withColumn("new", new.cast("long") * F.col("high")).groupBy(*groups).agg(F.sum("new").cast("long").alias("pixels"))


def rectangles(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes as painted: both corners in, cut to the frame."""
    edge = {"x1": F.greatest(F.lit(0), F.col("x")), "y1": F.greatest(F.lit(0), F.col("y")), "x2": F.least(F.lit(width), F.col("x") + F.col("w") + 1), "y2": F.least(F.lit(height), F.col("y") + F.col("h") + 1)}
    return boxes.withColumns(edge)


def sightings(vehicles: DataFrame, timeline_boxes: DataFrame, frac: float, width: int, height: int) -> DataFrame:
    """Each vehicle (with ``det_id``) and the share of its cabin that is painted; null for a cabin without area."""
    x1, y1, x2, y2 = cabin_corners(Box.of(), frac, width, height)
    cabins = vehicles.select(*FRAME, "det_id", x1.alias("cx1"), y1.alias("cy1"), x2.alias("cx2"), y2.alias("cy2"))
    cabins = cabins.withColumn("area", F.when((F.col("cx2") > F.col("cx1")) & (F.col("cy2") > F.col("cy1")), (F.col("cx2") - F.col("cx1")).cast("long") * (F.col("cy2") - F.col("cy1"))).otherwise(0))
    boxes = rectangles(timeline_boxes, width, height).select(*FRAME, "x1", "y1", "x2", "y2")
    inside = cabins.join(boxes, [*FRAME]).select(
        *FRAME, "det_id", F.greatest("x1", "cx1").alias("x1"), F.greatest("y1", "cy1").alias("y1"), F.least("x2", "cx2").alias("x2"), F.least("y2", "cy2").alias("y2")
    )
    covered = painted(inside, (*FRAME, "det_id"))
    return cabins.join(covered, [*FRAME, "det_id"], "left").select(*FRAME, "det_id", F.when(F.col("area") > 0, F.coalesce("pixels", F.lit(0)) / F.col("area").cast("double")).alias("coverage"))


def leaks(seen: Column, least: float) -> Column:
    return seen < F.lit(float(least))


def report(found: DataFrame, min_coverage: float) -> DataFrame:
    """By clip: sightings (those without cabin area too), leaks, and whether all is covered."""
    bad = F.count_if(leaks(F.col("coverage"), min_coverage))
    return found.groupBy("clip_id").agg(F.count(F.lit(1)).alias("vehicle_frames"), bad.alias("leaks"), (bad == 0).alias("ok"))


def worst(found: DataFrame, min_coverage: float, n: int = 5) -> DataFrame:
    """The n least covered leaks."""
    return found.where(leaks(F.col("coverage"), min_coverage)).orderBy("coverage", "frame_idx", "det_id").limit(n)
