"""Queries on pixels. Their frames are drawn from rows of the tables: no footage is needed, and SQL can tell what must come out.

The clips of the tracking queries show a patch that moves by a steady pace; there SQL tells where it is, and a box counts as right within
``NEAR`` pixels. The other queries are exact.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import drawn
from ..functions.geometry import Box, cabin_corners
from ..operators import boxes, detectors, pixels, tracker, tracks
from ..operators.detectors import BrightDetector, FixedDetector
from ..params import BARE, Params
from ..schema import FRAMES
from ..sources import clips
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
#: Clips of a moving patch: frames, rate, size of a frame and of the patch, frames between given detections, and pixels a box may be off.
LENGTH, FPS, WIDTH, HEIGHT, PATCH, EVERY, NEAR = 12, 12.0, 240, 136, 48, 6, 2
#: Masks are painted at a fourth of the detections' size.
SHRINK = 4
#: Stills with an edge, and the blur over it.
EDGE_WIDTH, EDGE_HEIGHT, STRENGTH, BASE = 64, 6, 12, 192

# where the patch is, for each nation
PLACES = """SELECT CAST(n_nationkey AS STRING) AS clip_id, k AS frame_idx, 20 + 3 * n_nationkey + (n_nationkey % 5) * k AS px, 30 + n_nationkey AS py
  FROM {nation} LATERAL VIEW explode(sequence(0, 11)) f AS k"""
S_PLACES = "(SELECT CAST(n_nationkey AS VARCHAR) AS clip_id, CAST(k AS INTEGER) AS frame_idx, 20 + 3 * n_nationkey + (n_nationkey % 5) * k AS px, 30 + n_nationkey AS py FROM nation, range(0, 12) f(k))"


def _draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in FRAMES.split(", ")]
    for p in parts:
        yield pd.DataFrame([(r.clip_id, r.frame_idx, r.frame_idx / FPS, WIDTH, HEIGHT, 1, drawn.frame(r.px, r.py, WIDTH, HEIGHT, PATCH).tobytes()) for r in p.itertuples()], columns=names)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PLACES, nation=X.table(spark, sf_dir, "nation"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).mapInPandas(_draw, FRAMES)


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _places(spark, sf_dir).where(F.col("frame_idx") % EVERY == 0)
    return seen.select("clip_id", "frame_idx", F.lit("plate").alias("cls"), F.lit(0).alias("det_ord"), F.col("px").cast("int").alias("x"), F.col("py").cast("int").alias("y"), F.lit(PATCH).alias("w"), F.lit(PATCH).alias("h"))


def _followed(spark: SparkSession, sf_dir: str, rows: DataFrame, dx: int = 0, dw: int = 0) -> DataFrame:
    """Track rows, and whether each box is where the patch is."""
    off = lambda c, v: F.abs(F.col(c) - v) <= NEAR
    right = off("x", F.col("px") + dx) & off("y", F.col("py")) & off("w", F.lit(PATCH - dw)) & off("h", F.lit(PATCH))
    return rows.join(_places(spark, sf_dir), ["clip_id", "frame_idx"], "left").select("clip_id", "track_id", "cls", "frame_idx", "anchor", F.coalesce(right, F.lit(False)).alias("followed"))


def s_followed(every: int) -> str:
    return f"SELECT clip_id, 0 AS track_id, 'plate' AS cls, frame_idx, CAST(frame_idx % {every} = 0 AS INTEGER) AS anchor, true AS followed FROM {S_PLACES}"


def track_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks between detections that are given every sixth frame."""
    return _followed(spark, sf_dir, tracker.track_clips(_frames(spark, sf_dir), _detections(spark, sf_dir), BARE))


def detect_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector and tracker together, by cadence: every second frame is looked at. The detector doesn't see the patch's first column."""
    rows = detectors.detect_and_track(_frames(spark, sf_dir), {"plate": BrightDetector()}, Params.of(BARE, plate_max_area_frac=0.0), FPS)
    return _followed(spark, sf_dir, rows, 1, 1)


def track_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker over a stream that is read to its end. Its files lie in the folder of checkpoints, which a cluster shares."""
    from ..streaming.tracker import track_stream as tracked

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lists = _detections(spark, sf_dir).groupBy("clip_id", "frame_idx").agg(F.collect_list("cls").alias("cls"), F.collect_list(F.array("x", "y", "w", "h")).alias("boxes"))
    frames = _frames(spark, sf_dir).drop("ts").join(lists, ["clip_id", "frame_idx"], "left").withColumn("last", F.col("frame_idx") == LENGTH - 1)
    place = _shared(spark)
    frames.write.mode("overwrite").parquet(f"{place}/in")
    stream = spark.readStream.schema(frames.schema).parquet(f"{place}/in")
    run = tracked(stream).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return _followed(spark, sf_dir, spark.read.schema(tracker.TRACK_ROWS).parquet(f"{place}/out"))  # without the count of late frames


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors see: under spark.checkpoint.dir; a folder of this machine in local mode alone."""
    named, name = spark.sparkContext.getConf().get("spark.checkpoint.dir"), f"regionflow-stream-{os.urandom(8).hex()}"
    if named:
        return f"{named.rstrip('/')}/{name}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix=name)


# masks, blur and stills
def _painted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for r in p.itertuples():
            each = (np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width) == 255).sum(1)
            rows.append((r.clip_id, r.frame_idx, int(each.sum()), int(each @ np.arange(r.height))))
        yield pd.DataFrame(rows, columns=["clip_id", "frame_idx", "pixels", "rows"])


def render_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks without feathering of every frame with detections: how many pixels are painted, and the sum of their rows."""
    small = lambda c: F.floor(F.col(c) / SHRINK).cast("int").alias(c)
    d = X.det(spark, sf_dir).select(F.col("clip_id").cast("string").alias("clip_id"), "frame_idx", "cls", F.col("det_id").alias("ord"), *map(small, "xywh"))
    frames = d.select("clip_id", "frame_idx").distinct().withColumns({"width": F.lit(X.WIDTH // SHRINK), "height": F.lit(X.HEIGHT // SHRINK)})
    return pixels.render_masks(frames, d.where("cls <> 'vehicle'"), 0, _painted, "clip_id string, frame_idx int, pixels long, rows long")


S_RENDER = f"""SELECT CAST(clip_id AS VARCHAR) AS clip_id, frame_idx, coalesce(pixels, 0)::BIGINT AS pixels, coalesce(rows, 0)::BIGINT AS rows FROM (SELECT DISTINCT clip_id, frame_idx FROM det) LEFT JOIN (
  SELECT clip_id, frame_idx, count(*) AS pixels, sum(yy) AS rows FROM (SELECT DISTINCT clip_id, frame_idx, yy, unnest(range(x1, x2)) AS xx FROM (SELECT *, unnest(range(y1, y2)) AS yy FROM (
    SELECT clip_id, frame_idx, greatest(0, x // {SHRINK}) AS x1, greatest(0, y // {SHRINK}) AS y1, least({X.WIDTH // SHRINK}, x // {SHRINK} + w // {SHRINK} + 1) AS x2, least({X.HEIGHT // SHRINK}, y // {SHRINK} + h // {SHRINK} + 1) AS y2 FROM det WHERE cls <> 'vehicle'))) GROUP BY clip_id, frame_idx) USING (clip_id, frame_idx)"""


def _edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in FRAMES.split(", ")]
    for p in parts:
        images = (np.tile((np.arange(EDGE_WIDTH) >= r.edge) * np.uint8(255), (EDGE_HEIGHT, 1)) for r in p.itertuples())
        yield pd.DataFrame([(r.clip_id, 0, 0.0, EDGE_WIDTH, EDGE_HEIGHT, 1, i.astype(np.uint8).tobytes()) for r, i in zip(p.itertuples(), images, strict=True)], columns=names)


def _summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        yield pd.DataFrame({"clip_id": p["clip_id"], "total": [int(np.frombuffer(x, np.uint8).sum(dtype=np.int64)) for x in p["pixels"]]})


def blur_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stills with an upright edge, one for each supplier, blurred under a mask that crosses it: the sum of their pixels."""
    of = X.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("clip_id"), (20 + F.col("s_suppkey") % 24).alias("edge"), (F.col("s_suppkey") % 40).cast("int").alias("x"), (F.col("s_suppkey") % 17 + 3).cast("int").alias("w"))
    frames = of.mapInPandas(_edges, FRAMES)
    masked = of.select("clip_id", F.lit(0).alias("frame_idx"), F.lit(0).alias("ord"), "x", F.lit(0).alias("y"), "w", F.lit(EDGE_HEIGHT).alias("h"))
    return pixels.blur_frames(frames, pixels.render_masks(frames, masked, 0), STRENGTH, BASE).mapInPandas(_summed, "clip_id string, total long")


_RADIUS = max(2, round(STRENGTH * EDGE_WIDTH / BASE))
S_BLUR = f"""WITH taps AS (SELECT i + j AS t, count(*) AS n FROM range(-{_RADIUS}, {_RADIUS} + 1) a(i), range(-{_RADIUS}, {_RADIUS} + 1) b(j) GROUP BY t),
  p AS (SELECT s_suppkey, 20 + s_suppkey % 24 AS edge, c.x, c.x BETWEEN s_suppkey % 40 AND s_suppkey % 40 + s_suppkey % 17 + 3 AS masked FROM supplier, range(0, {EDGE_WIDTH}) c(x)),
  v AS (SELECT s_suppkey, x, any_value(masked) AS masked, any_value(x >= edge) AS bright, round_even(255.0::DOUBLE * sum(n) FILTER (x + t >= edge) / {(2 * _RADIUS + 1) ** 2}, 0) AS soft FROM p, taps GROUP BY s_suppkey, x)
  SELECT CAST(s_suppkey AS VARCHAR) AS clip_id, CAST({EDGE_HEIGHT} * sum(CASE WHEN masked THEN coalesce(soft, 0) WHEN bright THEN 255 ELSE 0 END) AS BIGINT) AS total FROM v GROUP BY s_suppkey"""

#: Stills are a tenth of the tables' sizes, as are their tiles.
TENTH, TILE_PX = 10, 128
FACE_AT, PLATE_AT, TOO_LARGE = (1, 2, 6, 6), (0, 0, 12, 4), (0, 0, 90, 60)
#: Vehicles and people at these places, the least share of a frame's height they have, and the share of it below which vehicles don't count.
VEHICLES_AT, TALL, STRIP = ((3, 4, 20, 12), (8, 60, 30, 40), (5, 120, 9, 30)), 0.2, 0.3


def _blank(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in FRAMES.split(", ")]
    for p in parts:
        yield pd.DataFrame([(f"{r.width}x{r.height}", 0, 0.0, r.width, r.height, 1, bytes(r.width * r.height)) for r in p.itertuples()], columns=names)


def detect_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stills of many sizes through the detectors' protocol: faces and plates in tiles, vehicles and people whole, each with its gates."""
    sizes = X.sizes(spark, sf_dir).select((F.col("width") / TENTH).cast("int").alias("width"), (F.col("height") / TENTH).cast("int").alias("height")).distinct()
    found = {"face": FixedDetector(((FACE_AT, 0.9), (FACE_AT, 0.3))), "plate": FixedDetector(((PLATE_AT, 0.5), (TOO_LARGE, 0.8)))}
    found |= {"vehicle": FixedDetector(tuple((b, 0.7) for b in VEHICLES_AT)), "person": FixedDetector(tuple((b, 0.5) for b in VEHICLES_AT))}
    gates = {"vehicle_min_height_frac": TALL, "vehicle_ignore_bottom_frac": STRIP, "person_min_height_frac": TALL}
    return detectors.detect(sizes.mapInPandas(_blank, FRAMES), found, Params.of(tile_px=TILE_PX, **gates))


def s_detect_image(tiles: str) -> str:
    size = f"(SELECT DISTINCT width // {TENTH} AS width, height // {TENTH} AS height FROM sizes)"
    box = lambda cls, b, rule: f"SELECT width || 'x' || height AS clip_id, 0 AS frame_idx, '{cls}' AS cls, CAST(tile_ord AS INTEGER) AS det_ord, CAST(x0 + {b[0]} AS INTEGER) AS x, CAST(y0 + {b[1]} AS INTEGER) AS y, {b[2]} AS w, {b[3]} AS h FROM t WHERE {rule}"
    gate = f"{PLATE_AT[2] * PLATE_AT[3]} <= 0.01::DOUBLE * height * width"
    rows = " UNION ALL ".join(f"SELECT {k} AS k, {b[0]} AS x, {b[1]} AS y, {b[2]} AS w, {b[3]} AS h" for k, b in enumerate(VEHICLES_AT))
    whole = lambda cls, low: f"SELECT width || 'x' || height AS clip_id, 0 AS frame_idx, '{cls}' AS cls, CAST(row_number() OVER (PARTITION BY width, height ORDER BY k) - 1 AS INTEGER) AS det_ord, x, y, w, h FROM {size}, ({rows}) WHERE h >= {TALL}::DOUBLE * height AND y <= {low}"
    people = [whole("vehicle", f"(1 - {STRIP}::DOUBLE) * height"), whole("person", "height")]
    return f"WITH t AS ({tiles.replace('FROM sizes', f'FROM {size}')}) {' UNION ALL '.join([box('face', FACE_AT, 'true'), box('plate', PLATE_AT, gate), *people])}"


# reading, shrinking, coasting, and the coverage of painted masks
#: Clips of even gray frames, one for each nation: frames, and a frame's size.
EVEN_LENGTH, EVEN_WIDTH, EVEN_HEIGHT = 5, 32, 18


def _files(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every other clip as YUV4MPEG with colour, the rest as arrays."""
    import io

    for p in parts:
        rows = []
        for key in p["n_nationkey"]:
            images, out = [np.full((EVEN_HEIGHT, EVEN_WIDTH), (7 * key + k) % 200 + 16, np.uint8) for k in range(EVEN_LENGTH)], io.BytesIO()
            if key % 2:
                neutral = np.full(2 * EVEN_WIDTH * EVEN_HEIGHT // 4, 128, np.uint8).tobytes()
                out.write(f"YUV4MPEG2 W{EVEN_WIDTH} H{EVEN_HEIGHT} F4:1 C420jpeg\n".encode() + b"".join(b"FRAME\n" + i.tobytes() + neutral for i in images))
            else:
                np.save(out, np.stack(images))
            rows.append((f"store://clips/{key}.{'y4m' if key % 2 else 'npy'}", out.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


def _even(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        values = [np.unique(np.frombuffer(x, np.uint8)) for x in p["pixels"]]
        yield p.drop(columns="pixels").assign(value=[int(v[0]) if len(v) == 1 else -1 for v in values])


def clip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips decoded to frames: their order, times, sizes and the one value that all of a frame's bytes have."""
    files = X.table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(_files, "path string, content binary")
    return clips.decoded(files).mapInPandas(_even, "clip_id string, frame_idx int, ts double, width int, height int, channels int, value int")


_EVEN_VALUE = "((7 * n_nationkey + k) % 200 + 16)"
S_SCAN = f"""SELECT CAST(n_nationkey AS VARCHAR) AS clip_id, CAST(k AS INTEGER) AS frame_idx, CASE WHEN n_nationkey % 2 = 1 THEN k / 4.0::DOUBLE ELSE k::DOUBLE END AS ts, {EVEN_WIDTH} AS width, {EVEN_HEIGHT} AS height,
  CASE WHEN n_nationkey % 2 = 1 THEN 3 ELSE 1 END AS channels, CAST(CASE WHEN n_nationkey % 2 = 1 THEN least(255, greatest(0, round_even(1.164383::DOUBLE * ({_EVEN_VALUE} - 16), 0))) ELSE {_EVEN_VALUE} END AS INTEGER) AS value
  FROM nation, range(0, {EVEN_LENGTH}) f(k)"""


def _stripes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in FRAMES.split(", ")]
    for p in parts:
        across, down = np.arange(EDGE_WIDTH), np.arange(EDGE_HEIGHT)[:, None]
        yield pd.DataFrame([(str(k), 0, 0.0, EDGE_WIDTH, EDGE_HEIGHT, 1, ((across * 3 + down * 5 + k) % 251).astype(np.uint8).tobytes()) for k in p["s_suppkey"]], columns=names)


def _weighed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        images = [np.frombuffer(x, np.uint8).astype(np.int64) for x in p["small"]]
        yield pd.DataFrame({"clip_id": p["clip_id"], "total": [int(i.sum()) for i in images], "weighed": [int(i @ np.arange(len(i))) for i in images]})


def small_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's small images, half as wide and high: the sum of their pixels, and the sum weighed by place."""
    frames = X.table(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(_stripes, FRAMES)
    return tracker.shrunk(frames, BARE).mapInPandas(_weighed, "clip_id string, total long, weighed long")


_AT = lambda dx, dy: f"((2 * x + {dx}) * 3 + (2 * y + {dy}) * 5 + s_suppkey) % 251"
S_SMALL = f"""SELECT CAST(s_suppkey AS VARCHAR) AS clip_id, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * {EDGE_WIDTH // 2} + x)) AS BIGINT) AS weighed FROM (
  SELECT s_suppkey, x, y, round_even(({_AT(0, 0)} + {_AT(1, 0)} + {_AT(0, 1)} + {_AT(1, 1)}) / 4.0::DOUBLE, 0) AS v FROM supplier, range(0, {EDGE_WIDTH // 2}) a(x), range(0, {EDGE_HEIGHT // 2}) b(y)) GROUP BY s_suppkey"""

#: Frames before the patch goes, how long faces coast, and how long anything may live without a detection.
SEEN, COASTING, HORIZON = 4, 5, 9


def _gone(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in _draw(parts):
        blank = np.full((HEIGHT, WIDTH), 50, np.uint8).tobytes()
        yield p.assign(pixels=[x if k < SEEN else blank for x, k in zip(p["pixels"], p["frame_idx"], strict=True)])


def coast_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face and a plate on a patch that goes out of sight: the plate's track ends there, the face coasts on as long as it may."""
    p = Params.of(BARE, track_max_horizon_frames=3, track_face_coast_frames=COASTING)
    seen = _detections(spark, sf_dir).where("frame_idx = 0")
    both = seen.unionByName(seen.withColumn("cls", F.lit("face")))
    rows = tracker.track_clips(_places(spark, sf_dir).mapInPandas(_gone, FRAMES), both, p)
    return rows.groupBy("clip_id", "cls").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count(F.lit(1)).alias("n"))


S_COAST = f"""SELECT CAST(n_nationkey AS VARCHAR) AS clip_id, cls, 0 AS first_frame, last_frame, last_frame + 1 AS n FROM nation, (SELECT 'face' AS cls, {COASTING} AS last_frame UNION ALL SELECT 'plate', {SEEN - 1})"""


def verify_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage of vehicle cabins by painted masks, pixel by pixel; ``cabin_coverage`` works the same out from boxes."""
    d = X.det(spark, sf_dir).withColumn("clip_id", F.col("clip_id").cast("string"))
    vehicles = boxes.corroborated(d.where("cls = 'vehicle'"), d.where("cls = 'plate'"))
    corners = cabin_corners(Box.of(), 0.6, X.WIDTH, X.HEIGHT)
    cabins = vehicles.select("clip_id", "frame_idx", "det_id", *"xywh", *[c.cast("int").alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)])
    looked = cabins.select("clip_id", "frame_idx").distinct().withColumns({"width": F.lit(X.WIDTH), "height": F.lit(X.HEIGHT)})
    masked = tracks.timeline(d.where("cls <> 'vehicle'").withColumn("ord", F.col("det_id")), 40, X.WIDTH, X.HEIGHT)
    return pixels.measured_as_painted(cabins, looked, masked, 0).select("clip_id", "frame_idx", "det_id", "coverage")


def s_verify(cover: str) -> str:
    return f"SELECT CAST(clip_id AS VARCHAR) AS clip_id, frame_idx, det_id, coverage FROM ({cover})"


def queries() -> dict[str, Query]:
    found = (track_clip, render_mask, blur_composite, detect_image, detect_track, track_stream, clip_scan, small_gray, coast_clip, verify_masks)
    return {f.__name__: f for f in found}


def oracle_sql(tiles: Callable[[int], str], cover: str) -> dict[str, str]:
    """SQL over the derived relations; ``tiles`` gives that of a grid, ``cover`` that of cabins' coverage."""
    looked = round(FPS / Params().sample_fps)
    return {
        "track_clip": s_followed(EVERY), "track_stream": s_followed(EVERY), "detect_track": s_followed(looked), "render_mask": S_RENDER, "blur_composite": S_BLUR,
        "detect_image": s_detect_image(tiles(TILE_PX)), "clip_scan": S_SCAN, "small_gray": S_SMALL, "coast_clip": S_COAST, "verify_masks": s_verify(cover),
    }
