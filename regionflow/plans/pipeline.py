"""From clips to blurred clips: detect and track, timeline, masks, coverage gate, render. Nothing is rendered unless the gate passes."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Box, cabin_corners
from ..operators import boxes, coverage, detectors, pixels, tracks
from ..params import BLUR_STRENGTH, BLUR_WIDTH, DILATION_PX, FEATHER_PX, ROAD, Params, step
from ..schema import MASKS
from ..sources import clips, sidecar
from ..sources.models import ModelSpec, chosen, resolve

log = logging.getLogger(__name__)
#: Rates taken for clips that don't tell theirs: of the coverage check.
CHECK_FPS, CHECK_SAMPLE_FPS = 60.0, 4.0


@dataclass(frozen=True)
class Leak:
    """A vehicle that would be shown: the frame, the share of its cabin under the mask, and its box."""

    frame: int
    coverage: float
    box: tuple[int, int, int, int]


@dataclass(frozen=True)
class Report:
    vehicle_frames: int
    leaks: tuple[Leak, ...]

    @property
    def ok(self) -> bool:
        return not self.leaks


class CoverageError(RuntimeError):
    """A vehicle would be shown; nothing was rendered."""

    def __init__(self, report: Report):
        worst = ", ".join(f"frame {x.frame} ({x.coverage:.0%})" for x in sorted(report.leaks, key=lambda x: x.coverage)[:5])
        super().__init__(f"{len(report.leaks)} of {report.vehicle_frames} vehicle sightings with a plate are not covered: {worst}")
        self.report = report


@dataclass(frozen=True)
class Result:
    """Detections are -1 where a stored timeline was used."""

    sidecar: Path
    masks: DataFrame
    output: DataFrame | None
    frame_count: int
    faces: int
    plates: int
    report: Report | None


def confirmed(rows: DataFrame, p: Params, width: int, height: int) -> DataFrame:
    """Track rows to the confirmed boxes of every frame."""
    shown = rows.where("cls <> 'vehicle' OR has_plate")
    anchors = rows.where("anchor > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("anchor")))).select("clip_id", "track_id", "frame_idx")
    return tracks.frame_boxes(shown, anchors, face_min_detections=p.face_confirm_min_detections, interpolate=True, pre_roll_frames=p.pre_roll_frames, width=width, height=height, dedup_iou=p.track_dedup_iou)


def verify(frames: DataFrame, masks: DataFrame, found: Mapping[str, detectors.Detector], p: Params, width: int, height: int, fps: float, min_coverage: float = 0.5) -> Report:
    """Whether masks cover the cabins of vehicles that hold a plate. Without a plate model every vehicle counts."""
    if "vehicle" not in found:
        raise ValueError("no vehicle model to verify with")
    check = Params.of(p, tile_px=1280, tile_overlap=0.15, conf=0.4)
    looked = frames.where(F.col("frame_idx") % step(fps or CHECK_FPS, CHECK_SAMPLE_FPS) == 0)
    seen = detectors.detect(looked, {k: d for k, d in found.items() if k in ("vehicle", "plate")}, check).withColumn("det_id", F.col("det_ord").cast("long"))
    vehicles = seen.where("cls = 'vehicle'")
    if "plate" in found:
        vehicles = boxes.corroborated(vehicles, seen.where("cls = 'plate'"))
    corners = cabin_corners(Box.of(), p.track_cabin_frac, width, height)
    cabins = vehicles.select("clip_id", "frame_idx", "det_id", "x", "y", "w", "h", *[c.cast("int").alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)])
    shares = pixels.measured(cabins, masks)
    leak = F.when(coverage.leaks(F.col("coverage"), min_coverage), F.struct("frame_idx", "coverage", "x", "y", "w", "h"))
    found = shares.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(leak)).alias("leaks")).first()  # sightings of one clip, in one pass
    return Report(found["n"], tuple(Leak(r["frame_idx"], r["coverage"], (r["x"], r["y"], r["w"], r["h"])) for r in found["leaks"]))


def redact(
    spark: SparkSession, source: str | Path, output: str | Path | None = None, *, found: Mapping[str, detectors.Detector] | None = None,
    models: Mapping[str, ModelSpec] | None = None, cache: str | Path | None = None, work_dir: str | Path | None = None,
    params: Mapping | None = None, box_dilation_px: int = DILATION_PX, feather_px: int = FEATHER_PX, blur_strength: int = BLUR_STRENGTH, check: bool = True,
    min_coverage: float = 0.5, reuse: bool = True, match_params: bool = False, render: bool = True, fps: float = 0.0, eager: bool = False,
    encoding: Mapping | None = None,
) -> Result:
    """Redacts one clip. A stored timeline is used for a source of the same hash; with ``match_params`` only for the same parameters.
    Detectors are those ``found``, or are built from the default models, of which ``models`` replaces some. Masks are written once, as a
    table in the work folder; the output is a table, or a clip where its name ends in a clip's format (``encoding``: crf, preset, extra)."""
    source, p = Path(source), Params.of(ROAD, **(params or {}))
    if found is None:
        found = detectors.build(paths_of(chosen(models), cache), p)
    work = Path(work_dir) if work_dir else source.parent
    work.mkdir(parents=True, exist_ok=True)
    about, digest = clips.probe(source), clips.file_hash(source)
    fps = fps or about.fps
    clips.register(spark)
    frames = spark.read.format("clips").option("fps", fps).load(str(source))
    place = work / f"{source.stem}_timeline.json"
    own = hashlib.sha256(repr((asdict(p), box_dilation_px)).encode()).hexdigest()
    stored = sidecar.load(place) if reuse else None
    if stored is None or stored.source_hash != digest or (match_params and stored.params_hash != own):
        rows = detectors.detect_and_track(frames, dict(found), p, fps, eager).persist()
        n = {r["cls"]: r["n"] for r in rows.groupBy("cls").agg(F.sum("anchor").alias("n")).collect()}
        kept = tracks.timeline(confirmed(rows, p, about.width, about.height), box_dilation_px, about.width, about.height)
        listed: dict[int, list] = {}
        for r in kept.orderBy("frame_idx", "ord").toLocalIterator():  # one clip's boxes, written to one file
            listed.setdefault(r["frame_idx"], []).append((r["x"], r["y"], r["w"], r["h"]))
        count = frames.count() or about.count
        stored = sidecar.Timeline(digest, p.sample_fps, p.conf, box_dilation_px, fps, count, about.width, about.height, listed, own)
        sidecar.write(place, stored)
        faces, plates = n.get("face", 0), n.get("plate", 0)
        rows.unpersist()
    else:
        log.info("using %s", place.name)
        faces = plates = -1
    if min(stored.frame_width, stored.frame_height, stored.source_frame_count) <= 0:
        raise ValueError("a mask needs a size and frames")
    flat = [(source.stem, f, k, *b) for f, v in stored.frame_boxes.items() for k, b in enumerate(v)]
    timeline_boxes = spark.createDataFrame(flat, "clip_id string, frame_idx int, ord int, x int, y int, w int, h int")
    place_of_masks = str(work / f"{source.stem}_masks.parquet")
    pixels.render_masks(frames, timeline_boxes, feather_px).write.mode("overwrite").parquet(place_of_masks)
    masks = spark.read.schema(MASKS).parquet(place_of_masks)
    pixels.check_counts(frames, masks)  # what was written against what is read from the clip
    report = None
    if check and "vehicle" in found:
        report = verify(frames, masks, found, p, about.width, about.height, fps, min_coverage)
        if not report.ok:
            raise CoverageError(report)
    elif check:
        log.warning("no vehicle model: coverage was not verified")
    out = None
    if render:
        out = pixels.blur_frames(frames, masks, blur_strength, BLUR_WIDTH)
        target = Path(output or work / f"{source.stem}_redacted.parquet")
        if target.suffix and target.suffix != ".parquet":
            clips.export(out, target, fps, **({} if target.suffix in clips.WRITERS else {"sound": str(source), **(encoding or {})}))
        else:
            out.write.mode("overwrite").parquet(str(target))
    return Result(place, masks, out, stored.source_frame_count, faces, plates, report)


def regions(frames: DataFrame, found: Mapping[str, detectors.Detector], p: Params, fps: float, sample_fps: float = 2.0) -> DataFrame:
    """Faces and plates of sampled frames, one row for each: all parallel, without order."""
    looked = boxes.samples(frames, fps, sample_fps)
    seen = detectors.detect(looked, {k: d for k, d in found.items() if k in ("face", "plate")}, p)
    lists = seen.groupBy("clip_id", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("cls", "det_ord", "x", "y", "w", "h"))).alias("boxes"))
    pick = lambda kind: F.filter(F.coalesce("boxes", F.expr("CAST(array() AS array<struct<cls:string,det_ord:int,x:int,y:int,w:int,h:int>>)")), lambda b: b["cls"] == kind)
    joined = looked.select("clip_id", "frame_idx", "ts").join(lists, ["clip_id", "frame_idx"], "left")
    return joined.select("clip_id", "frame_idx", "ts", F.concat(pick("face"), pick("plate")).alias("boxes"), pick("face").alias("faces"), pick("plate").alias("plates"))


def paths_of(specs: Sequence[ModelSpec], cache: str | Path | None = None) -> dict[str, str | None]:
    return {s.name: str(path) if (path := resolve(s, Path(cache) if cache else None)) else None for s in specs}
