"""The timeline's sidecar: one JSON file for each clip, frames in order."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = "regionflow.timeline/1"
BoxT = tuple[int, int, int, int]


@dataclass
class Timeline:
    source_hash: str
    sample_fps: float
    conf: float
    box_dilation_px: int
    source_fps: float
    source_frame_count: int
    frame_width: int
    frame_height: int
    frame_boxes: dict[int, list[BoxT]] = field(default_factory=dict)
    #: Hash of the parameters; timelines are only reused for the same ones if the caller asks for that.
    params_hash: str = ""

    def active_at(self, frame: int) -> list[BoxT]:
        return self.frame_boxes.get(frame, [])


def write(path: str | Path, t: Timeline) -> None:
    data = {"schema": TAG, **asdict(t)}
    data["frame_boxes"] = {str(f): [list(b) for b in t.frame_boxes[f]] for f in sorted(t.frame_boxes)}
    Path(path).write_text(json.dumps(data, indent=2))


def load(path: str | Path) -> Timeline | None:
    """None if the file is absent, unreadable, no JSON or of another schema; a file that lacks fields raises KeyError."""
    try:
        data = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
    if not isinstance(data, dict) or data.pop("schema", None) != TAG:
        return None
    boxes = {int(f): [tuple(b) for b in v] for f, v in data["frame_boxes"].items()}
    names = ("source_hash", "sample_fps", "conf", "box_dilation_px", "source_fps", "source_frame_count", "frame_width", "frame_height")
    return Timeline(**{n: data[n] for n in names}, frame_boxes=boxes, params_hash=data.get("params_hash", ""))


def to_json(timeline_boxes: DataFrame) -> DataFrame:
    """Timelines of all clips at once: clip_id and its frames as JSON."""
    frame = timeline_boxes.groupBy("clip_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("ord", F.array("x", "y", "w", "h").alias("box")))).alias("b"))
    pairs = F.array_sort(F.collect_list(F.struct("frame_idx", F.transform("b", lambda s: s["box"]).alias("boxes"))))
    return frame.groupBy("clip_id").agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda s: F.struct(s["frame_idx"].cast("string"), s["boxes"])))).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """The boxes again; JSON that can't be read gives no rows."""
    parsed = rows.select("clip_id", F.explode(F.from_json("json", "map<string,array<array<int>>>")).alias("frame", "boxes"))
    boxes = parsed.select("clip_id", F.col("frame").cast("int").alias("frame_idx"), F.posexplode("boxes").alias("nth", "b"))
    return boxes.select("clip_id", "frame_idx", "nth", *[F.element_at("b", k + 1).alias(c) for k, c in enumerate("xywh")])
