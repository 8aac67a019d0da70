"""Parameters of detection and tracking, and the preset for road footage. Unknown keys are refused."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    # fixed values: the defaults that results must equal
    sample_fps: float = 8.0
    conf: float = 0.4
    face_conf: float | None = None
    face_sample_fps: float | None = None
    face_confirm_min_detections: int = 1
    pre_roll_frames: int = 0
    plate_model_path: str | None = None
    face_model_path: str | None = None
    face_infer_shape: tuple[int, int] = (640, 360)
    plate_infer_size: int = 640
    plate_iou: float = 0.45
    tile_px: int = 1280
    tile_overlap: float = 0.15
    plate_min_aspect: float = 2.0
    plate_max_aspect: float = 6.0
    plate_max_area_frac: float = 0.01
    plate_boost_speed_px: float = 0.0
    plate_boost_max_run: int = 6
    track_downscale: int = 2
    track_lk_win: int = 31
    track_lk_levels: int = 4
    track_max_horizon_frames: int = 9
    track_face_coast_frames: int = 20
    track_face_coast_moving_frames: int = 6
    track_coast_move_speed: float = 6.0
    track_retire_edge_coast_margin: int = 3
    track_min_points: int = 6
    track_scale_min: float = 0.8
    track_scale_max: float = 1.25
    track_min_inliers: int = 4
    track_motion_gain: float = 1.0
    track_motion_max_px: int = 160
    track_face_motion_gain: float = 1.6
    track_plate_margin_floor_px: int = 16
    track_face_margin_frac: float = 0.35
    track_assoc_motion_gain: float = 1.2
    track_assoc_min_gate_px: int = 72
    track_dedup_iou: float = 0.55
    track_cabin_frac: float = 0.0
    vehicle_model_path: str | None = None
    vehicle_conf: float = 0.35
    vehicle_min_height_frac: float = 0.0
    vehicle_ignore_bottom_frac: float = 0.0
    track_person: bool = False
    person_model_path: str | None = None
    person_conf: float = 0.35
    person_min_height_frac: float = 0.0
    plate_threads: int = 0
    # the tracker's own
    iou_match: float = 0.3
    rng_seed: int = 0

    @classmethod
    def of(cls, base: Params | None = None, **changes) -> Params:
        unknown = set(changes) - {f.name for f in fields(cls)}
        if unknown:
            raise TypeError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return replace(base or cls(), **changes)

    def face_threshold(self) -> float:
        return self.conf if self.face_conf is None else self.face_conf


#: What road footage wants other than the defaults.
ROAD = Params.of(
    face_conf=0.15, face_sample_fps=16.0, face_confirm_min_detections=2, pre_roll_frames=5, plate_max_area_frac=0.006,
    plate_boost_speed_px=8.0, track_cabin_frac=0.6, vehicle_conf=0.6, vehicle_min_height_frac=0.07, vehicle_ignore_bottom_frac=0.12,
    track_person=True, person_min_height_frac=0.05,
)
#: A tracker on its own has most features off.
BARE = Params.of(
    track_lk_win=15, track_lk_levels=2, track_face_coast_frames=0, track_face_coast_moving_frames=0, track_coast_move_speed=0.0,
    track_retire_edge_coast_margin=0, track_motion_gain=0.0, track_motion_max_px=0, track_face_motion_gain=0.0,
    track_plate_margin_floor_px=0, track_face_margin_frac=0.0, track_assoc_motion_gain=0.0, track_assoc_min_gate_px=0, track_dedup_iou=0.0,
)
DILATION_PX, FEATHER_PX, BLUR_STRENGTH, BLUR_WIDTH = 8, 8, 12, 1920
VEHICLE_CLASSES, PERSON_CLASSES = (2, 3, 5, 7), (0,)


def step(fps: float, sample_fps: float) -> int:
    """Every how many frames to look; every frame where either rate is unknown."""
    return max(1, round(fps / sample_fps)) if fps > 0 and sample_fps > 0 else 1
