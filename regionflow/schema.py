"""Schemas of the tables that stages exchange. Boxes are four flat INT columns in native pixels."""

BOX = ("x", "y", "w", "h")
CLIPS = "clip_id string, source_hash string, fps double, frame_count int, width int, height int"
FRAMES = "clip_id string, frame_idx int, ts double, width int, height int, channels int, pixels binary"
DETECTIONS = "clip_id string, frame_idx int, cls string, det_ord int, x int, y int, w int, h int, score float"
ANCHORS = "clip_id string, track_id int, frame_idx int"
TRACK_BOXES = "clip_id string, track_id int, cls string, frame_idx int, x int, y int, w int, h int"
TIMELINE = "clip_id string, frame_idx int, ord int, x int, y int, w int, h int"
MASKS = "clip_id string, frame_idx int, width int, height int, mask binary"
#: Detections of a frame are listed in this order of classes.
CLASSES = ("face", "plate", "vehicle", "person")
