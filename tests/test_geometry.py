import pytest
from pyspark.sql import functions as F
from regionflow.functions import geometry as G
from regionflow.functions.geometry import Box
from regionflow.operators import boxes as B
from regionflow.operators import tracks as T
from regionflow.params import ROAD, Params, step


def lit(b):
    return Box(*(F.lit(v) for v in b))


def value(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


@pytest.mark.parametrize("a, b, want", [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (50, 50, 10, 10), 0.0), ((0, 0, 10, 10), (5, 0, 10, 10), 5 / 15), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)])
def test_iou(spark, a, b, want):
    assert value(spark, G.iou(lit(a), lit(b)))[0] == pytest.approx(want)


def test_clamping(spark):
    assert value(spark, *G.shift_clamp(lit((-10, 0, 50, 50)), 100, 100)) == (0, 0, 50, 50)
    assert value(spark, *G.dilate(lit((5, 5, 10, 10)), 8, 100, 100)) == (0, 0, 23, 23)
    assert value(spark, *G.dilate(lit((90, 90, 10, 10)), 8, 100, 100)) == (82, 82, 18, 18)


def test_cabin(spark):
    assert value(spark, *G.cabin_corners(lit((40, 20, 100, 60)), 0.6, 200, 120)) == (40, 20, 140, 56)
    p = Params.of(track_cabin_frac=0.6)
    assert value(spark, *G.emitted(F.lit("vehicle"), lit((100, 80, 300, 160)), F.lit(0.0), p, 1920, 1080)) == (100, 80, 300, 96)
    whole = Params.of(track_cabin_frac=0.0)
    assert value(spark, *G.emitted(F.lit("vehicle"), lit((100, 80, 300, 160)), F.lit(0.0), whole, 1920, 1080)) == (100, 80, 300, 160)


def test_margins(spark):
    floor = lambda cls, b: value(spark, G.margin_floor(F.lit(cls), lit(b), 16, 0.3))[0]
    assert (floor("face", (0, 0, 20, 20)), floor("face", (0, 0, 120, 90)), floor("plate", (0, 0, 120, 90)), floor("person", (0, 0, 20, 20))) == (6, 36, 16, 6)
    outside = (-5, -5, 10, 10)
    assert value(spark, *G.motion_pad(lit(outside), F.lit(0.0), F.lit(0), 1.0, 160, 100, 100)) == outside


def test_letterbox_and_blur(spark):
    box = G.letterbox(F.lit(1280), F.lit(720), 640)
    assert value(spark, box["scale"], box["pad_x"], box["pad_y"]) == (0.5, 0, 140)
    assert value(spark, G.blur_radius(F.lit(1920)), G.blur_radius(F.lit(3840)), G.blur_radius(F.lit(320), 1)) == (12, 24, 2)
    graph = value(spark, G.filter_graph(F.lit(12)))[0]
    assert "alphamerge" in graph and "overlay" in graph and "[1:v]format=gray[m]" in graph and graph.endswith("[vout]") and graph.count(";") == 4


def test_tiles(spark):
    sizes = spark.createDataFrame([(1080, 720), (3840, 2160), (3200, 700)], "width int, height int")
    got = {}
    for r in B.tiles(sizes).orderBy("width", "tile_ord").collect():
        got.setdefault(r["width"], []).append((r["x0"], r["y0"], r["x1"], r["y1"]))
    assert got[1080] == [(0, 0, 1080, 720)]
    assert len(got[3840]) == 6 and {t[0] for t in got[3840]} == {0, 1088, 2368} and {t[2] for t in got[3840]} == {1472, 2752, 3840} and {t[1] for t in got[3840]} == {0, 918}
    assert len(got[3200]) == 2  # 2.5 rounds to even


def test_scores_compare_in_32_bits(spark):
    df = spark.createDataFrame([(0.35,), (0.34,)], "score float")
    assert df.where(B.confident(F.col("score"), 0.35)).count() == 1
    assert df.where(B.confident(F.col("score"), 0.35, strict=True)).count() == 0


def test_gates(spark):
    plates = spark.createDataFrame([(100, 30), (48, 30), (120, 30), (360, 30), (0, 0)], "w int, h int")
    assert sorted(r["w"] for r in plates.where(B.aspect_band(F.col("w"), F.col("h"), 2.0, 6.0)).collect()) == [100, 120]
    assert plates.where(B.aspect_band(F.col("w"), F.col("h"), 0.0, 0.0)).count() == 4
    v = spark.createDataFrame([(1800, 1300, 600, 400), (1600, 1390, 100, 65), (15, 1950, 1766, 200)], "x int, y int, w int, h int")
    assert [r["x"] for r in v.where(B.tall_and_high(Box.of(), 2160, 0.06, 0.12)).collect()] == [1800]
    assert v.where(B.tall_and_high(Box.of(), 2160, 0.0, 0.0)).count() == 3


def test_association_gate(spark):
    dets = spark.createDataFrame([("c", 1, "plate", 1, 160, 100, 48, 48), ("c", 1, "plate", 2, 900, 100, 48, 48)], "clip_id string, frame_idx int, cls string, det_id int, x int, y int, w int, h int")
    track = spark.createDataFrame([("c", 1, "plate", 7, 4.0, 100, 100, 48, 48)], "clip_id string, frame_idx int, cls string, track_ord int, speed double, x int, y int, w int, h int")
    near = Params.of(track_assoc_motion_gain=1.2, track_assoc_min_gate_px=0)
    assert [(r["det_id"], r["stage"]) for r in B.associate(dets, track, near).collect()] == [(1, "gate")]
    assert B.associate(dets, track, Params.of(track_assoc_motion_gain=0.0, track_assoc_min_gate_px=0)).count() == 0


def test_repeated_anchors_count_as_detections(spark):
    boxes = spark.createDataFrame([("c", 1, "face", 4, 1, 1, 9, 9), ("c", 2, "face", 4, 50, 1, 9, 9)], "clip_id string, track_id int, cls string, frame_idx int, x int, y int, w int, h int")
    anchors = spark.createDataFrame([("c", 1, 4), ("c", 1, 4), ("c", 2, 4)], "clip_id string, track_id int, frame_idx int")
    assert [r["track_id"] for r in T.confirmed(boxes, anchors, 2).collect()] == [1]


def test_parameters():
    with pytest.raises(TypeError):
        Params.of(no_such=1)
    assert ROAD.face_threshold() == 0.15 and Params().face_threshold() == 0.4
    assert (step(20, 8), step(60, 8), step(0, 8), step(12, 3), step(30, 0)) == (2, 8, 1, 4, 1)
