import hashlib
import importlib.machinery
import json
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from regionflow import cli, drawn
from regionflow.operators import detectors as D
from regionflow.operators import pixels as P
from regionflow.operators import tracker
from regionflow.params import BARE, Params
from regionflow.plans import pipeline
from regionflow.sources import clips, models, sidecar

from conftest import SMALL


def test_painting():
    mask = P.paint(32, 32, [(4, 4, 8, 8)])
    assert mask[4, 4] == 255 and mask[12, 12] == 255 and mask[13, 13] == 0 and (mask > 0).sum() == 81
    soft = P.paint(32, 32, [(4, 4, 8, 8)], 2)
    assert set(np.unique(soft)) - {0, 255} and soft[8, 8] == 255 and soft[30, 30] == 0


def test_blur_leaves_the_rest_alone():
    image = np.random.default_rng(1).integers(0, 255, (40, 60, 3), np.uint8)
    mask = P.paint(60, 40, [(10, 10, 15, 15)])
    out = P.composite(image, mask, 4)
    assert (out[mask == 0] == image[mask == 0]).all() and out[mask > 0].std() < image[mask > 0].std()
    assert P.composite(image, np.zeros((40, 60), np.uint8), 4) is image


def test_resizing():
    a = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert (P.resize_area(a, 8, 8) == a).all() and (P.resize_linear(a, 8, 8) == a).all()
    assert P.resize_area(np.full((9, 7, 3), 9, np.uint8), 3, 2).tolist() == np.full((2, 3, 3), 9).tolist()
    square, scale, px, py = P.letterboxed(np.zeros((720, 1280, 3), np.uint8), 640)
    assert (square.shape, scale, px, py) == ((640, 640, 3), 0.5, 0, 140) and square[0, 0, 0] == P.FILL


def anchors(*rows):
    out = np.zeros((1, 5, 8), np.float32)
    for k, r in enumerate(rows):
        out[0, :, k] = r
    return out


def test_decoding():
    go = lambda t, **kw: D.decode(t, 0.4, 0.5, 0, 140, 1280, 720, **kw)
    one = anchors((175, 347.5, 50, 15, 0.9))
    assert go(one) == [(300, 400, 100, 30)] == go(one.transpose(0, 2, 1))
    assert go(anchors((175, 347.5, 50, 15, 0.2))) == []
    assert len(go(anchors((175, 347.5, 50, 15, 0.9), (176, 347.5, 50, 15, 0.8)))) == 1
    assert go(one, min_aspect=4.0) == [] and len(go(one, max_aspect=4.0)) == 1 and go(one, max_aspect=3.0) == []
    many = np.zeros((1, 84, 100), np.float32)
    many[0, :4, 0], many[0, 4 + 2, 0] = (100, 240, 40, 40), 0.9
    many[0, :4, 1], many[0, 4 + 0, 1] = (300, 240, 40, 40), 0.9
    assert len(go(many)) == 2 and len(go(many, classes=(2, 3, 5, 7))) == 1
    assert go(np.zeros((1, 3, 8), np.float32)) == [] and go(np.zeros(4, np.float32)) == []


def test_tiling_and_gates():
    tiles = D.grid(3840, 2160, 1280, 0.15)
    image = np.zeros((2160, 3840, 3), np.uint8)
    one = D.FixedDetector((((10, 20, 5, 5), 0.9),))
    assert D.detect_tiled(image, one, 0.4, tiles) == [(x + 10, y + 20, 5, 5) for x, y, _, _ in tiles]
    twice = D.FixedDetector((((0, 0, 10, 10), 0.9), ((1, 0, 10, 10), 0.9)))
    assert len(D.detect_tiled(image, twice, 0.4, tiles[:1])) == 2
    assert D.fold([(0, 0, 10, 10), (1, 0, 10, 10), (100, 100, 10, 10)]) == [(0, 0, 10, 10), (100, 100, 10, 10)]
    low = D.FixedDetector((((0, 0, 10, 10), 0.2),))
    p = Params.of(face_conf=0.15, conf=0.4)
    small = np.zeros((1000, 1000, 3), np.uint8)
    assert D.detect_kind("face", small, low, p, [0]) and not D.detect_kind("plate", small, low, p, [0])
    big = D.FixedDetector((((0, 0, 300, 300), 0.9), ((0, 0, 50, 50), 0.9)))
    assert D.detect_kind("plate", small, big, p, [0]) == [(0, 0, 50, 50)]
    still = D.detect_image(small, {"face": one, "plate": big})
    assert still["boxes"] == still["faces"] + still["plates"]
    with pytest.raises(ValueError):
        D.detect_image(np.zeros((4, 4)), {})


def write_clip(path, frames):
    np.save(path, np.ascontiguousarray(frames))
    return path


def test_clip_source(spark, tmp_path):
    frames = drawn.clip(6, width=64, height=48, size=16, start=4, y=8)
    clips.register(spark)
    write_clip(tmp_path / "a.npy", frames)
    body = b"YUV4MPEG2 W64 H48 F12:1 Cmono\n" + b"".join(b"FRAME\n" + f.tobytes() for f in frames)
    (tmp_path / "b.y4m").write_bytes(body)
    (tmp_path / "c.pgm").write_bytes(b"P5 64 48 255\n" + frames[0].tobytes())
    df = spark.read.format("clips").option("fps", 0).load(",".join(str(tmp_path / n) for n in ("a.npy", "b.y4m", "c.pgm")))
    rows = {(r["clip_id"], r["frame_idx"]): r for r in df.collect()}
    assert len(rows) == 13 and all(bytes(rows[c, k]["pixels"]) == frames[k].tobytes() for c in "ab" for k in range(6))
    assert rows["b", 3]["ts"] == 0.25 and rows["a", 3]["ts"] == 3.0
    assert spark.read.format("clips").option("every", 4).load(str(tmp_path / "a.npy")).count() == 2
    assert clips.probe(tmp_path / "b.y4m") == clips.Clip(12.0, 6, 64, 48, 1) 
    with pytest.raises(ValueError, match="Could not open video"):
        clips.probe(tmp_path / "none.npy")
    (tmp_path / "some.avi").write_bytes(b"x")
    for name in ("none.avi", "some.avi", "some.xyz"):  # absent, without a decoder, of no known format
        with pytest.raises(ValueError, match="Could not open video"):
            clips.open_clip(str(tmp_path / name))


def test_sidecar(tmp_path):
    t = sidecar.Timeline("h", 8.0, 0.4, 8, 30.0, 5, 32, 32, {10: [(1, 2, 3, 4)], 2: [(4, 4, 8, 8)]})
    place = tmp_path / "t.json"
    sidecar.write(place, t)
    assert sidecar.load(place) == t and t.active_at(2) == [(4, 4, 8, 8)] and t.active_at(3) == []
    assert list(json.loads(place.read_text())["frame_boxes"]) == ["2", "10"]
    assert sidecar.load(tmp_path / "none.json") is None
    place.write_text("{")
    assert sidecar.load(place) is None
    place.write_text(json.dumps({"schema": "other"}))
    assert sidecar.load(place) is None
    place.write_text(json.dumps({"schema": sidecar.TAG}))
    with pytest.raises(KeyError):
        sidecar.load(place)


def test_models(tmp_path, monkeypatch):
    body = b"weights"
    sha = hashlib.sha256(body).hexdigest()
    own = tmp_path / "own.onnx"
    own.write_bytes(body)
    assert models.resolve(models.ModelSpec("face", path=str(own))) == own
    assert models.resolve(models.ModelSpec("face", path="/no/such")) is None and models.resolve(models.ModelSpec("face")) is None
    assert models.resolve(models.ModelSpec("face", "http://x/y", sha), tmp_path) is None
    import io

    monkeypatch.setattr(models.urllib.request, "urlopen", lambda *a, **k: io.BytesIO(body))
    found = models.resolve(models.ModelSpec("face", "https://x/y", sha), tmp_path / "cache")
    assert found.name == f"face_{sha[:12]}.onnx" and found.read_bytes() == body
    assert models.resolve(models.ModelSpec("plate", "https://x/y", "0" * 64), tmp_path / "cache2") is None
    assert list((tmp_path / "cache2").iterdir()) == []


def test_eager_is_lazy(spark):
    frames = spark.createDataFrame([("c", k, k / 12, 120, 80, 1, bytearray(f.tobytes())) for k, f in enumerate(drawn.clip(8, 10, 4, 16, width=120, height=80, size=32))], "clip_id string, frame_idx int, ts double, width int, height int, channels int, pixels binary")
    p = Params.of(BARE, plate_max_area_frac=0.0, plate_boost_speed_px=3.0, sample_fps=3.0)
    got = [sorted(map(tuple, D.detect_and_track(frames, {"plate": D.BrightDetector()}, p, 12.0, eager).collect())) for eager in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 8


def test_stream_equals_batch(spark):
    from regionflow.plans import pixel_queries as Q

    batch = sorted(map(tuple, Q.track_clip(spark, SMALL).collect()))
    assert sorted(map(tuple, Q.track_stream(spark, SMALL).collect())) == batch


VEHICLE, PLATE, FACE = (40, 20, 100, 60), (70, 40, 30, 12), (150, 80, 16, 16)


def found(cover=True):
    plate = PLATE if cover else (170, 5, 30, 12)
    return {"face": D.FixedDetector(((FACE, 0.9),)), "plate": D.FixedDetector(((plate, 0.9),)), "vehicle": D.FixedDetector(((VEHICLE, 0.9),))}


OFF = {"plate_max_area_frac": 0.5, "vehicle_min_height_frac": 0.0, "vehicle_ignore_bottom_frac": 0.0, "track_person": False, "face_confirm_min_detections": 1}


def test_pipeline(spark, tmp_path):
    source = write_clip(tmp_path / "clip.npy", np.random.default_rng(0).integers(0, 255, (6, 120, 200, 3), np.uint8))
    r = pipeline.redact(spark, source, found=found(), params=OFF, fps=3.0, work_dir=tmp_path / "w")
    assert r.frame_count == 6 and r.report.ok and r.report.vehicle_frames == 6 and r.faces > 0 and r.plates > 0
    out = spark.read.parquet(str(tmp_path / "w" / "clip_redacted.parquet"))
    assert out.count() == 6
    again = pipeline.redact(spark, source, found=found(), params=OFF, fps=3.0, work_dir=tmp_path / "w", render=False)
    assert again.faces == -1 and again.output is None
    # a timeline that leaves the cabin open
    t = sidecar.load(r.sidecar)
    t.frame_boxes = {k: [(0, 0, 4, 4)] for k in range(6)}
    sidecar.write(r.sidecar, t)
    with pytest.raises(pipeline.CoverageError) as e:
        pipeline.redact(spark, source, found=found(), params=OFF, fps=3.0, work_dir=tmp_path / "w", output=tmp_path / "no.parquet")
    assert len(e.value.report.leaks) == 6 and "frame 0 (0%)" in str(e.value) and not (tmp_path / "no.parquet").exists()


def test_vehicles_without_plates_are_not_checked(spark, tmp_path):
    source = write_clip(tmp_path / "clip.npy", np.zeros((3, 120, 200, 3), np.uint8))
    r = pipeline.redact(spark, source, found=found(False), params=OFF, fps=3.0, render=False)
    assert r.report.vehicle_frames == 0 and r.report.ok


def test_counts_must_agree(spark):
    frames = spark.range(5).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("frame_idx"))
    with pytest.raises(RuntimeError):
        P.check_counts(frames, frames.where("frame_idx < 4"))


def test_regions(spark):
    frames = spark.createDataFrame([("c", k, k / 4, 64, 48, 1, bytearray(64 * 48)) for k in range(8)], "clip_id string, frame_idx int, ts double, width int, height int, channels int, pixels binary")
    got = pipeline.regions(frames, {"face": D.FixedDetector((((1, 1, 9, 9), 0.9),))}, Params(), 4.0, 2.0).collect()
    assert len(got) == 4 and all(len(r["boxes"]) == len(r["faces"]) == 1 and not r["plates"] for r in got)


def test_command_line(capsys, tmp_path):
    assert cli.main(["--check-deps"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["a.npy", "--model", "hat=/x"])
    with pytest.raises(SystemExit):
        cli.main(["a.npy", "--model", "face"])
    with pytest.raises(SystemExit):
        cli.main([])
    assert cli.main([str(tmp_path / "none.npy"), *(f"--model={k}=/no/such" for k in models.KINDS)]) == 1
    assert "no face model" in capsys.readouterr().err


def test_command_line_redacts(spark, tmp_path, monkeypatch, capsys):
    source = write_clip(tmp_path / "clip.npy", np.random.default_rng(0).integers(0, 255, (3, 120, 200, 3), np.uint8))
    monkeypatch.setattr(D, "build", lambda paths, p: found())
    assert cli.main([str(source), "--fps", "3", "-o", str(tmp_path / "out.npy"), "--work-dir", str(tmp_path / "w"), "--model=face=/x"]) == 0
    assert "3 frames" in capsys.readouterr().out and clips.probe(tmp_path / "out.npy") == clips.Clip(0.0, 3, 200, 120, 3)


def test_no_face_model_falls_back_or_refuses(monkeypatch):
    import sys
    import types

    paths = {"face": None, "plate": "/p"}
    with pytest.raises(RuntimeError, match="no face model"):
        D.build(paths, Params())

    class CenterFace:
        def __init__(self, in_shape):
            self.shape = in_shape

        def __call__(self, image, threshold):
            return [(1.4, 2.5, 11.6, 300, 0.9), (5, 5, 5, 9, 0.9)], []

    package = types.ModuleType("deface")
    package.__spec__, package.__path__ = importlib.machinery.ModuleSpec("deface", None), []
    inner = types.ModuleType("deface.centerface")
    inner.CenterFace = CenterFace
    monkeypatch.setitem(sys.modules, "deface", package)
    monkeypatch.setitem(sys.modules, "deface.centerface", inner)
    built = D.build(paths, Params())
    assert set(built) == {"face", "plate"} and built["face"].detect(np.zeros((50, 60), np.uint8), 0.4) == [(1, 2, 11, 48)]
    assert set(D.build_for_images({"face": "/f", "plate": "/p"}, plate_iou=0.3)) == {"face", "plate"}


def test_gray_frames_reach_the_model(monkeypatch):
    seen = []

    class Session:
        def get_inputs(self):
            return [type("I", (), {"name": "in"})()]

        def run(self, _, feed):
            seen.append(feed["in"])
            return [anchors((175, 347.5, 50, 15, 0.9))]

    monkeypatch.setattr(D, "_session", lambda path, threads: Session())
    for image in (np.zeros((720, 1280), np.uint8), np.zeros((720, 1280, 3), np.uint8)):
        assert D.OnnxDetector("/m").detect(image, 0.4) == [(300, 400, 100, 30)]
    assert all(x.shape == (1, 3, 640, 640) for x in seen) and (seen[0] == seen[1]).all()


def test_colour_clips(spark, tmp_path):
    rng = np.random.default_rng(2)
    image = np.repeat(np.repeat(rng.integers(30, 220, (6, 8, 3), np.uint8), 4, 0), 4, 1)  # even blocks, so that shared chroma is exact
    back = clips.from_yuv(*clips.to_yuv(image))
    assert np.abs(back.astype(int) - image).max() <= 2
    y, u, v = clips.to_yuv(image)
    bodies = {"444": [y, u, v], "422": [y, u[:, ::2], v[:, ::2]], "420jpeg": [y, u[::2, ::2], v[::2, ::2]], "411": [y, u[:, ::4], v[:, ::4]]}
    for kind, planes in bodies.items():
        data = f"YUV4MPEG2 W32 H24 F5:1 C{kind}\n".encode() + 2 * (b"FRAME\n" + b"".join(p.tobytes() for p in planes))
        (tmp_path / f"{kind}.y4m").write_bytes(data)
        clip = clips.open_clip(str(tmp_path / f"{kind}.y4m"))
        assert clip.probe() == clips.Clip(5.0, 2, 32, 24, 3) and all((f == back).all() for f in clip.read(0, 2))
    with pytest.raises(ValueError):
        clips.Y4mFile(b"YUV4MPEG2 W32 H24 F5:1 C420p10\n")
    (tmp_path / "s.ppm").write_bytes(b"P6\n# drawn\n32 24\n255\n" + image[:, :, ::-1].tobytes())
    assert (next(clips.open_clip(str(tmp_path / "s.ppm")).read(0, 1)) == image).all()
    rows = clips.load(spark, [f"file://{tmp_path}/420jpeg.y4m", f"file://{tmp_path}/s.ppm"]).collect()  # through Spark's own reader
    assert {(r["clip_id"], r["frame_idx"]): bytes(r["pixels"]) == (back if r["clip_id"] != "s" else image).tobytes() for r in rows} == {("420jpeg", 0): True, ("420jpeg", 1): True, ("s", 0): True}


def test_clips_written_back(spark, tmp_path):
    frames = np.random.default_rng(3).integers(0, 255, (5, 16, 24, 3), np.uint8)
    write_clip(tmp_path / "a.npy", frames)
    clips.register(spark)
    df = spark.read.format("clips").load(str(tmp_path / "a.npy")).repartition(3)
    assert clips.export(df, tmp_path / "b.npy") == 5 and (np.load(tmp_path / "b.npy") == frames).all()
    masks = P.render_masks(df, spark.createDataFrame([("a", 2, 0, 3, 3, 5, 5)], "clip_id string, frame_idx int, ord int, x int, y int, w int, h int"), 0)
    assert clips.export(masks, tmp_path / "m.y4m", 12.0, "mask") == 5
    read = list(clips.open_clip(str(tmp_path / "m.y4m")).read(0, 5))
    assert [int((m == 255).sum()) for m in read] == [0, 0, 36, 0, 0]  # gray clips are lossless
    assert clips.export(df, tmp_path / "c.y4m") == 5 and clips.probe(tmp_path / "c.y4m").channels == 3
    with pytest.raises(RuntimeError, match="ffmpeg"):
        clips.export(df, tmp_path / "d.mp4")
    with pytest.raises(ValueError):
        clips.export(df.where("false"), tmp_path / "e.npy")


def test_few_masks_are_held_at_a_time():
    boxes = pd.DataFrame({"clip_id": "c", "frame_idx": range(200), "width": 1280, "height": 720, "boxes": [None if k % 3 else [dict(zip("xywh", (k, 2, 3, 4), strict=True))] for k in range(200)]})
    parts = list(P._render(iter([boxes, boxes.head(0)]), 0))
    assert max(p["mask"].map(len).sum() for p in parts) <= P.MASK_BYTES
    got = pd.concat(parts)
    assert list(got["frame_idx"]) == list(range(200)) and [np.frombuffer(m, np.uint8).any() for m in got["mask"]] == [k % 3 == 0 for k in range(200)]
    huge = boxes.head(2).assign(width=8000, height=4000)  # a single mask may be larger
    assert [len(p) for p in P._render(iter([huge]), 0)] == [1, 1]


def test_coverage_as_painted(spark):
    """The same as over masks that were rendered first, and no mask is a column on the way."""
    frames = spark.createDataFrame([("c", k, 64, 36) for k in range(9)], "clip_id string, frame_idx int, width int, height int")
    shown = spark.createDataFrame([("c", k, 0, 3 * k, 2, 9, 9) for k in range(0, 9, 2)], "clip_id string, frame_idx int, ord int, x int, y int, w int, h int")
    cabins = spark.createDataFrame([("c", k, k * 10 + i, 2, 2, 9, 9, 4 * i, 0, 4 * i + 12, 20) for k in range(8) for i in range(2)], "clip_id string, frame_idx int, det_id long, x int, y int, w int, h int, x1 int, y1 int, x2 int, y2 int")
    once = P.measured_as_painted(cabins, frames, shown, 2)
    assert sorted(once.collect()) == sorted(P.measured(cabins, P.render_masks(frames, shown, 2)).collect()) and once.count() == 16
    assert "mask" not in once._jdf.queryExecution().executedPlan().toString()


def test_leaks_have_their_box(spark, tmp_path):
    source = write_clip(tmp_path / "clip.npy", np.zeros((2, 120, 200, 3), np.uint8))
    class Counting:
        def detect(self, image, conf):
            Path(tmp_path / f"seen{len(list(tmp_path.glob('seen*')))}-{np.random.default_rng().integers(1 << 60)}").touch()
            return [VEHICLE]

    frames = clips.load(spark, f"file://{source}")
    masks = P.render_masks(frames, spark.createDataFrame([("clip", 0, 0, *VEHICLE)], "clip_id string, frame_idx int, ord int, x int, y int, w int, h int"), 0)
    r = pipeline.verify(frames, masks, {"vehicle": Counting()}, Params.of(track_cabin_frac=0.6), 200, 120, 4.0)
    assert r.vehicle_frames == 2 and r.leaks == (pipeline.Leak(1, 0.0, VEHICLE),)
    assert len(list(tmp_path.glob("seen*"))) == 2  # each frame is looked at once


def test_association_within_a_frame(spark):
    """Detectors number detections from 0 in every frame."""
    dets = spark.createDataFrame([("c", f, "plate", 0, 10, 10, 20, 20) for f in (0, 1)], "clip_id string, frame_idx int, cls string, det_id int, x int, y int, w int, h int")
    held = spark.createDataFrame([("c", f, "plate", 3, 0.0, 11, 10, 20, 20) for f in (0, 1)], "clip_id string, frame_idx int, cls string, track_ord int, speed double, x int, y int, w int, h int")
    from regionflow.operators import boxes

    assert boxes.associate(dets, held, Params()).count() == 2


def test_streams_give_up_missing_frames_and_count_late_ones(spark, tmp_path):
    from regionflow.streaming import tracker as S

    images = drawn.clip(9, 20, 2, 30, width=120, height=90)
    rows = [("c", k, 120, 90, 1, bytearray(images[k].tobytes()), ["plate"], [[20 + 2 * k, 30, 48, 48]], k == 8) for k in (0, 1, 3, 4, 5, 6, 7)]
    late = [("c", 2, 120, 90, 1, bytearray(images[2].tobytes()), None, None, False), ("c", 8, 120, 90, 1, bytearray(images[8].tobytes()), None, None, True)]
    for n, part in enumerate((rows, late)):
        spark.createDataFrame(part, S.INPUT).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(S.INPUT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = S.track_stream(stream, waiting_most=3).writeStream.format("memory").queryName("tracked").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.sql("SELECT * FROM tracked").collect()
    assert sorted(r["frame_idx"] for r in got) == [0, 1, 3, 4, 5, 6, 7, 8] and {r["late"] for r in got} == {1}


def test_speed_is_kept_per_class():
    t = tracker.ClipTracker(64, 48)
    assert t.max_speed("plate") == 0.0


FAKE = """#!{python}
import json, sys
if "ffprobe" in sys.argv[0]:
    print(json.dumps({{"streams": [{{"width": 4, "height": 3, "avg_frame_rate": "25/2", "nb_read_frames": "6"}}]}}))
elif "-i" in sys.argv and sys.argv[-1] == "-":
    n = int(sys.argv[sys.argv.index("-frames:v") + 1])
    sys.stdout.buffer.write(b"".join(bytes([k]) * 36 for k in range(n)))
else:
    open(sys.argv[-1], "wb").write(repr(sys.argv[1:-1]).encode() + sys.stdin.buffer.read())
"""


def test_other_formats_go_through_an_encoder(spark, tmp_path, monkeypatch):
    """With a stand-in for the program: what it is asked for, and that its frames come out in order."""
    import os
    import sys

    for name in ("ffprobe", "ffmpeg"):
        (tmp_path / name).write_text(FAKE.format(python=sys.executable))
        (tmp_path / name).chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}{os.pathsep}{os.environ['PATH']}")
    (tmp_path / "a.mp4").write_bytes(b"x")
    assert clips.probe(tmp_path / "a.mp4") == clips.Clip(12.5, 6, 4, 3, 3)
    assert [int(f[0, 0, 0]) for f in clips.open_clip(str(tmp_path / "a.mp4")).read(2, 5)] == [2, 3, 4]
    assert len(clips.ClipReader({"path": str(tmp_path / "a.mp4")}).partitions()) == 1
    frames = np.zeros((2, 3, 4, 3), np.uint8)
    n = clips.write_clip(tmp_path / "out.mp4", frames, clips.Clip(12.5, 2, 4, 3, 3), sound=str(tmp_path / "a.mp4"), crf=20, preset="fast", extra=["-movflags", "x"])
    said = (tmp_path / "out.mp4").read_bytes()
    assert n == 2 and said.endswith(bytes(72)) and all(w in said for w in (b"'20'", b"'fast'", b"'-movflags'", b"'1:a?'", b"'copy'", b"'libx264'"))
    clips.write_clip(tmp_path / "m.mkv", frames[..., 0], clips.Clip(0.0, 2, 4, 3, 1))
    assert b"ffv1" in (tmp_path / "m.mkv").read_bytes()


def test_idle_clips_end_by_a_timer():
    """The processor by itself: a frame waits for a missing one, the timer takes it in and ends the clip."""
    from types import SimpleNamespace

    import pandas as pd
    from regionflow.operators.tracker import smaller
    from regionflow.streaming import tracker as S

    class Handle:
        def __init__(self):
            self.held, self.timers = None, []

        def getValueState(self, name, schema):
            return self

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

        def listTimers(self):
            return iter([(t,) for t in self.timers])

        def deleteTimer(self, at):
            self.timers.remove(at)

        def registerTimer(self, at):
            self.timers.append(at)

    handle, p = Handle(), S.TrackProcessor(idle_ms=500)
    p.init(handle)
    images = drawn.clip(3, 20, 0, 30, width=120, height=90)
    rows = [("c", k, 120, 90, smaller(images[k], BARE.track_downscale).tobytes(), ["plate"], [[20, 30, 48, 48]], False) for k in (0, 2)]
    part = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in S.SMALL.split(", ")])
    times = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1000)
    assert not len(pd.concat(p.handleInputRows(("c",), iter([part.iloc[:1]]), times))) and handle.timers == [1500]
    times.getCurrentProcessingTimeInMs = lambda: 1200
    assert not len(pd.concat(p.handleInputRows(("c",), iter([part.iloc[1:]]), times))) and handle.timers == [1700]  # frame 1 is missing
    out = pd.concat(p.handleExpiredTimer(("c",), times, None))
    assert sorted(out["frame_idx"]) == [0, 2] and set(out["late"]) == {0} and handle.held is None and handle.timers == []
