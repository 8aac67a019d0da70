"""Frames from clip files: raw arrays (.npy), YUV4MPEG (.y4m, gray or colour), PGM and PPM stills, and the files written back.

Clips on a disk that all workers see are read in ranges of frames by a Python data source, so one long clip is several tasks. Clips in any
other store are read by Spark as whole files (``load``). Other codecs plug in through ``READERS`` and ``WRITERS``.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import shutil
import subprocess
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, partial
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import FRAMES

#: Frames and bytes that a task reads at most; one frame at least.
FRAMES_A_TASK, BYTES_A_TASK = 64, 128 << 20
HASH_BLOCK = 1 << 20


@dataclass(frozen=True)
class Clip:
    fps: float
    count: int
    width: int
    height: int
    channels: int


def file_hash(path: str | Path) -> str:
    """SHA-256 of a file of any size."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(HASH_BLOCK):
            h.update(block)
    return h.hexdigest()


def _opened(source: str | bytes) -> io.BufferedIOBase:
    """A clip's bytes: of a path, or as they are."""
    return io.BytesIO(source) if isinstance(source, bytes) else open(source, "rb")


def _refuse(source: str | bytes) -> ValueError:
    return ValueError(f"Could not open video: {source if isinstance(source, str) else 'bytes'}")


class ArrayFile:
    """Frames x height x width (x 3), unsigned bytes."""

    def __init__(self, source: str | bytes):
        self.frames = np.load(io.BytesIO(source)) if isinstance(source, bytes) else np.load(source, mmap_mode="r")
        if self.frames.ndim not in (3, 4) or self.frames.dtype != np.uint8:
            raise _refuse(source)

    def probe(self) -> Clip:
        n, h, w, *c = self.frames.shape
        return Clip(0.0, n, w, h, c[0] if c else 1)

    def read(self, begin: int, end: int) -> Iterator[np.ndarray]:
        yield from self.frames[begin:end]


def from_yuv(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """BGR of full-size planes, by the published BT.601 equations for studio range."""
    y, u, v = 1.164383 * (y.astype(np.float64) - 16), u.astype(np.float64) - 128, v.astype(np.float64) - 128
    bgr = np.stack([y + 2.017232 * u, y - 0.391762 * u - 0.812968 * v, y + 1.596027 * v], 2)
    return np.rint(bgr).clip(0, 255).astype(np.uint8)


def to_yuv(bgr: np.ndarray) -> np.ndarray:
    """Three full-size planes of a BGR image."""
    b, g, r = (bgr[:, :, k].astype(np.float64) for k in range(3))
    y = 16 + 0.256788 * r + 0.504129 * g + 0.097906 * b
    u = 128 - 0.148223 * r - 0.290993 * g + 0.439216 * b
    v = 128 + 0.439216 * r - 0.367788 * g - 0.071427 * b
    return np.rint(np.stack([y, u, v])).clip(0, 255).astype(np.uint8)


class Y4mFile:
    """YUV4MPEG with 8 bits: gray where it has luma alone, else BGR; chroma is repeated over the pixels that share it."""

    #: By colour space: how many columns and rows share a chroma sample.
    SHARED = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "411": (4, 1)}

    def __init__(self, source: str | bytes):
        self.source = source
        with _opened(source) as f:
            head = f.readline()
            self.length = f.seek(0, 2)
        if not head.startswith(b"YUV4MPEG2"):
            raise _refuse(source)
        tags = {t[:1]: t[1:] for t in head.decode("ascii").split()[1:]}
        self.width, self.height, self.start = int(tags["W"]), int(tags["H"]), len(head)
        num, den = map(int, tags.get("F", "0:1").split(":"))
        self.fps = num / den if den else 0.0
        kind = tags.get("C", "420")
        self.shared = None if kind == "mono" else self.SHARED.get(kind[:3])
        if kind != "mono" and (self.shared is None or re.search(r"p\d|alpha", kind.removesuffix("paldv").removesuffix("mpeg2").removesuffix("jpeg"))):
            raise _refuse(source)
        self.chroma = (0, 0) if self.shared is None else (-(-self.height // self.shared[1]), -(-self.width // self.shared[0]))
        self.size = 6 + self.width * self.height + 2 * self.chroma[0] * self.chroma[1]  # "FRAME" and a line end come first

    def probe(self) -> Clip:
        return Clip(self.fps, (self.length - self.start) // self.size, self.width, self.height, 3 if self.shared else 1)

    def read(self, begin: int, end: int) -> Iterator[np.ndarray]:
        with _opened(self.source) as f:
            for k in range(begin, end):
                f.seek(self.start + k * self.size + 6)
                data = np.frombuffer(f.read(self.size - 6), np.uint8)
                luma, rest = data[: self.width * self.height].reshape(self.height, self.width), data[self.width * self.height :]
                if self.shared is None:
                    yield luma
                else:
                    planes = rest.reshape(2, *self.chroma).repeat(self.shared[1], 1).repeat(self.shared[0], 2)[:, : self.height, : self.width]
                    yield from_yuv(luma, *planes)


class StillFile:
    """One binary PGM or PPM still."""

    def __init__(self, source: str | bytes):
        with _opened(source) as f:
            data = f.read()
        head = re.match(rb"(P[56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+255\s", data)
        if head is None:
            raise _refuse(source)
        w, h, channels = int(head[2]), int(head[3]), 1 if head[1] == b"P5" else 3
        image = np.frombuffer(data[head.end() : head.end() + w * h * channels], np.uint8)
        if len(image) != w * h * channels:
            raise _refuse(source)
        self.image = image.reshape(h, w) if channels == 1 else image.reshape(h, w, 3)[:, :, ::-1]

    def probe(self) -> Clip:
        return Clip(0.0, 1, self.image.shape[1], self.image.shape[0], 1 if self.image.ndim == 2 else 3)

    def read(self, begin: int, end: int) -> Iterator[np.ndarray]:
        yield from [self.image][begin:end]


class EncodedFile:
    """Any other format, decoded by an ffmpeg on the path. Frames follow from each other, so a clip is read from its start by one task."""

    def __init__(self, source: str | bytes):
        if isinstance(source, bytes):
            raise ValueError("encoded clips are read from a disk that all workers see")
        self.source, self.programs = source, [shutil.which(name) for name in ("ffprobe", "ffmpeg")]
        if None in self.programs:
            raise ValueError(f"Could not open video: {source} (no ffmpeg to decode it)")

    @cached_property
    def about(self) -> Clip:
        asked = ["-v", "error", "-count_frames", "-select_streams", "v:0", "-show_entries", "stream=width,height,avg_frame_rate,nb_read_frames", "-of", "json"]
        said = subprocess.run([self.programs[0], *asked, self.source], capture_output=True, text=True)
        found = json.loads(said.stdout or "{}").get("streams")
        if said.returncode or not found:
            raise _refuse(self.source)
        num, _, den = found[0].get("avg_frame_rate", "0/1").partition("/")
        return Clip(float(num) / float(den) if float(den or 0) else 0.0, int(found[0].get("nb_read_frames", 0)), int(found[0]["width"]), int(found[0]["height"]), 3)

    def probe(self) -> Clip:
        return self.about

    def read(self, begin: int, end: int) -> Iterator[np.ndarray]:
        shape = (self.about.height, self.about.width, 3)
        size = shape[0] * shape[1] * 3
        command = [self.programs[1], "-nostats", "-loglevel", "error", "-i", self.source, "-f", "rawvideo", "-pix_fmt", "bgr24", "-frames:v", str(end), "-"]
        with subprocess.Popen(command, stdout=subprocess.PIPE) as run:
            for k in range(end):
                data = run.stdout.read(size)
                if len(data) < size:
                    raise RuntimeError(f"{self.source}: only {k} of {end} frames were decoded")
                if k >= begin:
                    yield np.frombuffer(data, np.uint8).reshape(shape)


READERS: dict[str, Callable] = {".npy": ArrayFile, ".y4m": Y4mFile, ".pgm": StillFile, ".ppm": StillFile}
#: Endings of formats that need a decoder.
READERS |= dict.fromkeys((".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".png", ".jpg", ".jpeg"), EncodedFile)


def _suffix(path: str) -> str:
    return Path(path.rsplit("/", 1)[-1]).suffix.lower()


def open_clip(path: str):
    reader = READERS.get(_suffix(path))
    if reader is None or not Path(path).exists():
        raise _refuse(path)
    return reader(path)


def probe(path: str | Path) -> Clip:
    """What is known of a clip; zeros for what isn't. A clip that can't be opened raises ValueError."""
    try:
        return open_clip(str(path)).probe()
    except (OSError, KeyError) as e:
        raise _refuse(str(path)) from e


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class ClipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.fps, self.every = float(options.get("fps", 0) or 0), int(options.get("every", 1))

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            clip = open_clip(path)
            about = clip.probe()
            each = max(1, about.count) if isinstance(clip, EncodedFile) else max(1, min(FRAMES_A_TASK, BYTES_A_TASK // max(1, about.width * about.height * about.channels)))
            out += [Range(path, k, min(about.count, k + each)) for k in range(0, about.count, each)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        clip = open_clip(partition.path)
        fps, ident = self.fps or clip.probe().fps, Path(partition.path).stem
        yield from rows_of(clip, ident, fps, self.every, partition.begin, partition.end)


def rows_of(clip, ident: str, fps: float, every: int, begin: int, end: int) -> Iterator[tuple]:
    about = clip.probe()
    for k, image in enumerate(clip.read(begin, end), begin):
        if k % every == 0:
            yield ident, k, k / fps if fps > 0 else float(k), about.width, about.height, about.channels, np.ascontiguousarray(image).tobytes()


class ClipSource(DataSource):
    """``spark.read.format("clips").option("fps", 12).load("a.npy,b.y4m")``; ``every`` reads each n-th frame alone."""

    @classmethod
    def name(cls) -> str:
        return "clips"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> ClipReader:
        return ClipReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipSource)


def _frames_of(parts: Iterator[pd.DataFrame], fps: float, every: int) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in FRAMES.split(", ")]
    for p in parts:
        for path, content in zip(p["path"], p["content"], strict=True):
            reader = READERS.get(_suffix(path))
            if reader is None:
                raise _refuse(path)
            clip = reader(bytes(content))
            about = clip.probe()
            for k in range(about.count):  # a frame at a time: one clip's bytes are held, not its frames
                yield pd.DataFrame(rows_of(clip, Path(path.rsplit("/", 1)[-1]).stem, fps or about.fps, every, k, k + 1), columns=names)


def load(spark: SparkSession, paths: str | Sequence[str], fps: float = 0.0, every: int = 1) -> DataFrame:
    """Frames of clips in any store that Spark reads (a folder, a pattern or paths). A clip is one task and is read whole: for long clips
    prefer the data source on a shared disk, or frames kept as a table."""
    return decoded(spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths)), fps, every)


def decoded(files: DataFrame, fps: float = 0.0, every: int = 1) -> DataFrame:
    """Frames of clips that are rows themselves: path, whose ending tells the format, and content."""
    return files.select("path", "content").mapInPandas(partial(_frames_of, fps=fps, every=every), FRAMES)


# sinks
class ArrayWriter:
    """All frames as one array. Its head is written when the frames have been counted."""

    def __init__(self, path: str, about: Clip):
        self.path, self.about, self.n = path, about, 0
        self.file = open(path, "wb")
        self.head = self._head(0)
        self.file.write(self.head)

    def _head(self, n: int) -> bytes:
        shape = (n, self.about.height, self.about.width, *([3] if self.about.channels == 3 else []))
        text = f"{{'descr': '|u1', 'fortran_order': False, 'shape': {shape}, }}"
        return b"\x93NUMPY\x01\x00" + (118).to_bytes(2, "little") + text.ljust(117).encode() + b"\n"  # 128 bytes, as the format asks

    def write(self, image: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(image).tobytes())
        self.n += 1

    def close(self) -> None:
        self.file.seek(0)
        self.file.write(self._head(self.n))
        self.file.close()


class Y4mWriter:
    """YUV4MPEG: gray as it is, colour with full-size chroma."""

    def __init__(self, path: str, about: Clip):
        self.gray = about.channels == 1
        self.file = open(path, "wb")
        rate = round((about.fps or 30.0) * 1000)
        self.file.write(f"YUV4MPEG2 W{about.width} H{about.height} F{rate}:1000 Ip A1:1 C{'mono' if self.gray else '444'}\n".encode())

    def write(self, image: np.ndarray) -> None:
        self.file.write(b"FRAME\n" + (image if self.gray else to_yuv(image)).tobytes())

    def close(self) -> None:
        self.file.close()


class EncoderWriter:
    """Any other format, by an ffmpeg on the path: lossless for gray masks, x264 with the source's sound for clips."""

    def __init__(self, path: str, about: Clip, *, sound: str | None = None, crf: int = 18, preset: str = "medium", extra: Sequence[str] = ()):
        program = shutil.which("ffmpeg")
        if program is None:
            raise RuntimeError(f"{path}: no ffmpeg to encode it; .npy and .y4m need none")
        raw = ["-f", "rawvideo", "-pix_fmt", "gray" if about.channels == 1 else "bgr24", "-s", f"{about.width}x{about.height}", "-r", str(about.fps or 30.0), "-i", "-"]
        codec = ["-c:v", "ffv1", "-pix_fmt", "gray"] if about.channels == 1 else ["-c:v", "libx264", "-crf", str(crf), "-preset", preset]
        heard = ["-i", sound, "-map", "0:v", "-map", "1:a?", "-c:a", "copy"] if sound else []
        self.run = subprocess.Popen([program, "-y", "-nostats", "-loglevel", "error", *raw, *heard, *codec, *extra, path], stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE)

    def write(self, image: np.ndarray) -> None:
        self.run.stdin.write(np.ascontiguousarray(image).tobytes())

    def close(self) -> None:
        _, said = self.run.communicate()
        if self.run.returncode:
            raise RuntimeError(f"encoding failed: {said.decode(errors='replace')[-500:]}")


WRITERS: dict[str, Callable] = {".npy": ArrayWriter, ".y4m": Y4mWriter}


def write_clip(path: str | Path, images: Iterable[np.ndarray], about: Clip, **encoding) -> int:
    """Writes frames in order and returns how many; ``encoding`` goes to the encoder of formats that need one."""
    path = str(path)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    own = WRITERS.get(_suffix(path))
    out, n = own(path, about) if own else EncoderWriter(path, about, **encoding), 0
    try:
        for image in images:
            out.write(image)
            n += 1
    finally:
        out.close()
    return n


def export(frames: DataFrame, path: str | Path, fps: float = 0.0, pixels: str = "pixels", **encoding) -> int:
    """One clip's frames (or masks) as a file, in order. A file has one writer: frames come to the driver a partition at a time. The file is
    read again, and must have as many frames as were written."""
    first = frames.select("width", "height", *(["channels"] if "channels" in frames.columns else [])).first()
    if first is None:
        raise ValueError("no frames to write")
    channels = first["channels"] if "channels" in frames.columns else 1
    shape = (first["height"], first["width"], 3) if channels == 3 else (first["height"], first["width"])
    rows = frames.select("frame_idx", F.col(pixels).alias("pixels")).orderBy("frame_idx").toLocalIterator()
    n = write_clip(path, (np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(shape) for r in rows), Clip(fps, 0, first["width"], first["height"], channels), **encoding)
    if _suffix(str(path)) in READERS and probe(path).count != n:
        raise RuntimeError(f"{path}: {probe(path).count} frames for {n} written")
    return n
