"""Model files: a path given wins; else a checksummed download over HTTPS into a cache. Never raises for what can't be had."""

from __future__ import annotations

import logging
import os
import shutil
import tempfile
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from .clips import file_hash

log = logging.getLogger(__name__)
TIMEOUT_S = 180
CACHE = Path.home() / ".cache" / "regionflow"
KINDS = ("face", "plate", "vehicle", "person")
# fixed values: where public models are kept, and their checksums; one model finds vehicles and people
_COCO = ("https://huggingface.co/aaurelions/yolo11n.onnx/resolve/main/yolo11n.onnx", "5ad2aa77f7f678c06880f024444cb02f5eb53f991b4a64c819805c6c701fc9b8")
_FACE = ("https://github.com/akanametov/yolo-face/releases/download/1.0.0/yolov11n-face.onnx", "61d8cf127ff377939cf009565457aaddf216f4d9fdd9ac24f5aab3cb10ee67b5")
_PLATE = ("https://huggingface.co/morsetechlab/yolov11-license-plate-detection/resolve/main/license-plate-finetune-v1m.onnx", "53e6a1c535141a483e2fe5b802d4f8179e820561d5ed892b0bdeb5fbd200f010")
PUBLIC = {"face": _FACE, "plate": _PLATE, "vehicle": _COCO, "person": _COCO}


@dataclass(frozen=True)
class ModelSpec:
    name: str
    url: str = ""
    sha256: str = ""
    path: str = ""


def chosen(own: Mapping[str, ModelSpec] | None = None) -> list[ModelSpec]:
    """The public models, with one's own in place of some."""
    if unknown := set(own or {}) - set(KINDS):
        raise ValueError(f"no such kind of model: {', '.join(sorted(unknown))}")
    return [(own or {}).get(kind) or ModelSpec(kind, *PUBLIC[kind]) for kind in KINDS]


def fetch(url: str, sha256: str, to: Path) -> Path | None:
    """Downloads beside the target and renames it there once its checksum is right; leaves nothing behind otherwise."""
    to.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=to.parent, suffix=".part")
    try:
        with os.fdopen(handle, "wb") as out, urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "regionflow"}), timeout=TIMEOUT_S) as got:
            shutil.copyfileobj(got, out)
        if file_hash(name) != sha256:
            log.warning("wrong checksum: %s", url)
            return None
        os.replace(name, to)
        return to
    finally:
        Path(name).unlink(missing_ok=True)


def resolve(spec: ModelSpec, cache: Path | None = None) -> Path | None:
    if own := spec.path.strip():
        if (found := Path(own).expanduser()).exists():
            return found
        log.warning("%s: no model at %s", spec.name, own)
        return None
    url, sha = spec.url.strip(), spec.sha256.strip()
    if not (url and sha):
        return None
    to = Path(cache or CACHE) / f"{spec.name}_{sha[:12]}.onnx"
    if to.exists() and file_hash(to) == sha:
        return to
    if not url.lower().startswith("https://"):
        log.warning("%s: only https is fetched", spec.name)
        return None
    try:
        return fetch(url, sha, to)
    except Exception as e:
        log.warning("%s: %s", spec.name, e)
        return None
