"""Command line: redact one clip. Exit codes: 0 done, 1 failed, 2 coverage check failed."""

from __future__ import annotations

import argparse
import importlib
import logging
import sys
from collections.abc import Callable
from typing import NamedTuple

from .params import BLUR_STRENGTH
from .sources.models import KINDS, ModelSpec


def model(pair: str) -> ModelSpec:
    """KIND=PATH."""
    kind, _, path = pair.partition("=")
    if kind not in KINDS or not path:
        raise argparse.ArgumentTypeError(f"KIND=PATH with one of {', '.join(KINDS)}, not {pair!r}")
    return ModelSpec(kind, path=path)


class Option(NamedTuple):
    """A flag, the argument of ``redact`` that it sets, and its value: a type, or what the flag alone stands for."""

    flags: tuple[str, ...]
    sets: str
    value: object
    default: object = None
    told: str = ""


#: Those that ``redact`` doesn't know are the command's own.
OPTIONS = (
    Option(("-o", "--output"), "output", str, told="a table, or a clip by its ending"),
    Option(("--work-dir",), "work_dir", str),
    Option(("--model",), "models", model, told="KIND=PATH, repeatable; public models are fetched for the other kinds"),
    Option(("--no-verify",), "check", False, True),
    Option(("--no-render",), "render", False, True),
    Option(("--fresh",), "reuse", False, True, "don't use a stored timeline"),
    Option(("--blur-strength",), "blur_strength", int, BLUR_STRENGTH),
    Option(("--fps",), "fps", float, 0.0, "for clips that don't tell"),
    Option(("-v", "--verbose"), "verbose", True, False),
    Option(("--check-deps",), "check_deps", True, False),
)


def understood(argv: list[str] | None) -> dict:
    p = argparse.ArgumentParser(prog="regionflow", description="Blur faces, plates, people and vehicle cabins in a clip.")
    p.add_argument("input", nargs="?")
    for o in OPTIONS:
        how = {"action": "store_const", "const": o.value} if isinstance(o.value, bool) else {"type": o.value, **({"action": "append"} if o.value is model else {})}
        p.add_argument(*o.flags, dest=o.sets, default=o.default, help=o.told, **how)
    given = vars(p.parse_args(argv))
    if given["input"] is None and not given["check_deps"]:
        p.error("input is required")
    return given


def dependencies() -> str:
    """Versions of what the engine needs; ImportError where something is missing."""
    found = {name: importlib.import_module(name) for name in ("pyspark", "onnxruntime", "numpy", "pandas", "pyarrow")}
    return "\n".join([*(f"{name} {m.__version__}" for name, m in found.items()), "providers: " + ", ".join(found["onnxruntime"].get_available_providers())])


def redacted(given: dict) -> str:
    from pyspark.sql import SparkSession

    from .plans import pipeline

    own = {spec.name: spec for spec in given.pop("models") or ()}
    result = pipeline.redact(SparkSession.builder.getOrCreate(), given.pop("input"), models=own, **given)
    seen = f"\ncoverage holds over {result.report.vehicle_frames} vehicle sightings" if result.report else ""
    return f"timeline {result.sidecar}; {result.frame_count} frames{seen}"


def attempt(work: Callable[[], str]) -> int:
    """Runs a command, prints what it says, and gives its exit code."""
    from .plans.pipeline import CoverageError

    try:
        print(work())
        return 0
    except CoverageError as e:
        code, said = 2, f"coverage check failed: {e}"
    except ImportError as e:
        code, said = 1, f"missing: {e}"
    except (OSError, ValueError, RuntimeError) as e:
        code, said = 1, f"failed: {e}"
    print(said, file=sys.stderr)
    return code


def main(argv: list[str] | None = None) -> int:
    given = understood(argv)
    logging.basicConfig(level=logging.INFO if given.pop("verbose") else logging.WARNING)
    return attempt(dependencies if given.pop("check_deps") else lambda: redacted(given))


if __name__ == "__main__":
    sys.exit(main())
