"""What is installed here, and where model files are looked for."""

from __future__ import annotations

import importlib.util
import os
import platform
from pathlib import Path

#: Names of processor families.
FAMILIES = {"amd64": "x64", "x86_64": "x64", "x86-64": "x64", "aarch64": "arm64", "arm64": "arm64"}


def processor(name: str | None = None) -> str:
    name = (name if name is not None else platform.machine()).lower()
    return FAMILIES.get(name, name or "unknown")


def probe() -> dict[str, str | bool]:
    """Which optional libraries can be imported, and the processor family."""
    return {"processor": processor(), **{name: importlib.util.find_spec(name) is not None for name in ("onnxruntime", "tokenizers", "pypdf")}}


def model_folder(given: str | None = None) -> Path:
    """The given folder, else that of CLAUSEWRIGHT_MODELS, else `models`."""
    return Path(given or os.environ.get("CLAUSEWRIGHT_MODELS") or "models")


def model_file(folder: Path) -> Path | None:
    """The small model before the full one; null unless a vocabulary lies beside it."""
    found = next((f for f in (folder / "model_int8.onnx", folder / "model.onnx") if f.is_file()), None)
    return found if found and (folder / "vocab.txt").is_file() else None
