"""Rule packs as files: ``pack.yaml`` (or ``pack.json``) folders, read strictly on the driver."""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sievewright.operators.rules import Pack

NAMES = ("pack.yaml", "pack.json")


def discover(root: str | Path, include_hidden: bool = False) -> list[Path]:
    """Folders below ``root`` that hold a pack, by name; those that begin with _ only if asked for."""
    root = Path(root)
    if not root.is_dir():
        return []
    found = [d for d in sorted(root.iterdir()) if d.is_dir() and any((d / n).is_file() for n in NAMES)]
    return [d for d in found if include_hidden or not d.name.startswith("_")]


def load(folder: str | Path) -> Pack:
    """The pack of a folder; an unknown field, a missing id or a value of the wrong type is an error."""
    path = next(p for n in NAMES if (p := Path(folder) / n).is_file())
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path}: reading YAML needs a YAML module; pack.json does not") from e
        data = yaml.safe_load(text)
    data = data or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path}: not a mapping")
    known = {f.name: f.type for f in fields(Pack)}
    if unknown := sorted(set(data) - set(known)):
        raise ValueError(f"{path}: unknown fields {unknown}")
    if not data.get("id"):
        raise ValueError(f"{path}: no id")
    return Pack(**{"positives": (), **{name: _checked(path, name, known[name], value) for name, value in data.items()}})


def _checked(path: Path, name: str, kind: str, value):
    if name == "stages":
        if not isinstance(value, list) or any(not isinstance(s, dict) or set(s) != {"id", "risk", "cues"} for s in value):
            raise ValueError(f"{path}: stages must be a list of id, risk and cues")
        return tuple((s["id"], s["risk"], tuple(s["cues"])) for s in value)
    if kind.startswith("tuple"):
        if not isinstance(value, list) or any(not isinstance(v, str) for v in value):
            raise ValueError(f"{path}: {name} must be a list of strings")
        return tuple(value)
    takes = {"str": (str,), "int": (int,), "float": (int, float), "bool": (bool,)}[kind]
    if not isinstance(value, takes) or (isinstance(value, bool) and kind != "bool"):
        raise ValueError(f"{path}: {name} must be of type {kind}")
    return value


def packs(root: str | Path) -> list[Pack]:
    """All packs below a folder."""
    return [load(d) for d in discover(root)]


def load_all(root: str | Path) -> tuple[list[Pack], list[tuple[str, str]]]:
    """(packs, failures): every pack below a folder that can be read and has its folder's name as its id, and
    (folder, reason) for every other. One that fails keeps none of the others out."""
    found, failed = [], []
    for folder in discover(root):
        try:
            pack = load(folder)
            if pack.id != folder.name:
                raise ValueError(f"id {pack.id!r} is not the folder's name")
            found.append(pack)
        except Exception as e:  # whatever is wrong with a pack is its own failure
            failed.append((folder.name, f"{type(e).__name__}: {e}"))
    return found, failed


def failures(spark: SparkSession, root: str | Path) -> DataFrame:
    """(folder, reason) of the packs that could not be loaded."""
    return spark.createDataFrame(load_all(root)[1], "folder string, reason string")
