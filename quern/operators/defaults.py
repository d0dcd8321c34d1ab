"""Defaults of a project: ``quern.toml`` in the working folder or one above it.  A flag wins over the file."""

from __future__ import annotations

import tomllib
from pathlib import Path

FILE = "quern.toml"
#: What the file can set.
KEYS = {"data": str, "target": str, "recipe": str, "runs_dir": str, "models": str, "seed": int, "cv": int}


def find(start: Path | None = None) -> Path | None:
    at = (start or Path.cwd()).resolve()
    return next((p / FILE for p in (at, *at.parents) if (p / FILE).is_file()), None)


def load(start: Path | None = None) -> dict:
    """The file's values; an unknown key or a value of another type is an error, as it would be passed over in silence."""
    path = find(start)
    if path is None:
        return {}
    try:
        values = tomllib.loads(path.read_text(encoding="utf-8")).get("defaults", {})
    except tomllib.TOMLDecodeError as error:
        raise ValueError(f"{path}: {error}") from error
    if not isinstance(values, dict):
        raise ValueError(f"{path}: defaults must be a table")
    for k, v in values.items():
        if k not in KEYS:
            raise ValueError(f"{path}: no default {k}; there are {', '.join(KEYS)}")
        if type(v) is not KEYS[k]:
            raise ValueError(f"{path}: {k} must be of type {KEYS[k].__name__}")
    return values


def as_toml(values: dict) -> str:
    import json

    return "# Defaults of flags; a flag wins.\n[defaults]\n" + "".join(f"{k} = {json.dumps(values[k])}\n" for k in KEYS if values.get(k) is not None)
