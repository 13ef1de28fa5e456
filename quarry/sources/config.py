"""Run settings: the command line over a JSON file over defaults. exclude and schema add up, include and output replace."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    output: str = ".index"
    schema: tuple[str, ...] = ()


def load_config(path: str, **given: object) -> Config:
    """Settings of a JSON file, if it is there, and of keyword arguments; values of the wrong kind raise ValueError."""
    config = Config()
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            config = _merge(config, json.load(f))
    return _merge(config, given)


def _merge(config: Config, more: dict) -> Config:
    changes: dict[str, object] = {}
    for key, value in more.items():
        if key in ("include", "exclude", "schema"):
            if isinstance(value, str) or not all(isinstance(x, str) for x in value):
                raise ValueError(f"{key}: a list of strings is expected")
            if value:
                changes[key] = tuple(dict.fromkeys((*getattr(config, key), *value))) if key != "include" else tuple(value)
        elif key == "output" and value:
            changes[key] = str(value)
    return replace(config, **changes)
