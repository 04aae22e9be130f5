"""Configuration: TOML with defaults, merging of patches, protection levels."""

from __future__ import annotations

import copy
import json
import os
import tomllib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The defaults, and what each protection level sets.
DEFAULTS = {
    "pii": {"mode": "replace", "locale": "en-US", "confidence_threshold": 0.7, "vault_ttl_hours": 24, "tiers": {"regex": True, "ner": False, "slm": False}},
    "storage": {"retention_days": 0},
}
LEVELS = {
    "off": ("off", False, False, False),
    "detect": ("detect-only", True, False, False),
    "1": ("replace", True, False, False),
    "2": ("replace", True, True, False),
    "3": ("replace", True, True, True),
    "intelligent": ("replace", False, False, True),
}


def load(path: str) -> dict:
    """The file's settings over the defaults; a missing file gives the defaults."""
    out = copy.deepcopy(DEFAULTS)
    if os.path.exists(path):
        with open(path, "rb") as f:
            merge(out, tomllib.load(f))
    validate(out)
    return out


def merge(base: dict, patch: dict, prefix: str = "") -> list[str]:
    """Merge patch into base, objects key by key; returns the dotted keys whose values changed."""
    changed = []
    for key, value in patch.items():
        name = f"{prefix}{key}"
        if isinstance(value, dict) and isinstance(base.get(key), dict):
            changed += merge(base[key], value, f"{name}.")
        elif key not in base or base[key] != value:
            base[key] = copy.deepcopy(value)
            changed.append(name)
    return changed


def validate(config: dict) -> None:
    tiers = config["pii"]["tiers"]
    if tiers["ner"] and not tiers["regex"]:
        raise ValueError("the NER tier needs the regex tier")


def dotted(key: str, value: str) -> dict:
    """`a.b` and a value as text -> {"a": {"b": value}}, booleans and whole numbers recognized."""
    try:
        parsed = json.loads(value)
    except ValueError:
        parsed = value
    out: object = parsed if isinstance(parsed, bool | int) else value
    for part in reversed(key.split(".")):
        out = {part: out}
    return out  # type: ignore[return-value]


def level_patch(level: str) -> dict:
    if level not in LEVELS:
        raise ValueError(f"unknown protection level {level!r}")
    mode, regex, ner, slm = LEVELS[level]
    return {"pii": {"mode": mode, "tiers": {"regex": regex, "ner": ner, "slm": slm}}}


def level_of(config: dict) -> str:
    """The protection level that a configuration is; tiers that no level has together protect nothing: `off`."""
    tiers = config["pii"]["tiers"]
    now = (config["pii"]["mode"], tiers["regex"], tiers["ner"], tiers["slm"])
    if now[0] == "detect-only":
        return "detect"
    return next((k for k, v in LEVELS.items() if v == now and now[0] == "replace"), "off")


def level(mode: Column, regex: Column, ner: Column, slm: Column) -> Column:
    """The same for columns, with the name that is shown: detect-only."""
    out = F.when(mode == "detect-only", "detect-only")
    for name, (of, *tiers) in LEVELS.items():
        if of == "replace":
            same = mode == of
            for column, wanted in zip((regex, ner, slm), tiers):
                same = same & (column == F.lit(wanted))
            out = out.when(same, name)
    return out.otherwise("off")


def level_mode(name: Column) -> Column:
    """The mode that a level sets; null for names that aren't levels."""
    out = F.when(name == "detect-only", "detect-only")
    for level_name, (mode, *_) in LEVELS.items():
        out = out.when(name == level_name, mode)
    return out
