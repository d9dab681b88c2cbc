"""Configuration: YAML trees, deep merges and dotted overrides."""

from __future__ import annotations

from pathlib import Path

import yaml


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f)
    if got is not None and not isinstance(got, dict):
        raise ValueError(f"{path} holds no mapping")
    return got or {}


def merged(one: dict, two: dict) -> dict:
    """one with two's values; mappings are merged level by level, anything else is replaced."""
    out = dict(one)
    for k, v in two.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def get(tree: dict, dotted: str, default: object = None) -> object:
    for part in dotted.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return default
        tree = tree[part]
    return tree


def put(tree: dict, dotted: str, value: object) -> dict:
    """A copy of tree with value at a.b.c."""
    head, _, rest = dotted.partition(".")
    below = tree.get(head)
    return tree | {head: put(below if isinstance(below, dict) else {}, rest, value) if rest else value}


def overrides(pairs: list[str]) -> dict:
    """{} with each a.b=value; values are read as YAML, "none" and "null" as nothing, @file as that file's tree."""
    out: dict = {}
    for pair in pairs:
        key, eq, text = pair.partition("=")
        if not eq or not key.strip():
            raise ValueError(f"{pair!r} is not key=value")
        text = text.strip()
        value = load(text[1:]) if text.startswith("@") and Path(text[1:]).exists() else None if text.lower() in ("none", "null", "~") else yaml.safe_load(text)
        out = put(out, key.strip(), value)
    return out
