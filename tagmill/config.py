"""Parameters of pipelines: sections work_dir, trimmed, fixed, varied, dedup and anchor."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


def _value(text: str):
    text = text.split(" #")[0].strip()
    if text in ("", "None", "null", "~"):
        return None
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text[0] in "'\"" and text[-1] == text[0]:
        return _value(text[1:-1]) if text[1:-1] == "None" else text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _is_item(body: str) -> bool:
    return body == "-" or body.startswith("- ")


def _mapping(lines: list[tuple[int, str]], at: int) -> tuple[dict, int]:
    """The mapping that starts at a line, and the line after it."""
    out, depth = {}, lines[at][0]
    while at < len(lines) and lines[at][0] == depth and not _is_item(lines[at][1]):
        key, _, rest = lines[at][1].partition(":")
        at += 1
        if rest.strip():
            out[key.strip()] = _value(rest)
        elif at < len(lines) and lines[at][0] >= depth and _is_item(lines[at][1]):
            items, own = [], lines[at][0]
            while at < len(lines) and lines[at][0] == own and _is_item(lines[at][1]):
                items.append(_value(lines[at][1][1:]))
                at += 1
            out[key.strip()] = items
        elif at < len(lines) and lines[at][0] > depth:
            out[key.strip()], at = _mapping(lines, at)
        else:
            out[key.strip()] = None
    return out, at


def parse(text: str) -> dict:
    """Nested mappings and lists of scalars of an indented parameter file; the string None is null."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    return _mapping(lines, 0)[0] if lines else {}


@dataclass(frozen=True)
class Parameters:
    """What a pipeline reads; missing sections are empty."""

    work_dir: str = ""
    trimmed: dict = field(default_factory=dict)
    fixed: dict = field(default_factory=dict)
    varied: dict = field(default_factory=dict)
    dedup: dict = field(default_factory=dict)
    anchor: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "Parameters":
        text = Path(path).read_text(encoding="utf-8")
        data = json.loads(text) if path.endswith(".json") else parse(text)
        return cls(**{k: v or cls.__dataclass_fields__[k].default_factory() if k != "work_dir" else v for k, v in data.items() if k in cls.__dataclass_fields__})
