"""Extraction profiles learned from corrections, fix by fix."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import walk

#: What a profile starts with.
FIELDS = ["samples", "y_band", "x_gap", "drift", "offset_x", "offset_y", "artifact", "h1", "h2", "h3", "first_indent", "para_offset", "default_indent"]
START = (0, 3.0, 12.0, 0.0, 0.0, 0.0, 0.5, 18.0, 14.0, 12.0, 0.0, 0.0, 0.0)
KEEP = 0.85
Fix = namedtuple("Fix", "type dx dy tag size indented x margin prev_dy text_indent")
SCHEMA = ", ".join(f"{f} {'long' if f == 'samples' else 'double'}" for f in FIELDS)
RULES = "rules array<struct<src: string, dst: string>>"
TEXTS = ("before", "after")


def toward(now: float, new: float) -> float:
    """Weighted mean, 3 decimals."""
    value = KEEP * now + (1 - KEEP) * new
    scaled = int(abs(value) * 1000 + 0.5) / 1000
    return -scaled if value < 0 else scaled


def learn(state: tuple, fix: Fix) -> tuple:
    """The profile after one more fix; what a fix lacks is None."""
    p = dict(zip(FIELDS, state))
    p["samples"] += 1
    if fix.type == "move":
        if abs(fix.dx or 0) > 2:
            p["offset_x"] = toward(p["offset_x"], p["offset_x"] + fix.dx)
        if abs(fix.dy or 0) > 2:
            p["offset_y"] = toward(p["offset_y"], p["offset_y"] + fix.dy)
            p["drift"] = toward(p["drift"], p["drift"] + fix.dy)
    elif fix.type == "merge":
        if fix.indented:
            p["para_offset"] = toward(p["para_offset"], (fix.x or 0.0) - (fix.margin or 0.0))
        else:
            p["x_gap"] = toward(p["x_gap"], p["x_gap"] + 2)
            if abs(fix.prev_dy or 0) > p["y_band"]:
                p["y_band"] = toward(p["y_band"], abs(fix.prev_dy))
    elif fix.type == "split":
        p["x_gap"] = toward(p["x_gap"], max(1.0, p["x_gap"] - 2))
    elif fix.type == "tag-change":
        if fix.tag in ("h1", "h2", "h3"):
            p[fix.tag] = toward(p[fix.tag], 12.0 if fix.size is None else fix.size)
        elif fix.tag == "artifact":
            p["artifact"] = toward(p["artifact"], max(0.1, p["artifact"] - 0.05))
        elif fix.tag == "p" and fix.indented:
            p["first_indent"] = toward(p["first_indent"], fix.text_indent or 0.0)
    elif fix.type == "delete":
        p["artifact"] = toward(p["artifact"], max(0.1, p["artifact"] - 0.03))
    elif fix.type == "style-change" and fix.text_indent is not None:
        for f in ("first_indent", "default_indent"):
            p[f] = toward(p[f], fix.text_indent)
        p["para_offset"] = toward(p["para_offset"], 0.0 if fix.x is None else fix.x - (fix.margin or 0.0))
    return tuple(p.values())


def encoding_rules(pairs: list[tuple[str, str]], rules: dict[str, str] | None = None) -> dict[str, str]:
    """Character rules that text corrections (before, after) teach; a rule keeps its place when it is taught again."""
    rules = dict(rules or {})
    for before, after in pairs:
        for a, b in zip(before or "", after or ""):
            if a != b:
                rules[a] = b
    return rules


def with_texts(fixes: DataFrame) -> DataFrame:
    """fixes with the texts before and after a correction, null where there are none."""
    return fixes.withColumns({c: F.lit(None).cast("string") for c in TEXTS if c not in fixes.columns})


def fold(fixes: DataFrame, by: str = "fingerprint") -> DataFrame:
    """One profile and its character rules for each fingerprint, its fixes taken in the order of time and arrival.

    fixes: by, ts, seq and the fields of a Fix, perhaps before and after (texts), null where they do not apply."""
    kind = fixes.schema[by].dataType.simpleString()

    def each(key, rows):
        state, rules = START, {}
        for row in rows:
            *fields, before, after = row[3:]
            fix = Fix(*(None if v != v else v for v in fields))
            state = learn(state, fix)
            if fix.type == "text-correct":
                rules = encoding_rules([(before, after)], rules)
        yield (key, *state, [{"src": a, "dst": b} for a, b in rules.items()])

    return walk(with_texts(fixes).select(by, "ts", "seq", *Fix._fields, *TEXTS), [by], ["ts", "seq"], each, f"`{by}` {kind}, {SCHEMA}, {RULES}")
