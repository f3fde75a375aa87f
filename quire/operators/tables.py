"""Tables out of words: rows, segments, columns and a full grid of cells."""

from __future__ import annotations

from statistics import median

from pyspark.sql import DataFrame

from .lines import columns
from .scan import walk


def grid(words: DataFrame, by: tuple[str, str] = ("page", "box")) -> DataFrame:
    """Cells of each region: row, column, text, bounds, header.

    words: by, ln, pos, x, y, w, h, size, bold, text. A region's words are gathered, which a page bounds."""
    kinds = [words.schema[c].dataType.simpleString() for c in by]

    def each(key, rows):
        held = [dict(zip(("ln", "pos", "x", "y", "w", "h", "size", "bold", "text"), r[2:])) for r in rows]
        lines: list[list[dict]] = []
        for v in held:
            for line in lines:
                if abs(median(u["y"] for u in line) - v["y"]) <= max(2.0, 0.45 * v["h"]):
                    line.append(v)
                    break
            else:
                lines.append([v])
        lines.sort(key=lambda line: min(u["y"] for u in line))
        cut = [segments(line) for line in lines]
        tolerance = max(8.0, 0.75 * median(v["size"] for v in held), 0.75 * median(v["h"] for v in held))
        centres = columns([s[0]["x"] for line in cut for s in line], tolerance)
        header = sum(bool(v["bold"]) for v in lines[0]) * 2 >= len(lines[0])
        tops = [min(v["y"] for v in line) for line in lines]
        for i, line in enumerate(cut):
            own = max(v["y"] + v["h"] for v in lines[i]) - tops[i]
            height = max(own, tops[i + 1] - tops[i] if i + 1 < len(lines) else 0.0)
            cells: dict[int, list[dict]] = {}
            for s in line:
                near = min(range(len(centres)), key=lambda c: (abs(centres[c] - s[0]["x"]), c))
                cells.setdefault(near, []).extend(s)
            for c in range(len(centres)):
                text = " ".join(v["text"] for v in sorted(cells.get(c, []), key=lambda v: v["x"]))
                yield (*key, i, c, text, round(centres[c], 4), height, bool(header and i == 0))

    rows = words.select(*by, "ln", "pos", "x", "y", "w", "h", "size", "bold", "text")
    return walk(rows, list(by), ["y", "x", "ln", "pos"], each, f"{by[0]} {kinds[0]}, {by[1]} {kinds[1]}, row int, column int, text string, centre double, height double, header boolean")


def segments(line: list[dict]) -> list[list[dict]]:
    """Runs of a line's words without a gap over the threshold."""
    line = sorted(line, key=lambda v: (v["x"], v["pos"]))
    gaps = [b["x"] - a["x"] - a["w"] for a, b in zip(line, line[1:])]
    positive = [g for g in gaps if g > 0]
    limit = max(12.0, 0.75 * median(v["h"] for v in line), 0.85 * median(v["size"] for v in line), 2.4 * (median(positive) if positive else 0.0))
    out = [[line[0]]]
    for v, gap in zip(line[1:], gaps):
        if gap > limit:
            out.append([])
        out[-1].append(v)
    return out
