"""Blocks from spans, tags by rule, fixes applied to blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import walk

CAPS = re.compile(r"[A-Z0-9]+")


def merge_spans(spans: DataFrame, y_band: float = 3.0, x_gap: float = 12.0, drift: float = 0.0, first_indent: float = 0.0, para_offset: float = 0.0) -> DataFrame:
    """Blocks of each page: a span joins the last block if it continues its line. White space is squeezed, blank spans are skipped.

    spans: page, seq, margin, x, y, w, h, text, size, font, rotation. Spans go by line (anchored within y_band) and x, then seq."""

    def each(page, rows):
        lines, anchor, band = [], None, -1
        for r in rows:  # by y: bands are told as rows come, and a band is ordered by x when it is full
            if anchor is None or r[4] - anchor > y_band:
                yield from emit(page, lines)
                lines, anchor, band = [], r[4], band + 1
            lines.append(r)
        yield from emit(page, lines)
        yield from close(page)

    state: dict = {}

    def emit(page, rows):
        for _, seq, margin, x, y, w, h, text, size, font, rotation in sorted(rows, key=lambda r: (r[3], r[1])):
            text = " ".join((text or "").split())
            if not text:
                continue
            b = state.get("block")
            offset = x - margin
            indented = x > margin + (para_offset or 10.0) or first_indent > 0 and abs(offset - first_indent) < 3
            if b is not None:
                gap = x - (b["x"] + b["w"])
                guard = indented and b["y"] < y and abs(b["x"] - x) > 2
                if abs(b["last_y"] - y) <= y_band and b["font"] == font and abs(b["size"] - size) <= 1 and b["rotation"] == rotation and -1 <= gap <= x_gap and not guard:
                    caps = CAPS.fullmatch(b["text"].replace(" ", "")) and CAPS.fullmatch(text.replace(" ", ""))
                    b["text"] += (" " if gap > 3 and not caps else "") + text
                    b["w"], b["h"] = max(b["w"], x + w - b["x"]), max(b["h"], h)
                    b["last_x"], b["last_y"], b["n"] = x, y, b["n"] + 1
                    continue
            yield from close(page)
            state["block"] = {"seq": seq, "x": round(x, 2), "y": round(y + drift, 2), "w": round(w, 2), "h": round(h, 2), "text": text, "size": size, "font": font, "rotation": rotation, "indented": bool(indented), "text_indent": (first_indent or offset) if indented else 0.0, "n": 1, "last_x": x, "last_y": y}

    def close(page):
        b = state.pop("block", None)
        if b is not None:
            yield (page, b["seq"], b["x"], b["y"], b["w"], b["h"], b["text"], b["size"], b["font"], b["indented"], b["text_indent"], b["n"])

    kind = spans.schema["page"].dataType.simpleString()
    rows = spans.select("page", "seq", "margin", "x", "y", "w", "h", "text", "size", "font", "rotation")
    return walk(rows, ["page"], ["y", "x", "seq"], each, f"page {kind}, seq long, x double, y double, w double, h double, text string, size double, font string, indented boolean, text_indent double, spans int")


def predict_tag(confidence: Column, size: Column, width: Column, page_width: Column, indented: Column, artifact: float = 0.5, cutoffs: tuple[float, float, float] = (18.0, 14.0, 12.0)) -> Column:
    tag = F.when(confidence < artifact, "artifact").when(indented, "p")
    for name, cutoff in zip(("h1", "h2", "h3"), cutoffs):
        tag = tag.when(size >= cutoff, name)
    return tag.when(width > page_width / 2, "p").otherwise("span")


def usable(text: Column, tag: Column, w: Column, h: Column) -> Column:
    return (tag != "artifact") & (F.trim(text) != "") & (w >= 2) & (h >= 2)


def default_indent(tag: Column, indented: Column, x: Column, margin: Column, default: float) -> Column:
    return F.when((tag == "p") & F.lit(default > 0) & ~indented & (F.abs(x - margin) < 8), F.lit(default)).otherwise(F.lit(0.0))


def classify(size: Column, hash_: Column) -> Column:
    """Confidence of the stand-in classifier, 3 decimals."""
    return F.floor((0.3 * size / 24 + 0.1 * (hash_ % 100) / 100 + 0.6) * 1000 + 0.5) / 1000


def finished(text: Column, tag: Column, w: Column, h: Column) -> Column:
    """Blocks that stay after fixes: images, and what has text and an extent."""
    return F.coalesce((tag == "img") | (F.trim(F.coalesce(text, F.lit(""))) != "") & (w >= 1) & (h >= 1), F.lit(False))


def text_hash(text: Column) -> Column:
    """The rolling 32-bit hash (31 h + c, signed) of a text, below 10,000."""
    wrapped = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c) + (1 << 31), F.lit(1 << 32)) - (1 << 31))
    return F.abs(wrapped % 10000)


def classified(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """blocks (page, id, tag, confidence) with the classifier's tag and confidence; the rule's where it has none."""
    found = results.select("page", "id", F.col("tag").alias("_tag"), F.col("confidence").alias("_confidence"))
    return blocks.join(found, ["page", "id"], "left").withColumns({"tag": F.coalesce("_tag", "tag"), "confidence": F.coalesce("_confidence", "confidence")}).drop("_tag", "_confidence")


def named_sources(fixes: DataFrame) -> DataFrame:
    """page and id (text), each once, of the blocks whose words fixes name as their sources, as of without_sources()."""
    parts = fixes.select("page", F.explode("sources").alias("s")).select("page", F.regexp_extract("s", "^word:(.+):[^:]*:[^:]*$", 1).alias("id"))
    return parts.where("id <> ''").distinct()


def without_sources(blocks: DataFrame, fixes: DataFrame) -> DataFrame:
    """blocks (page, id text) but for those whose words a fix names as its sources (sources: array of word:block:line:word; a block's id may hold colons)."""
    return blocks.join(named_sources(fixes), ["page", "id"], "left_anti")
