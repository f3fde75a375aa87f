"""Corrections applied to blocks, one block at a time.

A fix touches the block that it names; a merge takes out a second one, too. So a page's log is dealt out by block: what a task keeps is one block, however
long the log or large the page is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import walk

#: What a fix may change, by kind.
FIELDS = {
    "x": "double", "y": "double", "w": "double", "h": "double", "text": "string", "tag": "string", "size": "double", "font": "string", "weight": "string", "color": "string", "confidence": "double", "indented": "boolean",
    "text_indent": "double", "padding_left": "double", "line_height": "double", "text_align": "string", "crop_x": "double", "crop_y": "double", "crop_w": "double", "crop_h": "double",
}
#: What a merge has that does not say otherwise, whatever its blocks had.
MERGED = {"tag": "p", "confidence": 0.8, "font": "serif", "size": 12.0, "weight": "normal", "color": "#000000", "text": "", "text_indent": 0.0, "padding_left": 0.0, "line_height": 1.4, "text_align": "left", "indented": False}
PLACE = ("x", "y", "w", "h")


def changed(block: dict | None, kind: str, patch: dict, base: dict) -> dict | None:
    """A block after one more fix; None where there is none. base: the block as it was at first, else the page's first one."""
    given = {f: v for f, v in patch.items() if v is not None}
    if kind == "delete":
        return None
    if kind == "create-group":
        return dict(patch)
    if kind == "merge":
        return {**base, **MERGED, **given}
    if block is None:
        return None
    block = {**block, **given}
    if block["crop_x"] is not None and any(c in given for c in PLACE):
        block |= {f"crop_{c}": block[c] for c in PLACE}
    return block


def stays(block: dict) -> bool:
    """Images, and what has text and an extent."""
    return block["tag"] == "img" or bool((block["text"] or "").strip()) and (block["w"] or 0) >= 1 and (block["h"] or 0) >= 1


def applied(blocks: DataFrame, fixes: DataFrame) -> DataFrame:
    """page, id and FIELDS of the blocks that stay after all fixes; the page's order is y, x, id.

    blocks: page, seq (place on the page), id, FIELDS, suppressed (its words went into a group: it is there for merges to start from, no more).
    fixes: page, seq, type, block, second and FIELDS, null where unchanged; ids are of one type. A merge starts from the original block, else from
    the page's first one; a group is made of its fix alone; other types patch a block that is there. A move or resize of a block with a crop moves the crop."""
    first = blocks.groupBy("page").agg(F.min_by(F.struct(*FIELDS), "seq").alias("_first"))
    row = F.struct(*[F.col(f).cast(k).alias(f) for f, k in FIELDS.items()])
    none = F.lit(None).cast(", ".join(f"{f}: {k}" for f, k in FIELDS.items()).join(("struct<", ">")))
    ids = ["page", "id", "tag_", "seq_", "kind", "suppressed", "patch", "base"]
    held = blocks.select("page", "id", F.lit(0).alias("tag_"), F.lit(0).cast("long").alias("seq_"), F.lit("block").alias("kind"), F.coalesce("suppressed", F.lit(False)).alias("suppressed"), row.alias("patch"), none.alias("base"))
    named = fixes.select("page", F.col("block").alias("id"), F.lit(1).alias("tag_"), F.col("seq").cast("long").alias("seq_"), F.col("type").alias("kind"), F.lit(False).alias("suppressed"), row.alias("patch"))
    merges = named.where("kind = 'merge'").join(first, "page", "left").withColumnRenamed("_first", "base")
    others = named.where("kind <> 'merge'").withColumn("base", none)
    second = fixes.where("type = 'merge' AND second IS NOT NULL AND second <> block").select("page", F.col("second").alias("id"), F.lit(1).alias("tag_"), F.col("seq").cast("long").alias("seq_"), F.lit("delete").alias("kind"), F.lit(False).alias("suppressed"), none.alias("patch"), none.alias("base"))
    rows = reduce(DataFrame.unionByName, [held, merges.select(ids), others.select(ids), second])

    def each(key, events):
        block = original = None
        for _, _, _, _, kind, suppressed, patch, base in events:
            if kind == "block":
                original = patch
                block = None if suppressed else dict(patch)
            else:
                block = changed(block, kind, patch or dict.fromkeys(FIELDS), original or base or dict.fromkeys(FIELDS))
        if block is not None and stays(block):
            yield (*key, *(block[f] for f in FIELDS))

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page", "id")]
    return walk(rows.select(ids), ["page", "id"], ["tag_", "seq_"], each, f"page {kinds[0]}, id {kinds[1]}, " + ", ".join(f"{f} {k}" for f, k in FIELDS.items()))
