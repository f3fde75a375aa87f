"""Operators of the editor: what is shown, selected, grouped, merged and changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.numbers import fixed

#: The rank of tags when blocks are merged.
RANKS = ["h1", "h2", "h3", "p", "caption", "table", "span"]


def visible(words: DataFrame, hidden: DataFrame) -> DataFrame:
    """words (id) that are not hidden."""
    return words.join(hidden.select("id").distinct(), "id", "left_anti")


def displayed(sources: Column, tag: Column) -> Column:
    """Blocks that are shown: those made of words, and images."""
    return F.coalesce((F.size(sources) > 0) | (tag == "img"), F.lit(False))


def hide(hidden: Column, ids: Column) -> Column:
    return F.array_union(hidden, ids)


def show(hidden: Column, ids: Column) -> Column:
    return F.array_except(hidden, ids)


def marquee(words: DataFrame, drags: DataFrame) -> DataFrame:
    """page, drag and the words that a dragged box (page, drag, x, y, w, h; over 3 wide and high) meets."""
    b = drags.where("w > 3 and h > 3").select("page", "drag", *[F.col(c).alias(f"_{c}") for c in "xywh"])
    return words.join(b, "page").where(g.intersects(g.box(), g.box("_"))).select("drag", *words.columns)


def union_of_words(claims: DataFrame) -> DataFrame:
    """page and its words once each, in the order in which sets (page, seq, words: array) name them first."""
    first = claims.select("page", "seq", F.posexplode("words").alias("at", "word")).groupBy("page", "word").agg(F.min(F.struct("seq", "at")).alias("first"))
    return first.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "word"))), lambda s: s["word"]).alias("words"))


def rank(tag: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in RANKS]), tag), F.lit(0)), F.lit(len(RANKS) + 1))


def merge_pairs(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """One block for each pair (page, one, two) of blocks (page, id, x, y, w, h, text, tag, confidence, indented): the joined bounds, texts from left to right, the tag of lower rank, the lesser confidence."""
    named = lambda p: blocks.select("page", *[F.col(c).alias(f"{p}_{c}") for c in blocks.columns if c != "page"])
    both = pairs.join(named("a").withColumnRenamed("a_id", "one"), ["page", "one"]).join(named("b").withColumnRenamed("b_id", "two"), ["page", "two"])
    swap = F.struct("b_x", "b_y") < F.struct("a_x", "a_y")
    first = lambda c: F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    second = lambda c: F.when(swap, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    x, y = F.least("a_x", "b_x"), F.least("a_y", "b_y")
    tag = F.when(rank(first("tag")) <= rank(second("tag")), first("tag")).otherwise(second("tag"))
    return both.select(
        "page", "one", "two", x.alias("x"), y.alias("y"), (F.greatest(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w")) - x).alias("w"), (F.greatest(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h")) - y).alias("h"),
        F.trim(F.concat(first("text"), F.lit(" "), second("text"))).alias("text"), tag.alias("tag"), fixed(F.least("a_confidence", "b_confidence"), 3).alias("confidence"), (F.col("a_indented") | F.col("b_indented")).alias("indented"),
    )


def group_words(words: DataFrame) -> DataFrame:
    """One block for each group of words (page, grp, line, seq, x, y, w, h, text): bounds, and the lines' texts; words in lines by x."""
    lines = words.groupBy("page", "grp", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda s: s["text"]), " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"), F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    made = lines.groupBy("page", "grp").agg(text.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("_r"), F.max("b").alias("_b"), F.sum("n").alias("words"))
    return made.withColumns({"w": F.col("_r") - F.col("x"), "h": F.col("_b") - F.col("y")}).drop("_r", "_b")


def relative(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Words of groups with their places relative to the group's block, 2 decimals."""
    at = blocks.select("page", "grp", F.col("x").alias("_x"), F.col("y").alias("_y"))
    return words.join(at, ["page", "grp"]).withColumns({"x": fixed(F.col("x") - F.col("_x"), 2), "y": fixed(F.col("y") - F.col("_y"), 2)}).drop("_x", "_y")


def resized(b: g.Box, handle: Column, dx: Column, dy: Column, least: float = 4.0) -> g.Box:
    """The box after one of its handles (n, s, e, w or corners of these) was dragged; the far side stays, and least is left."""
    low = F.lit(float(least))
    west, east, north, south = (handle.contains(c) for c in "wens")
    w = F.when(east, F.greatest(low, b[2] + dx)).when(west, F.greatest(low, b[2] - dx)).otherwise(b[2])
    h = F.when(south, F.greatest(low, b[3] + dy)).when(north, F.greatest(low, b[3] - dy)).otherwise(b[3])
    return F.when(west, b[0] + b[2] - w).otherwise(b[0]), F.when(north, b[1] + b[3] - h).otherwise(b[1]), w, h


def moved(a: g.Box, b: g.Box, over: float = 2.0) -> Column:
    """Whether a drag counts as a move; 0.5 for typed places."""
    return (F.abs(a[0] - b[0]) > over) | (F.abs(a[1] - b[1]) > over)


def was_resized(a: g.Box, b: g.Box, over: float = 0.5) -> Column:
    return moved(a, b, over) | (F.abs(a[2] - b[2]) > over) | (F.abs(a[3] - b[3]) > over)


def pending(fixes: DataFrame) -> DataFrame:
    """The fixes that stay pending: of each (block, type) the last one (seq), if it still changes something (changed)."""
    newest = F.row_number().over(Window.partitionBy("block", "type").orderBy(F.desc("seq")))
    return fixes.withColumn("_n", newest).where("_n = 1 and changed").drop("_n")
