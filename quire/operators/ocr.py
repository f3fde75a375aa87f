"""Text read from images against extracted blocks: best matches, issues, page scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.numbers import clamp01, fixed
from quire.functions.text import loose, text_score
from quire.sources.shared import once

ISSUES = 25
#: Shares of place and text in a score, and what bounds are loosened by.
PLACE, TEXT, NEAR = 0.55, 0.45, 1e-9


def parse_tsv(rows: DataFrame, column: str = "value") -> DataFrame:
    """Words (level 5, not blank) of a reader's tab-separated output; numbers that are none are 0."""
    parts = F.split(column, "\t", -1)
    number = lambda i, kind: F.coalesce(F.expr(f"try_cast(_p[{i}] as {kind})"), F.lit(0).cast(kind))
    names = ["level", "page", "block", "par", "line", "word", "x", "y", "w", "h"]
    rows = rows.select(parts.alias("_p")).where((F.size("_p") >= 12) & (F.col("_p")[0] != "level"))
    rows = rows.select(*[number(i, "int").alias(n) for i, n in enumerate(names)], number(10, "double").alias("confidence"), F.array_join(F.slice("_p", 12, F.size("_p")), "\t").alias("text"))
    return rows.where((F.col("level") == 5) & (F.trim("text") != ""))


def build_lines(words: DataFrame) -> DataFrame:
    """Lines of read words: bounds, mean confidence, text by x."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word", "text"))), lambda s: s["text"]), " ")
    return words.groupBy("page", "block", "par", "line").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), fixed(F.avg("confidence"), 4).alias("confidence"), text.alias("text"))


def page_confidence(lines: DataFrame) -> DataFrame:
    """Mean confidence of a page's lines, 4 decimals."""
    return lines.groupBy("page").agg(fixed(F.avg("confidence"), 4).alias("confidence"))


def in_order(lines: DataFrame, band: float = 2.0) -> DataFrame:
    """lines with seq, their place on the page: bands of y (anchored on lines sorted by y, high as band), then x."""
    from .scan import scan

    def step(state, y):
        if state is None or y - state[0] > band:
            state = (y, 0 if state is None else state[1] + 1)
        return state, state[1]

    banded = scan(lines, ["page"], ["y", "x"], lambda: None, step, ["y"], "_band", "int")
    return banded.withColumn("seq", F.row_number().over(Window.partitionBy("page").orderBy("_band", "x", "y")) - 1).drop("_band")


def polygon_box(points: F.Column) -> F.Column:
    """Bounds of array<array<double>> points, 2 decimals."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(fixed(F.array_min(xs), 2).alias("x"), fixed(F.array_min(ys), 2).alias("y"), fixed(F.array_max(xs) - F.array_min(xs), 2).alias("w"), fixed(F.array_max(ys) - F.array_min(ys), 2).alias("h"))


def match(blocks: DataFrame, lines: DataFrame, reach: float = 24.0) -> DataFrame:
    """The line that fits each block best (page, ln, seq, text_score, position, score); a score of 0 matches nothing.

    Candidates come before scores. A block first meets the lines around it: those whose middle lies in its own strip of the page, reach high, or in
    one beside it. What any other line can score follows from how far off it is and from the page's largest line; a block whose best score is higher
    is done. Only the others meet all lines of their page, and texts are compared only where place and the best text there could be reach the score
    that the block has."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    sets = (F.col("bset"), F.col("lset"))
    b = blocks.select("page", "ln", *[F.col(c).alias(f"b{c}") for c in ("x", "y", "w", "h")], loose(F.col("text")).alias("bt"), F.col("size").alias("bsize"))
    line = lines.select("page", "seq", "x", "y", "w", "h", loose(F.col("text")).alias("lt"))
    place = g.position_score(g.box("b"), g.box())

    def best(pairs: DataFrame, by: list[str], *kept) -> DataFrame:
        scored = pairs.withColumn("text_score", text_score(F.col("bt"), F.col("lt"), sets)).withColumn("score", PLACE * F.col("position") + TEXT * F.col("text_score"))
        fit = F.max(F.when(F.col("score") > 0, F.struct("score", (-F.col("seq")).alias("early"), "seq", "text_score", "position")))
        return scored.groupBy("page", "ln", *by).agg(*kept, fit.alias("m"))

    # lines go to three strips, so that all that a block meets lies where the block does
    strip = lambda y, h: F.floor((F.col(y) + F.col(h) / 2) / reach)
    largest = line.groupBy("page").agg(F.max("w").alias("_w"), F.max("h").alias("_h"))
    own = b.join(largest, "page", "left").withColumn("strip", strip("by", "bh"))
    around = line.withColumn("strip", F.explode(F.array(*[strip("y", "h") + i for i in (-1, 0, 1)])))
    # words are told apart after the shuffle, which texts go through once
    own, around = (rows.repartition(parts, "page", "strip").withColumn(name, words(text)) for rows, name, text in ((own, "bset", "bt"), (around, "lset", "lt")))
    first = best(own.join(around, ["page", "strip"], "left").withColumn("position", place), ["strip"], *[F.first(c).alias(c) for c in ("bw", "bh", "bsize", "_w", "_h")])
    tall = F.greatest("_w", "_h", "bw", "bh", F.lit(1.0))
    most = PLACE * 0.7 * clamp01(1 - reach / (2.5 * tall)) + TEXT
    apart = (F.col("bh") + F.col("_h")) / 2 < reach  # no other line can lie over the block
    first = first.withColumn("done", F.col("_w").isNull() | F.coalesce(apart & (most < F.col("m.score") - NEAR), F.lit(False)))
    first = once(first.select("page", "ln", "bsize", "m", "done"), "matches")
    # texts are not stored: the blocks that are left are told by their page's list, beside the lines of the page
    wanted = first.where("not done").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("ln", F.coalesce("m.score", F.lit(0.0))))).alias("_left"))
    left = b.join(wanted, "page").withColumn("least", F.element_at("_left", F.col("ln"))).where("least is not null").drop("_left").withColumn("bset", words("bt"))
    # another text scores 0.82 at most, or the share that the sizes of its words allow
    sizes = F.least(*map(F.size, sets)) / F.greatest(*map(F.size, sets))
    text = F.when(F.col("bt") == F.col("lt"), 1.0).otherwise(F.greatest(F.lit(0.82), sizes))
    rest = left.join(line.withColumn("lset", words("lt")), "page").withColumn("position", place).where(PLACE * F.col("position") + TEXT * text >= F.col("least") - NEAR)
    found = best(rest, []).withColumnRenamed("m", "_all")
    joined = first.join(found, ["page", "ln"], "left").withColumn("m", F.when(F.col("done"), F.col("m")).otherwise(F.col("_all")))
    return joined.select("page", "ln", "bsize", *[F.col(f"m.{c}").alias(c) for c in ("seq", "text_score", "position", "score")])


def unmatched(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """Lines that no block matches, but for blank ones."""
    used = matched.where("seq is not null").select("page", "seq").distinct()
    return lines.where(F.trim("text") != "").join(used, ["page", "seq"], "left_anti")


def issues(matched: DataFrame, rest: DataFrame, heights: DataFrame) -> DataFrame:
    """page, seq, type, severity of what differs; in order of blocks, then lines."""
    t, p = F.coalesce("text_score", F.lit(0.0)), F.coalesce("position", F.lit(0.0))
    heading = F.col("bsize") >= 16
    one = lambda when, kind, name, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), name.alias("type"), severity.alias("severity")))
    each = F.array_compact(F.array(
        one(t < 0.45, 0, F.when(heading, "heading-mismatch").otherwise("text-mismatch"), F.when(heading, "high").otherwise("medium")),
        one(p < 0.35, 1, F.lit("position-mismatch"), F.when(t > 0.65, "high").otherwise("medium")),
    ))
    own = matched.select("page", F.lit(0).alias("part"), F.col("ln").alias("at"), F.explode(each).alias("i")).select("page", "part", "at", "i.*")
    top = F.col("y") < 0.25 * F.col("height")
    lost = rest.join(heights, "page").select("page", F.lit(1).alias("part"), F.col("seq").alias("at"), F.lit(0).alias("kind"), F.when(top, "heading-mismatch").otherwise("missing-text").alias("type"), F.when(top, "high").otherwise("medium").alias("severity"))
    return own.unionByName(lost)


def first_issues(found: DataFrame, most: int = ISSUES) -> DataFrame:
    order = Window.partitionBy("page").orderBy("part", "at", "kind")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def page_score(matched: DataFrame, lines: DataFrame) -> DataFrame:
    """Score and matched blocks of each page."""
    t, p = F.coalesce("text_score", F.lit(0.0)), F.coalesce("position", F.lit(0.0))
    own = matched.groupBy("page").agg(F.count("*").alias("blocks"), F.avg(t).alias("t"), F.avg(p).alias("p"), F.count_if((t >= 0.45) | (p >= 0.35)).alias("matched"))
    both = own.join(lines.groupBy("page").agg(F.count("*").alias("lines")), "page", "left")
    share = clamp01(F.col("matched") / F.greatest(F.col("blocks"), F.coalesce("lines", F.lit(0)), F.lit(1)))
    return both.select("page", "matched", fixed(clamp01(0.45 * F.col("t") + 0.35 * F.col("p") + 0.20 * share), 4).alias("score"))


def blended(confidence: DataFrame, scores: DataFrame, found: DataFrame) -> DataFrame:
    """Confidence with the reader's share; a warning for any severe issue or a score under 0.65."""
    severe = found.groupBy("page").agg(F.count_if(F.col("severity") == "high").alias("severe"))
    both = confidence.join(scores, "page", "left").join(severe, "page", "left")
    status = F.when(F.col("score").isNull(), "unavailable").when((F.coalesce("severe", F.lit(0)) > 0) | (F.col("score") < 0.65), "warning").otherwise("ok")
    return both.select("page", F.when(F.col("score").isNull(), F.col("confidence")).otherwise(fixed(0.75 * F.col("confidence") + 0.25 * F.col("score"), 4)).alias("confidence"), status.alias("status"))
