"""Lines, segments and columns of words, and what is measured on them."""

from __future__ import annotations

from collections import deque
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numbers import clamp01, fixed, half_up

from .scan import scan, walk


def anchor_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """line of each word: on words sorted by y, a line goes on while y is within tolerance of its first word.

    Only the newest line can take a word, as each anchor lies further than the tolerance from those before it."""

    def step(state, y):
        if state is None or y - state[0] > tolerance:
            state = (y, 0 if state is None else state[1] + 1)
        return state, state[1]

    return scan(words, ["page"], ["y", "ln", "pos"], lambda: None, step, ["y"], "line", "int")


def editor_tolerance(words: DataFrame) -> DataFrame:
    """tolerance of each page for lines in the editor: at least 3, else 0.55 of the mean height."""
    return words.groupBy("page").agg(F.greatest(F.lit(3.0), F.avg("h") * 0.55).alias("tolerance"))


class Ordered:
    """Numbers in order, with their median; kept as the halves under and over it, so that adding one moves a few only."""

    def __init__(self, first: float) -> None:
        self.low, self.high = [-first], []  # heaps: the largest and the smallest of each half come first

    def add(self, value: float) -> None:
        if value <= -self.low[0]:
            heappush(self.low, -value)
        else:
            heappush(self.high, value)
        if len(self.low) > len(self.high) + 1:
            heappush(self.high, -heappop(self.low))
        elif len(self.high) > len(self.low):
            heappush(self.low, -heappop(self.high))

    @property
    def median(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def median_lines(words: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """line of each word: words by y and x go to the first line whose median y is within max(2, 0.45 h).

    A line that lies further above a word than the tallest word of its group can reach takes no more words, since later ones lie lower still: it
    is let go, so that a word meets the few lines near it and the state is those."""
    by, order = by or ["page"], order or ["y", "x", "ln", "pos"]
    most = F.greatest(F.lit(2.0), 0.45 * F.max("h").over(Window.partitionBy(*by)))

    def step(state, y, h, most):
        lines, n = state
        while lines and y - lines[0][0].median > most:
            lines.popleft()
        reach = max(2.0, 0.45 * h)
        for ys, i in lines:
            if abs(ys.median - y) <= reach:
                ys.add(y)
                return state, i
        lines.append((Ordered(y), n))
        return (lines, n + 1), n

    return scan(words.withColumn("_most", most), by, order, lambda: (deque(), 0), step, ["y", "h", "_most"], "line", "int").drop("_most")


def left_margin(words: DataFrame) -> DataFrame:
    """Most frequent left edge in steps of 4, the one seen first on a tie."""
    bucket = half_up(F.col("x") / 4) * 4
    # a place as one number, which is added up by hash: rows of words are not sorted for it
    place = F.shiftleft(F.col("ln").cast("long"), 32) + F.col("pos")
    counts = words.groupBy("page", bucket.alias("margin")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    best = F.min_by("margin", F.struct((-F.col("n")).alias("n"), "first"))
    return counts.groupBy("page").agg(best.cast("double").alias("margin"))


def medians(words: DataFrame) -> DataFrame:
    return words.groupBy("page").agg(F.coalesce(F.median("size"), F.lit(0.0)).alias("size"), F.coalesce(F.median("w"), F.lit(0.0)).alias("width"))


def dominant(words: DataFrame, column: str) -> DataFrame:
    """Value of column with the largest area on each page, the one seen first on a tie."""
    area = F.greatest(F.lit(1.0), F.col("w") * F.col("h"))
    sums = words.where(F.col(column).isNotNull()).groupBy("page", column).agg(F.sum(area).alias("area"), F.min(F.struct("ln", "pos")).alias("first"))
    return sums.groupBy("page").agg(F.min_by(column, F.struct((-F.col("area")).alias("area"), "first")).alias(column))


def segments(words: DataFrame) -> DataFrame:
    """segment of each word of a line: a new one after a gap over the line's threshold."""
    line = Window.partitionBy("page", "ln")
    by_x = line.orderBy("x", "pos")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(by_x)
    rows = words.withColumn("gap", gap)
    limits = rows.groupBy("page", "ln").agg(F.greatest(F.lit(12.0), F.median("h") * 0.75, F.median("size") * 0.85, F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0.0)) * 2.4).alias("limit"))
    rows = rows.join(limits, ["page", "ln"])
    return rows.withColumn("segment", F.sum(F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)).over(by_x)).drop("gap", "limit")


def line_stats(words: DataFrame, line: str = "ln") -> DataFrame:
    """Words, spread of y (population) and mean gap of each line."""
    order = Window.partitionBy("page", line).orderBy("x", "ln", "pos")
    rows = words.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("w")).over(order))
    return rows.groupBy("page", line).agg(F.count("*").alias("words"), fixed(F.coalesce(F.stddev_pop("y"), F.lit(0.0)), 4).alias("spread"), fixed(F.avg("gap"), 4).alias("gap"))


def line_heights(lines: DataFrame) -> DataFrame:
    """height of each line: to the next line's top, the last one's own."""
    order = Window.partitionBy("page").orderBy("y", "ln")
    return lines.withColumn("height", F.greatest(F.lit(0.0), F.coalesce(F.lead("y").over(order), F.col("y") + F.col("h")) - F.col("y")))


def common_gap(gaps: DataFrame, by: list[str], near: float = 0.05) -> DataFrame:
    """The mean gap where no gap is further from it than near, else null."""
    mean = gaps.groupBy(*by).agg(F.avg("gap").alias("mean"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    return mean.select(*by, F.when(F.greatest(F.col("most") - F.col("mean"), F.col("mean") - F.col("least")) <= near, F.col("mean")).alias("gap"))


def columns(starts: list[float], tolerance: float) -> list[float]:
    """Centres of the clusters of sorted starts: each joins the first cluster within tolerance of its running mean."""
    clusters: list[tuple[float, int]] = []
    for x in sorted(starts):
        for i, (mean, n) in enumerate(clusters):
            if abs(x - mean) <= tolerance:
                clusters[i] = ((mean * n + x) / (n + 1), n + 1)
                break
        else:
            clusters.append((x, 1))
    return sorted(mean for mean, _ in clusters)


def column_centres(starts: DataFrame, tolerance: float) -> DataFrame:
    """Columns of each page from the x of its segments."""
    kind = starts.schema["page"].dataType.simpleString()

    def each(page, rows):
        for i, centre in enumerate(columns([r[1] for r in rows], tolerance)):
            yield (page, i, round(centre, 4))

    return walk(starts.select("page", "x"), ["page"], ["x"], each, f"page {kind}, column int, centre double")


def nearest(value: Column, centres: Column) -> Column:
    """Place (from 0) of the nearest centre, the first on a tie; 0 if there is none."""
    far = F.transform(centres, lambda c: F.abs(c - value))
    return F.when(F.size(centres) == 0, F.lit(0)).otherwise(F.array_position(far, F.array_min(far)).cast("int") - 1)


def confidence(blocks: DataFrame, pages: DataFrame, band: float = 3.0, x_gap: float = 12.0, indent: float = 0.0) -> DataFrame:
    """Page confidence of blocks (page, line, seq, x, y, w, h, size, length, indented, text_indent) on pages (page, width, height).

    Baselines, gaps, fit of widths and coverage are weighed 0.30, 0.25, 0.25 and 0.20, and indents add or take a little."""
    order = Window.partitionBy("page", "line").orderBy("x", "seq")
    rows = blocks.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("w")).over(order))
    expected = F.greatest(F.lit(1.0), 0.6 * F.col("size") * F.col("length"))
    rows = rows.withColumn("fit", clamp01(1 - F.abs(F.col("w") - expected) / expected)).withColumn("near", F.when(F.abs(F.col("text_indent") - indent) < 3, 1.0).otherwise(0.0))
    per_line = rows.groupBy("page", "line").agg(
        F.count("*").alias("n"), F.stddev_pop("y").alias("dy"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("dx"), F.sum("fit").alias("fit"), F.sum(F.col("w") * F.col("h")).alias("area"),
        F.count_if("indented").alias("indents"), F.sum(F.when(F.col("indented"), F.col("near")).otherwise(0.0)).alias("near"),
    )
    base, gaps = clamp01(1 - F.col("dy") / 6), clamp01(1 - F.col("dx") / max(12.0, 1.5 * x_gap))
    page = per_line.groupBy("page").agg(F.avg(base).alias("b"), F.coalesce(F.avg(F.when(F.col("n") > 1, gaps)), F.lit(1.0)).alias("g"), (F.sum("fit") / F.sum("n")).alias("f"), F.sum("area").alias("area"), F.sum("indents").alias("indents"), F.sum("near").alias("near"))
    cover = clamp01(F.col("area") / F.greatest(F.lit(1.0), F.col("width") * F.col("height")) / 0.28)
    extra = F.lit(0.0) if indent <= 0 else F.when(F.col("indents") == 0, -0.03).otherwise((F.col("near") / F.greatest(F.col("indents"), F.lit(1)) - 0.5) * 0.1)
    score = fixed(clamp01(0.30 * F.col("b") + 0.25 * F.col("g") + 0.25 * F.col("f") + 0.20 * cover + extra), 4)
    return pages.join(page, "page", "left").select("page", F.when(F.col("b").isNull() | (F.col("width") <= 0) | (F.col("height") <= 0), F.lit(0.0)).otherwise(score).alias("confidence"))


def band(score: Column) -> Column:
    return F.when(score >= 0.85, "good").when(score >= 0.6, "warn").otherwise("low")


def confidence_series(pages: DataFrame) -> DataFrame:
    """Pages with their confidence and the mean of all, 2 decimals; ordered by page where they are shown."""
    mean = pages.agg(fixed(F.avg("confidence"), 2).alias("mean"))
    return pages.crossJoin(F.broadcast(mean))  # one row
