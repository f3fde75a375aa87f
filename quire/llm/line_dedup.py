"""Line dedup by site-relative frequency, in DataFrame functions only.

Rows are pages. For each host, the pages that contain a line are counted, each page once, and
divided by the host's pages; lines over a ratio are boilerplate of that host and dropped from its
pages. Lines count as equal without the spaces at their ends; 128 bits of hash stand for a line.

A null text is an empty one and stays empty; null hosts are one host. Blank lines are kept. A line
is dropped only if at least min_pages pages of its host hold it: by default two, since a line of one
page repeats nowhere. Repeated rows count as pages each. Very long texts need nothing special: lines
are hashed before they are dealt out, and counts are summed before the shuffle, so that a hot host or
line costs no more than others. Columns of any name are kept, but those named n_lines or n_removed
are replaced. No rows give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, join_sized, materialise

MAX_RATIO = 0.05
#: Pages of a host that hold a line before it can be boilerplate.
MIN_PAGES = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))


def _host(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit(""))


def boilerplate(df: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_host, _line (its hashes), pages, ratio: the lines over the ratio."""
    pages = df.select(_host(F.col(host_col)).alias("_host"), F.col(text_col).alias("_text"))
    held = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: F.trim(x) != ""), _key))
    seen = pages.select("_host", F.explode(held).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = materialise(pages.groupBy("_host").agg(F.count("*").alias("all")), "hosts")
    return join_sized(seen, totals, ["_host"], "inner").withColumn("ratio", F.col("pages") / F.col("all")).where(F.col("ratio") > max_ratio).drop("all")


def dedup_lines(df: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """df with the text's boilerplate lines dropped, and n_lines, n_removed."""
    columns = df.columns
    text, host = (f"c{columns.index(c)}" for c in (text_col, host_col))
    own = df.toDF(*[f"c{i}" for i in range(len(columns))])
    drop = materialise(boilerplate(own, text, host, max_ratio, min_pages).select("_host", "_line"), "lines")
    # a host's list holds at most its lines a page divided by the ratio
    lists = drop.groupBy("_host").agg(F.collect_list("_line").alias("_drop"))
    lists = F.broadcast(lists) if fits(drop) else lists
    own = own.withColumn("_host", _host(F.col(host))).join(lists, "_host", "left")
    own = own.withColumn("_lines", _lines(F.col(text)))
    hit = F.when(F.col("_drop").isNotNull(), F.array_intersect(F.transform("_lines", _key), F.col("_drop")))
    own = own.withColumn("_hit", F.when(F.size(hit) > 0, hit))
    left = F.when(F.col("_hit").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains(F.col("_hit"), _key(x)) | (F.trim(x) == "")))
    own = own.withColumn("_left", left)
    own = own.withColumn("_removed", (F.size("_lines") - F.size("_left")).cast("long"))
    own = own.withColumn(text, F.when(F.col("_removed") > 0, F.array_join("_left", "\n")).otherwise(F.coalesce(F.col(text), F.lit(""))))
    added = [F.size("_lines").cast("long").alias("n_lines"), F.col("_removed").alias("n_removed")]
    return own.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c not in ("n_lines", "n_removed")], *added)
