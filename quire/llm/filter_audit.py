"""Filter interaction audit: what each order of some filters keeps, removes and loses, for each part.

Every row gets a mask, a bit for each filter that it fails. Rows are counted into cells (part, mask);
all that follows needs the cells alone. The orders of the filters are visited by single swaps of
neighbours (Steinhaus, Johnson and Trotter): a swap changes only the two steps it touches, which are
computed anew from the part's cells; the sum of what each filter removes over all orders (its Shapley
value times their number) grows along the walk.

A row-wise filter is a boolean column, true where the row fails; null is no failure. The copy filter
fails rows whose text is that of a row with a smaller id, in whatever part. Copies are told by
SHA-256. A text's rows are counted by id and part before they meet, so a group of copies that holds a
third of the table comes to a few rows a task; the window over a text sees at most a row for each
part and label.

A null text is an empty one, a null part is the empty string. Rows without an id fail the copy filter
never, make no other fail it and have no labels. Rows with equal ids count each; of a text's
smallest id none fails. An id labelled twice is good or toxic if one of its labels says so. Very
long texts are split by the JVM, a row at a time. Columns other than those named are ignored. No
rows give no rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_sized, materialise

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
REPORT = "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in COUNTS) + ", shapley long"


def text_filters(text: Column) -> dict[str, Column]:
    """The row-wise filters A to D: few words, repeated words, upper case, signs."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": F.size(F.array_distinct(words)) * 100 < n * 80, "C": upper.cast("long") * 100 > F.length(text).cast("long") * 10, "D": text.rlike(r"[#$%&*|]")}


def walk(n: int) -> Iterator[tuple[list[int], int]]:
    """All orders of n things, each by one swap of neighbours from the one before; with the swap's first place, -1 for the first order."""
    order, ways = list(range(n)), [-1] * n  # of each thing, which way it looks
    yield list(order), -1
    while True:
        movable = [x for i, x in enumerate(order) if 0 <= i + ways[x] < n and order[i + ways[x]] < x]
        if not movable:
            return
        x = max(movable)
        i = order.index(x)
        j = i + ways[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            ways[y] = -ways[y]
        yield list(order), min(i, j)


def audit_cells(masks: np.ndarray, counts: np.ndarray, names: Sequence[str]) -> dict[str, list]:
    """The report of one part. counts: rows, good ones and toxic ones of each mask."""
    n = len(names)
    steps = [[0] * 5 for _ in range(n)]  # removed, redundant, unique, good, toxic at each place
    own = [int(counts[masks == 1 << f, 0].sum()) for f in range(n)]
    fails = [int(counts[masks >> f & 1 == 1, 0].sum()) for f in range(n)]
    whole = int(counts[:, 0].sum())
    shapley = [0] * n
    out: dict[str, list] = {c: [] for c in ("filter_order", "step", "filter", *COUNTS)}

    def step(before: int, f: int) -> list[int]:
        gone = (masks & before == 0) & (masks >> f & 1 == 1)
        removed, good, toxic = (int(x) for x in counts[gone].sum(axis=0))
        return [removed, fails[f] - removed, own[f], good, toxic]

    for order, at in walk(n):
        for place in range(n) if at < 0 else (at, at + 1):
            steps[place] = step(sum(1 << f for f in order[:place]), order[place])
        kept, name = whole, "".join(names[f] for f in order)
        for place, f in enumerate(order):
            removed = steps[place][0]
            kept -= removed
            shapley[f] += removed
            for c, v in zip(out, (name, place + 1, names[f], kept, *steps[place])):
                out[c].append(v)
    out["shapley"] = [shapley[names.index(f)] for f in out["filter"]]
    return out


def cells(df: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic. filters: row-wise failures over the column _text; copies: the name of the copy filter, whose bit follows theirs."""
    rows = df.select(F.coalesce(df[text_col], F.lit("")).alias("_text"), df[id_col].cast("long").alias("id"), F.coalesce(df[part_col].cast("string"), F.lit("")).alias("part"))
    bits = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())]
    # the hash first: one key for one text, so that rows of one text and id are counted before they are dealt out
    rows = rows.select("id", "part", F.unhex(F.sha2("_text", 256)).alias("text"), sum(bits, F.lit(0)).alias("mask")).groupBy("id", "part", "text", "mask").agg(F.count("*").alias("n"))
    marks = materialise(labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "labels")
    # rows without an id are spread by their text, under a key that no label has
    rows = rows.select("*", F.coalesce("id", F.xxhash64("text")).alias("key"), F.col("id").isNull().alias("free"))
    keyed = marks.select(F.col("id").alias("key"), F.lit(False).alias("free"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = join_sized(rows, keyed, ["key", "free"], "left").na.fill(0, ["good", "toxic"])
    groups = rows.groupBy("text", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("free"), F.col("n")).otherwise(0)).alias("free"), F.min("id").alias("low"), F.min(F.when(~F.col("free"), F.struct("id", "n"))).alias("least")
    )
    passed = F.col("free") + F.when(F.col("low") == F.min("low").over(Window.partitionBy("text")), F.col("least.n")).otherwise(0)
    split = groups.select("part", "mask", "good", "toxic", "n", passed.alias("passed"))
    bit = 1 << len(filters)
    both = F.array(F.struct(F.col("mask"), F.col("passed").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    return split.select("part", "good", "toxic", F.inline(both)).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def report(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """The audit of each part, from its cells: 2 ** len(names) rows at most."""
    names = list(names)

    def run(got: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(audit_cells(got["mask"].to_numpy(np.int64), got[["n", "good", "toxic"]].to_numpy(np.int64), names))
        out.insert(0, "part", got["part"].iloc[0])
        return out

    return counted.groupBy("part").applyInPandas(run, REPORT)


def audit(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """The interaction audit of the filters A to D and of copies (E)."""
    filters = text_filters(F.col("_text"))
    return report(cells(df, labels, filters, "E", text_col, id_col, part_col), [*filters, "E"])


def orders(names: str) -> list[str]:
    return ["".join(p) for p in permutations(names)]
