"""Of groups of texts the one row that stays.

Texts go by two hashes, so groups are found and joined without the texts themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sized, materialise


def keyed(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit("copy"), text))


def one_of_each(df: DataFrame, id_col: str, text_col: str, find: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """The rows of df that stay, one of each group: that with the smallest id, without an id if none has one, and of rows that repeat id and text one.

    find: gives k1, k2 (as of keyed()), first (smallest id with that text) and root (the group's) of each distinct text of a table, by id and text column."""
    columns = df.columns
    id_col, text_col = (f"c{columns.index(c)}" for c in (id_col, text_col))
    df = df.toDF(*[f"c{i}" for i in range(len(columns))])
    found = find(df, id_col, text_col)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("k1"), F.col("k2"))).alias("m"))
    keep = best.select("m.k1", "m.k2", F.col("m.first").alias("_first"))
    copies = keyed(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text").groupBy("k1", "k2", F.col("_id").alias("_first")).agg(F.count("*").alias("_same"))
    same = (keep["k1"] == copies["k1"]) & (keep["k2"] == copies["k2"]) & keep["_first"].eqNullSafe(copies["_first"])
    keep = materialise(keep.join(copies, same).select(keep["k1"], keep["k2"], keep["_first"], "_same"), "keep")
    rows = join_sized(keyed(df, text_col), keep, ["k1", "k2"], "inner").where(F.col(id_col).eqNullSafe(F.col("_first")))
    if keep.where("_same > 1").limit(1).count():
        rows = rows.where("_same = 1").unionByName(rows.where("_same > 1").dropDuplicates(["k1", "k2"]))
    return rows.select(*df.columns).toDF(*columns)
