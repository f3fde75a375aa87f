"""Files as tables, and tables as files: JSON documents, fix and visit logs, PDF signatures, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the bytes by which a PDF begins.
PDF = "25504446"
LARGE = 50 * 1024 * 1024


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each readable JSON document under path, with its file; those that can't be read are dropped."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("_file", F.col("_metadata.file_path")).where("_corrupt is null").drop("_corrupt")


def fix_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fixes of all jobs, but for what lies in a folder of visits."""
    return json_documents(spark, path, schema).where(~F.col("_file").contains("/visits/")).orderBy("timestamp")


def visit_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return json_documents(spark, path, schema).where(F.col("_file").contains("/visits/")).orderBy("visitedAt")


def draft_pages(files: DataFrame) -> DataFrame:
    """Page numbers in the names of draft files (_file), ascending."""
    number = F.regexp_extract("_file", r"(\d+)\.json$", 1)
    return files.where(number != "").select(number.cast("int").alias("page")).orderBy("page")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with whether they begin as a PDF does and whether they are large."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", "length", (F.substring("content", 1, 4) == F.unhex(F.lit(PDF))).alias("is_pdf"), F.when(F.col("length") > LARGE, "large_file").alias("warning"))


def with_defaults(keys: DataFrame, profiles: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """keys with their profile, and defaults where there is none."""
    found = keys.join(profiles, on, "left")
    return found.select(*keys.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def patched(current: DataFrame, patch: DataFrame, on: list[str], now: Column | None = None, updated: str = "updatedAt") -> DataFrame:
    """current with the non-null fields of patch; given now, rows that a patch names get it as their time of change, whatever the patch says."""
    if now is not None:
        patch = patch.drop(updated).withColumn(updated, now)
    fields = [c for c in current.columns if c not in on]
    new = patch.select(*on, *[F.col(c).alias(f"_new_{c}") for c in fields if c in patch.columns])
    held = current.join(new, on, "left")
    return held.select(*on, *[F.coalesce(f"_new_{c}", c).alias(c) if c in patch.columns else F.col(c) for c in fields])


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key of an append-only table."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def without_job(rows: DataFrame, job: str, column: str = "job") -> DataFrame:
    """What stays when a job is deleted."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(job)))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def under(path: str, roots: Iterable[str]) -> bool:
    """Whether a path lies in one of the roots; sibling folders with the same beginning do not."""
    import os

    own = os.path.normcase(os.path.realpath(path))
    return any(own == r or own.startswith(r.rstrip(os.sep) + os.sep) for r in (os.path.normcase(os.path.realpath(x)) for x in roots))


def stored_zip(entries: Iterable[tuple[str, bytes]], replace: dict[str, bytes] | None = None) -> bytes:
    """An uncompressed archive; replace gives other contents for some names. For a job's files, whose number is bounded."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in sorted(entries):
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), (replace or {}).get(name, content))
    return out.getvalue()


def external(rows: DataFrame, run, schema: str) -> DataFrame:
    """The contract for parsers, rasterisers and readers that are not part of the engine: run(iterator of pandas frames) -> frames."""
    return rows.mapInPandas(run, schema)
