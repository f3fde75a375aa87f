"""Results that several steps read: written once in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a small side that may be broadcast, by its rows and columns.
BROADCAST_BYTES = 64 << 20
ARROW_BYTES, ARROW_ROWS = 4 << 20, 1000

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a run in one process gets a folder of its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _tidy() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def new(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has, removed when the driver ends."""
    path = f"{folder(spark)}/quire-{uuid.uuid4().hex}-{label}"
    if not _made:
        atexit.register(_tidy)
    _made.append((spark, path))
    return path


def once(df: DataFrame, label: str) -> DataFrame:
    """df written as a table and read again: computed once however often it is used, and no executor's loss undoes it."""
    path = new(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes and rows, so that a worker holds few long texts at once; values that the user has set lower stay."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def sized(df: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """df as of once(), to be broadcast if its rows are few enough; else a join with it is shuffled."""
    table = once(df, label)
    bytes_ = table.select(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16 * len(table.columns))).first()[0] or 0
    return F.broadcast(table) if bytes_ <= (BROADCAST_BYTES if limit is None else limit) else table
