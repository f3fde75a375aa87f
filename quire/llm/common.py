"""Session helpers shared by the operators: shared storage, size-checked joins, Arrow batching."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measured bytes of a small side that may be broadcast; beyond them the join is shuffled.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch, and of the text that a Python worker handles at once.
ARROW_BYTES = BATCH_BYTES = 4 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a run in one process gets a local one; a cluster has to name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}-{label}"
    if not _made:
        atexit.register(_tidy)
    _made.append((spark, path))
    return path


def _tidy() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: lineage ends there, and any executor may be lost."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table from materialise() that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if name not in {p for _, p in _made} and not any(name.endswith(p.split("://")[-1]) for _, p in _made):
            raise ValueError("not a table of materialise()")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_shared(path: str, write: bool = False):
    """A file of the shared folder, from a worker."""
    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name, compression=None) if write else store.open_input_file(name)


def list_shared(path: str, suffix: str) -> list[str]:
    """Files with the suffix under a folder of the shared one, by name; none if it is not there."""
    store, name = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
    return sorted(path.rstrip("/") + f.path[len(name.rstrip("/")) :] for f in found if f.is_file and f.path.endswith(suffix))


def bounded_arrow(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that long texts do not fill a worker; a value set by the user stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) >= 1 << 28:
        spark.conf.set(key, str(ARROW_BYTES))


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about as a broadcast holds it."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(24).cast("long"), lambda a, x: a + _width(x, kind.elementType))
    return F.lit(8)


def fits(table: DataFrame, limit: int | None = None) -> bool:
    """Whether a written table's measured bytes are within the bound of what may be broadcast."""
    limit = BROADCAST_BYTES if limit is None else limit
    least = 16 + 8 * len(table.columns)
    if table.count() * least > limit:  # from file footers
        return False
    size = table.agg(F.sum(sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(16)).cast("long"))).first()[0]
    return (size or 0) <= limit


def join_sized(big: DataFrame, small: DataFrame, on: list[str], how: str, limit: int | None = None) -> DataFrame:
    """Joins a table from materialise() to big: broadcast if its measured bytes are within the bound, else shuffled."""
    return big.join(F.broadcast(small) if fits(small, limit) else small, on, how)


def text_array(column: pa.Array) -> pa.Array:
    """Null texts as empty ones, in one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def text_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each holds at most limit bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < len(sizes):
            yield batch.slice(first)
    release()


def settle(spark: SparkSession) -> None:
    """Asks the executors' JVMs to collect their garbage, which gives heap that they no longer need back to the machine.

    A JVM keeps the heap that its busiest moment took; the Python workers beside it live on what is left of an
    executor's memory. Call it before work that is done in Python. It is a request: results do not depend on it."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


def release() -> None:
    """Gives unused memory back at a task's end: workers are kept for other tasks, which need it too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
