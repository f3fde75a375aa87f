"""Vector code compression: product codes, their codebooks refined by Elkan's form of Lloyd's rounds.

Vectors become integers and are cut into equal parts; each part position has a codebook. For each
vector and part a table keeps the entry it is assigned to, an upper bound of the distance to it, and
one lower bound for each entry. When entries move, the bounds are shifted by the movement. An entry
is left out only where its lower bound, or half the distance between it and the assigned entry, is
strictly greater than the upper bound; all else is computed in integers, so ties are seen and go to
the lower index. Upper bounds are kept as floats rounded up, lower bounds as a byte each, the
greatest level under them of a geometric scale: a bound may be loose, never wrong.

The bounds are a table in the shared folder, written once a round (the one before is deleted then); no
row is shuffled. A task adds up its parts by entry, at most parts * entries rows, which are summed
and come to the driver: their number is fixed by the parameters, not by the data.

Vectors that are null, empty, or hold null or non-finite components take no part. Of the others those
of the commonest length that the parts divide take part (ties: the longest). Rows are distinct even
if their ids repeat; the first entries are of the smallest ids, ties by the components, rows without
an id last. With fewer rows than entries there are fewer entries. Components beyond 2^26 in size after scaling are
refused, since distances would not be exact. Null labels are one label. Columns other than those
named are ignored. No rows give no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, drop_written, fits, materialise, release

PARTS, ENTRIES, ROUNDS = 16, 64, 2
LARGEST = 1 << 26
#: Rows of a block of bounds.
ROWS = 2048
#: Lower bounds are kept as the place of a level; 256 levels from 0 over 1 to 2^32.
LEVELS = np.concatenate(([0.0], 2.0 ** (np.arange(255) * (32 / 254))))
UP, DOWN = 1 + 1e-12, 1 - 1e-12
BOUNDS = "vec_id long, label long, q binary, code binary, upper binary, lower binary, tried long"


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x width."""

    entries: np.ndarray

    def distances(self, part: int, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to all entries of a part, in integers."""
        out = np.zeros((len(x), self.entries.shape[1]), np.int64)
        for k in range(x.shape[1]):
            out += (x[:, k, None] - self.entries[None, part, :, k]) ** 2
        return out

    def moved(self, other: Codebooks) -> np.ndarray:
        """How far each entry went, rounded up."""
        return np.sqrt(((self.entries - other.entries) ** 2).sum(axis=2).astype(np.float64)) * UP

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _byte(bounds: np.ndarray) -> np.ndarray:
    return (np.searchsorted(LEVELS, bounds, side="right") - 1).clip(0).astype(np.uint8)


def first_bounds(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, upper and lower bounds of a block (rows x parts x width) from all distances, and how many were computed."""
    n, parts, _ = x.shape
    codes, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts, books.entries.shape[1]), np.uint8)
    for p in range(parts):
        d = books.distances(p, x[:, p])
        codes[:, p] = d.argmin(axis=1)
        roots = np.sqrt(d.astype(np.float64))
        upper[:, p] = roots[np.arange(n), codes[:, p]] * UP
        lower[:, p] = _byte(roots * DOWN)
    return codes, upper, lower, n * parts * books.entries.shape[1]


def next_bounds(x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same for entries that moved, computing only what the bounds do not rule out."""
    n, parts, _ = x.shape
    tried = 0
    codes, upper, lower = codes.copy(), upper.copy(), lower.copy()
    for p in range(parts):
        own = books.entries[p]
        apart = np.sqrt(((own[:, None] - own[None]) ** 2).sum(axis=2).astype(np.float64)) * (DOWN / 2)
        a, xs = codes[:, p], x[:, p]
        u = (upper[:, p] + moved[p][a]) * UP
        low = np.maximum((LEVELS[lower[:, p]] - moved[p][None, :]) * DOWN, 0.0)

        def open_to(rows: np.ndarray) -> np.ndarray:
            left = (low[rows] <= u[rows, None]) & (apart[a[rows]] <= u[rows, None])
            left[np.arange(len(rows)), a[rows]] = False
            return left

        rows = np.flatnonzero(open_to(np.arange(n)).any(axis=1))
        # first the bound itself is made tight; most rows need nothing else
        near = ((xs[rows] - own[a[rows]]) ** 2).sum(axis=1)
        tried += len(rows)
        root = np.sqrt(near.astype(np.float64))
        u[rows], low[rows, a[rows]] = root * UP, root * DOWN
        left = open_to(rows)
        i, j = np.nonzero(left)
        d = ((xs[rows[i]] - own[j]) ** 2).sum(axis=1)
        tried += len(i)
        low[rows[i], j] = np.sqrt(d.astype(np.float64)) * DOWN
        full = np.full(left.shape, np.iinfo(np.int64).max)
        full[i, j] = d
        full[np.arange(len(rows)), a[rows]] = near
        if len(rows):
            best = full.argmin(axis=1)
            u[rows] = np.sqrt(full[np.arange(len(rows)), best].astype(np.float64)) * UP
            codes[rows, p] = best
        upper[:, p], lower[:, p] = u, _byte(low)
    return codes, upper, lower, tried


def _block(batch: pa.RecordBatch, column: str, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind).reshape(batch.num_rows, *shape)


def _row(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(values, kind)], pa.binary())


def _up32(values: np.ndarray) -> np.ndarray:
    """As 32-bit floats, never less."""
    return np.nextafter(values.astype(np.float32), np.float32(np.inf))


def integers(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """vec_id, label, q (array<long>) of the rows that take part."""
    v = df[vector_col].cast("array<double>")
    fine = (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].cast("long").alias("label"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v")).where("v IS NOT NULL")
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("q"))


def _write_bounds(rows: DataFrame, parts: int, books: Codebooks, before: Codebooks | None) -> DataFrame:
    entries, width = books.entries.shape[1:]
    moved = None if before is None else books.moved(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _block(batch, "q", "<i4", parts, width).astype(np.int64)
                if before is None:
                    codes, upper, lower, tried = first_bounds(x, books)
                else:
                    codes, upper, lower, tried = next_bounds(x, _block(batch, "code", "u2", parts).astype(np.int64), _block(batch, "upper", "<f4", parts).astype(np.float64), _block(batch, "lower", "u1", parts, entries), books, moved)
                upper = _up32(upper)
                counts = np.zeros(batch.num_rows, np.int64)
                counts[0] = tried
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("q"), _row(codes, "u2"), _row(upper, "<f4"), _row(lower, "u1"), pa.array(counts)], names=["vec_id", "label", "q", "code", "upper", "lower", "tried"])
        release()

    return materialise(rows.mapInArrow(run, BOUNDS), "bounds")


def _replaced(bounds: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry by the floor of its parts' mean; entries without parts stay."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, codes = _block(batch, "q", "<i4", parts, width).astype(np.int64), _block(batch, "code", "u2", parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        held = np.argwhere(counts > 0)
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0], pa.int32()), pa.array(held[:, 1], pa.int32()), pa.array(counts[counts > 0]), pa.array(sums[counts > 0].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
        release()

    added = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    new = books.entries.copy()
    for row in bounds.select("q", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # parts * entries rows at most
        new[row["part"], row["entry"]] = [row[f"s{k}"] // row["n"] for k in range(width)]
    return Codebooks(new)


def train(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256) -> tuple[DataFrame | None, Codebooks | None]:
    """The table of bounds after the last assignment, and the codebooks; nothing where no row takes part."""
    spark = df.sparkSession
    bounded_arrow(spark)
    rows = integers(df, id_col, vector_col, label_col, parts, scale)
    seen = rows.groupBy(F.size("q").alias("dim")).agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("q"), -F.array_min("q"))).alias("most")).orderBy(F.desc("n"), F.desc("dim")).first()
    if seen is None:
        return None, None
    dim = seen["dim"]
    if seen["most"] >= LARGEST:
        raise ValueError("components are too large for exact distances")
    rows = rows.where(F.size("q") == dim)
    firsts = rows.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()  # as many rows as a codebook has entries
    books = Codebooks(np.array([r["q"] for r in firsts], np.int64).reshape(len(firsts), parts, dim // parts).transpose(1, 0, 2).copy())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _row(q, "<i4")], names=["vec_id", "label", "q"])

    bounds = _write_bounds(rows.mapInArrow(packed, "vec_id long, label long, q binary"), parts, books, None)
    for _ in range(rounds):
        new = _replaced(bounds, books)
        old, bounds = bounds, _write_bounds(bounds, parts, new, books)
        drop_written(old)
        books = new
    return bounds, books


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row that takes part; codes have two hex digits up to 256 entries, else four."""
    spark = df.sparkSession
    bounds, books = train(df, id_col, vector_col, label_col, parts, entries, rounds, scale)
    if bounds is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width, digits = books.entries.shape[2], 2 if entries <= 256 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, codes = _block(batch, "q", "<i4", parts, width).astype(np.int64), _block(batch, "code", "u2", parts)
            error = sum((((x[:, p] - books.entries[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(parts)), np.zeros(len(x), np.int64))
            text = [c.tobytes().hex() for c in np.ascontiguousarray(codes, "u1" if digits == 2 else ">u2")]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])
        release()

    coded = materialise(bounds.select("vec_id", "label", "q", "code").mapInArrow(run, "vec_id long, label long, code string, error long"), "codes")
    drop_written(bounds)
    key = F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key")
    sums = materialise(coded.groupBy(key).agg(F.sum("error").alias("label_error")), "errors")
    joined = coded.select("vec_id", "code", "error", key).join(F.broadcast(sums) if fits(sums) else sums, "key")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
