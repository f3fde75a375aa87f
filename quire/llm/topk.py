"""Exact top-k search by integer inner product: columnar branch and bound.

Vectors are quantised and laid out vertically, a row of a block for each dimension. A query adds up
its products one group of dimensions after the other. What the remaining dimensions can still add is
at most the product of the remaining lengths of both vectors (Cauchy-Schwarz); a candidate whose
partial score plus that bound lies under the k-th best lower bound is dropped, and the survivors are
compacted before the next group.

Vectors that are null or hold null or non-finite components take no part. Only vectors of equal
length are compared. Rows are distinct even if their ids repeat: each takes part, and a query leaves
out its own row alone. Candidates without an id come last among ties. Candidates are written once, as
blocks in the shared folder; each task holds some queries and streams the blocks past them, so that
what is shuffled grows with the rows, not with pairs. An empty table gives no rows; columns other
than the two named are not read, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, list_shared, materialise, open_shared, release, scratch

BLOCK_ROWS = 4096
#: Queries of a task: at most, and at least where there are as many.
QUERY_ROWS, FEW = 4096, 64
GROUP = 16
LAST = np.iinfo(np.int64).max


def quantise(df: DataFrame, vector_col: str, id_col: str, scale: int = 256) -> DataFrame:
    """vec_id and q array<double>: floor(scale * x) of the vectors that take part."""
    v = df[vector_col].cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(df[id_col].cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(whole, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("q"))


def _packed(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Blocks of at most size rows of equal length: dim, ids, data (vertical doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            got = held.pop(dim)
            ids = np.array([LAST if i is None else i for i, _ in got], np.int64)
            data = np.ascontiguousarray(np.array([v for _, v in got], np.float64).reshape(len(got), dim).T)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["dim", "ids", "data"])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("q").to_pylist()):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)
        release()

    return rows.repartition(n).mapInArrow(run, "dim int, ids binary, data binary")


def _candidates(path: str, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and data of the written blocks of a length, one after the other."""
    for name in list_shared(f"{path}/dim={dim}", ".parquet"):
        with open_shared(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1, columns=["ids", "data"]):
                ids = np.frombuffer(batch.column("ids")[0].as_py(), np.int64)
                yield ids, np.frombuffer(batch.column("data")[0].as_py(), np.float64).reshape(dim, len(ids))


def _search(query: np.ndarray, data: np.ndarray, rest: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the candidates that can be among the k best, none under floor. rest: lengths of the remaining dimensions by group."""
    dim, n = data.shape
    left = np.sqrt(np.concatenate((np.cumsum((query * query)[::-1])[::-1], [0.0])))
    alive, score = np.arange(n), np.zeros(n)
    for g, at in enumerate(range(0, dim, GROUP)):
        end = min(dim, at + GROUP)
        score = score + query[at:end] @ (data[at:end] if len(alive) == n else data[at:end, alive])
        slack = left[end] * rest[g + 1][alive] * (1 + 1e-9)
        if len(alive) > k:
            low = np.partition(score - slack, len(alive) - k)[len(alive) - k]
            floor = max(floor, low)
        keep = score + slack >= floor
        if not keep.all():
            alive, score = alive[keep], score[keep]
            if not len(alive):
                break
    return alive, score


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by every.

    Scores are exact while the product of two vectors' lengths stays under 2^53; vectors that could pass it are refused."""
    spark = df.sparkSession
    bounded_arrow(spark)
    rows = materialise(quantise(df, vector_col, id_col, scale), "vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "blocks")
    _packed(rows, BLOCK_ROWS, max(1, -(-rows.count() // BLOCK_ROWS))).write.partitionBy("dim").parquet(path)
    asked = rows.where(F.col("vec_id").isNotNull() & (F.col("vec_id") % every == 0))
    n = asked.count()
    size = max(FEW, min(QUERY_ROWS, -(-n // (2 * parts))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "data"))):
                yield _ranked(np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(dim, len(ids) // 8), _candidates(path, dim), k)
        release()

    return _packed(asked, size, max(1, -(-n // size))).mapInArrow(run, "query_id long, rank int, vec_id long, score long")


def _ranked(own: np.ndarray, asked: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> pa.RecordBatch:
    """The k best of all blocks for each query, but for its own row."""
    dim = len(asked)
    selves = (asked * asked).sum(axis=0)
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
    for ids, data in blocks:
        squares = np.concatenate((np.cumsum((data * data)[::-1], axis=0)[::-1], np.zeros((1, data.shape[1]))))
        if selves.max(initial=0) * squares[0].max(initial=0) >= 2.0**106:
            raise ValueError("vectors are too long for exact scores")
        rest = np.sqrt(squares[[*range(0, dim, GROUP), dim]])
        for q in range(len(own)):
            had_ids, had = best[q]
            alive, score = _search(np.ascontiguousarray(asked[:, q]), data, rest, k + 1, had[-1] if len(had) == k + 1 else -np.inf)
            if len(alive):
                best[q] = _best(np.concatenate((had_ids, ids[alive])), np.concatenate((had, score)), k + 1)
    queries, ranks, found, scores = [], [], [], []
    for q, (ids, score) in enumerate(best):
        mine = np.flatnonzero((ids == own[q]) & (score == selves[q]))[:1]
        ids, score = np.delete(ids, mine)[:k], np.delete(score, mine)[:k]
        queries += [int(own[q])] * len(ids)
        ranks += range(1, len(ids) + 1)
        found += [None if i == LAST else i for i in ids.tolist()]
        scores += score.astype(np.int64).tolist()
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(ranks, pa.int32()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "rank", "vec_id", "score"])
