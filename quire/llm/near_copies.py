"""Near copies by word shingles: prefixes of the shingle sets find the candidates, an exact comparison decides.

Two sets of a Jaccard similarity of 0.8 or more share one of the first shingles (by hash) of both: one
of n shares at least 0.8 n, so it cannot have all of these among the n - 0.8 n that are not the last
ones. Every pair of the similarity meets at the first shingle that it shares, and none is lost.
Shingles at which the same texts meet are one meeting, its first shingle's.

Only groups are asked for, not pairs. At each meeting all texts are compared with its smallest node and
its largest; where nodes of several groups remain, the pairs across groups follow, but for those whose
sizes, places or parities (an exact bound on what two sets have apart) rule the similarity out. Pairs that
met at one of the first EARLY meetings of both are not made at later ones. Large meetings are cut into blocks of nodes, and each pair
of blocks is work of its own. There is no limit on partners. Shingles are hashes of 48 bits.

A null text is an empty one; all texts without words are one group. Of a group the row with the
smallest id stays, without an id if none has one, and of rows that repeat id and text one stays. No
rows give no rows. Columns of any name are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_arrow, join_sized, materialise, release, settle, text_array, text_batches
from .components import components
from .copies import keyed, one_of_each
from .simhash import shingle_hashes

BLOCK = 512  # nodes of a meeting that are compared with as many others at once
WIDTH = 6  # bytes of a shingle's hash
PLACES = 1 << 28
EARLY = 64  # of a node's first meetings that its later ones know of: pairs that met there are not made again
_LITTLE = 1e-6  # room for rounding, on the safe side


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size) & np.uint64((1 << 8 * WIDTH) - 1))


def packed(shingles: np.ndarray) -> bytes:
    return np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.view(np.int64).ravel()


def prefix(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles, of which a set of the similarity has one among its own first; 0 stands for a set without any."""
    n = len(shingles)
    return shingles[: n - int(np.ceil(similarity * n - _LITTLE)) + 1] if n else np.zeros(1, np.uint64)


def parities(shingles: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each of two to four times as many bits as there are shingles."""
    bits = max(64, 2 << max(len(shingles) - 1, 0).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(raw: bytes, words: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint64)
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def room(both: np.ndarray, similarity: float) -> np.ndarray:
    """The most shingles that two sets of the similarity may have apart, by the sum of their sizes; parities that differ are no more than these."""
    return both * (1 - similarity) / (1 + similarity) + _LITTLE


def possible(sizes: np.ndarray, places: np.ndarray, marks: list[bytes], maybe: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes left (rows of maybe) and right (columns) the pairs whose sizes, places of the first common shingle, and parities allow the similarity."""
    a, b = sizes[left][:, None], sizes[right][None, :]
    most = np.minimum((sizes - places)[left][:, None], (sizes - places)[right][None, :])
    maybe = maybe & (np.minimum(a, b) >= similarity * np.maximum(a, b) - _LITTLE) & (most >= similarity * (a + b) / (1 + similarity) - _LITTLE)
    words = np.array([len(x) // 8 for x in marks])
    levels = {w: {k: folded(marks[k], w) for k in np.flatnonzero(words >= w).tolist()} for w in np.unique(words).tolist()}
    i, j = [], []
    for row in np.flatnonzero(maybe.any(axis=1)).tolist():
        x, columns = int(left[row]), np.flatnonzero(maybe[row])
        shared_words = np.minimum(words[x], words[right[columns]])
        for w in np.unique(shared_words).tolist():
            some = columns[shared_words == w]
            level = levels[w]
            apart = np.bitwise_count(np.stack([level[k] for k in right[some].tolist()]) ^ level[x]).sum(axis=1, dtype=np.int64)
            some = some[apart <= room(sizes[x] + sizes[right[some]], similarity)]
            i.append(np.full(len(some), row))
            j.append(some)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + i), np.concatenate(none + j)


def across(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of different roots that may have the similarity; rows come sorted by token, low and high.

    A pair whose nodes have a token in common in before has met there, where it was judged; it is left out."""
    names = ("own", "node", "root", "size", "place", "marks", "before")

    def out(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        own, node, root, sizes, places = (np.array(x, np.int64) for x in list(zip(*rows))[:5])
        left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
        i = j = np.zeros(0, np.int64)
        if len(left) and len(right) and (root != root[0]).any():
            i, j = possible(sizes, places, [r[5] for r in rows], root[left][:, None] != root[right][None, :], left, right, similarity)
            i, j = left[i], right[j]
            met = {k: frozenset(rows[k][6]) for k in np.union1d(i, j).tolist()}
            new = np.array([met[a].isdisjoint(met[b]) for a, b in zip(i.tolist(), j.tolist())], bool)
            i, j = i[new], j[new]
        u, v = node[i], node[j]
        both = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

    key, held = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("token", "low", "high")))
        for k, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in names))):
            if k != key:
                if len(held) > 1:
                    yield out(key, held)
                key, held = k, []
            held.append(row)
    if len(held) > 1:
        yield out(key, held)
    release()


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token those whose token is not theirs alone."""
    held, before = None, None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token = batch.column("token").to_numpy()
        same = token[1:] == token[:-1]
        keep = np.concatenate(([before is not None and token[0] == before], same)) | np.concatenate((same, [False]))
        yield batch.slice(0, len(batch) - 1).filter(pa.array(keep[:-1]))
        held = batch.slice(len(batch) - 1)
        before = token[-2] if len(token) > 1 else before
    if held is not None and held.column("token")[0].as_py() == before:
        yield held
    release()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """k1, k2 (the text's hashes), first (smallest id with that text) and root (the group's), of each distinct text; a written table."""
    spark = df.sparkSession
    bounded_arrow(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            sizes, firsts, marks = [], [], []
            for text in text_array(batch.column("text")).to_pylist():
                s = shingle_set(text, size)
                sizes.append(len(s))
                firsts.append(packed(prefix(s, similarity)))
                marks.append(parities(s))
            made = [pa.array(sizes, pa.int64()), pa.array(firsts, pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("id"), *made], names=["k1", "k2", "id", "size", "prefix", "marks"])

    settle(spark)
    kind = df.schema[id_col].dataType.simpleString()
    signed = texts.select("k1", "k2", "id", "text").mapInArrow(sign, f"k1 long, k2 long, id {kind}, size long, prefix binary, marks binary")
    nodes = signed.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("marks").alias("marks"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                firsts, node, sizes = some.column("prefix").to_pylist(), some.column("node").to_numpy(), some.column("size").to_numpy()
                times = np.array([len(x) // WIDTH for x in firsts])
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(b"".join(firsts))), pa.array(np.repeat(node, times)), pa.array(np.repeat(sizes * PLACES, times) + place)], names=["token", "node", "at"])

    replicas = nodes.select("node", "size", "prefix").mapInArrow(spread, "token long, node long, at long")
    met = materialise(replicas.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(shared, replicas.schema), "met")
    one = F.struct("node", "at")
    meetings = met.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("met"), "node")).alias("x2"), F.min(one).alias("least"), F.max(one).alias("most"))
    meetings = meetings.groupBy("n", "x1", "x2").agg(F.min(F.struct("token", "least", "most")).alias("m"))
    meetings = materialise(meetings.select("m.token", "n", "m.least", "m.most"), "meetings")
    met = materialise(join_sized(met, meetings, ["token"], "inner"), "meet")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            sets = [packed(shingle_set(t, size)) for t in text_array(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "s"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("su").to_pylist(), batch.column("sv").to_pylist()):
                x, y = unpacked(x), unpacked(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column("nu").to_numpy() + batch.column("nv").to_numpy()
            apart = []
            for x, y in zip(batch.column("su").to_pylist(), batch.column("sv").to_pylist()):
                words = min(len(x), len(y)) // 8
                apart.append(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()))
            yield batch.select(["u", "v"]).filter(pa.array(np.array(apart, np.int64) <= room(both, similarity)))

    def alike(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        asked = materialise(nodes.select("k1", "k2", "node").join(ends, "node"), "asked")
        sets = join_sized(texts.select("k1", "k2", "text"), asked, ["k1", "k2"], "inner").select("node", "text").mapInArrow(shingle, "node long, s binary")
        sets = materialise(sets.groupBy("node").agg(F.first("s").alias("s")), "sets")
        both = pairs.join(sets.withColumnRenamed("node", "u").withColumnRenamed("s", "su"), "u").join(sets.withColumnRenamed("node", "v").withColumnRenamed("s", "sv"), "v")
        return materialise(both.select("u", "v", "su", "sv").mapInArrow(decide, "u long, v long"), "links")

    def allowed(other: Column) -> Column:
        a, b = (F.floor(x / F.lit(PLACES)) for x in (F.col("at"), other))
        left = F.least(*(n - F.pmod(x, F.lit(PLACES)) for n, x in ((a, F.col("at")), (b, other))))
        return (F.least(a, b) >= similarity * F.greatest(a, b) - _LITTLE) & (left >= similarity * (a + b) / (1 + similarity) - _LITTLE)

    near = [met.where((F.col("node") != F.col(f"{c}.node")) & allowed(F.col(f"{c}.at"))).select(F.least("node", f"{c}.node").alias("u"), F.greatest("node", f"{c}.node").alias("v")) for c in ("least", "most")]
    near = near[0].unionByName(near[1]).distinct()
    for c in "uv":
        near = near.join(nodes.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("marks").alias(f"s{c}")), c)
    links = alike(materialise(near.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(prune, "u long, v long"), "pairs"))
    roots = materialise(components(links), "roots")
    left = met.where((F.col("n") > 3) & (F.col("node") != F.col("least.node")) & (F.col("node") != F.col("most.node")))
    left = materialise(join_sized(left.select("token", "n", "node", "at"), roots, ["node"], "left").withColumn("root", F.coalesce("root", "node")), "left")
    open_ = materialise(left.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("token"), "open")
    if open_.limit(1).count():
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = join_sized(left, open_, ["token"], "left_semi")
        order = Window.partitionBy("node").orderBy("token")
        dealt = dealt.withColumn("nth", F.row_number().over(order)).withColumn("before", F.collect_list(F.when(F.col("nth") <= EARLY, F.col("token"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        dealt = dealt.join(nodes.select("node", "marks"), "node")
        dealt = dealt.withColumn("size", F.floor(F.col("at") / PLACES)).withColumn("place", F.pmod("at", F.lit(PLACES)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        dealt = dealt.select("token", "low", "high", "own", "node", "root", "size", "place", "marks", "before").repartition(parts, "token", "low", "high").sortWithinPartitions("token", "low", "high")
        more = materialise(dealt.mapInArrow(lambda it: across(it, similarity), "u long, v long").distinct(), "across")
        roots = components(links.unionByName(alike(more)))
    return materialise(nodes.select("k1", "k2", "first", "node").join(roots, "node", "left").select("k1", "k2", "first", F.coalesce("root", "node").alias("root")), "groups")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df that stay: one of each group."""
    return one_of_each(df, id_col, text_col, lambda rows, i, t: groups(rows, i, t, size, similarity))
