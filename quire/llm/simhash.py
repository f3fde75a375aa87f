"""SimHash near-dedup with anchor-point covering.

The 64 bits of a fingerprint are covered by a product of perfect codes: two Golay codes of 23 bits
(covering radius 3), a Hamming code of 15 bits (radius 1) and 3 bits as they are (radius 0). Two
fingerprints at distance 2 or less have a point between them at distance 1 or less from both, and
the anchor of that point lies, part by part, within the covering radius of both but for at most one
part in which it may be one further. So each fingerprint is replicated to the anchors within the
covering radius plus half the threshold, some twenty of 2^38, and fingerprints are compared only at
an anchor that they share. Anchors that more than BUCKET fingerprints share are compared in another
exact way: fingerprints within 1 of a common point are linked to the smallest of them.

Equal fingerprints are one node, so exact copies cost nothing. A null text is an empty one, with
fingerprint zero. A component's id is the smallest document id in it; rows without an id do not
count for that, and get null if their component has none. No rows give no rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, materialise, text_array, text_batches
from .components import components
from .copies import keyed, one_of_each

BUCKET = 256
#: Fixed by the codes: generator polynomials of the Golay code of length 23 and the Hamming code of length 15.
GOLAY, HAMMING = 0xAE3, 0x13


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of size words, repeats included; of all words if there are fewer."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(size)))), repeat(42)), np.uint64, len(w) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """id_col and fp (the fingerprint as a signed long)."""
    bounded_arrow(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            made = np.array([fingerprint(shingle_hashes(t, size)) for t in text_array(batch.column("text")).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made.view(np.int64))], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


class Cover:
    """Codewords of a perfect code within its radius, and those one further."""

    def __init__(self, bits: int, poly: int, radius: int):
        self.check = poly.bit_length() - 1
        single = []
        for i in range(bits):
            v = 1 << i
            while v.bit_length() > self.check:
                v ^= poly << (v.bit_length() - poly.bit_length())
            single.append(v)
        self.low = self._sums(single[: bits // 2])
        self.high = self._sums(single[bits // 2 :])
        self.half, self.bits = bits // 2, bits
        near = [0] * (1 << self.check)
        far: list[list[int]] = [[] for _ in near]
        for weight in range(radius + 2):
            for places in combinations(range(bits), weight):
                s = e = 0
                for i in places:
                    s ^= single[i]
                    e |= 1 << i
                if weight <= radius:
                    near[s] = e
                else:
                    far[s].append(e)
        self.near = np.array(near, np.uint64)
        self.sizes = np.array([len(x) for x in far])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.far = np.array([e for x in far for e in x], np.uint64)

    @staticmethod
    def _sums(single: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for v in single:
            out = np.concatenate((out, out ^ v))
        return out

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codeword within the radius; those one further, and which word each belongs to."""
        s = self.low[(words & np.uint64((1 << self.half) - 1)).astype(np.int64)] ^ self.high[(words >> np.uint64(self.half)).astype(np.int64)]
        n = self.sizes[s]
        who = np.repeat(np.arange(len(words)), n)
        at = np.repeat(self.first[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return words ^ self.near[s], words[who] ^ self.far[at], who


_parts: list[tuple[int, Cover]] = []


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors of the fingerprints, and the place of the fingerprint each belongs to."""
    if not _parts:
        golay = Cover(23, GOLAY, 3)
        _parts.extend([(0, golay), (23, golay), (46, Cover(15, HAMMING, 1))])
    home = fps & np.uint64(7 << 61)
    moved, whose = [], []
    for shift, cover in _parts:
        near, far, who = cover.anchors((fps >> np.uint64(shift)) & np.uint64((1 << cover.bits) - 1))
        home = home | near << np.uint64(shift)
        moved.append((far ^ near[who]) << np.uint64(shift))
        whose.append(who)
    for bit in (61, 62, 63):
        moved.append(np.full(len(fps), 1 << bit, np.uint64))
        whose.append(np.arange(len(fps)))
    who = np.concatenate(whose)
    return np.concatenate((home, home[who] ^ np.concatenate(moved))), np.concatenate((np.arange(len(fps)), who))


def replicas(nodes: DataFrame) -> DataFrame:
    """anchor and fp for each distinct fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            at, who = anchors(fps)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fps[who].view(np.int64))], names=["anchor", "fp"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long")


def _forest(fps: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that join something new."""
    up = list(range(len(fps)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    kept = []
    for i, j in pairs:
        a, b = top(i), top(j)
        if a != b:
            up[a] = b
            kept.append((i, j))
    return kept


def compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links of the fingerprints that share an anchor; rows come sorted by anchor."""

    def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        sizes = np.diff(np.append(first, len(anchor)))
        a, b = [], []
        for k in range(1, int(sizes.max(initial=1))):
            i = np.flatnonzero(anchor[:-k] == anchor[k:])
            i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= threshold]
            a.append(i)
            b.append(i + k)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if len(i) > 4 * len(first):  # dense: keep what connects
            i, j = (np.array(x, np.int64) for x in zip(*_forest(fp, list(zip(i.tolist(), j.tolist())))))
        return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], names=["u", "v"])

    held_a, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        held_a = np.concatenate((held_a, batch.column("anchor").to_numpy()))
        held_f = np.concatenate((held_f, batch.column("fp").to_numpy().view(np.uint64)))
        if len(held_a):
            done = int(np.searchsorted(held_a, held_a[-1]))
            yield links(held_a[:done], held_f[:done])
            held_a, held_f = held_a[done:], held_f[done:]
    yield links(held_a, held_f)


def links(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """u and v: fingerprints at distance threshold (2 or less) that connect all such pairs; nodes: distinct fp, a written table."""
    if not 0 <= threshold <= 2:
        raise ValueError("the cover is laid out for a threshold of at most 2")
    spark = nodes.sparkSession
    bounded_arrow(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = replicas(nodes)
    shared = spread.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(spread.join(shared, "anchor"), "met")
    near = met.where(F.col("n") <= BUCKET).repartition(parts, "anchor").sortWithinPartitions("anchor", "fp").select("anchor", "fp").mapInArrow(lambda it: compare(it, threshold), "u long, v long")
    if threshold == 2:
        point = F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))
        points = met.where(F.col("n") > BUCKET).select("fp").distinct().select("fp", point.alias("point"))
        least = points.groupBy("point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
        near = near.unionByName(points.join(least, "point").where("fp != v").select(F.col("fp").alias("u"), "v").distinct())
    elif met.where(F.col("n") > BUCKET).limit(1).count():
        raise ValueError("an anchor is shared by too many fingerprints for this threshold")
    return near


def near_groups(prints: DataFrame, id_col: str = "doc_id", threshold: int = 2) -> DataFrame:
    """id_col, fp and component_id for each row of prints, a written table."""
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    roots = components(links(nodes, threshold))
    own = roots.withColumnRenamed("node", "fp").join(nodes, "fp")
    smallest = own.groupBy("root").agg(F.min("first").alias("component"))
    linked = own.join(smallest, "root").select("fp", "component")
    names = materialise(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")), "names")
    return prints.join(names, "fp")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: int = 2) -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits) and component_id of each row."""
    prints = materialise(fingerprints(df, id_col, text_col, size), "prints")
    return near_groups(prints, id_col, threshold).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: int = 2) -> DataFrame:
    """k1, k2 (the text's hashes), first (smallest id with that text) and root (the component's) of each distinct text."""
    bounded_arrow(df.sparkSession)
    texts = keyed(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text").select("k1", "k2", "id", "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            made = np.array([fingerprint(shingle_hashes(t, size)) for t in text_array(batch.column("text")).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("id"), pa.array(made.view(np.int64))], names=["k1", "k2", "id", "fp"])

    signed = texts.mapInArrow(sign, f"k1 long, k2 long, id {df.schema[id_col].dataType.simpleString()}, fp long")
    distinct = materialise(signed.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.min("fp").alias("fp")), "texts")
    roots = components(links(materialise(distinct.select("fp").distinct(), "nodes"), threshold)).withColumnRenamed("node", "fp")
    return materialise(distinct.join(roots, "fp", "left").select("k1", "k2", "first", F.coalesce("root", "fp").alias("root")), "groups")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: int = 2) -> DataFrame:
    """The rows of df that stay: one of each component. Columns of any name are kept."""
    return one_of_each(df, id_col, text_col, lambda rows, i, t: text_groups(rows, i, t, size, threshold))
