"""Removal of passages that occur elsewhere, by bucket-pointer refinement of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts at another place, in the same
text or another. Suffixes are not all dealt out. In each string of LENGTH bytes one gram of GRAM
bytes is chosen by its hash, the first of the smallest: equal strings choose the same, so they meet
in the bucket of that gram. The strings that chose one place lie in a row and make a span.

Buckets with one place are done. Equal spans (hash of 64 bits within a gram's bucket, whose key is
another 64 bits) are counted; what is in such spans is repeated as a whole. Where a bucket holds
different spans, one of each kind goes to the bucket's task, which refines buckets of 8-grams by
sorting on the bucket identifiers of later offsets, to 16, 32, 64, 128 and LENGTH bytes; only buckets
with more than one member are refined further. A bucket of more than GROUP kinds is not gathered: the
strings themselves are counted, by 128 bits of hash, with sums before the shuffle.

A null text is empty. Texts are told apart by 128 bits of hash, so that repeated texts, which lose
all from LENGTH bytes on, share their work; ids may be null or repeat. Matches never cross texts.
Very long texts are read in overlapping parts. No rows give no rows; other columns are kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, join_sized, materialise, settle, text_array, text_batches

LENGTH = 200
GRAM = 48
GROUP = 8192
PART = 1 << 20
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _STEPS[0]
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the size bytes from each place on, put together from those of powers of two."""
    level, span, out, done = _BYTES[data], 1, None, 0
    step = 0
    while True:
        if size & span:
            if out is None:
                out = level
            else:
                n = len(level) - done
                out = _mix(out[:n] * _STEPS[-1] + level[done:])
            done += span
        if done == size:
            return out[: len(data) - size + 1]
        level = _mix(level[: len(level) - span] * _STEPS[step] + level[span:])
        span *= 2
        step += 1


def spans(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each chosen place of texts that lie one after the other: first and last string that chose it, the place, its gram's hash.

    ends: where each text ends. A place next to a text's border may have more than one row."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(key) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max)
    full[: len(key)] = key
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    chosen = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.zeros(len(data) + 1, np.int64)
    np.add.at(text, ends[ends <= len(data)], 1)
    text = np.cumsum(text)[: len(data)]
    valid = text[:n] == text[length - 1 : length - 1 + n]
    same = np.zeros(n, bool)
    same[1:] = (chosen[1:] == chosen[:-1]) & valid[:-1] & valid[1:] & (text[1:n] == text[: n - 1])
    first = np.flatnonzero(valid & ~same)
    last = np.flatnonzero(valid & ~np.append(same[1:], False))
    return first, last, chosen[first], h[chosen[first]]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Bytes of texts one after the other, their ends, and (row, place in its text) of each; long texts in overlapping parts."""
    texts = [t.encode() for t in text_array(batch.column("text")).to_pylist()]
    if sum(map(len, texts)) <= PART:
        yield np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), [(i, 0) for i in range(len(texts))]
        return
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PART - LENGTH + 1):
            some = t[at : at + PART]
            yield np.frombuffer(some, np.uint8), np.array([len(some)]), [(i, at)]


def chosen_spans(texts: DataFrame) -> DataFrame:
    """texts: k1, k2, text. A row for each span: k1, k2, lo (first string), more (strings after it), gram and content hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", PART):
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for data, ends, rows in _parts(batch):
                first, last, place, gram = spans(data, ends)
                raw = memoryview(data)
                content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : b + LENGTH], d) for a, b, d in zip(first.tolist(), last.tolist(), (place - first).tolist())), np.uint64, len(first))
                which = np.searchsorted(ends, first, "right")
                row = np.array([r for r, _ in rows], np.int64)[which] if len(which) else which
                shift = np.array([s for _, s in rows], np.int64) - np.concatenate(([0], ends[:-1]))
                lo = first + shift[which] if len(which) else first
                yield pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(lo), pa.array((last - first).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(content.view(np.int64))], names=["k1", "k2", "lo", "more", "gram", "content"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, lo long, more int, gram long, content long")


def repeated_strings(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the string of length bytes from each start on begins at another start too, by bucket-pointer refinement."""
    if not len(starts):
        return np.zeros(0, bool)
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8))).astype(np.uint64)
    n = len(data)
    code = padded[: n + length]
    for k in range(1, 8):
        code = (code << np.uint64(8)) | padded[k : k + n + length]
    bucket = np.unique(code, return_inverse=True)[1].astype(np.int64)
    size = 8
    while 2 * size <= length:
        bucket = _refine(bucket, np.concatenate((bucket[size:], np.full(size, -1, np.int64))))
        size *= 2
    _, where, count = np.unique(np.stack((bucket[starts], bucket[starts + length - size])), axis=1, return_inverse=True, return_counts=True)
    return count[where.ravel()] > 1


def _refine(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Buckets by (own, later) identifiers; a bucket of one stays as it is."""
    many = np.bincount(bucket)[bucket] > 1
    out = np.empty_like(bucket)
    at = np.flatnonzero(many)
    found, inverse = np.unique(bucket[at] * np.int64(len(bucket) + 1) + later[at] + 1, return_inverse=True)
    out[at] = inverse
    out[~many] = len(found) + np.arange(len(bucket) - len(at))
    return out


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of kinds of spans, sorted by gram: the repeated parts of the kinds that occur once."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        begin = np.cumsum([0] + [len(r[5]) for r in rows])[:-1]
        counts = np.array([len(r[5]) - LENGTH + 1 for r in rows])
        edge = np.cumsum(counts) - counts
        starts = np.repeat(begin - edge, counts) + np.arange(counts.sum())
        hit = repeated_strings(data, starts)
        out = []
        for (_, k1, k2, lo, n, _), e, c in zip(rows, edge, counts):
            if n == 1:
                out += [(k1, k2, lo + a, lo + b + LENGTH) for a, b in _runs(hit[e : e + c])]
        return pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in (zip(*out) if out else [[]] * 4)], names=["k1", "k2", "start", "end"])

    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "k1", "k2", "lo", "n", "bytes"))):
            if held > 1 << 20 and row[0] != rows[-1][0]:
                yield done(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[5])
    if rows:
        yield done(rows)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of each kind, by hash."""
    for batch in batches:
        for k1, k2, lo, n, raw in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "lo", "n", "bytes"))):
            view, count = memoryview(raw), len(raw) - LENGTH + 1
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i : i + LENGTH]) for i in range(count)), np.int64).reshape(-1, 2)
            full = lambda v: pa.array(np.full(count, v, np.int64))  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), full(k1), full(k2), pa.array(lo + np.arange(count)), full(n)], names=["w1", "w2", "k1", "k2", "start", "n"])


def keyed(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit(LENGTH), text))


def repeats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """k1, k2 (the text's hashes), starts and ends of its repeated runs of bytes."""
    spark = df.sparkSession
    bounded_arrow(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(df.select(F.col(text_col).cast("string").alias("text")), "text").where("octet_length(text) >= %d" % LENGTH)
    settle(spark)
    found = materialise(chosen_spans(texts), "spans")
    grams = materialise(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")  # written, so that a hot gram's side of the join can be split
    shared = materialise(found.join(grams, "gram", "left_semi"), "shared")
    kinds = materialise(shared.groupBy("gram", "content").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "more")).alias("one")), "kinds")
    whole = materialise(kinds.where("n > 1").select("gram", "content"), "whole")
    sure = shared.join(whole, ["gram", "content"], "left_semi").select("k1", "k2", F.col("lo").alias("start"), (F.col("lo") + F.col("more") + LENGTH).alias("end"))
    open_ = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("gram", "kinds")
    asked = kinds.join(open_, "gram").select("gram", "content", "kinds", "n", "one.*")
    lists = materialise(asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "content", "kinds", "n", "lo", "more")).alias("asked")), "asked")  # a text's own spans
    places = F.explode("asked").alias("a")
    cut = join_sized(texts.withColumn("raw", F.encode("text", "UTF-8")).drop("text"), lists, ["k1", "k2"], "inner").select("k1", "k2", "raw", places)
    cut = cut.select("k1", "k2", "a.*", F.expr(f"substring(raw, cast(a.lo + 1 as int), a.more + {LENGTH})").alias("bytes")).drop("more")
    cut = materialise(cut.groupBy("gram", "content").agg(*[F.first(c).alias(c) for c in ("k1", "k2", "lo", "n", "kinds", "bytes")]), "contexts")
    settle(spark)
    near = cut.where(F.col("kinds") <= GROUP).repartition(parts, "gram").sortWithinPartitions("gram").select("gram", "k1", "k2", "lo", "n", "bytes").mapInArrow(_refined, "k1 long, k2 long, start long, end long")
    strings = materialise(cut.where(F.col("kinds") > GROUP).select("k1", "k2", "lo", "n", "bytes").mapInArrow(_strings, "w1 long, w2 long, k1 long, k2 long, start long, n long"), "strings")
    again = strings.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2")
    many = strings.where("n = 1").join(again, ["w1", "w2"], "left_semi").select("k1", "k2", "start", (F.col("start") + LENGTH).alias("end"))
    pieces = sure.unionByName(near).unionByName(many).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for runs in batch.column("runs").to_pylist():
                s, e = [], []
                for r in runs:
                    if e and r["start"] <= e[-1]:
                        e[-1] = max(e[-1], r["end"])
                    else:
                        s.append(r["start"])
                        e.append(r["end"])
                starts.append(s)
                ends.append(e)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["k1", "k2", "starts", "ends"])

    return pieces.mapInArrow(merge, "k1 long, k2 long, starts array<long>, ends array<long>")


def with_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with starts and ends of the repeated runs of bytes of each text; null where there are none. df has no columns k1, k2, starts and ends."""
    found = materialise(repeats(df, text_col), "repeats")
    return join_sized(keyed(df, text_col), found, ["k1", "k2"], "left").drop("k1", "k2")


def kept(raw: bytes, starts: list[int] | None, ends: list[int] | None) -> bytes:
    """What is left without the runs."""
    if not starts:
        return raw
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)]))


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and the digest of what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [t.encode() for t in text_array(batch.column("text")).to_pylist()]
            starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
            left = [kept(*x) for x in zip(raws, starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(list(map(len, raws)), pa.int64()), pa.array([len(a) - len(b) for a, b in zip(raws, left)], pa.int64()), pa.array([len(s or []) for s in starts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = with_runs(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text")
    return rows.select("id", "text", "starts", "ends").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the repeated runs taken out of its texts; what is left of a character that was cut through goes too."""
    columns = df.columns
    names = [f"c{i}" for i in range(len(columns))]
    at = columns.index(text_col)
    rows = df.toDF(*names)
    rows = with_runs(rows.withColumn(names[at], F.coalesce(F.col(names[at]).cast("string"), F.lit(""))), names[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names[at]).to_pylist()
            left = [t if not s else kept(t.encode(), s, e).decode("utf-8", "ignore") for t, s, e in zip(texts, batch.column("starts").to_pylist(), batch.column("ends").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()) if n == names[at] else batch.column(n) for n in names], names=names)

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, "starts", "ends").mapInArrow(run, schema).toDF(*columns)
