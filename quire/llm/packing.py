"""Packing token sequences by cutting-stock column generation.

Documents are cut into full sequences and a rest. The histogram of rests is a cutting-stock problem:
a linear program over patterns of lengths, whose columns are priced by knapsack dynamic programming
with the program's duals. Its rounded patterns, and a first-fit plan for what rounding leaves, say how
many rests of each length stand together; ranked rests take their places by arithmetic on their rank.
Rests in patterns that would waste more than WASTE of a sequence are cut at powers of two instead,
which fill sequences without a gap; the last of these are sequences of powers of two.

Only the histogram (one number for each length) and the plan are on the driver: their size does not
follow the input. A null text is empty: its document is the closing id alone. Repeated rows and ids
are packed each. Very long texts are encoded whole. No rows give no rows; other columns aren't read."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_arrow, fits, materialise, settle, text_array, text_batches
from .pieces import Memory, chunks, gather

LENGTH = 2048
UNIT = 16
WASTE = 0.02
POWERS = [1 << k for k in range(LENGTH.bit_length() - 2, -1, -1)]


def knapsack(values: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The best pattern: values[i] is worth of an item of size i + 1, any number of each."""
    best = np.zeros(room + 1)
    take = np.zeros(room + 1, np.int32)
    for c in range(1, room + 1):
        worth = values[:c] + best[c - 1 :: -1][:c]
        i = worth.argmax()
        if worth[i] > best[c - 1]:
            best[c], take[c] = worth[i], i + 1
        else:
            best[c] = best[c - 1]
    pattern: dict[int, int] = {}
    c = room
    while c:
        if take[c]:
            pattern[int(take[c])] = pattern.get(int(take[c]), 0) + 1
            c -= int(take[c])
        else:
            c -= 1
    return float(best[room]), pattern


def cutting_stock(demand: dict[int, int], room: int, gap: float = 1e-3, most: int = 5000) -> list[tuple[dict[int, int], int]]:
    """Patterns (size: number) and how often each is used, covering demand (size: number) exactly."""
    sizes = sorted(s for s, n in demand.items() if n > 0)
    if not sizes:
        return []
    m, row = len(sizes), {s: i for i, s in enumerate(sizes)}
    need = np.array([demand[s] for s in sizes], float)
    patterns: list[dict[int, int]] = [{s: room // s} for s in sizes]
    inverse = np.diag([1.0 / (room // s) for s in sizes])
    x = inverse @ need
    bound = 0.0
    for step in range(most):
        if step % 200 == 199:  # against drift
            basis = np.zeros((m, m))
            for j, p in enumerate(patterns):
                for s, a in p.items():
                    basis[row[s], j] = a
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ need, 0)
        dual = inverse.sum(axis=0)
        values = np.zeros(room)
        values[[s - 1 for s in sizes]] = dual
        worth, pattern = knapsack(values, room)
        bound = max(bound, x.sum() / worth)  # the duals divided by the best worth are feasible
        if worth <= 1 + 1e-9 or x.sum() - bound <= gap * x.sum():
            break
        column = np.zeros(m)
        for s, a in pattern.items():
            column[row[s]] = a
        direction = inverse @ column
        up = direction > 1e-9
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        inverse[out] /= direction[out]
        rest = np.arange(m) != out
        inverse[rest] -= np.outer(direction[rest], inverse[out])
        patterns[out] = pattern
    left = {s: int(demand[s]) for s in sizes}
    plan = []
    for p, often in sorted(zip(patterns, x), key=lambda t: -t[1]):
        n = min([int(often + 1e-6), *(left[s] // a for s, a in p.items())])
        if n > 0:
            plan.append((p, n))
            for s, a in p.items():
                left[s] -= a * n
    while any(left.values()):  # a pattern at a time, the largest first
        space, p = room, {}
        for s in reversed(sizes):
            if a := min(left[s], space // s):
                p[s] = a
                space -= a * s
        n = min(left[s] // a for s, a in p.items())
        plan.append((p, n))
        for s, a in p.items():
            left[s] -= a * n
    return plan


class Plan:
    """Places of ranked rests: which sequence, and where in it, for the r-th rest of a length."""

    def __init__(self, counts: np.ndarray, full: int):
        """counts: rests of each length from 0 to LENGTH - 1; full: sequences that are one piece."""
        self.room = LENGTH // UNIT
        self.bin = -(-np.arange(LENGTH) // UNIT)
        before = np.cumsum(counts) - counts
        first = np.searchsorted(self.bin, np.arange(self.room + 1))
        self.in_bin = before - before[np.minimum(first[self.bin], LENGTH - 1)]
        demand = {int(b): int(n) for b, n in enumerate(np.bincount(self.bin, counts, self.room + 1)) if b and n}
        good = [(p, n) for p, n in cutting_stock(demand, self.room) if (self.room - sum(s * a for s, a in p.items())) * UNIT <= WASTE * LENGTH]
        self.ranges: dict[int, tuple[list[int], list[int], list[int]]] = {b: ([0], [], []) for b in range(self.room + 1)}  # ends, first sequence, number in each
        at = full
        for p, n in good:
            for s, a in p.items():
                ends, firsts, each = self.ranges[s]
                ends.append(ends[-1] + a * n)
                firsts.append(at)
                each.append(a)
            at += n
        self.cut_base = at
        taken = np.array([self.ranges[b][0][-1] for b in range(self.room + 1)])
        self.whole = np.clip(taken[self.bin] - self.in_bin, 0, counts)  # rests of each length that stay whole
        self.cut = counts - self.whole
        self.cut[0] = 0
        self.part_rank: dict[int, np.ndarray] = {}
        self.part_base: dict[int, int] = {}
        offset = 0
        for s in POWERS:
            has = np.where(np.arange(LENGTH) & s, self.cut, 0)
            self.part_rank[s] = np.cumsum(has) - has
            self.part_base[s] = offset
            offset += int(has.sum()) * s
        self.last, self.over = divmod(offset, LENGTH)

    def rest(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, order in it) of each piece."""
        if rank < self.whole[length]:
            b = int(self.bin[length])
            r = int(self.in_bin[length]) + rank
            ends, firsts, each = self.ranges[b]
            k = int(np.searchsorted(ends, r, "right")) - 1
            place = r - ends[k]
            return [(0, length, firsts[k] + place // each[k], (self.room - b) * LENGTH + place % each[k])]
        pieces, start = [], 0
        for s in POWERS:
            if length & s:
                at = self.part_base[s] + (int(self.part_rank[s][length]) + rank - int(self.whole[length])) * s
                sequence, offset = divmod(at, LENGTH)
                if sequence == self.last:  # sequences of powers of two, the larger ones first
                    edge = 0
                    for k, p in enumerate(q for q in POWERS if self.over & q):
                        if offset < edge + p:
                            sequence, offset = sequence + k, offset - edge
                            break
                        edge += p
                pieces.append((start, s, self.cut_base + sequence, offset))
                start += s
        return pieces


class Encoder:
    """Ids by the tokenizers library, asked once for each piece of text that is new to the worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory(None)
        #: Strings that the library finds in a text before all else.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin. Texts that hold a special token's string are left whole to the library."""
        special = np.zeros(len(texts), bool)
        for content in self.added:
            special |= pc.match_substring(texts, content, ignore_case=True).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._plain(texts)
        ids, at = self._plain(pc.if_else(pa.array(special), "", texts))
        parts = [ids[a:b] for a, b in zip(at, at[1:])]
        for i in np.flatnonzero(special).tolist():
            parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = chunks(texts, lower=True, bare=True)
        if not cut.distinct:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        held = self.memory.many(cut.distinct, lambda new: [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)])
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids, ends = gather(np.frombuffer(b"".join(held), "<u4"), sizes, cut.codes)
        return ids, ends[cut.docs]


_encoders: dict[str, Encoder] = {}


def measured(df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its length, checksums of its full pieces, of its rest and of the rest's parts at powers of two, and its local ranks."""
    bounded_arrow(df.sparkSession)
    close = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        part, full, ranks = TaskContext.get().partitionId(), 0, np.zeros(LENGTH, np.int64)
        for batch in text_batches(batches, "text"):
            ids, at = _encoders[path].encode(text_array(batch.column("text")))
            rows = []
            for a, b in zip(at, at[1:]):
                raw = ids[a:b].astype("<u4").tobytes() + close
                n = len(raw) // 4
                whole, rest = divmod(n, LENGTH)
                crcs = [zlib.crc32(raw[i * LENGTH * 4 : (i + 1) * LENGTH * 4]) for i in range(whole)]
                tail, parts, i = raw[whole * LENGTH * 4 :], [], 0
                for s in POWERS:
                    if rest & s:
                        parts.append(zlib.crc32(tail[i * 4 : (i + s) * 4]))
                        i += s
                rows.append((n, crcs, rest, zlib.crc32(tail), parts, part, full, int(ranks[rest])))
                full += whole
                ranks[rest] += 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(v), k) for v, k in zip(zip(*rows), kinds))], names=[id_col, "doc_tokens", "full_crcs", "rest", "rest_crc", "part_crcs", "part", "full_rank", "rest_rank"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, doc_tokens long, full_crcs array<long>, rest int, rest_crc long, part_crcs array<long>, part int, full_rank long, rest_rank long")


def pack(df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    settle(df.sparkSession)
    docs = materialise(measured(df, path, end_id, id_col, text_col), "measured")
    local = docs.groupBy("part", "rest").agg(F.count("*").alias("n")).unionByName(docs.groupBy("part").agg(F.sum(F.size("full_crcs")).cast("long").alias("n")).withColumn("rest", F.lit(LENGTH)))
    ahead = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(local.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "bases")  # at most LENGTH + 1 rows for each partition of the input
    counts = np.zeros(LENGTH + 1, np.int64)
    for rest, n in bases.groupBy("rest").agg(F.sum("n")).collect():
        counts[rest] = n
    plan = Plan(counts[:LENGTH], int(counts[LENGTH]))
    few = fits(bases)
    for name, table in (("rest_base", bases.where(F.col("rest") < LENGTH).select("part", "rest", F.col("base").alias("rest_base"))), ("full_base", bases.where(F.col("rest") == LENGTH).select("part", F.col("base").alias("full_base")))):
        docs = docs.join(F.broadcast(table) if few else table, [c for c in table.columns if c != name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column("id").to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("doc_tokens", "full_crcs", "rest", "rest_crc", "part_crcs", "full_rank", "rest_rank", "full_base", "rest_base")]
            for i, n, crcs, rest, crc, parts, full, rank, full_base, rest_base in zip(ids, *columns):
                rows += [(i, k * LENGTH, LENGTH, c, n, full_base + full + k, 0) for k, c in enumerate(crcs)]
                if rest:
                    pieces = plan.rest(rest, rest_base + rank)
                    at = len(crcs) * LENGTH
                    uncut = len(pieces) == 1 and pieces[0][1] == rest
                    rows += [(i, at + start, size, crc if uncut else c, n, sequence, order) for (start, size, sequence, order), c in zip(pieces, parts)]
            kinds = [batch.schema.field("id").type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])

    kind = df.schema[id_col].dataType.simpleString()
    placed = docs.withColumnRenamed(id_col, "id").mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # at most LENGTH pieces
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("place")
