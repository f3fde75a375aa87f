"""WARC archives written from pages, read back, and indexed by an external merge.

Each task writes its pages, sorted by URL key and time, as one archive of records compressed one by
one: a sorted capture run. Reading an archive gives its entries in that order, which are written as an
index run in the shared folder, RUN_ROWS entries a block (where the order breaks, a new run begins).
The merge is external: while there are more than FAN runs, each FAN of them are merged to one, by ranges of
URL key, time and page, so that no task takes a long run alone; the last merge gives the result, ordered over
all partitions: capture histories. A range streams the blocks that reach into it through a loser tree, a block
of each run at a time. Ranges are so wide that a run has two blocks or more in each on average: a block is
read about one and a half times a pass at most, at any number of runs. A bounded sample of blocks says where
ranges begin, which matters for balance alone.

A null html is empty, a null url an empty key. Of pages with equal payloads the one with the
smallest page_id is the response; repeated rows with just that page_id are responses too, and rows
without a page_id are revisits where any row of the group has one, else responses. No rows give no
rows. Very long texts are one record each, read whole. Other columns are not read, whatever their names."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import accumulate, groupby, islice
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_arrow, join_sized, materialise, open_shared, scratch

FIRST_CAPTURE = datetime(2020, 1, 1, tzinfo=UTC)
INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured_at string, run int, place long"
#: Characters of addresses that go into a header as they are; the percent sign is not one, so that quoting can be undone.
URL_SAFE = ":/?#[]@!$&'()*+,;=-._~"
#: Entries of a block of an index run, of a range (about), and runs that are merged at once.
RUN_ROWS, RANGE_ROWS, FAN = 512, 200_000, 64
#: Blocks that are looked at to choose where ranges begin.
SAMPLE = 2000


def url_key(url: F.Column) -> F.Column:
    """Host names reversed, then the rest of the address: com,example,www)/path."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(lower, r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1)
    rest = F.regexp_replace(lower, r"^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def record(page_id: int | None, url: str | None, time: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; first: the response that a revisit stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {time}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URL_SAFE)}")
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + payload if first is None else http
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _members(path: str) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    with open_shared(path) as f:
        held, unzip, parts = b"", zlib.decompressobj(31), []
        while True:
            held = held or f.read(1 << 20)
            if not held:
                if parts:
                    raise ValueError(f"{path} ends within a record")
                return
            parts.append(unzip.decompress(held))
            held = unzip.unused_data
            if unzip.eof:
                yield b"".join(parts)
                unzip, parts = zlib.decompressobj(31), []


def parse(raw: bytes) -> dict:
    """What a record says, checked against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    said = dict(x.split(": ", 1) for x in lines)
    http, _, payload = rest[: int(said["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = said["WARC-Payload-Digest"].removeprefix("sha1:")
    if said["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{said['WARC-Record-ID']}: the payload does not fit its digest")
    page = lambda x: None if x is None or x == "<urn:page:None>" else int(x[10:-1])
    url = unquote(said["WARC-Target-URI"]) if "WARC-Target-URI" in said else None
    return {"page_id": page(said["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": said["WARC-Type"], "refers_to": page(said.get("WARC-Refers-To")), "url": url, "captured_at": said["WARC-Date"]}


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes one archive for each partition into the shared folder; their paths (run, path)."""
    spark = pages.sparkSession
    bounded_arrow(spark)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    first = materialise(rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first"), "first")
    rows = join_sized(rows, first, ["sha"], "left")
    again = (F.length("payload") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", F.when(again, F.col("first")).alias("first"), "sha", "payload", url_key(F.col("url")).alias("key")).sortWithinPartitions("key", "page_id")
    base = scratch(spark, "warc")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path, out = f"{base}/run-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", None
        try:
            for batch in batches:
                for x in batch.to_pylist():
                    out = out or open_shared(path, True)
                    time = (FIRST_CAPTURE + timedelta(seconds=(x["page_id"] or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                    zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = record(x["page_id"], x["url"], time, x["payload"], base64.b32encode(x["sha"]).decode(), x["first"])
                    out.write(zipped.compress(raw) + zipped.flush())
        finally:
            if out:
                out.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path])], names=["run", "path"])

    return materialise(rows.mapInArrow(run, "run int, path string"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """An entry for each record, by run and place in it."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("captured_at", pa.string()), ("run", pa.int32()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                held = []
                for place, raw in enumerate(_members(x["path"])):
                    held.append(parse(raw) | {"run": x["run"], "place": place})
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    n = max(1, archives.count())
    rows = archives.repartitionByRange(n, "run").mapInArrow(run, INDEX.replace("url_key string, ", ""))
    return rows.withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner plays on upwards."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._draw(i)
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i, True)

    def _draw(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if building and other < 0:
                self.losers[node] = i
                return
            if self._before(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.k:
            i = self.winner
            if self.heads[i] is None:
                return
            yield self.heads[i]
            self._draw(i)
            self._play(i)


def _key(x: dict) -> tuple:
    return x["url_key"], x["captured_at"], x["page_id"] is not None, x["page_id"] or 0


class _Runs:
    """Writes entries as index runs: sorted files of blocks. made: path, block, rows, first and last key of each."""

    def __init__(self, base: str, name: str, schema: pa.Schema, rows: int):
        self.base, self.name, self.schema, self.rows = base, name, schema, rows
        self.made: list[tuple] = []
        self.held: list[dict] = []
        self.files, self.out, self.writer, self.last = 0, None, None, None

    def add(self, x: dict) -> None:
        now = _key(x)
        if self.last is not None and now < self.last:
            self.close()
        if len(self.held) == self.rows:
            self._block()
        self.held.append(x)
        self.last = now

    def _block(self) -> None:
        if not self.held:
            return
        if self.writer is None:
            self.path, self.block = f"{self.base}/{self.name}-{self.files}.arrow", 0
            self.out = open_shared(self.path, True)
            self.writer = pa.ipc.new_file(self.out, self.schema)
            self.files += 1
        self.writer.write_batch(pa.RecordBatch.from_pylist(self.held, self.schema))
        self.made.append((self.path, self.block, len(self.held), *_key(self.held[0]), *_key(self.held[-1])))
        self.block += 1
        self.held = []

    def close(self) -> None:
        """Ends the run."""
        self._block()
        if self.writer is not None:
            self.writer.close()
            self.out.close()
            self.writer = None
        self.last = None


def _streamed(blocks: list[tuple[str, int]], low: tuple | None, high: tuple | None) -> Iterator[dict]:
    """A run's entries from low on and before high, a block at a time; its blocks may lie in several files."""
    for path, own in groupby(blocks, lambda b: b[0]):
        with open_shared(path) as f:
            held = pa.ipc.open_file(f)
            for _, block in own:
                for x in held.get_batch(block).to_pylist():
                    now = _key(x)
                    if (low is None or now >= low) and (high is None or now < high):
                        yield x


_KEY_NAMES = [f"{e}_{c}" for e in ("first", "last") for c in ("url", "at", "has", "page")]
_KEY_KINDS = [pa.string(), pa.string(), pa.bool_(), pa.int64()] * 2
_KEYS = ", ".join(f"{n} {k}" for n, k in zip(_KEY_NAMES, ["string", "string", "boolean", "long"] * 2))


class _Index:
    """Index runs in the shared folder, merged in passes. Blocks: run (numbered from 0), place in it, path, block, rows, first and last key."""

    def __init__(self, entries: DataFrame, run_rows: int, fan: int, log: list | None) -> None:
        self.spark, self.fan, self.run_rows, self.log = entries.sparkSession, fan, run_rows, log
        self.base = scratch(self.spark, "runs")
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
        self.kind, self.schema = entries.schema, to_arrow_schema(entries.schema)
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def written(self, entries: DataFrame) -> DataFrame:
        """Blocks of the entries' runs as they come: a run ends with its number, or where the order breaks."""
        base, schema, run_rows = self.base, self.schema, self.run_rows

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get()
            out = _Runs(base, f"run-{task.partitionId():06d}-{task.taskAttemptId()}", schema, run_rows)
            before = None
            for batch in batches:
                for x in batch.to_pylist():
                    if before is not None and x["run"] != before:
                        out.close()
                    before = x["run"]
                    out.add(x)
            out.close()
            if out.made:
                names = {path: i for i, path in enumerate(dict.fromkeys(m[0] for m in out.made))}
                columns = [[task.partitionId()] * len(out.made), [names[m[0]] for m in out.made], [m[1] for m in out.made], *map(list, zip(*out.made))]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), *_KEY_KINDS]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["part", "run", "place", "path", "block", "rows", *_KEY_NAMES])

        made = materialise(entries.mapInArrow(write, f"part int, run long, place long, path string, block int, rows long, {_KEYS}"), "blocks")
        counts = made.groupBy("part").agg((F.max("run") + 1).alias("n")).orderBy("part").collect()  # a row a task
        ends = list(accumulate((r["n"] for r in counts), initial=0))
        starts = self.spark.createDataFrame([(r["part"], e) for r, e in zip(counts, ends)], "part int, start long")
        return made.join(F.broadcast(starts), "part").withColumn("run", F.col("run") + F.col("start")).drop("part", "start")

    def ranges(self, blocks: DataFrame, groups: int, facts: dict) -> list[tuple]:
        """Keys at which ranges begin: as many ranges as balance asks for, but a run has two blocks in each on average, so that few blocks are read twice."""
        wanted = max(-(-self.parts // groups), -(-facts["rows"] // (groups * RANGE_ROWS)))
        n = max(1, min(wanted, facts["blocks"] // (2 * max(1, facts["runs"]))))
        seen = sorted(tuple(r) for r in blocks.orderBy(F.xxhash64("path", "block")).limit(SAMPLE + 4 * n).select(*_KEY_NAMES[:4]).collect())
        return sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []

    def dealt(self, blocks: DataFrame, edges: list[tuple], fan: int) -> DataFrame:
        """range, group, run, place, path and block: a row for each block and range that it reaches into."""

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for x in batch.to_pylist():
                    first, last = (bisect_right(edges, tuple(x[f"{e}_{c}"] for c in ("url", "at", "has", "page"))) for e in ("first", "last"))
                    out += [(r, x["run"] // fan, x["run"], x["place"], x["path"], x["block"]) for r in range(first, last + 1)]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["range", "group", "run", "place", "path", "block"])

        return blocks.mapInArrow(reach, "range int, group long, run long, place long, path string, block int")

    def facts(self, blocks: DataFrame) -> dict:
        return blocks.agg((F.coalesce(F.max("run"), F.lit(-1)) + 1).alias("runs"), F.count("*").alias("blocks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first().asDict()

    def pass_(self, blocks: DataFrame, facts: dict, number: int) -> DataFrame:
        """Blocks after runs were merged to longer ones, fan to one; a run's ranges are merged by tasks of their own."""
        groups = -(-facts["runs"] // self.fan)
        edges = self.ranges(blocks, groups, facts)
        base, schema, run_rows = self.base, self.schema, self.run_rows

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            attempt = TaskContext.get().taskAttemptId()
            for (group, r), merged in _merged(batches, edges):
                out = _Runs(base, f"pass-{number}-{group}-{r}-{attempt}", schema, run_rows)
                for x in merged:
                    out.add(x)
                out.close()
                columns = [[group] * len(out.made), [(r << 32) + i for i in range(len(out.made))], *map(list, zip(*out.made))]
                if out.made:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), *_KEY_KINDS))], names=["run", "place", "path", "block", "rows", *_KEY_NAMES])

        rows = self._counted(self.dealt(blocks, edges, self.fan), facts)
        n = max(self.parts, min(groups * (len(edges) + 1), 100_000))
        rows = rows.repartition(n, "group", "range").sortWithinPartitions("group", "range", "run", "place")
        return materialise(rows.mapInArrow(merge, f"run long, place long, path string, block int, rows long, {_KEYS}"), "blocks")

    def _counted(self, rows: DataFrame, facts: dict) -> DataFrame:
        if self.log is not None:
            self.log.append(facts | {"reads": rows.count()})
        return rows

    def merged(self, blocks: DataFrame) -> DataFrame:
        """All entries in order over the partitions."""
        facts, number = self.facts(blocks), 0
        while facts["runs"] > self.fan:
            blocks, number = self.pass_(blocks, facts, number), number + 1
            facts = self.facts(blocks)
        edges, schema = self.ranges(blocks, 1, facts), self.schema

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, entries in _merged(batches, edges):
                while part := list(islice(entries, 10_000)):
                    yield pa.RecordBatch.from_pylist(part, schema)

        rows = self._counted(self.dealt(blocks, edges, self.fan), facts)
        return rows.repartitionByRange(len(edges) + 1, "range").sortWithinPartitions("range", "run", "place").mapInArrow(merge, self.kind)


def _merged(batches: Iterator[pa.RecordBatch], edges: list[tuple]) -> Iterator[tuple[tuple[int, int], Iterator[dict]]]:
    """Group and range with their entries in order; a run's blocks come by place."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("group", "range", "run", "path", "block"))))
    for (group, r), own in groupby(rows, lambda x: x[:2]):
        runs: dict[int, list[tuple[str, int]]] = {}
        for _, _, run, path, block in own:
            runs.setdefault(run, []).append((path, block))
        low, high = edges[r - 1] if r else None, edges[r] if r < len(edges) else None
        yield (group, r), iter(LoserTree([_streamed(b, low, high) for b in runs.values()], _key))


def merge_index(entries: DataFrame, run_rows: int = RUN_ROWS, fan: int = FAN, log: list | None = None) -> DataFrame:
    """All entries ordered by URL key, time and page over the partitions, from their sorted runs (rows come by run and place).

    log: gets the runs, blocks and rows of each pass, and the block reads that it makes."""
    index = _Index(entries, run_rows, fan, log)
    return index.merged(index.written(entries))


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages as WARC archives and back: the merged index of what the archives hold."""
    return merge_index(read_archives(write_archives(pages, min_bytes)))
