"""A page's artefacts in one pass: df.write.format("page_artefacts").mode("append").save(path).

Rows are pages: page, image (binary), page_json, html, css, review_json. Each row becomes five files. A task writes them under a folder of its own, with a
list of them beside them, and names that folder in its commit message. Only when all tasks have succeeded does the driver write one manifest of these folders,
move what their lists say, one list after the other, and remove it: a task that is killed, or runs twice, leaves no file in a page's place, and a driver that is lost between two moves leaves a manifest from
which recover() goes on. A null field leaves its file out.
With .option("packed", True) HTML and CSS, which repeat themselves, are kept as gzip, under their name and .gz: as servers send them; read() unpacks them.
With .option("listing", folder) the lists are kept there, a file a task, so that read() needs no list of all files on the driver. The driver holds a task's list at a time, and the names of tasks."""

from __future__ import annotations

import gzip
import json
import uuid
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import small_batches

#: Column and place of each artefact; pages count from 1 in names, but for the page's own JSON.
PLACES = {"image": "images/page-{n}.png", "page_json": "pages/{i}.json", "html": "review/page-{n}.html", "css": "review/style/page-{n}.css", "review_json": "review/page-{n}.json"}
PACKED = ("html", "css")
STAGED, MANIFESTS, LIST = "_staged", "_manifests", "pages.json"
#: Files that the driver moves at once.
MOVERS = 16
#: Files that a task of read() opens, and bytes of a batch of them.
AT_ONCE, BATCH_BYTES = 5_000, 1 << 20


@dataclass
class Written(WriterCommitMessage):
    attempt: str


def _place(column: str, page: int) -> str:
    """column: one of PLACES, with .gz behind it where its file is packed."""
    name, dot, suffix = column.partition(".")
    return PLACES[name].format(i=page, n=page + 1) + dot + suffix


def _folders() -> set[str]:
    return {p.rsplit("/", 1)[0] for p in PLACES.values()}


class Writer(DataSourceWriter):
    def __init__(self, path: str, packed: bool = False, listing: str | None = None) -> None:
        self.path, self.packed, self.listing, self.run = path, packed, listing, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        attempt, pages = f"{self.run}/{uuid.uuid4().hex}", []
        for place in _folders():
            store.create_dir(f"{root}/{STAGED}/{attempt}/{place}", recursive=True)
        for row in iterator:
            held = []
            for column in PLACES:
                value = row[column]
                if value is None:
                    continue
                value = value.encode() if isinstance(value, str) else bytes(value)
                if self.packed and column in PACKED:
                    column, value = f"{column}.gz", gzip.compress(value, 1, mtime=0)
                with store.open_output_stream(f"{root}/{STAGED}/{attempt}/{_place(column, row['page'])}", compression=None) as out:
                    out.write(value)
                held.append(column)
            pages.append(json.dumps({"page": row["page"], "columns": held}))
        with store.open_output_stream(f"{root}/{STAGED}/{attempt}/{LIST}") as out:
            out.write("\n".join(pages).encode())
        return Written(attempt)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        done = [m for m in messages if m is not None]
        name = f"{root}/{MANIFESTS}/{self.run}.json"
        store.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        with store.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps({"listing": self.listing, "attempts": [m.attempt for m in done]}).encode())
        store.move(f"{name}.part", name)
        _finish(store, root, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        _drop(store, f"{root}/{STAGED}/{self.run}")


def _drop(store: fs.FileSystem, folder: str) -> None:
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


def _finish(store: fs.FileSystem, root: str, manifest: str) -> None:
    """Moves what a manifest lists to its place; what was moved before is passed over."""
    with store.open_input_file(manifest) as f:
        held = json.loads(f.read())
    for place in _folders():
        store.create_dir(f"{root}/{place}", recursive=True)
    lists = None
    if held["listing"]:
        lists = fs.FileSystem.from_uri(held["listing"])[1]
        store.create_dir(lists, recursive=True)

    def move(each: tuple[str, str]) -> None:
        attempt, place = each
        source = f"{root}/{STAGED}/{attempt}/{place}"
        if store.get_file_info(source).is_file:
            store.move(source, f"{root}/{place}")

    with ThreadPoolExecutor(MOVERS) as pool:
        for attempt in held["attempts"]:
            listed = f"{root}/{STAGED}/{attempt}/{LIST}"
            if not store.get_file_info(listed).is_file:
                continue  # moved before, all of it: the list goes last
            with store.open_input_file(listed) as f:
                pages = [json.loads(line) for line in f.read().splitlines()]
            deque(pool.map(move, [(attempt, _place(column, p["page"])) for p in pages for column in p["columns"]]), maxlen=0)
            if lists:
                store.move(listed, f"{lists}/{attempt.replace('/', '-')}.json")
    _drop(store, f"{root}/{STAGED}/{manifest.rsplit('/', 1)[1].removesuffix('.json')}")
    store.delete_file(manifest)


def recover(path: str) -> int:
    """Carries out what a lost driver had committed and not finished; how many runs that were."""
    store, root = fs.FileSystem.from_uri(path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True)) if f.path.endswith(".json")]
    for name in sorted(found):
        _finish(store, root, name)
    return len(found)


class PageArtefacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_artefacts"

    def schema(self) -> str:
        return "page long, image binary, page_json string, html string, css string, review_json string"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        missing = {"page", *PLACES} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return Writer(self.options["path"], str(self.options.get("packed", "false")).lower() == "true", self.options.get("listing") or None)


def read(spark: SparkSession, path: str, listing: str | None = None) -> DataFrame:
    """name and content of the artefacts under path, packed ones unpacked.

    listing: the folder of write()'s lists; tasks open what these name, each file once. Without it the driver lists all files under path."""
    small_batches(spark)
    if listing is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        held = files.select(F.regexp_extract("path", "((?:images|pages|review)/.*)$", 1).alias("name"), "content")
    else:
        pages = spark.read.schema("page long, columns array<string>").json(listing)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(pages.select(F.sum(F.size("columns"))).first()[0] or 0) // AT_ONCE))
        held = pages.select("page", F.explode("columns").alias("column")).repartition(parts, "page", "column").distinct()

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        if listing is None:
            yield from ((name.as_py(), content.as_py()) for name, content in zip(*batch.columns))
            return
        store, root = fs.FileSystem.from_uri(path)
        for page, column in zip(*batch.columns):
            name = _place(column.as_py(), page.as_py())
            with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                yield name, f.read()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, contents, size = [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], names=["name", "content"])
        for batch in batches:
            for name, content in opened(batch):
                if name.endswith(".gz"):
                    name, content = name.removesuffix(".gz"), gzip.decompress(content)
                names.append(name)
                contents.append(content)
                size += len(content)
                if size >= BATCH_BYTES:
                    yield made()
                    names, contents, size = [], [], 0
        if names:
            yield made()

    return held.mapInArrow(unpacked, "name string, content binary")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageArtefacts)


def write(pages: DataFrame, path: str, packed: bool = False, listing: str | None = None) -> None:
    """Writes the artefacts of pages (page, and those columns of PLACES that there are) under path, and lists of them in the folder listing."""
    register(pages.sparkSession)
    kinds = {c: "binary" if c == "image" else "string" for c in PLACES}
    full = pages.select(F.col("page").cast("long"), *[(F.col(c) if c in pages.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    full.write.format("page_artefacts").option("packed", packed).options(**({"listing": listing} if listing else {})).mode("append").save(path)
