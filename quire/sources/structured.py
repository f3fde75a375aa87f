"""Structured text of documents as a data source: spark.read.format("structured_text").

Files are what an external extractor leaves: a JSON object for each document, with pages of blocks of lines:
{"pages": [{"page": 0, "width": .., "height": .., "html": "..", "blocks": [{"type": "text", "lines": [{"bbox": {x, y, w, h}, "text": "..",
"font": {"name": "..", "size": ..}, "chars": [{"c": "..", "quad": [8 numbers], "size": ..}]}]}]}]}.
The option kind chooses the table: spans (a row a line), chars or pages, each of a declared schema. A partition is some whole files up to
PARTITION_BYTES, or one file, read as Arrow batches. Equality, sets and bounds on document and page are taken over from Spark: documents that are not
asked for are not opened, pages that are not asked for make no rows. Files that are no such JSON give no rows, as in a document scan."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PARTITION_BYTES = 32 << 20
ROWS = 4096
SCHEMAS = {
    "spans": "document string, page long, seq long, x double, y double, w double, h double, text string, font string, size double",
    "chars": "document string, page long, line long, seq long, text string, quad array<double>, size double, font string",
    "pages": "document string, page long, width double, height double, html string, lines long",
}

_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


@dataclass
class Files(InputPartition):
    paths: tuple[tuple[str, str], ...]  # document, path

    def __init__(self, paths: tuple[tuple[str, str], ...]) -> None:
        super().__init__(None)
        self.paths = paths


def _number(value: object) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _rows(kind: str, document: str, page: dict) -> Iterator[tuple]:
    number = int(page["page"])
    lines = [(line, block) for block in page.get("blocks") or [] if block.get("type") == "text" for line in block.get("lines") or []]
    if kind == "pages":
        yield document, number, _number(page.get("width")), _number(page.get("height")), page.get("html"), len(lines)
        return
    for seq, (line, block) in enumerate(lines):
        font = line.get("font") or {}
        if kind == "spans":
            box = line.get("bbox") or block.get("bbox") or {}
            yield document, number, seq, *(_number(box.get(c)) for c in "xywh"), line.get("text"), font.get("name"), _number(font.get("size"))
        else:
            for at, char in enumerate(line.get("chars") or []):
                yield document, number, seq, at, char.get("c"), [float(v) for v in char.get("quad") or []], _number(char.get("size")), font.get("name")


_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("document",), ("page",)):
                self.wanted.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _asked(self, column: str, value: object) -> bool:
        return all(_TESTS[kind](value, against) for name, kind, against in self.wanted if name == column)

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".json"))
        out, held, size = [], [], 0
        for path, n in found:
            document = path.rsplit("/", 1)[1].removesuffix(".json")
            if not self._asked("document", document):
                continue
            if held and size + n > PARTITION_BYTES:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append((document, path))
            size += n
        return [*out, *([Files(tuple(held))] if held else [])]

    def _all(self, part: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for document, path in part.paths:
            with store.open_input_file(path) as f:
                try:
                    pages = json.loads(f.read())["pages"]
                    rows = [r for p in pages if self._asked("page", int(p["page"])) for r in _rows(self.kind, document, p)]
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
            yield from rows

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, SCHEMAS[self.kind].split(", "))])
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for row in self._all(partition):
            held.append(row)
            if len(held) == ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class StructuredText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "structured_text"

    def schema(self) -> str:
        kind = self.options.get("kind", "spans")
        if kind not in SCHEMAS:
            raise ValueError(f"kind is one of {', '.join(SCHEMAS)}")
        return SCHEMAS[kind]

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("kind", "spans"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StructuredText)
