"""Structured text as a source, artefacts as a sink, text out of nested results."""

import json
import os
import pickle

import pytest
from pyspark.sql import functions as F

from quire.functions import nested
from quire.sources import artefacts, structured


@pytest.fixture
def documents(tmp_path):
    def line(text, n):
        return {"bbox": {"x": 1, "y": 2.5 * n, "w": 3, "h": 4}, "text": text, "font": {"name": "F", "size": 9}, "chars": [{"c": c, "quad": [0, 0, 1, 0, 1, 1, 0, 1], "size": 9.5} for c in text]}

    for d in range(3):
        pages = [{"page": p, "width": 10, "height": 20.5, "html": "<p>", "blocks": [{"type": "image"}, {"type": "text", "bbox": {"x": 9}, "lines": [line(f"{d}{p}", 1), {"text": "bare"}]}, {"type": "text"}]} for p in range(4)]
        (tmp_path / f"doc{d}.json").write_text(json.dumps({"pages": pages}))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "other.json").write_text('{"a": 1}')
    (tmp_path / "note.txt").write_text("x")
    return f"file://{tmp_path}"


def test_structured_text(spark, documents):
    structured.register(spark)
    load = lambda kind: spark.read.format("structured_text").option("kind", kind).load(documents)
    spans = load("spans").orderBy("document", "page", "seq").collect()
    assert len(spans) == 24 and tuple(spans[0]) == ("doc0", 0, 0, 1.0, 2.5, 3.0, 4.0, "00", "F", 9.0) and tuple(spans[1]) == ("doc0", 0, 1, 9.0, None, None, None, "bare", None, None)
    assert load("chars").count() == 24 and load("chars").where("text = '2'").count() == 7  # 02, 12, 20, 21, 22 twice, 23
    assert [tuple(r) for r in load("pages").where("page = 3").orderBy("document").collect()] == [(f"doc{d}", 3, 10.0, 20.5, "<p>", 2) for d in range(3)]
    with pytest.raises(Exception, match="kind is one of"):
        load("none").count()


def test_filters_go_to_the_source(spark, documents, monkeypatch):
    structured.register(spark)
    rows = spark.read.format("structured_text").load(documents)
    asked = rows.where("page > 1 AND page <= 3 AND document IN ('doc1', 'doc2') AND text <> 'bare'")
    assert sorted((r["document"], r["page"]) for r in asked.collect()) == [("doc1", 2), ("doc1", 3), ("doc2", 2), ("doc2", 3)]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.splitlines() if "Filter" in line]
    assert not any("page" in line.split("Filter", 1)[1].split("BatchScan")[0] and ">" in line for line in left if "BatchScan" not in line)
    own = structured.Reader(documents, "spans")
    kept = list(own.pushFilters([structured.EqualTo(("document",), "doc1"), structured.GreaterThan(("seq",), 0), structured.GreaterThanOrEqual(("page",), 3)]))
    assert kept == [structured.GreaterThan(("seq",), 0)]
    assert [[d for d, _ in part.paths] for part in own.partitions()] == [["doc1"]]
    assert sum(b.num_rows for part in own.partitions() for b in own.read(part)) == 2
    monkeypatch.setattr(structured, "PARTITION_BYTES", 1)
    assert len(structured.Reader(documents, "spans").partitions()) == 5


PAGES = "page long, image binary, page_json string, html string, css string, review_json string"


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names if not f.endswith(".crc")}


def test_artefacts_of_a_page(spark, tmp_path):
    rows = [(p, bytes([p]), f'{{"p": {p}}}', f"<html>{p} é", f"css{p}", None if p == 2 else "r") for p in range(5)]
    artefacts.write(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}")
    got = files(tmp_path)
    assert len(got) == 24 and got["images/page-4.png"] == b"\x03" and got["pages/3.json"] == b'{"p": 3}' and got["review/page-1.html"] == "<html>0 é".encode() and "review/page-3.json" not in got and got["review/style/page-5.css"] == b"css4"
    artefacts.write(spark.createDataFrame([(1, "new")], "page long, css string"), f"file://{tmp_path}")
    again = files(tmp_path)
    assert again.pop("review/style/page-2.css") == b"new" and again.items() <= got.items()
    artefacts.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}")
    assert len(files(tmp_path)) == 24


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def fail(page):
        if page == 7:
            raise RuntimeError("lost")
        return "x"

    rows = spark.range(8).withColumnRenamed("id", "page").withColumn("html", fail("page"))
    with pytest.raises(Exception, match="lost"):
        artefacts.write(rows.coalesce(2), f"file://{tmp_path}")
    assert not [f for f in files(tmp_path) if not f.startswith("_staged")]


def test_a_lost_driver_is_gone_on_from(tmp_path):
    writer = artefacts.Writer(f"file://{tmp_path}")
    row = lambda p: dict(zip(["page", *artefacts.PLACES], [p, b"i", "j", "h", "c", "r"]))
    first, twice = writer.write(iter([row(0), row(1)])), writer.write(iter([row(0), row(1)]))
    assert first.attempt != twice.attempt and not any(not f.startswith("_staged") for f in files(tmp_path))
    real, moved = artefacts._finish, []

    def half(store, root, manifest):
        store.create_dir(f"{root}/images", recursive=True)
        store.move(f"{root}/_staged/{first.attempt}/images/page-1.png", f"{root}/images/page-1.png")
        moved.append(manifest)

    artefacts._finish = half
    try:
        writer.commit([first, None])
    finally:
        artefacts._finish = real
    assert moved and len([f for f in files(tmp_path) if not f.startswith("_")]) == 1
    assert artefacts.recover(f"file://{tmp_path}") == 1
    assert len(files(tmp_path)) == 10 and artefacts.recover(f"file://{tmp_path}") == 0


def plain(value):
    """The walk as a recursion."""
    if isinstance(value, dict):
        return next((t for k in nested.TEXT_KEYS if (t := plain(value.get(k)))), "") or " ".join(filter(None, map(plain, value.values())))
    if isinstance(value, list):
        return " ".join(filter(None, map(plain, value)))
    return "" if value is None else str(value).strip()


def test_nested_text():
    values = [None, " a ", 3, {"b": {"c": ["x", {"text": "", "formula": "f", "z": "no"}]}, "d": None}, {"latex": {"text": " "}, "text": ["t", "t"], "q": 1}, [[], {}, [["y"]]], {"content": "", "k": "v"}]
    for value in values:
        assert nested._text(value) == plain(value)
    deep = "z"
    for _ in range(50_000):
        deep = [deep]
    assert nested._text(deep) == "z"


def test_json_is_recovered(spark):
    texts = ['{"raw": "a"}', 'x\r\n {"raw": "b"} \n{"raw": \n', "nothing", "", None, '{"raw": "c"}\n{"raw": "d"}\n[1]']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(nested.text_of(nested.recovered(F.col("t")))).collect()] == ["a", "b", None, None, None, "d"]


def test_an_output_is_parsed_once(spark):
    rows = spark.createDataFrame([("x\n{\"raw\": 1}",)], "t string").select(nested.recovered(F.col("t")).alias("v"))
    assert rows._jdf.queryExecution().analyzed().toString().count("try_parse_json") == 2  # as a whole, and a line


def test_what_begins_or_ends_like_json_is_told_by_the_parser(spark):
    texts = [' \t\r\n{"raw": "a"}\n', "true", "-1", '"s"', "[1] x", "{}]", 'x\n{"raw": "b"} \t\r\n{"raw": }\n{', "+1", "nul", "\ufeff{}", "\x0b{}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(F.to_json(nested.recovered(F.col("t")))).collect()] == ['{"raw":"a"}', "true", "-1", '"s"', None, None, '{"raw":"b"}', None, None, None, None]


def test_the_driver_gets_no_list_of_files(spark, tmp_path):
    writer = artefacts.Writer(f"file://{tmp_path}/few")
    row = lambda p: dict(zip(["page", *artefacts.PLACES], [p, b"i", "j", "h", "c", None]))
    sizes = [len(pickle.dumps(writer.write(map(row, range(n))))) for n in (1, 500)]
    assert sizes[0] == sizes[1]
    path, listing = f"file://{tmp_path}/own", f"file://{tmp_path}/lists"
    for n in (7, 3):  # the second run writes three of the pages again
        artefacts.write(spark.range(n).select(F.col("id").alias("page"), F.lit(f"é{n}").alias("html"), F.when(F.col("id") % 2 == 0, "j").alias("page_json")), path, packed=True, listing=listing)
    got = artefacts.read(spark, path, listing)
    assert "binaryFile" not in got._jdf.queryExecution().toString().replace("BinaryFile", "binaryFile")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, artefacts.read(spark, path).collect())) and got.count() == 11
    assert got.where("name = 'review/page-3.html'").first()["content"].decode() == "é3" and got.where("name = 'review/page-4.html'").first()["content"].decode() == "é7"
    assert not [f for f in files(tmp_path / "own") if f.startswith("_")]
