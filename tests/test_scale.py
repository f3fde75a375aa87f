"""What is shuffled and stored, by plans and schemas."""

from pyspark.sql import functions as F

from quire.operators import ocr
from quire.plans import catalogue
from quire.sources import adapters as a

from .conftest import SF


def test_lines_of_documents_equal_lines_of_words(spark):
    docs = spark.createDataFrame([(1, "a b\n\n  c"), (1, "d  e"), (2, None), (3, ""), (4, "x" * 40 + "\ny ä")], "doc_id long, text string")
    for table in (docs, a.table(spark, SF, "documents")):
        want, got = a.lines(a.words(table)), a.document_lines(table)
        assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_what_is_grouped_by_page_is_shuffled_as_texts_alone(spark):
    grouped = catalogue._words(spark, SF).groupBy("page", "ln").agg(F.max("x"))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_matching_stores_no_texts(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ocr, "once", lambda df, label, put=ocr.once: kept.append(df.dtypes) or put(df, label))
    own = catalogue._lines(spark, SF)
    assert ocr.match(own, a.ocr_lines(own)).count() == own.count()
    assert kept and not any("string" in kind for table in kept for _, kind in table)


def test_a_page_gets_each_named_source_once(spark, monkeypatch):
    from quire.operators import blocks
    from quire.plans import more

    named = []
    monkeypatch.setattr(blocks, "without_sources", lambda own, fixes, put=blocks.without_sources: named.append(fixes) or put(own, fixes))
    assert more.q53(spark, SF).count() > 0
    assert named[0].count() == named[0].select("page").distinct().count()


def test_few_corrections_leave_words_where_they_are(spark):
    plan = catalogue.QUERIES["q29_corrections"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("REPARTITION_BY_NUM") <= 2 and "SortMergeJoin" not in plan


def test_many_corrections_are_shuffled_to_the_same_result(spark, monkeypatch):
    from quire.sources import shared

    want = sorted(map(repr, catalogue.QUERIES["q29_corrections"](spark, SF).collect()))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, catalogue.QUERIES["q29_corrections"](spark, SF).collect())) == want


def test_a_correction_of_a_page_without_number_meets_no_page(spark):
    from quire.operators import pages

    rules = spark.createDataFrame([(0, 0, 5, ".page1__word5", " left: 1px; top: 2px; font-family: 'A'; font-size: 10px; ")], "page long, at long, word long, selector string, body string")
    given = "seq long, scope string, class string, page long, word long, font string, size double, style string, top double, left double, spacing double"
    each = [(1, "page-font-size", None, None, None, "A", 10.0, "normal", 1.0, 1.0, 0.0), (2, "page-font-size", None, 0, None, "A", 10.004, "normal", 2.0, 0.0, 0.5), (3, "page-font-size", None, 1, None, "A", 10.0, "normal", 8.0, 8.0, 0.0)]
    got = pages.override_rules(rules, spark.createDataFrame(each, given)).select("left", "top", "spacing").collect()
    assert [tuple(r) for r in got] == [(1.0, 4.0, 0.5)]


def test_words_are_numbered_on_their_page_without_a_sort(spark):
    docs = spark.createDataFrame([(1, "a b\n\n  c"), (1, "d  e"), (2, None), (3, ""), (4, "y ä")], "doc_id long, text string")
    got = a.numbered(docs)
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["page"], r["word"], r["ln"], r["pos"], r["text"]) for r in got.collect()) == [(1, 0, 0, 0, "a"), (1, 1, 0, 0, "d"), (1, 2, 0, 1, "b"), (1, 3, 0, 2, "e"), (1, 4, 2, 2, "c"), (4, 0, 0, 0, "y"), (4, 1, 0, 1, "ä")]
    assert sorted(map(repr, got.drop("word").collect())) == sorted(map(repr, a.words(docs).collect()))


def test_more_text_is_dealt_out_to_more_tasks(spark, monkeypatch):
    docs = a.table(spark, SF, "documents")
    few = a.dealt(docs).rdd.getNumPartitions()
    monkeypatch.setattr(a, "TASK_BYTES", 1000)
    assert a.dealt(docs).rdd.getNumPartitions() > few


def test_words_meet_regions_and_margins_without_a_sort(spark):
    from quire.operators import claim, lines

    words = catalogue._words(spark, SF)
    for found in (claim.claim(words, catalogue._boxes(spark, SF)), words.groupBy("page").count()):
        assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()
    counted = lines.left_margin(words)._jdf.queryExecution().executedPlan().toString()
    assert counted.count("HashAggregate") >= 2


def test_walked_words_are_shuffled_as_texts_alone(spark):
    from quire.operators import lines

    plan = lines.median_lines(catalogue._words(spark, SF).select("page", "ln", "pos", "x", "y", "h"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_final_pages_write_no_words_that_no_region_claims(spark, monkeypatch):
    from quire.operators import final
    from quire.plans import final as plans

    kept = {}
    monkeypatch.setattr(final, "once", lambda df, label, put=final.once: kept.setdefault(label, put(df, label)))
    plans._final(spark, SF, looks=False)
    words = catalogue._words(spark, SF).count()
    assert kept and all(table.count() < words / 2 for table in kept.values())


def test_packed_artefacts_are_smaller_and_read_as_they_were(spark, tmp_path):
    from quire.sources import artefacts

    pages = spark.createDataFrame([(0, b"png", "{}", "<p>é</p>" * 1000, None, "[]")], "page long, image binary, page_json string, html string, css string, review_json string")
    path = f"file://{tmp_path}/packed"
    artefacts.write(pages, path, packed=True)
    assert (tmp_path / "packed/review/page-1.html.gz").stat().st_size < 1000
    got = {r["name"]: bytes(r["content"]) for r in artefacts.read(spark, path).collect()}
    assert got == {"images/page-1.png": b"png", "pages/0.json": b"{}", "review/page-1.html": ("<p>é</p>" * 1000).encode(), "review/page-1.json": b"[]"}


def test_rules_and_spans_of_a_page_meet_without_a_shuffle(spark):
    from quire.operators import words

    page = spark.createDataFrame([(1, ".page1__word0{left:1px}", '<span class="page1__word0">a</span>')], "page long, css string, html string")
    assert "Exchange" not in words.parse(page)._jdf.queryExecution().executedPlan().toString()


def test_lines_meet_few_named_sources_where_they_are(spark):
    from quire.plans import fixes

    plan = fixes.q37(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_common_looks_equal_common_declarations_without_a_join(spark):
    from quire.operators import styles
    from quire.plans import more

    items = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "A", "x"), (2, 2, "a", None), (2, 3, "b", None), (3, 4, None, "y"), (3, 5, "c", "y"), (None, 6, "d", "z"), (None, 6, "d", "z")], "page long, item long, font string, color string")
    given = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("font", "font"), ("paint", "color"))]))
    want = styles.common_declarations(items.where("page is not null").select("page", "item", given.alias("g")).select("page", "item", "g.*"), ["page"])
    got = styles.common_looks(items, ["page"], ["font", "color"], {"font": F.col("font"), "paint": F.col("color")})
    assert sorted(map(repr, got.where("page is not null").collect())) == sorted(map(repr, want.collect()))
    assert sorted(tuple(r)[1:] for r in got.where("page is null").collect()) == [("font", "d"), ("paint", "z")]
    assert "Join" not in more.q49(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_lines_of_one_text_are_not_taken_apart(spark):
    texts = ["a  b", " x y z u v w", "\n\n", "  ", "a\r\n ä  b\t c", "q w e r t y  ", "q  w e r t", "", None]
    docs = spark.createDataFrame([(i if i % 4 else 3, t) for i, t in enumerate(texts + [f"{a}\n{b}" for a in texts for b in texts])], "doc_id long, text string")
    want, got = a.lines(a.words(docs)), a.document_lines(docs)
    assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "array_sort(" not in got._jdf.queryExecution().executedPlan().toString()


def test_regions_grids_groups_and_runs_shuffle_texts_and_regions_alone(spark):
    from quire.plans import more

    most = {"q16_alignment": 3, "q35_table_grid": 2, "q66_grouped_words": 1, "q45_html_runs": 1}
    for name, n in most.items():
        assert more.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= n, name


def test_affected_pages_make_a_page_once_and_shuffle_texts_alone(spark):
    from quire.operators import pages
    from quire.plans import more

    plan = more.q46b(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 1
    begin, end = pages.OVERRIDES
    sheets = spark.createDataFrame([(0, "a\n"), (1, "b\n"), (2, f"c\n\n{begin}\nx\n{end}\n"), (3, f"d\n\n{begin}\nx\n{end}\n"), (4, f"e\n\n{begin}\nx\n{end}\n"), (5, "\n"), (6, None)], "page long, css string")
    given = spark.createDataFrame([(1, 0, "y"), (2, 0, "x"), (3, 0, "y"), (5, 1, "z"), (5, 0, "y"), (9, 0, "y")], "page long, at long, css string")
    want = sorted(r["page"] for r in pages.changed_pages(sheets, pages.with_overrides(sheets, given)).collect())
    assert sorted(r["page"] for r in pages.changed_by(sheets, given).collect()) == want == [1, 3, 4, 5]


def test_claimed_words_of_final_pages_are_written_once(spark, monkeypatch):
    from quire.operators import final
    from quire.plans import final as plans

    walked = []
    monkeypatch.setattr(final, "_lined", lambda words, put=final._lined: walked.append(words) or put(words))
    pages, _ = plans._final(spark, SF)
    assert len(walked) == 1 and any("-inside" in f for f in walked[0].inputFiles()) and "posexplode" not in walked[0]._jdf.queryExecution().toString()
    assert not [line for line in pages._jdf.queryExecution().optimizedPlan().toString().splitlines() if r"^\s+|\s+$" in line]
