"""Turned words, styled runs, overrides and final pages against what the formats say."""

from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.operators import claim, final, lines, pages, styles, words

WORD = "page long, word long, text string, x double, y double, w double, h double, size double, font string, weight string, style string, color string, rotation double"
BOX = "page long, box string, tag string, x double, y double, w double, h double, reading_order double"


def word(i, x, y, text="word", w=30.0, h=10.0, size=10.0, font="Arial", weight="normal", style="normal", color="#000000", rotation=0.0, page=0):
    return (page, i, text, float(x), float(y), w, h, size, font, weight, style, color, rotation)


@pytest.mark.parametrize("angle, placed", [(0.0, (10, 20, 6, 60)), (90.0, (16, 20, 60, 6)), (-90.0, (10, 80, 60, 6)), (180.0, (16, 80, 6, 60)), (12.5, (10, 20, 6, 60))])
def test_turned_words_come_back(spark, angle, placed):
    rows = spark.createDataFrame([(10.0, 20.0, 6.0, 60.0, angle)], "x double, y double, w double, h double, a double")
    css = geometry.css_box(geometry.box(), F.col("a"))
    assert tuple(rows.select(*css).first()) == placed
    back = rows.select(*[c.alias(n) for c, n in zip(css, "xywh")], "a")
    assert tuple(back.select(*geometry.visual_box(geometry.box(), F.col("a"))).first()) == (10, 20, 6, 60)


def test_turned_words_are_claimed_by_what_they_take_up(spark):
    rows = spark.createDataFrame([word(0, 100, 10, w=60.0, h=6.0, rotation=90.0), word(1, 50, 200, w=60.0, h=6.0, rotation=-90.0), word(2, 300, 300, w=40.0, h=10.0, rotation=180.0)], WORD)
    boxes = spark.createDataFrame([(0, "a", "p", 90.0, 10.0, 12.0, 60.0, 1.0), (0, "b", "p", 48.0, 140.0, 10.0, 60.0, 2.0), (0, "c", "img", 259.0, 289.0, 42.0, 12.0, 3.0), (0, "d", "p", 300.0, 300.0, 50.0, 50.0, 4.0)], BOX)
    got = final.claimed_words(rows, boxes).orderBy("word").collect()
    assert [r["box"] for r in got] == ["a", "b", "c"]
    assert [(r["px"], r["py"], r["pw"], r["ph"]) for r in got] == [(94, 10, 6, 60), (50, 140, 6, 60), (260, 290, 40, 10)]
    assert [r["box"] for r in claim.claim(rows, boxes).orderBy("word").collect()] != ["a", "b", "c"]


def test_runs_decode_before_tags_go(spark):
    html = '<P Style="TOP:3pt;left:4.5pt"><SPAN STYLE="color:#ABC">a &lt;b&gt; c</SPAN><span>no style</span><span style="x"><i>d</i> &#x26;</span></P><p><span style="color:red">no place</span></p>'
    got = pages.runs(spark.createDataFrame([(1, html)], "page long, html string")).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(1, 0, 4.5, 3.0, "#ABC", "a  c"), (1, 1, 4.5, 3.0, None, "d &")]


def test_runs_are_spent_by_trying(spark):
    line = "page long, seq long, text string, x double, y double"
    asked = spark.createDataFrame([(0, 0, "nothing like it", 0.0, 0.0), (0, 1, "q", 0.0, 0.0), (1, 0, " ", 0.0, 0.0), (1, 1, "ab", 5.0, 5.0), (1, 2, "end", 0.0, 0.0)], line)
    runs = spark.createDataFrame([(0, 0, "q", 0.0, 0.0, "red"), (1, 0, "a", 9.0, 5.0, "far"), (1, 1, "", 5.0, 5.0, "blank"), (1, 2, "b", 5.0, 6.0, "near"), (1, 3, "abc", None, 5.0, "nowhere"), (1, 4, "ab", 0.0, 0.0, None), (1, 5, "end", 0.0, 0.0, "last")], line + ", color string")
    got = words.colours(asked, runs).orderBy("page", "seq").collect()
    assert [r["color"] for r in got] == [None, None, None, None, "last"]
    got = words.colours(asked, runs, attempts=4).orderBy("page", "seq").collect()
    assert [r["color"] for r in got] == [None, None, None, "near", "last"]


def test_overrides_keep_declarations_and_apply_once(spark):
    css = ".page1__word0 { left: 1px; color: red; top: 2.5px; Font-Size: 12px; font-family: 'A  b', serif }\n.page1__word1{top:1px}\n.page2__word0 { left: 1px; top: 1px }\n.page1__word2 { left: 5px; top: 5px; letter-spacing: 9px; font-size: 12.004px; font-family: \"a B\"; font-style: Normal; }"
    sheet = spark.createDataFrame([(0, css)], "page long, css string")
    given = "seq long, scope string, class string, page long, word long, font string, size double, style string, top double, left double, spacing double"
    rows = [(1, "span", None, 0, 0, "", 0.0, "", 1.0, 2.0, 0.0), (2, "span", ".page1__word0", 0, 0, "", 0.0, "", 0.25, 0.0, 0.0), (3, "span", None, 0, 1, "", 0.0, "", 5.0, 5.0, 1.0), (4, "book-font-size", None, 7, 0, "a b", 12.0, " NORMAL", 0.0, 0.0, 0.5), (5, "page-font-size", None, 3, 0, "a b", 12.0, "normal", 9.0, 9.0, 9.0)]
    corrections = spark.createDataFrame(rows, given)
    got = pages.override_rules(pages.rule_parts(sheet), corrections).orderBy("at").collect()
    assert [(r["word"], r["css"]) for r in got] == [
        (0, ".page1__word0 { left: 3px; color: red; top: 3.75px; font-size: 12px; font-family: 'A  b', serif; letter-spacing: 0.5px; }"),
        (2, ".page1__word2 { left: 5px; top: 5px; letter-spacing: 0.5px; font-size: 12.004px; font-family: \"a B\"; font-style: Normal; }"),
    ]
    once = pages.with_overrides(sheet, pages.override_rules(pages.rule_parts(sheet), corrections))
    stripped = once.withColumn("css", pages.without_overrides(F.col("css")))
    assert stripped.first()["css"] == css
    twice = pages.with_overrides(once, pages.override_rules(pages.rule_parts(stripped), corrections))
    assert twice.first() == once.first() and pages.changed_pages(once, twice).count() == 0
    none = pages.with_overrides(once, pages.override_rules(pages.rule_parts(stripped), corrections.where("false")))
    assert none.first()["css"] == css + "\n"


def brute_lines(rows):
    held, out = [], []
    for y, _, h in rows:
        for i, ys in enumerate(held):
            if abs(median(ys) - y) <= max(2.0, 0.45 * h):
                ys.append(y)
                out.append(i)
                break
        else:
            held.append([y])
            out.append(len(held) - 1)
    return out


def test_median_lines_let_go_only_what_is_past(spark):
    rng = np.random.default_rng(0)
    rows = [(int(p), i, float(rng.integers(0, 60)), float(rng.integers(0, 400)) / 4, float(rng.choice([4, 10, 10, 40]))) for p in range(12) for i in range(80)]
    df = spark.createDataFrame(rows, "page long, word long, x double, y double, h double")
    got = {(r["page"], r["word"]): r["line"] for r in lines.median_lines(df, ["page"], ["y", "x", "word"]).collect()}
    for p in range(12):
        own = sorted((y, x, w, h) for q, w, x, y, h in rows if q == p)
        assert [got[p, w] for _, _, w, _ in own] == brute_lines([(y, x, h) for y, x, _, h in own])


def made(spark, rows, boxes, **k):
    out, registry = final.build(spark.createDataFrame(rows, WORD), spark.createDataFrame(boxes, BOX), **k)
    return {r["page"]: r for r in out.collect()}, registry


def test_final_page(spark):
    rows = [word(0, 10, 10, "One"), word(1, 45, 10, "t<o"), word(2, 10, 24, "red", color="#ff0000"), word(3, 300, 300, "left"), word(4, 10, 100, "Head", weight="bold"), word(5, 44, 100, "of", weight="bold"), word(8, 78, 100, "it"), word(9, 200, 100, "B", weight="bold"), word(6, 202, 120, "c2"), word(7, 12, 200, "eq")]
    boxes = [(0, "p1", "p", 10.0, 10.0, 200.0, 30.0, 2.0), (0, "t", "table", 0.0, 95.0, 250.0, 60.0, 1.0), (0, "i/1", "img", 400.0, 10.0, 50.0, 50.0, 3.0), (0, "e", "equation", 10.0, 195.0, 80.0, 20.0, 4.0)]
    sheet = spark.createDataFrame([(0, "@font-face { a: b }\n.keep { c: d }\n.page1__word0 { left: 1px }")], "page long, css string")
    got, registry = made(spark, rows, boxes, sheets=sheet)
    html, css = got[0]["html"], got[0]["css"]
    assert '<p id="page0001_para2" class="s1 f1 fs1 fw1 fst1 lh1 ta1 page__para page1-para2" data-box-id="p1"><span class="page__line page1-para2__line1"><span class="page__word page1__word0" data-word-index="0">One</span>' in html
    assert "t&lt;o" in html and '<img id="page0001_img1" class="page__crop page1-img1" src="./images/crops/page-1-i-1.png" alt="">' in html
    assert '<table id="page0001_table1" class="tbl1 f1 fs1 fst1 c1 page__table page1-table1" data-box-id="t" data-row-count="2" data-column-count="2">' in html
    assert '<th id="page0001_table1_r1c1" class="page__table-cell page1-table1__cell page1-table1__r1c1" data-text="Head of it" scope="col">' in html
    assert '<th id="page0001_table1_r1c2" class="page__table-cell page1-table1__cell page1-table1__r1c2 fw2" data-text="B" scope="col">' in html
    assert '<td id="page0001_table1_r2c1" class="page__table-cell page1-table1__cell page1-table1__r2c1" data-text=""></td>' in html
    assert html.index("para2") < html.index("<table") < html.index("word3") < html.index("page0001_img1") < html.index("<figure")
    assert css.startswith(".keep { c: d }\n\n#page0001_para2 { left: 10px; top: 10px; width: 200px; }")
    assert ".page1-para2__line1 { height: 14px; color: #000000; margin-left: 0px; margin-top: 0px; column-gap: 5px; }" in css
    assert "word0 {" not in css and ".page__table .page1__word9" not in css
    assert ".page1-para2__line2 { height: 10px; color: #ff0000; margin-left: 0px; }" in css
    assert "#page0001_table1_r2c2 { width: 31px; height: 10px; padding: 0px 0 0 1px; }" in css and ".page1-table1__row1 { height: 20px; }" in css and ".page__table .page1__word8 { font-weight: normal; }" in css and ".page1__word3 { position: absolute; left: 300px;" in css
    assert {(r["prefix"], r["id"]): r["css"] for r in registry.collect()}["fw", 2] == "font-weight: bold;"
    sheet = final.common_css(registry, spark.createDataFrame([(0, "@font-face { a:  b }"), (1, " @font-face { a: b }")], "page long, face string")).first()["css"]
    assert sheet.startswith("@font-face { a:  b }\n\nhtml, body") and sheet.count("@font-face") == 1 and sheet.endswith(".tbl1 { " + final.TABLE + " }")


def test_turned_paragraphs_are_placed_word_by_word(spark):
    rows = [word(0, 60, 20, "up", rotation=90.0, w=40.0), word(1, 20, 20, "flat")]
    got, _ = made(spark, rows, [(0, "p", "p", 10.0, 10.0, 100.0, 100.0, 1.0)])
    assert "page__para page__para--absolute" in got[0]["html"] and "page__line" not in got[0]["html"]
    assert "#page0001_para1 { left: 10px; top: 10px; width: 100px; height: 100px; }" in got[0]["css"]
    assert ".page1-para1 .page1__word0 { position: absolute; left: 50px; top: 10px; width: 40px; height: 10px;" in got[0]["css"] and "transform: rotate(90deg);" in got[0]["css"]


def test_classes_keep_their_numbers(spark):
    boxes = [(0, "a", "p", 0.0, 0.0, 500.0, 50.0, 1.0), (1, "a", "p", 0.0, 0.0, 500.0, 50.0, 1.0)]
    first, registry = made(spark, [word(0, 10, 10, font="B"), word(0, 10, 10, font="C", page=1)], boxes)
    ids = {(r["prefix"], r["css"]): r["id"] for r in registry.collect()}
    again, later = made(spark, [word(0, 10, 10, font="A"), word(0, 10, 10, font="C", page=1)], boxes, registry=registry)
    now = {(r["prefix"], r["css"]): r["id"] for r in later.collect()}
    assert ids.items() <= now.items() and now["f", "font-family: 'A', serif;"] == 3
    assert again[1] == first[1] and " f3 " in again[0]["html"]


def test_pages_without_words_or_boxes(spark):
    got, _ = made(spark, [word(0, 10, 10, page=3)], [(5, "a", "p", 0.0, 0.0, 10.0, 10.0, None)])
    assert sorted(got) == [3, 5] and "word0" in got[3]["html"] and "para" not in got[5]["html"] and got[5]["css"] == ""
    assert made(spark, [], [])[0] == {}


def test_registry_of_nothing(spark):
    rows = spark.createDataFrame([("f", "a", 1)], "prefix string, css string, seq long")
    assert [tuple(r) for r in styles.style_ids(rows, None).collect()] == [("f", "a", 1)]


def test_override_rules_are_read_once_whatever_they_look_like(spark):
    css = [
        ".page1__word0 { left: 1.5px; top: 2px; width: 3px; height: 4px; font-size: 12px; font-family: 'A', serif; font-weight: bold; font-style: normal; color: rgb(1, 2, 3); transform-origin: top left; transform: rotate(90deg); }",
        ".page1__word1{top:1px;\n\tLEFT : 9px ;font-size:12px;font-family:\"a\";top:7px;color:;x:y:z;letter-spacing:2px}", ".page1__word2 { left: 1px; left: 4px; top: 5; top: 6px; font-family: a; font-size: 12px; left: }", ".page1__word3 { top: 5px; font-family: a; font-size: 12px; }", ".page1__word4 { left: 1px; top: 2px; font-family: a }", ".page01__word5 { }",
    ]
    given = "seq long, scope string, class string, page long, word long, font string, size double, style string, top double, left double, spacing double"
    moved = lambda space: spark.createDataFrame([(1, "book-font-size", None, None, None, "a", 12.0, "normal", 1.0, 2.0, space)], given)
    rules = pages.rule_parts(spark.createDataFrame([(0, "\n".join(css))], "page long, css string"))
    assert [(r["at"], r["word"], r["selector"]) for r in rules.orderBy("at").collect()] == [(i, i, f".page1__word{i}" if i < 5 else ".page01__word5") for i in range(6)]
    rest = " width: 3px; height: 4px; font-size: 12px; font-family: 'A', serif; font-weight: bold; font-style: normal; color: rgb(1, 2, 3); transform-origin: top left; transform: rotate(90deg);"
    for space, (first, second) in ((0.0, ("", "2px")), (0.5, (" letter-spacing: 0.5px;", "0.5px"))):
        found = pages.override_rules(rules, moved(space))
        assert [(r["word"], r["left"], r["top"], r["css"]) for r in found.orderBy("at").collect()] == [
            (0, 3.5, 3.0, f".page1__word0 {{ left: 3.5px; top: 3px;{rest}{first} }}"), (1, 11.0, 8.0, f'.page1__word1 {{ top: 8px; left: 11px; font-size: 12px; font-family: "a"; x: y:z; letter-spacing: {second}; }}'),
            (2, 6.0, 7.0, f".page1__word2 {{ top: 7px; font-family: a; font-size: 12px;{first} }}"),
        ]
        # no condition makes a rule's parts again
        assert not [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter " in line and "regexp_" in line]
