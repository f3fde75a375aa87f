"""Words from characters, spans and serialised pages."""

from pyspark.sql import functions as F

from quire.operators import words


def test_words_from_chars(spark):
    rows = [(0, 0, i, c, 10.0 * i, 0.0, 9.0, 10.0, 12.0, "f", "normal", "normal", "#000000", 0.0) for i, c in enumerate("ab  cﬁ d")]
    got = words.from_chars(spark.createDataFrame(rows, "page long, line int, seq int, text string, x double, y double, w double, h double, size double, font string, weight string, style string, color string, rotation double")).orderBy("seq").collect()
    assert [(r["text"], r["x"], r["w"]) for r in got] == [("ab", 0.0, 19.0), ("cfi", 40.0, 19.0), ("d", 70.0, 9.0)]


def test_words_from_spans(spark):
    rows = [(0, 0, "ab  c", 10.0, 0.0, 50.0, 10.0, 0.0), (0, 1, "x y", 0.0, 0.0, 30.0, 10.0, 90.0), (0, 2, "   ", 0.0, 0.0, 30.0, 10.0, None)]
    got = words.from_spans(spark.createDataFrame(rows, "page long, seq long, text string, x double, y double, w double, h double, rotation double")).orderBy("seq", "part").collect()
    assert [(r["text"], r["x"], r["w"]) for r in got] == [("ab", 10.0, 20.0), ("c", 50.0, 10.0), ("x y", 0.0, 30.0)]


def test_serialised_pages(spark):
    css = ".page1__word0{left:1.5px;top:-2px;width:3px;height:4px;font-size:12px;color:#ff0000}.page1__word1{left:9px}.page1__word0{left:7px}"
    html = '<span class="w page1__word0">a &amp;amp; <b>b</b></span><span class="page1__word2">x</span><span class="page1__word0">c</span>'
    got = words.parse(spark.createDataFrame([(1, css, html)], "page long, css string, html string")).collect()
    assert [(r["word"], r["x"], r["y"], r["weight"], r["color"], r["text"]) for r in got] == [(0, 7.0, 0.0, "normal", "#000000", "c")]


def test_rotations_and_colours(spark):
    lines = spark.createDataFrame([(0, 0, " Hello", 10.0, 10.0), (0, 1, "World", 50.0, 50.0), (0, 2, "zzz", 0.0, 0.0)], "page long, seq long, text string, x double, y double")
    hints = spark.createDataFrame([(0, 5, "H", 11.0, 9.0, 90.0), (0, 6, "H", 10.0, 10.0, 45.0), (0, 7, "W", 60.0, 50.0, 90.0)], "page long, seq long, char string, x double, y double, rotation double")
    assert [r["rotation"] for r in words.rotations(lines, hints).orderBy("seq").collect()] == [90.0, None, None]
    runs = spark.createDataFrame([(0, 0, "Hello", 10.0, 10.0, "red"), (0, 1, "World peace", 90.0, 50.0, "far"), (0, 2, "Worl", 50.0, 50.0, "near")], "page long, seq long, text string, x double, y double, color string")
    assert [r["color"] for r in words.colours(lines, runs).orderBy("seq").collect()] == ["red", "near", None]


def test_pages_are_read_once_whatever_their_rules_look_like(spark):
    sheet = [
        ".page1__word0 { left: 1.5px; top: -2px; width: 3px; height: 4px; font-size: 5px; font-family: 'A\\'b', serif; font-weight: bold; font-style: italic; color: rgb(1, 2, 3); transform: rotate(90deg); }",
        ".page1__word1{COLOR:red;top:7;left : 8pt; font-size:9em;color: blue ; margin left: 3}", ".page1__word2 { }", ".page1__word3 { left: 1px; top: 2px; width: 3px; height: 4px; font-size: 5px; font-family: a font-weight: 3; font-weight: 4; font-style: x; color: #abc; }",
        ".page1__word0004 { left: 9px }", ".page1__word4 { left: 10px }", ".page1__word5 { top: 1px }", ".page1__word { left: 1px }", ".page1__word2 { color:  ; font-weight:\n5 }",
    ]
    spans = [
        '<span class="page__word page1__word0" data-word-index="0">a &lt;b&gt; &amp;lt; &#39;&#x41;&#xD800;&#9999999;</span>', "<span id='x' class=\"a page2__word1 b\"\n><b>bold</b> text\n</span>", '<span class="page1__word2"></span>', '<span class="page1__word3">3</span>',
        '<span class="page1__word4">old</span>', '<span class="page1__word04" x>new</span>', '<span class="page1__word6">none</span>', '<span class="xpage1__word5">no</span>',
    ]
    given = [(1, "\n".join(sheet), "".join(spans)), (2, "\n".join(sheet[:1]), "".join(spans[:1])), (3, None, "x"), (4, "", ""), (None, sheet[0], spans[0]), (5, sheet[0], None)]
    pages = spark.createDataFrame(given, "page long, css string, html string")
    got = words.parse(pages)
    want = words.parse_css(pages).alias("c").join(words.parse_html(pages).alias("h"), F.expr("c.page <=> h.page and c.word = h.word")).select("c.*", "h.text")
    assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "regexp_extract" not in got._jdf.queryExecution().toString()
