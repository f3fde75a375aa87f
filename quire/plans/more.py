"""Queries on serialised pages, the editor, fonts, colours and training, with their SQL; QUERIES and ORACLES hold the catalogue's too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import colours, geometry
from quire.functions import text as tx
from quire.functions.numbers import fixed
from quire.operators import blocks, claim, editor, fonts, lines, pages, reviews, styles, words
from quire.plans import sql as q
from quire.plans.catalogue import ORACLES, QUERIES, _boxes, _claimed, _fixes, _fonts, _lines, _words, query
from quire.sources import adapters as a
from quire.sources import files, shared

__all__ = ["ORACLES", "QUERIES"]


def num(value: str, places: int = 2) -> str:
    v = q.r(value, places)
    return rf"regexp_replace(printf('%.{places}f', CASE WHEN {v} = 0 THEN 0.0 ELSE {v} END), '\.?0+$', '')"


def px(value: str, places: int = 2) -> str:
    return f"{num(value, places)} || 'px'"


def pick(names: list[str], at: str) -> str:
    return "[" + ", ".join("NULL" if n is None else "'" + n.replace("'", "''") + "'" for n in names) + f"][{at} + 1]"


def chosen(names: list[str], at) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))


FAMILIES, COLOURS = ["Times New Roman", "Arial", "O'Neil Sans"], ["#123456", "red", "rgb(1, 2, 3)", "#abc"]
ESCAPED = "replace(replace(replace(replace(replace({v}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
STYLED = f"""
styled AS (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY ln, pos) - 1 AS word, {pick(FAMILIES, 'ln % 3')} AS font, CASE WHEN bold THEN 'bold' ELSE 'normal' END AS weight, CASE WHEN pos % 7 = 3 THEN 'italic' ELSE 'normal' END AS style,
    {pick(COLOURS, 'pos % 4')} AS color, CASE WHEN (ln + pos) % 17 = 5 THEN 90.0 WHEN (ln + pos) % 19 = 5 THEN 12.5 WHEN (ln + pos) % 23 = 5 THEN -90.0 WHEN (ln + pos) % 29 = 5 THEN 180.0 ELSE 0.0 END::DOUBLE AS rotation FROM words),
turned AS (
  SELECT *, CASE rotation WHEN 90 THEN x + w WHEN 180 THEN x + w ELSE x END AS tx, CASE rotation WHEN -90 THEN y + h WHEN 180 THEN y + h ELSE y END AS ty, CASE WHEN rotation IN (90, -90) THEN h ELSE w END AS tw, CASE WHEN rotation IN (90, -90) THEN w ELSE h END AS th,
    CASE WHEN regexp_matches(color, '^#[0-9A-Fa-f]{{3,6}}$') OR regexp_matches(color, '(?i)^rgba?\\(') THEN color ELSE '#000000' END AS paint FROM styled)"""


def _styled(s: SparkSession, d: str, cut: Callable[[DataFrame], DataFrame] = a.numbered) -> DataFrame:
    """cut: a.words where nobody asks for a word's number."""
    ln, pos = F.col("ln"), F.col("pos")
    return cut(a.table(s, d, "documents")).withColumns({
        "font": chosen(FAMILIES, ln % 3), "weight": F.when(F.col("bold"), "bold").otherwise("normal"), "style": F.when(pos % 7 == 3, "italic").otherwise("normal"),
        "color": chosen(COLOURS, pos % 4), "rotation": F.when((ln + pos) % 17 == 5, 90.0).when((ln + pos) % 19 == 5, 12.5).when((ln + pos) % 23 == 5, -90.0).when((ln + pos) % 29 == 5, 180.0).otherwise(0.0),
    })


# pages as text

LINE_FONTS = ["Arial", "Arial-Bold", "Heavy Sans"]


@query("q40_span_projection", q.with_(q.TOKENS, q.LINES) + f"SELECT page, ln, x * 2 + 1.5 AS x, y * 2 - 0.5 AS y, w * 2 AS w, h * 2 AS h, coalesce(CASE WHEN ln % 4 < 3 THEN size END, h, 12.0) AS size, CASE WHEN regexp_matches({pick(LINE_FONTS, 'ln % 3')}, '(?i)bold|black|heavy') THEN 'bold' ELSE 'normal' END AS weight FROM lines")
def q40(s, d):
    spans = _lines(s, d).withColumns({"size": F.when(F.col("ln") % 4 < 3, F.col("size")), "font": chosen(LINE_FONTS, F.col("ln") % 3)})
    return pages.project(spans, 2.0, 1.5, -0.5).select("page", "ln", "x", "y", "w", "h", "size", "weight")


RULES = f"""
rules AS (
  SELECT page, word, '<span class="page__word page' || (page + 1) || '__word' || word || '" data-word-index="' || word || '">' || {ESCAPED.format(v='text')} || '</span>' AS html,
    '.page' || (page + 1) || '__word' || word || ' {{ left: ' || {px('tx')} || '; top: ' || {px('ty')} || '; width: ' || {px('tw')} || '; height: ' || {px('th')} || '; font-size: ' || {px('size * 1.5', 3)}
    || '; font-family: ''' || replace(font, '''', '\\''') || ''', serif; font-weight: ' || weight || '; font-style: ' || style || '; color: ' || paint || ';' || CASE WHEN rotation <> 0 THEN ' transform-origin: top left; transform: rotate(' || {num('rotation')} || 'deg);' ELSE '' END || ' }}' AS css FROM turned)"""


@query("q41_word_rules", q.with_(q.TOKENS, STYLED, RULES) + "SELECT page, word, md5(html) AS html, md5(css) AS css FROM rules")
def q41(s, d):
    return pages.word_rules(_styled(s, d), 1.5).select("page", "word", F.md5("html").alias("html"), F.md5("css").alias("css"))


@query("q42_page_round_trip", q.with_(q.TOKENS, STYLED) + f"SELECT page, word, text, {q.r('tx', 2)} AS x, {q.r('ty', 2)} AS y, {q.r('tw', 2)} AS w, {q.r('th', 2)} AS h, {q.r('size * 1.5', 3)} AS size, weight, style, paint AS color FROM turned")
def q42(s, d):
    return words.parse(pages.page_text(pages.word_rules(_styled(s, d), 1.5))).select("page", F.col("word").cast("long").alias("word"), "text", "x", "y", "w", "h", "size", "weight", "style", "color")


SHEET = "'@font-face { font-family: F' || doc_id % 7 || '; src: url(a.woff) }' || chr(10) || '.page { x: y }' || chr(10) || '.page__bg { a: b }' || chr(10) || '.page__word { c: d }' || repeat(chr(10), 4) || '@FONT-FACE{b}' || '.page' || doc_id || '__word0 { left: 1px }' || chr(10) || '.page' || doc_id || '__word12{top:2px}' || chr(10) || '.keep' || doc_id || ' { e: f }' || chr(10)"
TIDY = r"regexp_replace({v}, '\n{{3,}}', chr(10) || chr(10), 'g')"
ENDS = r"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


@query(
    "q43_css_parts",
    f"WITH c AS (SELECT doc_id AS page, {SHEET} AS css FROM documents) SELECT page, "
    + TIDY.format(v=r"regexp_replace(regexp_replace(css, '\n?\.page' || page || '__word[0-9]+\s*\{[^}]*\}\s*', chr(10), 'g'), '\n?\.page__word\s*\{[^}]*\}\s*', chr(10), 'g')") + " AS no_words, "
    + ENDS.format(v=TIDY.format(v=r"regexp_replace(regexp_replace(regexp_replace(css, '\n?\.page__bg\s*\{[^}]*\}\s*', chr(10), 'g'), '\n?\.page__text\s*\{[^}]*\}\s*', chr(10), 'g'), '\n?\.page__word\s*\{[^}]*\}\s*', chr(10), 'g')")) + " AS no_shared, "
    + ENDS.format(v=TIDY.format(v=r"regexp_replace(css, '(?i)@font-face\s*\{[^}]*\}\s*', '', 'g')")) + r" AS no_faces, array_to_string(regexp_extract_all(css, '(?i)@font-face\s*\{[^}]*\}'), '|') AS faces FROM c",
)
def q43(s, d):
    i = F.col("page").cast("string")
    sheet = F.concat(F.lit("@font-face { font-family: F"), (F.col("page") % 7).cast("string"), F.lit("; src: url(a.woff) }\n.page { x: y }\n.page__bg { a: b }\n.page__word { c: d }\n\n\n\n@FONT-FACE{b}.page"), i, F.lit("__word0 { left: 1px }\n.page"), i, F.lit("__word12{top:2px}\n.keep"), i, F.lit(" { e: f }\n"))
    css = F.col("css")
    sheets = a.table(s, d, "documents").select(F.col("doc_id").alias("page")).withColumn("css", sheet)
    return sheets.select("page", pages.without_word_rules(css, F.col("page")).alias("no_words"), pages.without_shared_rules(css).alias("no_shared"), pages.without_font_faces(css).alias("no_faces"), F.array_join(pages.font_faces(css), "|").alias("faces"))


PAINTS = ["#abc", "#AABBCCDD", " rgb(1,2,3) ", "RGBA(1,2", "red", "#12345", "#a1B2c3", None]
BYTE = "least(255, greatest(0, floor(CASE WHEN {v} <= 1 THEN {v} * 255 ELSE {v} END + 0.5)))::INT"


def hex_of(*values: str) -> str:
    return "'#' || " + " || ".join(f"printf('%02x', {BYTE.format(v=f'({v})')})" for v in values)


INK = ["least(1.0, CASE WHEN c[{i}] <= 1 THEN c[{i}] ELSE c[{i}] / 255 END)".format(i=i) for i in range(1, 5)]


@query(
    "q44_colours",
    f"WITH p AS (SELECT p_partkey AS id, {pick(PAINTS, 'p_partkey % 8')} AS v, CASE p_partkey % 5 WHEN 0 THEN []::DOUBLE[] WHEN 1 THEN [p_size / 50.0::DOUBLE] WHEN 2 THEN [p_size / 50.0::DOUBLE, p_size * 4.0::DOUBLE, 0.5::DOUBLE] WHEN 3 THEN [p_size / 60.0::DOUBLE, 0.25::DOUBLE, p_size * 3.0::DOUBLE, 0.1::DOUBLE] END AS c FROM part) "
    + r"SELECT id, CASE WHEN regexp_matches(trim(v), '^#[0-9A-Fa-f]{3,6}$') OR regexp_matches(trim(v), '(?i)^rgba?\(') THEN trim(v) ELSE '#000000' END AS review, CASE WHEN regexp_matches(trim(v), '^#[0-9A-Fa-f]{3,8}$') OR regexp_matches(trim(v), '(?i)^rgba?\([^)]*\)$') THEN trim(v) ELSE '#000000' END AS final, "
    + r"CASE WHEN regexp_matches(trim(v), '^#[0-9A-Fa-f]{6}$') THEN upper(trim(v)) WHEN regexp_matches(trim(v), '^#[0-9A-Fa-f]{3}$') THEN upper('#' || v[2] || v[2] || v[3] || v[3] || v[4] || v[4]) END AS hex, "
    + f"CASE WHEN c IS NULL OR len(c) = 0 THEN '#000000' WHEN len(c) = 1 THEN {hex_of('c[1]', 'c[1]', 'c[1]')} WHEN len(c) = 4 THEN {hex_of(*[f'(1 - {INK[i]}) * (1 - {INK[3]})' for i in range(3)])} ELSE {hex_of('c[1]', 'c[2]', 'c[3]')} END AS channels FROM p",
)
def q44(s, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("double")
    arr = lambda *v: F.array(*[x if isinstance(x, F.Column) else F.lit(x) for x in v])
    sets = F.when(k % 5 == 0, F.array().cast("array<double>")).when(k % 5 == 1, arr(n / 50.0)).when(k % 5 == 2, arr(n / 50.0, n * 4.0, 0.5)).when(k % 5 == 3, arr(n / 60.0, 0.25, n * 3.0, 0.1))
    v = F.col("v")
    rows = a.table(s, d, "part").select(k.alias("id"), chosen(PAINTS, k % 8).alias("v"), sets.alias("c"))
    return rows.select("id", colours.sanitised(v).alias("review"), colours.sanitised(v, True).alias("final"), colours.upper_hex(v).alias("hex"), colours.from_channels(F.col("c")).alias("channels"))


@query(
    "q45_html_runs",
    q.with_(q.TOKENS, q.LINES)
    + "SELECT page, (row_number() OVER (PARTITION BY page ORDER BY ln, part) - 1)::INT AS seq, x, y, CASE WHEN part = 0 THEN '#a0b1c2' END AS color, CASE WHEN part = 0 THEN regexp_replace(text, '<[^>]+>', '', 'g') ELSE 'tail & A' || ln || ' mark  end' END AS text FROM lines, (SELECT unnest([0, 1]) AS part) WHERE ln % 11 <> 7",
)
def q45(s, d):
    ln = F.col("ln").cast("string")
    tags = lambda plain, loud: F.when(F.col("ln") % 3 == 1, loud).otherwise(plain)
    start = F.concat(tags("<p id='a' style=\"top:", '<P STYLE = "TOP: '), pages.number(F.col("y")), tags("pt;left:", "PT; Left :"), pages.number(F.col("x")), tags('pt">', 'Pt;" lang="x">'))
    spans = F.concat(tags('<span style="font-size:9pt; color:#a0b1c2"><b>', '<SPAN class="a" Style="COLOR:#a0b1c2">'), tx.escape_html(F.col("text")), tags("</b></span>", "</SPAN>"), F.lit('<span class="y">unstyled</span><span style="x:y">tail &amp; &#65;'), ln, F.lit(" mark &lt;b&gt; end</span>"))
    one = F.when(F.col("ln") % 11 == 7, F.concat(F.lit("<p>"), spans, F.lit("</p>"))).otherwise(F.concat(start, spans, tags("</p>", "</P>")))
    html = _lines(s, d).withColumn("p", one).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "p"))), lambda r: r["p"]), "\n").alias("html"))
    return pages.runs(html)


CORRECTED = f"""
fixed_by AS (
  SELECT p_partkey AS seq, CASE WHEN p_partkey % 200 = 9 THEN 'book-font-size' WHEN p_partkey % 10 > 6 THEN 'page-font-size' ELSE 'span' END AS scope, p_partkey % 211 AS page, p_size AS word,
    CASE WHEN p_partkey % 3 = 0 THEN 'page' || (p_partkey % 211 + 1) || '__word' || p_size END AS class, {pick(FAMILIES, 'p_partkey % 3')} AS font, 10.0::DOUBLE + 3 * (p_size % 4) + 0.004 * (p_size % 4) AS size, CASE WHEN p_size % 5 = 0 THEN 'Italic' ELSE 'normal' END AS style,
    (p_size % 5 - 2)::DOUBLE AS top, (p_size % 3 - 1)::DOUBLE AS "left", CASE WHEN p_size % 6 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS spacing FROM part),
hits AS (
  SELECT w.page, w.word, c.* EXCLUDE (page, word) FROM turned w JOIN fixed_by c ON c.scope = 'span' AND c.class = 'page' || (w.page + 1) || '__word' || w.word
  UNION ALL SELECT w.page, w.word, c.* EXCLUDE (page, word) FROM turned w JOIN fixed_by c ON c.scope = 'span' AND c.page = w.page AND c.word = w.word AND c.class IS DISTINCT FROM 'page' || (w.page + 1) || '__word' || w.word
  UNION ALL SELECT w.page, w.word, c.* EXCLUDE (page, word) FROM turned w JOIN fixed_by c ON c.scope <> 'span' AND lower(c.font) = lower(replace(w.font, '''', '\\''')) AND lower(c.style) = w.style AND abs(w.size - c.size) < 0.01 AND (c.scope = 'book-font-size' OR c.page = w.page)),
overrides AS (
  SELECT page, word, sum("left") AS dx, sum(top) AS dy, arg_max(spacing, seq) FILTER (WHERE abs(spacing) > 0.001) AS spacing FROM hits GROUP BY page, word
  HAVING abs(sum(top)) >= 0.001 OR abs(sum("left")) >= 0.001 OR count(*) FILTER (WHERE abs(spacing) > 0.001) > 0)"""


def _given(s: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    return a.table(s, d, "part").select(
        k.alias("seq"), F.when(k % 200 == 9, "book-font-size").when(k % 10 > 6, "page-font-size").otherwise("span").alias("scope"), (k % 211).alias("page"), n.cast("long").alias("word"),
        F.when(k % 3 == 0, F.concat(F.lit("page"), (k % 211 + 1).cast("string"), F.lit("__word"), n.cast("string"))).alias("class"), chosen(FAMILIES, k % 3).alias("font"), (10.0 + 3 * (n % 4) + F.lit(0.004) * (n % 4)).alias("size"),
        F.when(n % 5 == 0, "Italic").otherwise("normal").alias("style"), (n % 5 - 2).cast("double").alias("top"), (n % 3 - 1).cast("double").alias("left"), F.when(n % 6 == 0, 0.5).otherwise(0.0).alias("spacing"),
    )


def _rules(s: SparkSession, d: str) -> DataFrame:
    return pages.word_rules(_styled(s, d)).select("page", "word", "css")


def _overrides(s: SparkSession, d: str) -> DataFrame:
    return pages.override_rules(pages.rule_parts(_rules(s, d)).withColumn("at", F.col("word")), _given(s, d))


MOVED = f"""
moved AS (SELECT page, word, {q.r('tx', 2)} + dx AS "left", {q.r('ty', 2)} + dy AS top, spacing,
  '.page' || (page + 1) || '__word' || word || ' {{ left: ' || {px(f"({q.r('tx', 2)} + dx)", 3)} || '; top: ' || {px(f"({q.r('ty', 2)} + dy)", 3)} || '; width: ' || {px('tw')} || '; height: ' || {px('th')} || '; font-size: ' || {px('size', 3)}
    || '; font-family: ''' || replace(font, '''', '\\''') || ''', serif; font-weight: ' || weight || '; font-style: ' || style || '; color: ' || paint || ';' || CASE WHEN rotation <> 0 THEN ' transform-origin: top left; transform: rotate(' || {num('rotation')} || 'deg);' ELSE '' END
    || coalesce(' letter-spacing: ' || {px('spacing', 3)} || ';', '') || ' }}' AS css FROM overrides JOIN turned USING (page, word))"""


@query("q46_override_rules", q.with_(q.TOKENS, STYLED, CORRECTED, MOVED) + 'SELECT page, word, "left", top, spacing, md5(css) AS css FROM moved')
def q46(s, d):
    return _overrides(s, d).select("page", "word", "left", "top", "spacing", F.md5("css").alias("css"))


@query("q46b_affected_pages", q.with_(q.TOKENS, STYLED, CORRECTED) + "SELECT DISTINCT page FROM overrides")
def q46b(s, d):
    before = _rules(s, d).groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("css")), "\n").alias("css"))
    return pages.changed_by(before.withColumn("css", F.concat("css", F.lit("\n"))), _overrides(s, d))


@query(
    "q47_flow_margins",
    q.with_(q.TOKENS)
    + f""", g AS (SELECT page, ln, pos, y, greatest(0.0, lead(x) OVER o - (x + w)) AS gap, min(y) OVER (PARTITION BY page, ln) AS top, lead(pos) OVER o AS nxt FROM words WINDOW o AS (PARTITION BY page, ln ORDER BY x, pos)),
c AS (SELECT page, ln, CASE WHEN max(abs(gap - m)) <= 0.05 THEN any_value(m) END AS common FROM (SELECT *, avg(gap) OVER (PARTITION BY page, ln) AS m FROM g WHERE nxt IS NOT NULL) GROUP BY 1, 2),
r AS (SELECT page, ln AS line, pos AS seq, greatest(0.0, y - top) AS t, CASE WHEN nxt IS NULL THEN 0.0 ELSE greatest(0.0, gap - coalesce(common, 0.0)) END AS rt FROM g LEFT JOIN c USING (page, ln))
SELECT page, line, seq, CASE WHEN t <= 0.05 THEN 0.0 ELSE {q.r('t', 2)} END::DOUBLE AS margin_top, CASE WHEN rt <= 0.05 THEN 0.0 ELSE {q.r('rt', 2)} END::DOUBLE AS margin_right FROM r""",
)
def q47(s, d):
    return pages.flow_margins(_words(s, d).select("page", F.col("ln").alias("line"), F.col("pos").alias("seq"), "x", "y", "w"))


CLAIMED = "own AS (SELECT c.*, s.size, s.font, s.paint AS color FROM claimed c JOIN turned s USING (page, ln, pos))"


@query(
    "q48_equation_style",
    q.with_(q.TOKENS, q.BOXES, q.CLAIMS, STYLED, CLAIMED)
    + f""", t AS (SELECT page, box, max(size) AS most, min(x) AS sx, min(y) AS sy, max(x + w) AS r, max(y + h) AS b, count(*) AS n FROM own GROUP BY 1, 2),
base AS (SELECT o.* FROM own o JOIN t USING (page, box) WHERE o.size >= most * 0.78), m AS (SELECT page, box, median(size) AS med FROM base GROUP BY 1, 2),
fo AS (SELECT page, box, font FROM base GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY sum(greatest(1.0, w * h)) DESC, min(ln * 100000 + pos)) = 1),
co AS (SELECT page, box, color FROM own GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY sum(greatest(1.0, w * h)) DESC, min(ln * 100000 + pos)) = 1),
e AS (SELECT b.*, most, sx, sy, r, t.b AS bottom, n, med, font, color, least(greatest(0.0, b.w - 1), sx - b.x) AS l0, least(greatest(0.0, b.h - 1), sy - b.y) AS t0 FROM boxes b LEFT JOIN t USING (page, box) LEFT JOIN m USING (page, box) LEFT JOIN fo USING (page, box) LEFT JOIN co USING (page, box) WHERE tag = 'equation')
SELECT page, box, {q.r('CASE WHEN n > 0 THEN greatest(6.0, least(greatest(8.0, h * 1.35), med)) ELSE greatest(8.0, h * 0.82) END', 3)} AS size, {q.r('CASE WHEN n > 0 THEN greatest(0.0, l0) ELSE 0.0 END', 3)} AS "left", {q.r('CASE WHEN n > 0 THEN greatest(0.0, t0) ELSE 0.0 END', 3)} AS top,
  {q.r('CASE WHEN n > 0 THEN greatest(1.0, least(greatest(1.0, w - greatest(0.0, l0)), r - sx)) ELSE w END', 3)} AS width, {q.r('CASE WHEN n > 0 THEN greatest(1.0, least(greatest(1.0, h - greatest(0.0, t0)), bottom - sy)) ELSE h END', 3)} AS height, coalesce(color, '#000000') AS color, coalesce(font, '') AS font, CASE WHEN contains(lower(coalesce(font, '')), 'times') THEN '''Times New Roman'', ''Cambria Math'', ''STIX Two Math'', serif' ELSE '''Cambria Math'', ''STIX Two Math'', ''Times New Roman'', serif' END AS css_font, coalesce(n, 0) AS words FROM e""",
)
def q48(s, d):
    looks = _styled(s, d).withColumns({"color": colours.sanitised(F.col("color")), "seq": F.col("ln") * 100000 + F.col("pos")})
    claimed = shared.once(claim.claim(looks, _boxes(s, d)).where("tag = 'equation'"), "claimed")
    return pages.equation_style(_boxes(s, d).where("tag = 'equation'"), claimed.select("page", "box", "seq", "x", "y", "w", "h", "size", "font", "color"))


DECLARED = "declared AS (SELECT page, ln, word AS item, unnest(['font-family', 'font-weight', 'color']) AS key, unnest([font, weight, paint]) AS value FROM turned)"
SHARED = "shared AS (SELECT page, ln, key, min(value) AS value FROM declared d GROUP BY 1, 2, 3 HAVING min(value) = max(value))"


def _looks() -> dict[str, F.Column]:
    return {"font-family": F.col("font"), "font-weight": F.col("weight"), "color": colours.sanitised(F.col("color"))}


def _declared(s: SparkSession, d: str) -> DataFrame:
    given = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in _looks().items()])
    return _styled(s, d).select("page", "ln", F.col("word").alias("item"), F.explode(given).alias("g")).select("page", "ln", "item", "g.*")


def _shared(s: SparkSession, d: str) -> DataFrame:
    return styles.common_looks(_styled(s, d, a.words), ["page", "ln"], ["font", "weight", "color"], _looks())


@query("q49_common_declarations", q.with_(q.TOKENS, STYLED, DECLARED, SHARED) + "SELECT page, ln, key, value FROM shared")
def q49(s, d):
    return _shared(s, d)


@query("q49b_own_declarations", q.with_(q.TOKENS, STYLED, DECLARED, SHARED) + "SELECT page, ln, item, key, value FROM declared d WHERE NOT EXISTS (SELECT 1 FROM shared s WHERE s.page = d.page AND s.ln = d.ln AND s.key = d.key)")
def q49b(s, d):
    return pages.subtracted(_declared(s, d), _shared(s, d), ["page", "ln"])


# blocks, corrections and training


@query("q51_finished_blocks", q.with_(q.TOKENS, q.BOXES) + "SELECT page, box FROM boxes WHERE tag = 'img' OR (CASE WHEN (page + box) % 3 = 0 THEN ' ' WHEN (page + box) % 7 = 0 THEN NULL ELSE 'x' END IS NOT NULL AND trim(CASE WHEN (page + box) % 3 = 0 THEN ' ' ELSE 'x' END) <> '' AND w >= 1 AND h - (page % 31) >= 1)")
def q51(s, d):
    k = F.col("page") + F.col("box")
    return _boxes(s, d).where(blocks.finished(F.when(k % 3 == 0, " ").when(k % 7 != 0, "x"), F.col("tag"), F.col("w"), F.col("h") - F.col("page") % 31)).select("page", "box")


HASH = "abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({v}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) % 10000)"


@query(
    "q52_classified",
    q.with_(q.TOKENS, q.LINES)
    + f"SELECT page, ln AS id, CASE WHEN ln % 3 = 0 THEN 'span' WHEN size >= 18 THEN 'h1' ELSE 'p' END AS tag, CASE WHEN ln % 3 = 0 THEN floor((0.3::DOUBLE * size / 24 + 0.1::DOUBLE * ({HASH.format(v="'block ' || page || ':' || ln")} % 100) / 100 + 0.6::DOUBLE) * 1000 + 0.5) / 1000 ELSE 0.8 END::DOUBLE AS confidence FROM lines",
)
def q52(s, d):
    own = _lines(s, d).select("page", F.col("ln").alias("id"), "size")
    by_rule = own.select("page", "id", F.when(F.col("size") >= 18, "h1").otherwise("p").alias("tag"), F.lit(0.8).alias("confidence"))
    name = F.concat(F.lit("block "), F.col("page").cast("string"), F.lit(":"), F.col("id").cast("string"))
    results = own.where("id % 3 = 0").select("page", "id", F.lit("span").alias("tag"), blocks.classify(F.col("size"), blocks.text_hash(name)).alias("confidence"))
    return blocks.classified(by_rule, results)


@query("q53_suppressed_sources", q.with_(q.TOKENS, q.LINES) + "SELECT page, 'b:' || ln AS id FROM lines l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 97 = l.page % 97 AND p.p_partkey % 40 = l.ln AND p.p_partkey % 6 <> 5)")
def q53(s, d):
    own = _lines(s, d).select("page", F.concat(F.lit("b:"), F.col("ln").cast("string")).alias("id"))
    k = F.col("p_partkey")
    at = F.concat(F.when(k % 6 == 5, "other").otherwise("word"), F.lit(":b:"), (k % 40).cast("string"), F.lit(":1:2"))
    touched = a.table(s, d, "part").select((k % 97).alias("low"), F.array(at, F.lit("word:x")).alias("sources"))
    # a page's sources each once, however many parts name them
    touched = touched.select("low", F.explode("sources").alias("source")).distinct().groupBy("low").agg(F.collect_list("source").alias("sources"))
    named = own.select("page").distinct().withColumn("low", F.col("page") % 97).join(F.broadcast(touched), "low").select("page", "sources")
    return blocks.without_sources(own, named)


KEYED = "keyed AS (SELECT *, p_partkey % 700 AS id, CASE WHEN scope = 'span' AND class IS NOT NULL THEN scope || ':class:' || class WHEN scope = 'span' THEN scope || ':' || page || ':' || word WHEN scope = 'page-font-size' THEN scope || ':' || page || ':' || look ELSE scope || ':' || look END AS key FROM (SELECT f.*, f.seq AS p_partkey, lower(font) || ':' || " + q.r("size", 3) + " || ':' || lower(style) AS look FROM fixed_by f))"


@query("q54_correction_upsert", q.with_(q.TOKENS, STYLED, CORRECTED, KEYED) + "SELECT seq, id, key FROM keyed QUALIFY seq = max(seq) OVER (PARTITION BY key) AND seq = max(seq) OVER (PARTITION BY id)")
def q54(s, d):
    given = _given(s, d).withColumn("id", F.col("seq") % 700)
    keyed = given.withColumn("key", styles.correction_key(*[F.col(c) for c in ("scope", "class", "page", "word", "font", "size", "style")]))
    return styles.upsert(keyed).select("seq", "id", "key")


BAD = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'span' WHEN 1 THEN 'page-font-size' WHEN 2 THEN 'book-font-size' WHEN 3 THEN 'page' END AS scope, CASE p_size % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE p_size::DOUBLE END AS v FROM part"


@query("q55_valid_corrections", f"SELECT id, coalesce(scope IN ('span', 'page-font-size', 'book-font-size') AND isfinite(v), false) AND v IS NOT NULL AS valid FROM ({BAD})")
def q55(s, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    scope = F.when(k % 5 == 0, "span").when(k % 5 == 1, "page-font-size").when(k % 5 == 2, "book-font-size").when(k % 5 == 3, "page")
    v = F.when(n % 7 == 0, float("nan")).when(n % 7 == 1, float("inf")).when(n % 7 != 2, n.cast("double"))
    return a.table(s, d, "part").select(k.alias("id"), styles.valid(scope, v, F.lit(1.0)).alias("valid"))


@query("q56_common_values", q.with_(q.TOKENS, STYLED) + "SELECT page, ln, CASE WHEN min(weight) = max(weight) THEN min(weight) END AS weight, arg_min(weight, pos) AS first, CASE WHEN max(abs(size - s0)) < 0.01 THEN any_value(s0) END AS size FROM (SELECT *, first_value(size) OVER (PARTITION BY page, ln ORDER BY pos) AS s0 FROM styled) GROUP BY 1, 2")
def q56(s, d):
    rows = _styled(s, d)
    return styles.common_text(rows, ["page", "ln"], "weight", "pos").join(styles.common_number(rows, ["page", "ln"], "size", "pos"), ["page", "ln"])


FIXED_TYPES = ["tag-change", "delete", "style-change", "merge", "split", "move"]
SAMPLES = f"""
samples AS (SELECT event_id AS seq, {pick(FIXED_TYPES, 'event_id % 6')} AS type, {pick(['h1', 'p', 'span', None], 'user_id % 4')} AS tag, CASE WHEN event_id % 9 < 8 THEN (10 + event_id % 14)::DOUBLE END AS size, CASE WHEN user_id % 2 = 0 THEN 'bold' ELSE 'normal' END AS weight, 'Font ' || (user_id % 7) AS font,
  (event_id % 600)::DOUBLE AS x, (event_id % 800)::DOUBLE AS y, (event_id % 300)::DOUBLE AS w, (event_id % 40)::DOUBLE AS h, repeat('word ', (event_id % 5)::INT) || event_type AS text, event_id % 8 = 3 AS indented, (event_id % 4 * 6)::DOUBLE AS text_indent, CASE WHEN event_id % 3 = 0 THEN 2.0::DOUBLE END AS padding_left FROM events)"""


def _samples(s: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return a.table(s, d, "events").select(
        e.alias("seq"), chosen(FIXED_TYPES, e % 6).alias("type"), chosen(["h1", "p", "span", None], u % 4).alias("tag"), F.when(e % 9 < 8, (10 + e % 14).cast("double")).alias("size"), F.when(u % 2 == 0, "bold").otherwise("normal").alias("weight"), F.concat(F.lit("Font "), (u % 7).cast("string")).alias("font"),
        *[(e % n).cast("double").alias(c) for c, n in (("x", 600), ("y", 800), ("w", 300), ("h", 40))], F.concat(F.repeat(F.lit("word "), (e % 5).cast("int")), "event_type").alias("text"), (e % 8 == 3).alias("indented"), (e % 4 * 6).cast("double").alias("text_indent"), F.when(e % 3 == 0, 2.0).alias("padding_left"),
    )


@query(
    "q39_training_features",
    q.with_(SAMPLES)
    + """SELECT seq, CASE WHEN type IN ('merge', 'split') THEN 'join' ELSE 'tag' END AS target, CASE type WHEN 'tag-change' THEN coalesce(tag, 'p') WHEN 'delete' THEN 'artifact' WHEN 'style-change' THEN 'p' ELSE type END AS label, coalesce(size, 12.0) AS size, CASE WHEN weight = 'bold' THEN 1.0 ELSE 0.0 END::DOUBLE AS bold,
  (list_sum(list_transform(string_split(font, ''), lambda c: ord(c))) % 1000)::DOUBLE AS font_hash, x, y, w, h, length(text)::DOUBLE AS length, len(list_filter(string_split(text, ' '), lambda t: t <> ''))::DOUBLE AS words, CASE WHEN type = 'style-change' OR indented THEN 1.0 ELSE 0.0 END::DOUBLE AS indented, text_indent, coalesce(padding_left, 0.0) AS padding_left
FROM samples WHERE type IN ('tag-change', 'delete', 'merge', 'split') OR type = 'style-change' AND text_indent > 0""",
)
def q39(s, d):
    return reviews.features(_samples(s, d))


@query("q57_confidence_series", q.with_(q.TOKENS, q.CONFIDENCE) + f"SELECT page, confidence, {q.r('avg(confidence) OVER ()', 2)} AS mean FROM confidence")
def q57(s, d):
    return lines.confidence_series(QUERIES["q12_confidence"](s, d).select("page", "confidence"))


@query("q58_review_state", "WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'move' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'tag-change' ELSE 'text-correct' END AS type FROM events WHERE event_type <> 'view') SELECT type, count(*) AS n, (SELECT bool_or(o_orderstatus IN ('O', 'P')) FROM orders) AS any_open FROM e GROUP BY 1")
def q58(s, d):
    return reviews.pending_summary(_fixes(s, d)).crossJoin(F.broadcast(reviews.any_open(a.jobs(a.table(s, d, "orders")))))  # one row


@query("q59_font_fallback", q.with_(q.FONTS) + "SELECT job, seq, 'found' AS origin FROM fonts WHERE job % 5 <> 0 AND seq % 2 = 0 UNION ALL SELECT job, seq, 'other' FROM fonts f WHERE NOT EXISTS (SELECT 1 FROM fonts o WHERE o.job = f.job AND o.job % 5 <> 0 AND o.seq % 2 = 0)")
def q59(s, d):
    f = _fonts(s, d).select("job", "seq")
    return fonts.fallback(f.where("job % 5 <> 0 and seq % 2 = 0").withColumn("origin", F.lit("found")), f.withColumn("origin", F.lit("other")))


@query("q59b_font_names", q.with_(q.FONTS) + "SELECT seq, regexp_matches(base_font, '(?i)bold|black|heavy|demi') AS bold, regexp_matches(base_font || style, '(?i)italic|oblique') AS italic FROM (SELECT seq, style, base_font || CASE WHEN seq % 4 = 1 THEN 'Demi' ELSE '' END AS base_font FROM fonts)")
def q59b(s, d):
    name = F.concat("base_font", F.when(F.col("seq") % 4 == 1, "Demi").otherwise(""))
    return _fonts(s, d).select("seq", fonts.is_bold(name, demi=True).alias("bold"), fonts.is_italic(F.concat(name, "style")).alias("italic"))


@query("q60_font_rules", "SELECT trim(regexp_replace(rule, '\\s+', ' ', 'g')) AS norm, arg_min(rule, seq) AS rule, min(seq) AS seq FROM (SELECT p_partkey AS seq, '@font-face  {' || repeat(' ', (p_partkey % 3)::INT) || p_brand || chr(10) || '}' AS rule FROM part) GROUP BY 1")
def q60(s, d):
    k = F.col("p_partkey")
    return fonts.merge_rules(a.table(s, d, "part").select(k.alias("seq"), F.concat(F.lit("@font-face  {"), F.repeat(F.lit(" "), (k % 3).cast("int")), "p_brand", F.lit("\n}")).alias("rule")))


# the editor


@query("q61_visible_words", q.with_(q.TOKENS) + "SELECT page, ln, pos FROM words WHERE NOT (pos % 3 = 1 AND ln % 2 = 0)")
def q61(s, d):
    own = _words(s, d).withColumn("id", F.concat_ws(":", F.lit("word"), F.col("page").cast("string"), F.col("ln").cast("string"), F.col("pos").cast("string")))
    return editor.visible(own, own.where("pos % 3 = 1 and ln % 2 = 0").select("id")).select("page", "ln", "pos")


@query("q62_displayed_blocks", q.with_(q.TOKENS, q.BOXES) + "SELECT page, box, list_sort(list_distinct(list_concat([1, 2, box], [box + 1]))) AS hidden, list_sort(list_filter(list_distinct([1, 2, box]), lambda v: v <> box + 1)) AS shown FROM boxes WHERE tag = 'img' OR (page + box) % 3 <> 0")
def q62(s, d):
    k = F.col("box")
    sources = F.when((F.col("page") + k) % 3 != 0, F.array(F.lit("word:a:0:0"))).otherwise(F.array().cast("array<string>"))
    hidden = F.array(F.lit(1), F.lit(2), k)
    own = _boxes(s, d).where(editor.displayed(sources, F.col("tag")))
    return own.select("page", "box", F.sort_array(editor.hide(hidden, F.array(k + 1))).alias("hidden"), F.sort_array(editor.show(hidden, F.array(k + 1))).alias("shown"))


@query("q63_marquee", q.with_(q.TOKENS, q.BOXES) + "SELECT b.box AS drag, w.page, w.ln, w.pos FROM words w JOIN (SELECT page, box, x, y, w - (page % 4) * 60 - 38 AS w, h AS h FROM boxes) b USING (page) WHERE b.w > 3 AND b.h > 3 AND w.x < b.x + b.w AND w.x + w.w > b.x AND w.y < b.y + b.h AND w.y + w.h > b.y")
def q63(s, d):
    drags = _boxes(s, d).select("page", F.col("box").alias("drag"), "x", "y", (F.col("w") - (F.col("page") % 4) * 60 - 38).alias("w"), "h")
    return editor.marquee(_words(s, d), drags).select("drag", "page", "ln", "pos")


@query("q64_union_of_words", q.with_(q.TOKENS, q.BOXES, q.CLAIMS) + "SELECT page, array_to_string(list(word ORDER BY k), ',') AS words FROM (SELECT page, word, min(s * 100000000000 + place) AS k FROM (SELECT page, 1 - box % 2 AS s, ln * 100000 + pos AS place, ln * 100000 + pos AS word FROM claimed UNION ALL SELECT page, 5, ln * 100000 + pos, ln * 100000 + pos FROM words WHERE pos = 0) GROUP BY 1, 2) GROUP BY 1")
def q64(s, d):
    word = F.col("ln") * 100000 + F.col("pos")
    sets = _claimed(s, d).where("box is not null").select("page", (1 - F.col("box") % 2).alias("seq"), word.alias("word")).unionByName(_words(s, d).where("pos = 0").select("page", F.lit(5).alias("seq"), word.alias("word")))
    claims = sets.groupBy("page", "seq").agg(F.array_sort(F.collect_list("word")).alias("words"))
    return editor.union_of_words(claims).select("page", F.array_join(F.transform("words", lambda w: w.cast("string")), ",").alias("words"))


RANK = "coalesce(list_position(['h1', 'h2', 'h3', 'p', 'caption', 'table', 'span'], {v}), 8)"


@query(
    "q65_merged_blocks",
    q.with_(q.TOKENS, q.BOXES)
    + f""", n AS (SELECT *, tag || ' ' || box AS text, 0.5 + (page % 7) / 20.0::DOUBLE + box / 100.0::DOUBLE AS confidence, (page + box) % 3 = 0 AS indented FROM boxes),
p AS (SELECT a.page, a.box AS one, b.box AS two, least(a.x, b.x) AS x, least(a.y, b.y) AS y, greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS w, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS h, (b.x < a.x OR b.x = a.x AND b.y < a.y) AS swap, a.text AS t1, b.text AS t2, a.tag AS g1, b.tag AS g2, least(a.confidence, b.confidence) AS c, a.indented OR b.indented AS indented FROM n a JOIN n b ON a.page = b.page AND b.box = a.box + 1 AND a.box % 2 = 0)
SELECT page, one, two, x, y, w, h, CASE WHEN swap THEN t2 || ' ' || t1 ELSE t1 || ' ' || t2 END AS text, CASE WHEN swap THEN CASE WHEN {RANK.format(v='g2')} <= {RANK.format(v='g1')} THEN g2 ELSE g1 END ELSE CASE WHEN {RANK.format(v='g1')} <= {RANK.format(v='g2')} THEN g1 ELSE g2 END END AS tag, {q.r('c', 3)} AS confidence, indented FROM p""",
)
def q65(s, d):
    k = F.col("box")
    own = _boxes(s, d).select("page", k.alias("id"), "x", "y", "w", "h", F.concat("tag", F.lit(" "), k.cast("string")).alias("text"), "tag", (F.lit(0.5) + (F.col("page") % 7) / F.lit(20.0) + k / F.lit(100.0)).alias("confidence"), ((F.col("page") + k) % 3 == 0).alias("indented"))
    pairs = own.where("id % 2 = 0").select("page", F.col("id").alias("one"), (F.col("id") + 1).alias("two"))
    return editor.merge_pairs(own, pairs)


@query("q66_grouped_words", q.with_(q.TOKENS) + ", l AS (SELECT page, ln // 4 AS grp, ln AS line, string_agg(text, ' ' ORDER BY x, pos) AS text, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b, count(*) AS n FROM words GROUP BY 1, 2, 3) SELECT page, grp, md5(string_agg(text, chr(10) ORDER BY line)) AS text, min(x) AS x, min(y) AS y, max(r) - min(x) AS w, max(b) - min(y) AS h, sum(n)::BIGINT AS words FROM l GROUP BY 1, 2")
def q66(s, d):
    own = _words(s, d).select("page", F.floor(F.col("ln") / 4).alias("grp"), F.col("ln").alias("line"), F.col("pos").alias("seq"), "x", "y", "w", "h", "text")
    return editor.group_words(own).withColumn("text", F.md5("text"))


@query("q66b_relative_words", q.with_(q.TOKENS) + f"SELECT page, ln // 4 AS grp, ln AS line, pos AS seq, {q.r('x - min(x) OVER g', 2)} AS x, {q.r('y - min(y) OVER g', 2)} AS y FROM words WINDOW g AS (PARTITION BY page, ln // 4)")
def q66b(s, d):
    own = _words(s, d).select("page", F.floor(F.col("ln") / 4).alias("grp"), F.col("ln").alias("line"), F.col("pos").alias("seq"), "x", "y", "w", "h", "text")
    return editor.relative(own, editor.group_words(own)).select("page", "grp", "line", "seq", "x", "y")


HANDLES = ["e", "w", "n", "s", "ne", "nw", "se", "sw"]


@query(
    "q67_resized_boxes",
    q.with_(q.TOKENS, q.BOXES)
    + f""", m AS (SELECT *, {pick(HANDLES, '(page + box) % 8')} AS hd, (page * 7 % 401 - 200)::DOUBLE AS dx, (page * 11 % 81 - 40)::DOUBLE AS dy FROM boxes),
z AS (SELECT *, CASE WHEN contains(hd, 'e') THEN greatest(4.0, w + dx) WHEN contains(hd, 'w') THEN greatest(4.0, w - dx) ELSE w END AS nw, CASE WHEN contains(hd, 's') THEN greatest(4.0, h + dy) WHEN contains(hd, 'n') THEN greatest(4.0, h - dy) ELSE h END AS nh FROM m),
r AS (SELECT *, CASE WHEN contains(hd, 'w') THEN x + w - nw ELSE x END AS nx, CASE WHEN contains(hd, 'n') THEN y + h - nh ELSE y END AS ny FROM z)
SELECT page, box, nx AS x, ny AS y, nw AS w, nh AS h, abs(nx - x) > 2 OR abs(ny - y) > 2 AS moved, abs(nx - x) > 0.5 OR abs(ny - y) > 0.5 OR abs(nw - w) > 0.5 OR abs(nh - h) > 0.5 AS resized FROM r""",
)
def q67(s, d):
    page = F.col("page")
    old = geometry.box()
    new = editor.resized(old, chosen(HANDLES, (page + F.col("box")) % 8), (page * 7 % 401 - 200).cast("double"), (page * 11 % 81 - 40).cast("double"))
    return _boxes(s, d).select("page", "box", *[v.alias(c) for v, c in zip(new, "xywh")], editor.moved(old, new).alias("moved"), editor.was_resized(old, new).alias("resized"))


@query("q68_pending_fixes", q.with_(q.REVIEWS) + "SELECT block, type, seq FROM (SELECT job * 1000 + page AS block, type, seq, value > 20 AS changed FROM fixes) QUALIFY row_number() OVER (PARTITION BY block, type ORDER BY seq DESC) = 1 AND changed")
def q68(s, d):
    return editor.pending(_fixes(s, d).select((F.col("job") * 1000 + F.col("page")).alias("block"), "type", "seq", (F.col("value") > 20).alias("changed"))).select("block", "type", "seq")


# geometry and plain values


@query(
    "q69_geometry",
    q.with_(q.TOKENS, q.BOXES)
    + f""", v AS (SELECT *, (page % 41 - 20)::DOUBLE AS dx, (box * 13 + page % 17 - 8)::DOUBLE AS dy, [90.0, 180.0, -90.0, 45.0][box + 1]::DOUBLE AS angle FROM boxes), u AS (SELECT *, degrees(atan2(dy, dx)) AS raw FROM v), n AS (SELECT *, CASE WHEN raw <= -180 THEN raw + 360 ELSE raw END AS deg FROM u)
SELECT page, box, CASE WHEN sqrt(dx * dx + dy * dy) < 0.01 THEN 0.0 WHEN abs(deg) <= 3 THEN 0.0 WHEN abs(deg - 90) <= 3 THEN 90.0 WHEN abs(deg + 90) <= 3 THEN -90.0 WHEN abs(deg - 180) <= 3 OR abs(deg + 180) <= 3 THEN 180.0 ELSE {q.r('deg', 2)} END::DOUBLE AS rotation,
  CASE angle WHEN 90 THEN x + w WHEN 180 THEN x + w ELSE x END AS css_x, CASE angle WHEN -90 THEN y + h WHEN 180 THEN y + h ELSE y END AS css_y, CASE angle WHEN 90 THEN x - h WHEN 180 THEN x - w ELSE x END AS seen_x, CASE angle WHEN -90 THEN y - w WHEN 180 THEN y - h ELSE y END AS seen_y, CASE WHEN angle IN (90, -90) THEN h ELSE w END AS seen_w, least(x, x + dx, x + 5) * 2 + 1 AS quad_x, greatest(0.1, (greatest(x, x + dx, x + 5) - least(x, x + dx, x + 5)) * 2) AS quad_w, greatest(0.1, (greatest(y, y + dy) - least(y, y + dy)) * 2) AS quad_h,
  least(greatest(floor(x), 0), 99)::BIGINT AS crop_x, (least(greatest(ceil(x + w), least(greatest(floor(x), 0), 99) + 1), 100) - least(greatest(floor(x), 0), 99))::BIGINT AS crop_w, least(greatest(x, 0.0), 250.0 - least(greatest(w, 4.0), 250.0)) AS clamped_x FROM n""",
)
def q69(s, d):
    page, k = F.col("page"), F.col("box")
    rows = _boxes(s, d).withColumns({"dx": (page % 41 - 20).cast("double"), "dy": (k * 13 + page % 17 - 8).cast("double"), "angle": F.element_at(F.array(*[F.lit(v) for v in (90.0, 180.0, -90.0, 45.0)]), (k + 1).cast("int"))})
    b, x, y = geometry.box(), F.col("x"), F.col("y")
    placed, seen = geometry.css_box(b, F.col("angle")), geometry.visual_box(b, F.col("angle"))
    quad = geometry.quad_box(F.array(x, y, x + F.col("dx"), y + F.col("dy"), x + 5, y, x, y), 2.0, 1.0, 0.0)
    crop, clamped = geometry.crop(b, F.lit(100), F.lit(100)), geometry.clamped(b, F.lit(250.0), F.lit(250.0))
    return rows.select("page", "box", geometry.rotation(F.col("dx"), F.col("dy")).alias("rotation"), placed[0].alias("css_x"), placed[1].alias("css_y"), seen[0].alias("seen_x"), seen[1].alias("seen_y"), seen[2].alias("seen_w"), quad[0].alias("quad_x"), quad[2].alias("quad_w"), quad[3].alias("quad_h"), crop[0].cast("long").alias("crop_x"), crop[2].cast("long").alias("crop_w"), clamped[0].alias("clamped_x"))


@query(
    "q70_plain_values",
    r"""SELECT p_partkey AS id, least(200.0, 150.0, greatest(72.0, p_size * 5.0)) / 72 AS scale, """
    + ESCAPED.format(v="p_brand || '<&\"'''")
    + r""" AS html, replace(replace('a\' || p_name || '''', '\', '\\'), '''', '\''') AS css, coalesce(nullif(substring(regexp_replace(regexp_replace(p_brand || '/x', '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 8), ''), 'file') AS slug, p_size % 3 = 0 OR p_size % 5 = 0 AND p_size % 3 <> 0 AS flag, CASE WHEN p_retailprice / 2000 >= 0.85 THEN 'good' WHEN p_retailprice / 2000 >= 0.6 THEN 'warn' ELSE 'low' END AS band,
CASE WHEN (p_partkey % 2 = 0) THEN 'p' ELSE 'h1' END = 'p' AND NOT (p_size % 4 = 0) AND abs(p_size - 20.0) < 8 AS indent FROM part""",
)
def q70(s, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    option = F.when(n % 3 == 0, "TRUE").when(n % 5 == 0, "1").otherwise("0")
    indent = blocks.default_indent(F.when(k % 2 == 0, "p").otherwise("h1"), n % 4 == 0, n.cast("double"), F.lit(20.0), 6.0) == 6.0
    return a.table(s, d, "part").select(
        k.alias("id"), geometry.scale_for(n * 5.0).alias("scale"), tx.escape_html(F.concat("p_brand", F.lit("<&\"'"))).alias("html"), tx.escape_css(F.concat(F.lit("a\\"), "p_name", F.lit("'"))).alias("css"),
        tx.slug(F.concat("p_brand", F.lit("/x")), 8).alias("slug"), files.truthy(option).alias("flag"), lines.band(F.col("p_retailprice") / 2000).alias("band"), indent.alias("indent"),
    )


@query("q71_line_heights", q.with_(q.TOKENS, q.LINES) + "SELECT page, ln, greatest(0.0, coalesce(lead(y) OVER (PARTITION BY page ORDER BY y, ln), y + h) - y) AS height FROM lines")
def q71(s, d):
    return lines.line_heights(_lines(s, d)).select("page", "ln", "height")


@query("q72_editor_tolerance", q.with_(q.TOKENS) + "SELECT page, greatest(3.0, avg(h) * 0.55) AS tolerance FROM words GROUP BY 1")
def q72(s, d):
    return lines.editor_tolerance(_words(s, d))
