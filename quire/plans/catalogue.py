"""Queries and their SQL, by name. Each query runs its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.numbers import fixed
from quire.operators import blocks, claim, fonts, lines, ocr, profiles, reviews, styles, tables
from quire.plans import sql as q
from quire.sources import adapters as a
from quire.sources.shared import once, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, statement: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if statement:
            ORACLES[name] = statement
        return f

    return put


def _words(s: SparkSession, d: str) -> DataFrame:
    return a.words(a.table(s, d, "documents"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return a.document_lines(a.table(s, d, "documents"))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    return a.boxes(a.table(s, d, "documents"))


def _claimed(s: SparkSession, d: str) -> DataFrame:
    return claim.claim(_words(s, d), _boxes(s, d))


def _fixes(s: SparkSession, d: str) -> DataFrame:
    return a.fixes(a.table(s, d, "events"))


def _visits(s: SparkSession, d: str) -> DataFrame:
    return a.visits(a.table(s, d, "events"))


def _fonts(s: SparkSession, d: str) -> DataFrame:
    return a.fonts(a.table(s, d, "part"))


# claims


@query("q01_claim", q.with_(q.TOKENS, q.BOXES, q.CLAIMS) + f"SELECT page, ln, pos, box, tag, {q.r('ratio', 4)} AS ratio FROM claimed")
def q01(s, d):
    return _claimed(s, d).where("box is not null").select("page", "ln", "pos", "box", "tag", fixed(F.col("ratio"), 4).alias("ratio"))


@query("q02_box_words", q.with_(q.TOKENS, q.BOXES, q.CLAIMS) + "SELECT page, box, count(*) AS n_words, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, string_agg(text, ' ' ORDER BY ln, pos) AS text FROM claimed GROUP BY 1, 2")
def q02(s, d):
    return claim.per_box(_claimed(s, d))


@query("q03_leftover", q.with_(q.TOKENS, q.BOXES, q.CLAIMS) + "SELECT page, count(*) AS n, sum(length(text)) AS chars FROM words v WHERE NOT EXISTS (SELECT 1 FROM claimed c WHERE c.page = v.page AND c.ln = v.ln AND c.pos = v.pos) GROUP BY 1")
def q03(s, d):
    return _claimed(s, d).where("box is null").groupBy("page").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "q16_alignment",
    q.with_(q.TOKENS, q.BOXES, q.CLAIMS)
    + """, per AS (SELECT page, box, ln, min(x) AS l, max(x + w) AS r, max(bx) AS bx, max(bw) AS bw FROM claimed GROUP BY 1, 2, 3),
off AS (SELECT page, box, avg(abs((l + r) / 2 - bx - bw / 2)) AS c, avg(abs(l - bx)) AS le, avg(abs(bx + bw - r)) AS ri, abs((min(l) + max(r)) / 2 - max(bx + bw / 2)) AS whole, max(greatest(4.0, least(18.0, bw * 0.08))) AS tol FROM per GROUP BY 1, 2)
SELECT page, box, CASE WHEN c <= tol AND c < le AND c < ri THEN 'center' WHEN ri <= tol AND ri < le THEN 'right' WHEN whole <= tol AND c < le THEN 'center' ELSE 'left' END AS align FROM off""",
)
def q16(s, d):
    return claim.alignment(_claimed(s, d), _boxes(s, d))


@query("q31_reading_order", q.with_(q.BOXES) + "SELECT page, box, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN box = 1 THEN NULL ELSE -reading_order END NULLS LAST, box) AS reading_order FROM boxes")
def q31(s, d):
    moved = _boxes(s, d).withColumn("reading_order", F.when(F.col("box") != 1, -F.col("reading_order")))
    return claim.reading_order(moved, ["page"]).select("page", "box", F.col("reading_order").cast("long").alias("reading_order"))


# reviews


@query(
    "q04_edit_summary",
    q.with_(q.REVIEWS)
    + """SELECT job, count(*) FILTER (WHERE edit) AS edits, count(DISTINCT page) FILTER (WHERE NOT edit) AS reviewed, count(DISTINCT page) FILTER (WHERE edit) AS edited,
  count(DISTINCT page) FILTER (WHERE NOT edit AND NOT hit) AS accurate, count(DISTINCT reviewer) AS reviewers, max(ts) FILTER (WHERE edit) AS last_edit
FROM (SELECT *, event_type <> 'view' AS edit, bool_or(event_type <> 'view') OVER (PARTITION BY job, page) AS hit FROM seen) GROUP BY 1""",
)
def q04(s, d):
    return reviews.summary(_fixes(s, d), _visits(s, d))


@query("q05_edits_by_page", q.with_(q.REVIEWS) + "SELECT job, page, count(*) AS edits FROM fixes GROUP BY 1, 2")
def q05(s, d):
    return reviews.by_page(_fixes(s, d))


@query("q06_edits_by_type", q.with_(q.REVIEWS) + f"SELECT j.job, t.type, count(f.seq) AS edits FROM (SELECT DISTINCT job FROM fixes) j CROSS JOIN (SELECT unnest({reviews.TYPES}) AS type) t LEFT JOIN fixes f ON f.job = j.job AND f.type = t.type GROUP BY 1, 2")
def q06(s, d):
    return reviews.by_type(_fixes(s, d))


@query("q07_pages_accurate", q.with_(q.REVIEWS) + "SELECT job, page FROM visits EXCEPT SELECT job, page FROM fixes")
def q07(s, d):
    return reviews.accurate_pages(_fixes(s, d), _visits(s, d))


@query("q08_latest_visits", q.with_(q.REVIEWS) + "SELECT job, page, reviewer, ts, seq FROM latest")
def q08(s, d):
    return reviews.latest_visits(_visits(s, d))


@query("q08b_last_visited", q.with_(q.REVIEWS) + "SELECT job, arg_max(page, (ts, seq)) AS last_page FROM latest GROUP BY 1")
def q08b(s, d):
    return reviews.last_visited(_visits(s, d))


@query(
    "q38_job_list",
    q.with_(q.REVIEWS)
    + """, e AS (SELECT job, count(*) FILTER (WHERE event_type <> 'view') AS edits, count(DISTINCT page) FILTER (WHERE event_type = 'view') AS reviewed FROM seen GROUP BY 1),
l AS (SELECT job, arg_max(page, (ts, seq)) AS last_page FROM latest GROUP BY 1)
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' WHEN 'F' THEN 'done' ELSE 'failed' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS updated,
  coalesce(edits, 0) AS edits, coalesce(reviewed, 0) AS reviewed, last_page
FROM orders LEFT JOIN e ON e.job = o_orderkey % 25 LEFT JOIN l ON l.job = o_orderkey % 25""",
)
def q38(s, d):
    return reviews.job_list(a.jobs(a.table(s, d, "orders")).withColumn("job", F.col("id") % 25), _fixes(s, d), _visits(s, d)).withColumn("updated", F.date_format("updated", "yyyy-MM-dd"))


# lines and measures


@query("q09_left_margin", q.with_(q.TOKENS) + "SELECT page, margin::DOUBLE AS margin FROM (SELECT page, floor(x / 4 + 0.5) * 4 AS margin, count(*) AS n, min((ln, pos)) AS first FROM words GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, first) = 1")
def q09(s, d):
    return lines.left_margin(_words(s, d))


@query(
    "q10_lines",
    q.with_(
        q.TOKENS,
        """
ordered AS (SELECT page, ln, pos, y, row_number() OVER (PARTITION BY page ORDER BY y, ln, pos) AS i FROM words),
walk AS (SELECT page, ln, pos, i, y AS anchor, 0 AS line FROM ordered WHERE i = 1
  UNION ALL SELECT o.page, o.ln, o.pos, o.i, CASE WHEN o.y - w.anchor > 3 THEN o.y ELSE w.anchor END, CASE WHEN o.y - w.anchor > 3 THEN w.line + 1 ELSE w.line END FROM walk w JOIN ordered o ON o.page = w.page AND o.i = w.i + 1)""",
        recursive=True,
    )
    + "SELECT page, ln, pos, line FROM walk",
)
def q10(s, d):
    return lines.anchor_lines(_words(s, d).select("page", "ln", "pos", "y")).select("page", "ln", "pos", "line")


@query("q11_line_stats", q.with_(q.TOKENS) + f", g AS (SELECT *, x - lag(x + w) OVER (PARTITION BY page, ln ORDER BY x, ln, pos) AS gap FROM words) SELECT page, ln, count(*) AS words, {q.r('coalesce(stddev_pop(y), 0)', 4)} AS spread, {q.r('avg(gap)', 4)} AS gap FROM g GROUP BY 1, 2")
def q11(s, d):
    return lines.line_stats(_words(s, d))


def _confidence(s: SparkSession, d: str) -> DataFrame:
    w = _words(s, d)
    pages = w.groupBy("page").agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"))
    blocks = w.select("page", F.col("ln").alias("line"), F.col("pos").alias("seq"), "x", "y", "w", "h", "size", F.length("text").alias("length"), F.lit(False).alias("indented"), F.lit(0.0).alias("text_indent"))
    return lines.confidence(blocks, pages)


@query("q12_confidence", q.with_(q.TOKENS, q.CONFIDENCE) + "SELECT page, confidence, CASE WHEN confidence >= 0.85 THEN 'good' WHEN confidence >= 0.6 THEN 'warn' ELSE 'low' END AS band FROM confidence")
def q12(s, d):
    return _confidence(s, d).withColumn("band", lines.band(F.col("confidence")))


@query(
    "q13_segments",
    q.with_(
        q.TOKENS,
        """
g AS (SELECT *, x - lag(x + w) OVER (PARTITION BY page, ln ORDER BY x, pos) AS gap FROM words),
limits AS (SELECT page, ln, greatest(12.0, median(h) * 0.75, median(size) * 0.85, coalesce(median(gap) FILTER (WHERE gap > 0), 0) * 2.4) AS lim FROM g GROUP BY 1, 2)""",
    )
    + "SELECT page, ln, count(*) FILTER (WHERE gap > lim) + 1 AS segments, sum(CASE WHEN gap > lim THEN pos ELSE 0 END) AS places FROM g JOIN limits USING (page, ln) GROUP BY 1, 2",
)
def q13(s, d):
    cut = lines.segments(_words(s, d))
    first = cut.groupBy("page", "ln", "segment").agg(F.min("pos").alias("pos"))
    return first.groupBy("page", "ln").agg(F.count("*").alias("segments"), F.sum(F.when(F.col("segment") > 0, F.col("pos")).otherwise(0)).alias("places"))


@query(
    "q14_medians_dominant",
    q.with_(q.TOKENS)
    + ", t AS (SELECT page, size, sum(greatest(1.0, w * h)) AS area, min((ln, pos)) AS first FROM words GROUP BY 1, 2), b AS (SELECT page, size AS dominant FROM t QUALIFY row_number() OVER (PARTITION BY page ORDER BY area DESC, first) = 1) SELECT page, median(size) AS size, median(w) AS width, any_value(dominant) AS dominant FROM words JOIN b USING (page) GROUP BY 1",
)
def q14(s, d):
    return lines.medians(_words(s, d)).join(lines.dominant(_words(s, d), "size").withColumnRenamed("size", "dominant"), "page")


# text


DAMAGED_SQL = """
dirty AS (SELECT doc_id, ['â€™ ', 'ﬁﬂ ', '� ', chr(7) || '️', 'Â© ', 'A B C ', ''][doc_id % 7 + 1] || coalesce(text, '') AS text FROM documents)"""


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


@query(
    "q17_text_warnings",
    q.with_(DAMAGED_SQL)
    + f"SELECT doc_id, {_count(chr(0xFFFD))} AS replaced, {_count('Ã|Â|â€|ï¿½')} AS mojibake, {_count('[' + chr(0xE000) + '-' + chr(0xF8FF) + ']')} AS private, {_count('[' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0b' + chr(92) + 'x0c' + chr(92) + 'x0e-' + chr(92) + 'x1f' + chr(92) + 'x7f]')} AS control, {_count('[' + chr(0xFE00) + '-' + chr(0xFE0F) + ']')} AS selector FROM dirty",
)
def q17(s, d):
    names = {"replaced": "replacement-character", "mojibake": "mojibake", "private": "private-use", "control": "control-character", "selector": "variation-selector"}
    return a.dirty(a.table(s, d, "documents")).select("doc_id", *[F.regexp_count("text", F.lit(tx.WARNINGS[k])).alias(n) for n, k in names.items()])


@query(
    "q17b_text_repaired",
    q.with_(DAMAGED_SQL)
    + "SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(text, 'â€™', '’'), 'Â©', '©'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '️', ''), chr(7), ''), '[\\t\\n\\x0b\\f\\r  ]+', ' ', 'g'))) AS md5 FROM dirty",
)
def q17b(s, d):
    small_batches(s)  # long texts leave the JVM
    return a.dirty(a.table(s, d, "documents")).select("doc_id", F.md5(tx.normalise(F.col("text"))).alias("md5"))


@query(
    "q18_loose_jaccard",
    f"WITH k AS (SELECT doc_id, {q.loose('text')} AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {q.loose('text')} AS t FROM benchmark) SELECT doc_id, length(k.t) AS chars, {q.r(q.text_score('k.t', 'b.t'), 4)} AS score FROM k JOIN b ON item_id = doc_id % 40",
)
def q18(s, d):
    k = a.table(s, d, "documents").where("text is not null").select("doc_id", tx.loose(F.col("text")).alias("t"))
    b = a.table(s, d, "benchmark").select(F.col("item_id").alias("i"), tx.loose(F.col("text")).alias("bt"))
    return k.join(b, F.col("doc_id") % 40 == F.col("i")).select("doc_id", F.length("t").alias("chars"), fixed(tx.text_score(F.col("t"), F.col("bt")), 4).alias("score"))


@query(
    "q19_html_text",
    "WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM pages) SELECT page_id, length(t) AS chars, md5(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''')) AS md5 FROM t",
)
def q19(s, d):
    t = a.table(s, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("chars"), F.md5(tx.decode_entities(F.col("t"))).alias("md5"))


# reading by OCR


def _ocr(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = _lines(s, d)
    read = a.ocr_lines(own)
    return own, read, ocr.match(own, read)


@query("q20_ocr_match", q.with_(q.TOKENS, q.LINES, q.OCR, q.MATCH) + f"SELECT page, ln, seq, {q.r('score', 4)} AS score FROM matched")
def q20(s, d):
    return _ocr(s, d)[2].select("page", "ln", "seq", fixed(F.col("score"), 4).alias("score"))


@query("q21_ocr_unmatched", q.with_(q.TOKENS, q.LINES, q.OCR, q.MATCH) + "SELECT page, seq, text FROM rest")
def q21(s, d):
    _, read, found = _ocr(s, d)
    return ocr.unmatched(read, found).select("page", "seq", "text")


@query("q22_ocr_score", q.with_(q.TOKENS, q.LINES, q.OCR, q.MATCH, q.SCORES) + "SELECT page, matched, score FROM scores")
def q22(s, d):
    _, read, found = _ocr(s, d)
    return ocr.page_score(found, read)


def _issues(own: DataFrame, read: DataFrame, found: DataFrame) -> DataFrame:
    return ocr.issues(found, ocr.unmatched(read, found), own.groupBy("page").agg(F.max(F.col("y") + F.col("h")).alias("height")))


@query("q23_ocr_issues", q.with_(q.TOKENS, q.LINES, q.OCR, q.MATCH, q.ISSUES) + "SELECT page, n, \"at\", type, severity FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY part, \"at\", kind) AS n FROM issues) WHERE n <= 25")
def q23(s, d):
    own, read, found = _ocr(s, d)
    return ocr.first_issues(_issues(own, read, once(found, "found"))).select("page", "n", "at", "type", "severity")


@query(
    "q24_blended",
    q.with_(q.TOKENS, q.LINES, q.OCR, q.MATCH, q.ISSUES, q.SCORES, q.CONFIDENCE)
    + f"SELECT page, CASE WHEN score IS NULL THEN confidence ELSE {q.r('0.75 * confidence + 0.25 * score', 4)} END AS confidence, CASE WHEN score IS NULL THEN 'unavailable' WHEN coalesce(severe, 0) > 0 OR score < 0.65 THEN 'warning' ELSE 'ok' END AS status FROM confidence LEFT JOIN scores USING (page) LEFT JOIN (SELECT page, count(*) FILTER (WHERE severity = 'high') AS severe FROM issues GROUP BY 1) USING (page)",
)
def q24(s, d):
    own, read, found = _ocr(s, d)
    found = once(found, "found")
    return ocr.blended(_confidence(s, d), ocr.page_score(found, read), _issues(own, read, found))


# fonts


NAMES = "names AS (SELECT DISTINCT 'XYZABC+' || p_brand || CASE WHEN p_partkey % 4 = 0 THEN ' Italic' ELSE '' END AS name FROM part UNION SELECT n_name FROM nation)"


@query(
    "q25_font_resolve",
    q.with_(q.FONTS, NAMES)
    + f""", k AS (SELECT seq, family, {q.key('base_font')} AS key FROM fonts UNION ALL SELECT seq, family, {q.key('family')} FROM fonts),
own AS (SELECT key, arg_min(family, seq) AS family, min(seq) AS seq FROM k GROUP BY 1),
fams AS (SELECT {q.key('family')} AS key, arg_min(family, seq) AS family, min(seq) AS seq FROM fonts GROUP BY 1),
exact AS (SELECT name, {q.key('name')} AS nk, family FROM names LEFT JOIN own ON key = {q.key('name')})
SELECT name, coalesce(family, (SELECT arg_min(o.family, o.seq) FROM fams o WHERE contains(o.key, nk) OR contains(nk, o.key)), {q.clean('name')}) AS family FROM exact""",
)
def q25(s, d):
    part = a.table(s, d, "part").select(F.concat(F.lit("XYZABC+"), "p_brand", F.when(F.col("p_partkey") % 4 == 0, " Italic").otherwise("")).alias("name"))
    return fonts.resolve(part.unionByName(a.table(s, d, "nation").select(F.col("n_name").alias("name"))), _fonts(s, d))


@query(
    "q26_font_faces",
    q.with_(q.FONTS)
    + ", s AS (SELECT *, CASE WHEN regexp_matches(base_font, '(?i)bold|black|heavy') THEN 'bold' ELSE 'normal' END AS weight, CASE format WHEN 'woff2' THEN 1 WHEN 'woff' THEN 2 WHEN 'truetype' THEN 3 ELSE 4 END AS p FROM fonts) SELECT family, weight, style, count(*) AS n, array_to_string(list(format || ':' || seq ORDER BY p, seq), ',') AS sources FROM s GROUP BY 1, 2, 3",
)
def q26(s, d):
    return fonts.faces(_fonts(s, d))


@query("q26b_font_pages", q.with_(q.FONTS) + "SELECT job, lower(family) AS family, format, left(sha256(content), 8) AS hash, min(seq) AS seq, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM fonts GROUP BY 1, 2, 3, 4")
def q26b(s, d):
    return fonts.dedupe(_fonts(s, d))


@query("q27_font_manifest", q.with_(q.FONTS) + "SELECT job, seq, format, 'old' AS origin FROM fonts WHERE seq % 3 <> 0 AND NOT (seq % 5 = 0) UNION ALL SELECT job, seq, format, 'new' FROM fonts WHERE seq % 5 = 0")
def q27(s, d):
    f = _fonts(s, d).select("job", "seq", "format")
    return fonts.merge_manifest(f.where("seq % 3 <> 0").withColumn("origin", F.lit("old")), f.where("seq % 5 = 0").withColumn("origin", F.lit("new")))


@query(
    "q28_fingerprint",
    q.with_(q.FONTS)
    + f""", p AS (SELECT job, page, count(*) || 'x' || min(seq) AS bounds, list_sort(list(DISTINCT {q.clean('base_font')})) AS names FROM fonts GROUP BY 1, 2)
SELECT job, substring(sha256('pageCount=' || count(*) || ';' || coalesce(string_agg(bounds || '|' || array_to_string(names, ','), ';' ORDER BY page) FILTER (WHERE page < 3), '')), 1, 16) AS fingerprint FROM p GROUP BY 1""",
)
def q28(s, d):
    p = _fonts(s, d).groupBy("job", "page").agg(F.concat(F.count("*").cast("string"), F.lit("x"), F.min("seq").cast("string")).alias("bounds"), F.collect_set(fonts.clean_name(F.col("base_font"))).alias("fonts"))
    return fonts.fingerprint(p)


# profiles, styles, corrections, ordered operators


def _learning(s: SparkSession, d: str) -> DataFrame:
    f = _fixes(s, d)
    e = F.col("seq")
    tag = F.when(f["type"] == "tag-change", F.when(e % 3 == 0, "artifact").otherwise("h1"))
    none = lambda k: F.lit(None).cast(k)
    return f.select(
        F.col("job").alias("fingerprint"), "ts", "seq", "type", (e % 11 - 5).cast("double").alias("dx"), (e % 7 - 3).cast("double").alias("dy"), tag.alias("tag"), (e % 12 + 10).cast("double").alias("size"),
        none("boolean").alias("indented"), none("double").alias("x"), none("double").alias("margin"), none("double").alias("prev_dy"), none("double").alias("text_indent"),
    )


def _toward(now: str, new: str) -> str:
    return q.r(f"(0.85::DOUBLE * ({now}) + (1 - 0.85::DOUBLE) * ({new}))", 3)


@query(
    "q32_profile_fold",
    q.with_(
        q.REVIEWS,
        f"""
o AS (SELECT job, seq, type, (seq % 11 - 5)::DOUBLE AS dx, (seq % 7 - 3)::DOUBLE AS dy, (seq % 12 + 10)::DOUBLE AS size, row_number() OVER (PARTITION BY job ORDER BY ts, seq) AS i FROM fixes),
w AS (SELECT job, 0::BIGINT AS i, 0.0::DOUBLE AS ox, 0.0::DOUBLE AS oy, 0.5::DOUBLE AS t, 18.0::DOUBLE AS h1 FROM (SELECT DISTINCT job FROM fixes)
  UNION ALL SELECT o.job, o.i, CASE WHEN type = 'move' AND abs(dx) > 2 THEN {_toward('ox', 'ox + dx')} ELSE ox END, CASE WHEN type = 'move' AND abs(dy) > 2 THEN {_toward('oy', 'oy + dy')} ELSE oy END,
    CASE WHEN type = 'delete' THEN {_toward('t', 'greatest(0.1::DOUBLE, t - 0.03::DOUBLE)')} WHEN type = 'tag-change' AND seq % 3 = 0 THEN {_toward('t', 'greatest(0.1::DOUBLE, t - 0.05::DOUBLE)')} ELSE t END,
    CASE WHEN type = 'tag-change' AND seq % 3 <> 0 THEN {_toward('h1', 'size')} ELSE h1 END
  FROM w JOIN o ON o.job = w.job AND o.i = w.i + 1)""",
        recursive=True,
    )
    + "SELECT job AS fingerprint, i AS samples, ox AS offset_x, oy AS offset_y, t AS artifact, h1 FROM w QUALIFY row_number() OVER (PARTITION BY job ORDER BY i DESC) = 1",
)
def q32(s, d):
    return profiles.fold(_learning(s, d)).select("fingerprint", "samples", "offset_x", "offset_y", "artifact", "h1")


@query("q30_style_ids", q.with_(q.TOKENS) + ", c AS (SELECT 'w' || (page % 5) AS prefix, 'font-size:' || size::INT || ';weight:' || CASE WHEN bold THEN 700 ELSE 400 END AS css, min((page, ln, pos)) AS first FROM words GROUP BY 1, 2) SELECT prefix, css, row_number() OVER (PARTITION BY prefix ORDER BY first, css) AS id FROM c")
def q30(s, d):
    css = F.concat(F.lit("font-size:"), F.col("size").cast("int").cast("string"), F.lit(";weight:"), F.when(F.col("bold"), "700").otherwise("400"))
    w = _words(s, d).select(F.concat(F.lit("w"), (F.col("page") % 5).cast("string")).alias("prefix"), css.alias("css"), F.struct("page", "ln", "pos").alias("seq"))
    return styles.style_ids(w).withColumn("id", F.col("id").cast("long"))


CORRECTIONS = """
corr AS (SELECT CASE event_id % 3 WHEN 0 THEN 'span' WHEN 1 THEN 'page' ELSE 'book' END AS scope, event_id AS seq, user_id AS page, 0 AS ln, event_id % 5 AS pos, 10.0::DOUBLE + event_id % 4 * 3 AS size, event_id % 2 = 0 AS bold, (event_id % 5 - 2)::DOUBLE AS top, (event_id % 7 - 3)::DOUBLE AS lft, (event_id % 4)::DOUBLE / 4 AS spacing FROM events),
c_s AS (SELECT page, ln, pos, sum(top) AS top, sum(lft) AS lft, max((seq, spacing)) FILTER (WHERE spacing > 0) AS last FROM corr WHERE scope = 'span' GROUP BY 1, 2, 3),
c_p AS (SELECT page, size, bold, sum(top) AS top, sum(lft) AS lft, max((seq, spacing)) FILTER (WHERE spacing > 0) AS last FROM corr WHERE scope = 'page' GROUP BY 1, 2, 3),
c_b AS (SELECT size, bold, sum(top) AS top, sum(lft) AS lft, max((seq, spacing)) FILTER (WHERE spacing > 0) AS last FROM corr WHERE scope = 'book' GROUP BY 1, 2)"""


@query(
    "q29_corrections",
    q.with_(q.TOKENS, CORRECTIONS)
    + """SELECT v.page, v.ln, v.pos, coalesce(s.top, 0) + coalesce(p.top, 0) + coalesce(b.top, 0) AS top, coalesce(s.lft, 0) + coalesce(p.lft, 0) + coalesce(b.lft, 0) AS "left",
  coalesce(list_max(list_filter([s.last, p.last, b.last], lambda x: x IS NOT NULL))[2], 0) AS spacing
FROM words v LEFT JOIN c_s s ON s.page = v.page AND s.ln = v.ln AND s.pos = v.pos LEFT JOIN c_p p ON p.page = v.page AND p.size = v.size AND p.bold = v.bold LEFT JOIN c_b b ON b.size = v.size AND b.bold = v.bold""",
)
def q29(s, d):
    e = F.col("event_id")
    c = a.table(s, d, "events").select(
        F.when(e % 3 == 0, "span").when(e % 3 == 1, "page").otherwise("book").alias("scope"), e.alias("seq"), F.col("user_id").alias("page"), F.lit(0).alias("ln"), (e % 5).cast("int").alias("pos"),
        (e % 4 * 3 + 10).cast("double").alias("size"), (e % 2 == 0).alias("bold"), (e % 5 - 2).cast("double").alias("top"), (e % 7 - 3).cast("double").alias("left"), ((e % 4) / 4).cast("double").alias("spacing"),
    )
    return styles.corrected(_words(s, d), c).select("page", "ln", "pos", "top", "left", "spacing")


@query(
    "q15_rule_tags",
    q.with_(q.TOKENS)
    + ", s AS (SELECT page, max(x + w) AS width FROM words GROUP BY 1) SELECT page, CASE WHEN pos = 1 THEN 'p' WHEN size >= 18 THEN 'h1' WHEN size >= 14 THEN 'h2' WHEN size >= 12 THEN 'h3' WHEN w > width / 2 THEN 'p' ELSE 'span' END AS tag, count(*) AS n FROM words JOIN s USING (page) GROUP BY 1, 2",
)
def q15(s, d):
    w = _words(s, d)
    sizes = w.groupBy("page").agg(F.max(F.col("x") + F.col("w")).alias("width"))
    tagged = w.join(sizes, "page").withColumn("tag", blocks.predict_tag(F.lit(0.8), F.col("size"), F.col("w"), F.col("width"), F.col("pos") == 1))
    return tagged.where(blocks.usable(F.col("text"), F.col("tag"), F.col("w"), F.col("h"))).groupBy("page", "tag").agg(F.count("*").alias("n"))


@query("q33_median_lines")
def q33(s, d):
    return lines.median_lines(_words(s, d).select("page", "ln", "pos", "x", "y", "h")).select("page", "ln", "pos", "line")


@query("q34_columns")
def q34(s, d):
    starts = lines.segments(_words(s, d)).groupBy("page", "ln", "segment").agg(F.min("x").alias("x"))
    return lines.column_centres(starts, 8.0)


@query("q35_table_grid")
def q35(s, d):
    return tables.grid(_claimed(s, d).where("tag = 'table'"))


@query("q36_span_merge")
def q36(s, d):
    w = _words(s, d)
    spans = w.join(lines.left_margin(w), "page").select("page", (F.col("ln").cast("long") * 100000 + F.col("pos")).alias("seq"), "margin", "x", "y", "w", "h", "text", "size", F.when(F.col("bold"), "b").otherwise("r").alias("font"), F.lit(0.0).alias("rotation"))
    return blocks.merge_spans(spans, y_band=5.0, x_gap=60.0)
