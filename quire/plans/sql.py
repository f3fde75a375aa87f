"""The adapters as SQL, and the pieces that several statements share."""

from __future__ import annotations


def r(value: str, places: int) -> str:
    return f"(sign({value}) * floor(abs({value}) * 1e{places} + 0.5) / 1e{places})"


def clamp(value: str) -> str:
    return f"least(1.0, greatest(0.0, {value}))"


TOKENS = """
raw_lines AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents WHERE text IS NOT NULL),
raw_words AS (SELECT page, ln, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS pos FROM raw_lines),
words AS (SELECT page, ln, pos, text, pos * 60.0::DOUBLE AS x, ln * 14.0::DOUBLE + (pos * 7 + ln) % 5 AS y, length(text) * 6.0::DOUBLE AS w, 10.0::DOUBLE AS h, 10.0::DOUBLE + (ln % 4) * 3 AS size, pos % 5 = 0 AS bold FROM raw_words WHERE text <> '')"""
BOXES = """
boxes AS (SELECT doc_id AS page, k AS box, ['p', 'h1', 'table', 'img', 'equation', 'caption'][(doc_id + k) % 6 + 1] AS tag, ((doc_id * 31 + k * 37) % 200)::DOUBLE AS x, k * 28.0::DOUBLE AS y, 220.0::DOUBLE AS w, 30.0::DOUBLE AS h, k + 1 AS reading_order
  FROM documents, (SELECT unnest([0, 1, 2, 3]) AS k))"""
CLAIMS = """
shares AS (
  SELECT v.page, v.ln, v.pos, v.text, v.x, v.y, v.w, v.h, b.box, b.tag, b.reading_order, b.x AS bx, b.y AS by, b.w AS bw, b.h AS bh,
    greatest(0.0, least(v.x + v.w, b.x + b.w) - greatest(v.x, b.x)) * greatest(0.0, least(v.y + v.h, b.y + b.h) - greatest(v.y, b.y)) / greatest(1.0, v.w * v.h) AS ratio,
    v.x + v.w / 2 BETWEEN b.x AND b.x + b.w AND v.y + v.h / 2 BETWEEN b.y AND b.y + b.h AS centre
  FROM words v JOIN boxes b USING (page)),
claimed AS (
  SELECT * FROM shares WHERE CASE WHEN tag IN ('img', 'equation') THEN ratio >= 0.7 OR ratio >= 0.25 AND centre ELSE ratio >= 0.15 END
  QUALIFY row_number() OVER (PARTITION BY page, ln, pos ORDER BY ratio DESC, reading_order) = 1)"""
REVIEWS = """
seen AS (SELECT user_id % 25 AS job, event_id % 211 AS page, user_id AS reviewer, ts, event_id AS seq, event_type, value FROM events),
fixes AS (SELECT *, CASE event_type WHEN 'click' THEN 'move' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'tag-change' ELSE 'text-correct' END AS type FROM seen WHERE event_type <> 'view'),
visits AS (SELECT * FROM seen WHERE event_type = 'view'),
latest AS (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY job, page ORDER BY seq DESC) = 1)"""
LINES = """
lines AS (SELECT page, ln, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, max(size) AS size, string_agg(text, ' ' ORDER BY pos) AS text FROM words GROUP BY 1, 2)"""
OCR = r"""
ocr AS (SELECT page, ln AS seq, x + (ln % 3) * 5.0::DOUBLE AS x, y, w, h, CASE WHEN ln % 5 = 2 THEN regexp_replace(text, '^[^ ]* ?', '') ELSE text END AS text FROM lines WHERE ln % 7 <> 3)"""


def loose(value: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({value}), '[\x{{2018}}\x{{2019}}\x{{201c}}\x{{201d}}]', '''', 'g'), '[\x{{2013}}\x{{2014}}]', '-', 'g'), '[^\p{{L}}\p{{N}}\s''-]', ' ', 'g'), '\s+', ' ', 'g'))"


JACCARD = "len(list_intersect(string_split({a}, ' '), string_split({b}, ' '))) / len(list_distinct(list_concat(string_split({a}, ' '), string_split({b}, ' '))))::DOUBLE"


def text_score(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.82 ELSE {JACCARD.format(a=a, b=b)} END::DOUBLE"


MATCH = f"""
l_b AS (SELECT page, ln, x, y, w, h, size, {loose('text')} AS t FROM lines),
l_o AS (SELECT page, seq, x, y, w, h, {loose('text')} AS t FROM ocr),
geo AS (
  SELECT b.page, b.ln, b.size, o.seq, b.t AS bt, o.t AS ot,
    greatest(0.0, least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x)) * greatest(0.0, least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y)) AS shared, b.w * b.h + o.w * o.h AS area,
    sqrt(power(b.x + b.w / 2 - o.x - o.w / 2, 2) + power(b.y + b.h / 2 - o.y - o.h / 2, 2)) AS far, greatest(b.w, b.h, o.w, o.h, 1.0) AS dim
  FROM l_b b JOIN l_o o USING (page)),
pairs AS (
  SELECT *, greatest(CASE WHEN shared > 0 THEN shared / (area - shared) ELSE 0.0 END, 0.7 * {clamp('1 - far / (2.5 * dim)')}) AS position, {text_score('bt', 'ot')} AS text_score FROM geo),
best AS (
  SELECT page, ln, seq, position, text_score, 0.55 * position + 0.45 * text_score AS score FROM pairs WHERE 0.55 * position + 0.45 * text_score > 0
  QUALIFY row_number() OVER (PARTITION BY page, ln ORDER BY 0.55 * position + 0.45 * text_score DESC, seq) = 1),
matched AS (SELECT b.page, b.ln, b.size AS bsize, m.seq, m.position, m.text_score, m.score FROM l_b b LEFT JOIN best m USING (page, ln)),
rest AS (SELECT o.* FROM ocr o WHERE trim(o.text) <> '' AND NOT EXISTS (SELECT 1 FROM best m WHERE m.page = o.page AND m.seq = o.seq)),
heights AS (SELECT page, max(y + h) AS height FROM lines GROUP BY 1)"""
ISSUES = """
issues AS (
  SELECT page, 0 AS part, ln AS "at", 0 AS kind, CASE WHEN bsize >= 16 THEN 'heading-mismatch' ELSE 'text-mismatch' END AS type, CASE WHEN bsize >= 16 THEN 'high' ELSE 'medium' END AS severity FROM matched WHERE coalesce(text_score, 0) < 0.45
  UNION ALL SELECT page, 0, ln, 1, 'position-mismatch', CASE WHEN coalesce(text_score, 0) > 0.65 THEN 'high' ELSE 'medium' END FROM matched WHERE coalesce(position, 0) < 0.35
  UNION ALL SELECT page, 1, seq, 0, CASE WHEN y < 0.25 * height THEN 'heading-mismatch' ELSE 'missing-text' END, CASE WHEN y < 0.25 * height THEN 'high' ELSE 'medium' END FROM rest JOIN heights USING (page))"""
SCORES = f"""
scores AS (
  SELECT page, matched, {r(clamp('0.45 * t + 0.35 * p + 0.20 * ' + clamp('matched / greatest(blocks, coalesce(n, 0), 1)::DOUBLE')), 4)} AS score
  FROM (SELECT page, count(*) AS blocks, avg(coalesce(text_score, 0)) AS t, avg(coalesce(position, 0)) AS p, count(*) FILTER (WHERE coalesce(text_score, 0) >= 0.45 OR coalesce(position, 0) >= 0.35) AS matched FROM matched GROUP BY 1)
  LEFT JOIN (SELECT page, count(*) AS n FROM ocr GROUP BY 1) USING (page))"""
CONFIDENCE = f"""
gapped AS (SELECT *, x - lag(x + w) OVER (PARTITION BY page, ln ORDER BY x, pos) AS gap, {clamp("1 - abs(w - greatest(1.0, 0.6 * size * length(text))) / greatest(1.0, 0.6 * size * length(text))")} AS fit FROM words),
per_line AS (SELECT page, ln, count(*) AS n, stddev_pop(y) AS dy, coalesce(stddev_pop(gap), 0) AS dx, sum(fit) AS fit, sum(w * h) AS area FROM gapped GROUP BY 1, 2),
sizes AS (SELECT page, max(x + w) AS width, max(y + h) AS height FROM words GROUP BY 1),
confidence AS (
  SELECT page, {r(clamp('0.30 * b + 0.25 * g + 0.25 * f + 0.20 * ' + clamp('area / greatest(1.0, width * height) / 0.28')), 4)} AS confidence
  FROM (SELECT page, avg({clamp('1 - dy / 6')}) AS b, coalesce(avg({clamp('1 - dx / 18.0')}) FILTER (WHERE n > 1), 1.0) AS g, sum(fit) / sum(n) AS f, sum(area) AS area FROM per_line GROUP BY 1) JOIN sizes USING (page))"""
FONTS = """
fonts AS (
  SELECT p_partkey AS seq, p_partkey % 97 AS job, 'ABCDEF+' || replace(p_brand, '#', ' ') || CASE WHEN p_partkey % 3 = 0 THEN '-Bold' ELSE '' END AS base_font, replace(p_brand, '#', ' ') AS family,
    ['woff2', 'woff', 'truetype', 'opentype', 'type1'][p_size % 5 + 1] AS format, CASE WHEN contains(p_type, 'STEEL') THEN 'italic' ELSE 'normal' END AS style, p_size % 10 AS page, p_brand || (p_partkey % 2) AS content FROM part)"""


def clean(value: str) -> str:
    return rf"coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({value}, ''), '^[A-Z]{{6}}\+', ''), '[^A-Za-z0-9_\s-]', ' ', 'g'), '\s+', ' ', 'g')), ''), 'pdffont')"


def key(value: str) -> str:
    return f"lower(regexp_replace({clean(value)}, '[^A-Za-z0-9]', '', 'g'))"


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",".join(parts) + "\n"
