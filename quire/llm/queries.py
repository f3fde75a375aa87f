"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, filter_audit, langid, langmodel, line_dedup, media, packing, simhash, suffix_dedup, topk, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("source").alias("host"), "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents"), size=3, threshold=2)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(_table(spark, sf_dir, "documents"))
    return langid.identify_pages(_table(spark, sf_dir, "pages"), model).withColumn("posterior", F.round("posterior", 6))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.conversations(turns.unionByName(more))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_bpe, op3_simhash, op4_top_k, op5_packing, op6_lm_scoring, op7_suffix_dedup, op8_language_id, op9_media, op10_warc, op11_chat, op12_filter_audit, op13_vector_codes)}

ORACLES: dict[str, str] = {
    "op1_line_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), seen AS (
  SELECT source, trim(line) AS line, count(DISTINCT r) AS pages FROM l WHERE trim(line) <> '' GROUP BY 1, 2
), total AS (
  SELECT source, count(*) AS n FROM d GROUP BY 1
), bad AS (
  SELECT s.source, s.line FROM seen s JOIN total t ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.pages >= 2 AND s.pages / CAST(t.n AS DOUBLE) > 0.05
), marked AS (
  SELECT l.*, b.line IS NOT NULL AS out FROM l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line) = b.line
), kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT out), '') AS text
  FROM marked GROUP BY 1
)
SELECT d.doc_id, d.source AS host, k.n_lines, k.n_removed, length(k.text) AS kept_chars, md5(k.text) AS kept_md5
FROM kept k JOIN d USING (r)
""",
    "op4_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), a AS (
  SELECT *, regexp_extract_all(text, '!\[[^\[\]\n]*\]\([^()\x00-\x20]+\.((?i:png|jpg|jpeg|gif|webp|bmp))\)') AS images,
    regexp_extract_all(text, '!\[[^\[\]\n]*\]\([^()\x00-\x20]+\.((?i:mp3|wav|ogg|flac))\)') AS sounds,
    regexp_extract_all(text, '!\[[^\[\]\n]*\]\([^()\x00-\x20]+\.((?i:pdf|docx|epub))\)') AS files,
    regexp_replace(text, '!\[[^\[\]\n]*\]\([^()\x00-\x20]+\.((?i:png|jpg|jpeg|gif|webp|bmp|mp3|wav|ogg|flac|pdf|docx|epub))\)', chr(1), 'g') AS bare
  FROM t
), s AS (
  SELECT *, regexp_replace(regexp_replace(bare, '(\[)(\\*/?(INST|SYS|ROLE|DOC)\]|\\*(/TURN|IMG|AUDIO)\])', '\1\\\2', 'g'), '(<)(\\*/?s>)', '\1\\\2', 'g') AS plain,
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 22 + length(regexp_replace(regexp_replace(role, '(\[)(\\*/?(INST|SYS|ROLE|DOC)\]|\\*(/TURN|IMG|AUDIO)\])', '\1\\\2', 'g'), '(<)(\\*/?s>)', '\1\\\2', 'g')) END AS marks
  FROM a
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(marks + length(plain) + 4 * len(images) + 6 * len(sounds) + 4 * len(files)) AS BIGINT) AS formatted_chars,
  CAST(sum(len(images) + len(sounds) + len(files)) AS BIGINT) AS n_attachments,
  CAST(sum(256 * len(images) + 750 * len(sounds) + 512 * len(files)) AS BIGINT) AS attached_tokens
FROM s GROUP BY conv_id
""",
    "op12_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS low FROM d
), g AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
    + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(low < w.doc_id, false) AS INT) AS mask
  FROM w LEFT JOIN g ON g.doc_id = w.doc_id
), c AS MATERIALIZED (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY 1, 2
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits, [a.x, b.x, c.x, d.x, e.x] AS names
  FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
), s AS (
  SELECT filter_order, step, names[step] AS filter, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
    CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
""",
    "op13_vector_codes": """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER (ORDER BY vec_id) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, r, p, q[4 * p + 1] AS a, q[4 * p + 2] AS b, q[4 * p + 3] AS c, q[4 * p + 4] AS d FROM v, (SELECT unnest(range(16)) AS p)
), e0 AS MATERIALIZED (SELECT p, r AS e, a, b, c, d FROM x WHERE r < 64
), n0 AS MATERIALIZED (
  SELECT x.r, x.p, arg_min(e, {d2} * 64 + e) AS e FROM x JOIN e0 y ON x.p = y.p GROUP BY 1, 2
), e1 AS MATERIALIZED ({update0}
), n1 AS MATERIALIZED (
  SELECT x.r, x.p, arg_min(e, {d2} * 64 + e) AS e FROM x JOIN e1 y ON x.p = y.p GROUP BY 1, 2
), e2 AS MATERIALIZED ({update1}
), n2 AS MATERIALIZED (
  SELECT x.r, x.p, min({d2} * 64 + e) AS m FROM x JOIN e2 y ON x.p = y.p GROUP BY 1, 2
), h AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e2
), s AS (
  SELECT r, string_agg(printf('%02x', CAST(m % 64 AS INT)), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM n2 GROUP BY 1
)
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM s JOIN v USING (r), h
""",
}

_D2 = "((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2)::BIGINT"


def _update(n: int) -> str:
    mean = ", ".join(f"CASE WHEN k > 0 THEN (s{i} - ((s{i} % k) + k) % k) // k ELSE y.{i} END AS {i}" for i in "abcd")
    sums = ", ".join(f"CAST(sum({i}) AS BIGINT) AS s{i}" for i in "abcd")
    return f"SELECT y.p, y.e, {mean} FROM e{n} y LEFT JOIN (SELECT x.p, z.e, count(*) AS k, {sums} FROM x JOIN n{n} z ON x.r = z.r AND x.p = z.p GROUP BY 1, 2) t ON t.p = y.p AND t.e = y.e"


ORACLES["op13_vector_codes"] = ORACLES["op13_vector_codes"].format(d2=_D2, update0=_update(0), update1=_update(1))
