"""Queries on corrections of all nine types, with their SQL; QUERIES and ORACLES hold those of the other modules too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import blocks, fixes, profiles
from quire.plans import sql as q
from quire.plans.catalogue import _lines, _toward, query
from quire.plans.final import ORACLES, QUERIES
from quire.plans.more import pick
from quire.sources import adapters as a
from quire.sources.shared import sized

__all__ = ["ORACLES", "QUERIES"]


def some(n: int, at: int, value: str) -> str:
    return f"CASE WHEN e % {n} = {at} THEN {value} END"


CORR = f"""
corr AS (
  SELECT user_id % 25 AS job, e % 211 AS page, ts, e AS seq, {pick(a.NINE, 'e % 9')} AS type, CASE WHEN e % 9 = 8 THEN 1000 + k % 4 ELSE k % 24 END AS block, CASE WHEN e % 9 = 2 AND k % 5 > 0 THEN k % 24 + k % 3 END AS second,
    {some(4, 1, '(e % 50)::DOUBLE')} AS x, {some(5, 1, '(e % 90)::DOUBLE')} AS y, {some(3, 2, '(e % 40)::DOUBLE')} AS w, {some(6, 2, '(e % 4)::DOUBLE')} AS h,
    CASE WHEN e % 9 = 6 OR e % 9 = 8 OR e % 18 = 2 THEN CASE WHEN e % 13 = 0 THEN ' ' ELSE 'fixed ' || e % 13 END END AS text, CASE WHEN e % 9 = 4 OR e % 27 = 2 THEN {pick(['h1', 'h2', 'h3', 'artifact', 'p', 'img'], 'k % 6')} END AS tag,
    {some(8, 4, '(e % 12 + 10)::DOUBLE')} AS size, {some(7, 3, "'Font B'")} AS font, {some(11, 5, "'bold'")} AS weight, {some(13, 2, "'#123456'")} AS color, {some(16, 2, '0.5::DOUBLE')} AS confidence, {some(5, 2, 'e % 2 = 0')} AS indented,
    CASE WHEN e % 9 = 7 AND e % 5 < 4 THEN (e % 30)::DOUBLE END AS text_indent, {some(14, 7, '2.0::DOUBLE')} AS padding_left, {some(15, 7, '1.2::DOUBLE')} AS line_height, {some(17, 7, "'right'")} AS text_align,
    {', '.join(some(19, 4, f'(e % {20 + i})::DOUBLE') + f' AS crop_{c}' for i, c in enumerate('xywh'))}
  FROM (SELECT *, event_id AS e, event_id // 9 AS k FROM events))"""

NAMES = list(fixes.FIELDS)


def _lit(value: object) -> str:
    return {bool: lambda v: str(v).lower(), str: lambda v: f"'{v}'"}.get(type(value), lambda v: f"{v}::DOUBLE")(value)


def _step(name: str) -> str:
    """A field of the block after one more fix."""
    patched = f"coalesce(v.{name}, s.{name})"
    if name.startswith("crop_"):
        own = name[-1]
        patched = f"CASE WHEN coalesce(v.crop_x, s.crop_x) IS NOT NULL AND coalesce(v.x, v.y, v.w, v.h) IS NOT NULL THEN coalesce(v.{own}, s.{own}) ELSE {patched} END"
    merged = f"coalesce(v.{name}, {_lit(fixes.MERGED[name])})" if name in fixes.MERGED else f"coalesce(v.{name}, v.base_{name})"
    return f"CASE v.type WHEN 'merge' THEN {merged} WHEN 'create-group' THEN v.{name} WHEN 'delete' THEN s.{name} ELSE CASE WHEN s.alive THEN {patched} ELSE s.{name} END END"


HELD = f"""
held AS (
  SELECT page, ln::BIGINT AS id, x, y, w, h, text, CASE WHEN ln % 13 = 5 THEN 'img' ELSE 'p' END AS tag, size, 'Arial' AS font, 'normal' AS weight, '#111111' AS color, 0.9::DOUBLE AS confidence, ln % 4 = 0 AS indented, 0.0::DOUBLE AS text_indent, 0.0::DOUBLE AS padding_left, 1.3::DOUBLE AS line_height, 'left' AS text_align,
    {', '.join(f"CASE WHEN ln % 13 = 5 THEN {c} END AS crop_{c}" for c in 'xywh')} FROM lines),
named AS (SELECT DISTINCT page, (seq // 9) % 31 AS id FROM corr WHERE type = 'create-group'),
firsts AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY page ORDER BY id) = 1),
touches AS (
  SELECT c.*, c.block AS id FROM corr c
  UNION ALL SELECT c.* REPLACE ('delete' AS type), second FROM corr c WHERE type = 'merge' AND second IS NOT NULL AND second <> block),
numbered AS MATERIALIZED (
  SELECT t.*, row_number() OVER (PARTITION BY t.page, t.id ORDER BY t.seq) AS n, {', '.join(f'CASE WHEN o.id IS NOT NULL THEN o.{f} ELSE f.{f} END AS base_{f}' for f in NAMES)}
  FROM touches t LEFT JOIN held o ON o.page = t.page AND o.id = t.id LEFT JOIN firsts f ON f.page = t.page),
states AS (
  SELECT k.page, k.id, 0::BIGINT AS n, o.id IS NOT NULL AND m.id IS NULL AS alive, {', '.join(f'o.{f}' for f in NAMES)}
  FROM (SELECT page, id FROM held UNION SELECT page, id FROM touches) k LEFT JOIN held o ON o.page = k.page AND o.id = k.id LEFT JOIN named m ON m.page = k.page AND m.id = k.id
  UNION ALL
  SELECT s.page, s.id, v.n, CASE v.type WHEN 'merge' THEN true WHEN 'create-group' THEN true WHEN 'delete' THEN false ELSE s.alive END, {', '.join(_step(f) for f in NAMES)}
  FROM states s JOIN numbered v ON v.page = s.page AND v.id = s.id AND v.n = s.n + 1),
ends AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY n DESC) = 1)"""


@query("q37_fix_application", q.with_(q.TOKENS, q.LINES, CORR, HELD, recursive=True) + f"SELECT page, id, {', '.join(NAMES)} FROM ends WHERE alive AND (coalesce(tag = 'img', false) OR trim(coalesce(text, '')) <> '' AND coalesce(w, 0) >= 1 AND coalesce(h, 0) >= 1)")
def q37(s, d):
    ln = F.col("ln")
    lines = _lines(s, d).withColumns({"id": ln.cast("long"), "seq": ln.cast("long")})
    crop = {f"crop_{c}": F.when(ln % 13 == 5, F.col(c)) for c in "xywh"}
    held = lines.withColumns({
        "tag": F.when(ln % 13 == 5, "img").otherwise("p"), "font": F.lit("Arial"), "weight": F.lit("normal"), "color": F.lit("#111111"), "confidence": F.lit(0.9), "indented": ln % 4 == 0, "text_indent": F.lit(0.0), "padding_left": F.lit(0.0),
        "line_height": F.lit(1.3), "text_align": F.lit("left"), **crop,
    })
    given = a.corrections(a.table(s, d, "events"))
    # groups name the blocks that their words came from
    sources = given.where("type = 'create-group'").select("page", F.array(F.concat(F.lit("word:"), ((F.col("seq") / 9).cast("long") % 31).cast("string"), F.lit(":0:0"))).alias("sources"))
    named = blocks.named_sources(sources).select("page", F.col("id").try_cast("long").alias("id"), F.lit(True).alias("suppressed")).where("id IS NOT NULL")
    marked = held.join(sized(named, "named"), ["page", "id"], "left").withColumn("suppressed", F.col("suppressed").isNotNull())
    return fixes.applied(marked, given)


def _learning(s: SparkSession, d: str) -> DataFrame:
    e = F.col("seq")
    text = lambda *n: F.concat(F.lit("x"), (e % n[0]).cast("string"), F.lit("é"), (e % n[1]).cast("string"), F.lit("tail"))
    return a.corrections(a.table(s, d, "events")).select(
        F.col("job").alias("fingerprint"), "ts", "seq", "type", (e % 11 - 5).cast("double").alias("dx"), (e % 7 - 3).cast("double").alias("dy"), "tag", "size", "indented", "x", F.lit(4.0).alias("margin"), (e % 10 - 5).cast("double").alias("prev_dy"), "text_indent",
        text(3, 5).alias("before"), F.concat(text(4, 6), F.lit("!")).alias("after"),
    )


def _profile(name: str) -> str:
    """A profile's field after one more fix."""
    fresh, merge = f"p.{name}", "type = 'merge'"
    cases = {
        "offset_x": [("type = 'move' AND abs(dx) > 2", _toward("p.offset_x", "p.offset_x + dx"))],
        "offset_y": [("type = 'move' AND abs(dy) > 2", _toward("p.offset_y", "p.offset_y + dy"))],
        "drift": [("type = 'move' AND abs(dy) > 2", _toward("p.drift", "p.drift + dy"))],
        "para_offset": [(f"{merge} AND indented", _toward("p.para_offset", "coalesce(x, 0.0) - 4.0")), ("type = 'style-change' AND text_indent IS NOT NULL", _toward("p.para_offset", "coalesce(x - 4.0, 0.0)"))],
        "x_gap": [(f"{merge} AND NOT coalesce(indented, false)", _toward("p.x_gap", "p.x_gap + 2")), ("type = 'split'", _toward("p.x_gap", "greatest(1.0, p.x_gap - 2)"))],
        "y_band": [(f"{merge} AND NOT coalesce(indented, false) AND abs(prev_dy) > p.y_band", _toward("p.y_band", "abs(prev_dy)"))],
        **{h: [(f"type = 'tag-change' AND tag = '{h}'", _toward(f"p.{h}", "coalesce(size, 12.0)"))] for h in ("h1", "h2", "h3")},
        "artifact": [("type = 'tag-change' AND tag = 'artifact'", _toward("p.artifact", "greatest(0.1, p.artifact - 0.05::DOUBLE)")), ("type = 'delete'", _toward("p.artifact", "greatest(0.1, p.artifact - 0.03::DOUBLE)"))],
        "first_indent": [("type = 'tag-change' AND tag = 'p' AND indented", _toward("p.first_indent", "coalesce(text_indent, 0.0)")), ("type = 'style-change' AND text_indent IS NOT NULL", _toward("p.first_indent", "text_indent"))],
        "default_indent": [("type = 'style-change' AND text_indent IS NOT NULL", _toward("p.default_indent", "text_indent"))],
    }
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases[name]) + f" ELSE {fresh} END"


LEARNED = profiles.FIELDS[1:]
FOLD = f"""
o AS MATERIALIZED (SELECT *, (seq % 11 - 5)::DOUBLE AS dx, (seq % 7 - 3)::DOUBLE AS dy, (seq % 10 - 5)::DOUBLE AS prev_dy, 'x' || seq % 3 || 'é' || seq % 5 || 'tail' AS before, 'x' || seq % 4 || 'é' || seq % 6 || 'tail!' AS after, row_number() OVER (PARTITION BY job ORDER BY ts, seq) AS i FROM corr),
p AS (
  SELECT DISTINCT job, 0::BIGINT AS i, {', '.join(f'{v}::DOUBLE AS {f}' for f, v in zip(LEARNED, profiles.START[1:]))} FROM o
  UNION ALL SELECT o.job, o.i, {', '.join(_profile(f) for f in LEARNED)} FROM p JOIN o ON o.job = p.job AND o.i = p.i + 1),
chars AS (SELECT job, i, unnest(range(1, least(length(before), length(after)) + 1)) AS spot, before, after FROM o WHERE type = 'text-correct'),
taught AS (SELECT job, before[spot] AS src, arg_max(after[spot], i * 100 + spot) AS dst, min(i * 100 + spot) AS place FROM chars WHERE before[spot] <> after[spot] GROUP BY 1, 2),
rules AS (SELECT job, string_agg(src || '>' || dst, ' ' ORDER BY place) AS rules FROM taught GROUP BY 1)"""


@query("q32b_profile_fold_all", q.with_(CORR, FOLD, recursive=True) + f"SELECT job AS fingerprint, i AS samples, {', '.join(LEARNED)}, coalesce(rules, '') AS rules FROM p LEFT JOIN rules USING (job) QUALIFY row_number() OVER (PARTITION BY job ORDER BY i DESC) = 1")
def q32b(s, d):
    text = F.array_join(F.transform("rules", lambda r: F.concat(r["src"], F.lit(">"), r["dst"])), " ")
    return profiles.fold(_learning(s, d)).withColumn("rules", text)
