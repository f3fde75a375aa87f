"""Words from characters, spans and serialised pages; colours and rotations carried over from other readings."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numbers import fixed
from quire.functions.text import ENTITIES, SPACE, decode_entities, normalise, strip_tags
from quire.sources.shared import small_batches

from .scan import walk

STYLE = ["size", "font", "weight", "style", "color", "rotation"]


def from_chars(chars: DataFrame, unicode: bool = True) -> DataFrame:
    """Words of each line: characters up to white space, bounds in 2 decimals, the first character's style.

    chars: page, line, seq, text, x, y, w, h and STYLE. Words whose normalised text is empty are dropped."""
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(f"^{SPACE}*$")
    order = Window.partitionBy("page", "line").orderBy("seq")
    held = chars.withColumn("_blank", blank).withColumn("word", F.sum(F.col("_blank").cast("int")).over(order)).where("not _blank")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "")
    words = held.groupBy("page", "line", "word").agg(
        text.alias("text"), F.min("seq").alias("seq"), fixed(F.min("x"), 2).alias("x"), fixed(F.min("y"), 2).alias("y"), fixed(F.greatest(F.lit(0.1), F.max(F.col("x") + F.col("w")) - F.min("x")), 2).alias("w"),
        fixed(F.greatest(F.lit(0.1), F.max(F.col("y") + F.col("h")) - F.min("y")), 2).alias("h"), F.min_by(F.struct(*STYLE), "seq").alias("_style"),
    )
    return words.withColumn("text", normalise(F.col("text"), unicode=unicode)).where("text <> ''").select("page", "line", "seq", "text", "x", "y", "w", "h", "_style.*")


def from_spans(spans: DataFrame) -> DataFrame:
    """Words of spans (page, seq, text, x, y, w, h, rotation), each taking its share of the width; a turned span is one word, trimmed."""
    whole = F.coalesce("rotation", F.lit(0.0)) != 0
    tokens = F.when(whole, F.array(F.regexp_replace("text", f"^{SPACE}+|{SPACE}+$", ""))).otherwise(F.split("text", SPACE, -1))
    rows = spans.withColumn("_tokens", tokens).select("*", F.posexplode("_tokens").alias("part", "_token")).where("_token <> ''")
    start = F.when(F.col("part") == 0, 0).otherwise(F.length(F.array_join(F.slice("_tokens", 1, F.greatest(F.col("part"), F.lit(1))), " ")) + 1)
    unit = F.col("w") / F.greatest(F.length("text"), F.lit(1))
    width = F.when(whole, F.col("w")).otherwise(F.greatest(F.lit(2.0), F.length("_token") * unit))
    return rows.select("page", "seq", "part", F.col("_token").alias("text"), (F.col("x") + start * unit).alias("x"), "y", width.alias("w"), "h", "rotation")


def _number(body: F.Column, name: str) -> F.Column:
    found = F.regexp_extract(body, rf"(?:^|[;\s]){name}\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(F.when(found != "", found).cast("double"), F.lit(0.0))


RULE = r"\.page\d+__word(\d+)\s*\{([^}]*)\}"
SPAN = r'<span[^>]*class="[^"]*\bpage\d+__word(\d+)\b[^"]*"[^>]*>([\s\S]*?)</span>'


def _found(column: str, pattern: str, value: str) -> list[F.Column]:
    """i and value: arrays of the words' numbers and of what they have, in order."""
    return [F.regexp_extract_all(column, F.lit(pattern), F.lit(i + 1)).alias(name) for i, name in enumerate(("i", value))]


def _styles() -> list[F.Column]:
    """A rule's (body) place and styles; what is missing is 0, normal or black."""
    named = lambda name, default: F.coalesce(F.nullif(F.trim(F.regexp_extract("body", rf"(?:^|[;\s]){name}\s*:\s*([^;]+)", 1)), F.lit("")), F.lit(default))
    return [*[_number(F.col("body"), css).alias(c) for c, css in (("x", "left"), ("y", "top"), ("w", "width"), ("h", "height"), ("size", "font-size"))], named("font-weight", "normal").alias("weight"), named("font-style", "normal").alias("style"), named("color", "#000000").alias("color")]


def parse_css(pages: DataFrame) -> DataFrame:
    """Words' places and styles from page CSS (page, css): a later rule of the same word wins; what is missing is 0, normal or black."""
    rules = F.arrays_zip(*_found("css", RULE, "body"))
    rows = pages.select("page", F.posexplode(rules).alias("at", "r")).select("page", "at", F.col("r.i").cast("int").alias("word"), F.col("r.body").alias("body"))
    last = rows.groupBy("page", "word").agg(F.max_by("body", "at").alias("body"))
    return last.select("page", "word", *_styles())


def parse_html(pages: DataFrame) -> DataFrame:
    """Words' texts from page HTML (page, html), tags stripped and entities decoded; a later span of the same word wins."""
    spans = F.arrays_zip(*_found("html", SPAN, "text"))
    rows = pages.select("page", F.posexplode(spans).alias("at", "r")).select("page", "at", F.col("r.i").cast("int").alias("word"), decode_entities(strip_tags(F.col("r.text"))).alias("text"))
    return rows.groupBy("page", "word").agg(F.max_by("text", "at").alias("text"))


#: A rule and a span as word_rules() writes them, or as anything else that RULE and SPAN take; the last group of each is what is to be read by parts.
_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"
_PLACED = "".join(f" {css}: {_NUMBER}px;" for css in ("left", "top", "width", "height", "font-size"))
_STYLED = r" font-family: [^;:{}]*; font-weight: ([^;:{}\s]+); font-style: ([^;:{}\s]+); color: (#[0-9A-Fa-f]+|rgba?\([^;:{}]*\));[^{}]*"
_RULES = re.compile(r"\.page\d+__word(\d+)\s*\{(?:" + _PLACED + _STYLED + r"|([^}]*))\}", re.A)
_SPANS = re.compile(r'<span(?: class="page__word page\d+__word(\d+)" data-word-index="\d+">([^<]*)|[^>]*class="[^"]*\bpage\d+__word(\d+)\b[^"]*"[^>]*>([\s\S]*?))</span>', re.A)
_NUMBERS = [re.compile(rf"(?:^|[;\s]){css}\s*:\s*{_NUMBER}", re.A) for css in ("left", "top", "width", "height", "font-size")]
_NAMES = [(re.compile(rf"(?:^|[;\s]){css}\s*:\s*([^;]+)", re.A), default) for css, default in (("font-weight", "normal"), ("font-style", "normal"), ("color", "#000000"))]
_TAG = re.compile("<[^>]*>")
_ENTITY = re.compile("&#(?:x([0-9a-fA-F]{1,6})|([0-9]{1,7}));")
#: Words of a batch that parse() hands on.
_AT_ONCE = 10_000


def _read(body: str) -> tuple[str, ...]:
    """A rule's place and styles, whatever their order; what is missing is 0, normal or black."""
    numbers = [m.group(1) if (m := r.search(body)) else "0" for r in _NUMBERS]
    return (*numbers, *[(m.group(1).strip(" ") if (m := r.search(body)) else "") or default for r, default in _NAMES])


def _entity(m: re.Match) -> str:
    code = int(m.group(1), 16) if m.group(1) else int(m.group(2))
    return m.group(0) if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def _shown(text: str) -> str:
    """strip_tags() and decode_entities() of a span's inside."""
    text = _TAG.sub("", text)
    if "&#" in text:
        text = _ENTITY.sub(_entity, text)
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return text


def _page_words(css: str, html: str) -> tuple[Sequence[int], list[Sequence[str]], Sequence[str]]:
    """Numbers, styles (a sequence a property) and texts of the words that rules and spans both have; of several the last."""
    rules, spans = list(zip(*_RULES.findall(css))), list(zip(*_SPANS.findall(html)))
    if not rules or not spans:
        return [], [[]] * 8, []
    numbers, named, inside = list(map(int, rules[0])), spans[0], spans[1]
    if not all(named):
        named, inside = map(str.__add__, named, spans[2]), list(map(str.__add__, inside, spans[3]))
    named = list(map(int, named))
    styles = rules[1:9]
    if not all(rules[1]):
        styles = list(zip(*[r[:8] if r[0] else _read(r[8]) for r in zip(*rules[1:])]))
    if numbers != named or len(set(numbers)) < len(numbers):
        last, texts = dict(zip(numbers, zip(*styles))), dict(zip(named, inside))
        numbers = [n for n in last if n in texts]
        styles, inside = list(zip(*[last[n] for n in numbers])) or [[]] * 8, [texts[n] for n in numbers]
    return numbers, styles, [_shown(v) if "&" in v or "<" in v else v for v in inside]


def parse(pages: DataFrame) -> DataFrame:
    """Words that both the CSS and the HTML of a page (page, css, html; a row a page) know: parse_css() and parse_html() met by word.

    A page is read once in each, in its row. Rules as word_rules() writes them are taken by one pattern, others declaration by declaration."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page"].dataType
    names = ["page", "word", "x", "y", "w", "h", "size", "weight", "style", "color", "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[] for _ in names]
            for i, (css, html) in enumerate(zip(batch["css"], batch["html"])):
                if css.is_valid and html.is_valid:
                    numbers, styles, texts = _page_words(css.as_py(), html.as_py())
                    for column, more in zip(held, (repeat(i, len(numbers)), numbers, *styles, texts)):
                        column.extend(more)
                if held[0] and (len(held[0]) >= _AT_ONCE or i + 1 == len(batch)):
                    at, number, *places, weight, style, color, text = held
                    columns = [batch["page"].take(pa.array(at)), pa.array(number, pa.int32()), *[pa.array(p).cast(pa.float64()) for p in places], *[pa.array(c) for c in (weight, style, color, text)]]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    held = [[] for _ in names]

    return pages.select("page", "css", "html").mapInArrow(read, f"page {kind.simpleString()}, word int, x double, y double, w double, h double, size double, weight string, style string, color string, text string")


def rotations(lines: DataFrame, hints: DataFrame, near: float = 2.0) -> DataFrame:
    """lines with the rotation of the first hint (page, seq, char, x, y, rotation) with the same first character within reach."""
    first = F.substring(F.regexp_replace("text", f"^{SPACE}+", ""), 1, 1)
    own = lines.withColumn("_char", first)
    h = hints.select(F.col("page").alias("_page"), F.col("char").alias("_hint"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("seq").alias("_seq"), F.col("rotation").alias("_turn"))
    met = own.join(h, (own["page"] == h["_page"]) & (own["_char"] == h["_hint"]) & (F.abs(own["x"] - h["_x"]) <= near) & (F.abs(own["y"] - h["_y"]) <= near))
    best = met.groupBy("page", "seq").agg(F.min_by("_turn", "_seq").alias("rotation"))
    return lines.drop("rotation").join(best, ["page", "seq"], "left")


def colours(lines: DataFrame, runs: DataFrame, attempts: int = 12, unicode: bool = True) -> DataFrame:
    """color of each line (page, seq, text, x, y) from runs (page, seq, text, x, y, color), both read in order with one cursor.

    A line tries the runs after the cursor, at most attempts; each one tried is spent, whether it matches or not. The first with the same text
    gives its colour; without one the nearest that holds the text or is held by it does. Blank lines try none, blank runs count as tries.

    Both tables are one sorted stream, a page's lines before its runs: a page's open lines are held, no run is."""
    kind = lines.schema["page"].dataType.simpleString()
    text = normalise(F.coalesce("text", F.lit("")), unicode=unicode)
    shared = ["page", F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    own = lines.select(*shared, F.lit(0).alias("tag"), text.alias("text"), F.lit(None).cast("string").alias("color")).where("text <> ''")
    both = own.unionByName(runs.select(*shared, F.lit(1).alias("tag"), text.alias("text"), "color"))

    def each(page, rows):
        waiting: deque[tuple] = deque()
        tried, far, found = 0, None, None
        for _, seq, x, y, tag, words, color in rows:
            if tag == 0:
                waiting.append((seq, x, y, words))
                continue
            if not waiting:
                continue
            line, lx, ly, mine = waiting[0]
            tried += 1
            done = words == mine
            if done:
                found = color
            elif words and (words in mine or mine in words) and None not in (x, y, lx, ly):
                off = abs(x - lx) + 2 * abs(y - ly)
                if far is None or off < far:
                    far, found = off, color
            if done or tried == attempts:
                yield page, line, found
                waiting.popleft()
                tried, far, found = 0, None, None
        for line, *_ in waiting:
            yield page, line, found
            found = None

    found = walk(both, ["page"], ["tag", "seq"], each, f"page {kind}, seq long, color string")
    return lines.drop("color").join(found, ["page", "seq"], "left")
