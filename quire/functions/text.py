"""Text normalisation: warnings, replacement maps, repair of mis-decoded text, loose keys."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, in the order in which they apply: mis-decoded sequences and what they stood for.
MOJIBAKE = [
    ("\u00e2\u20ac\u0153", "\u201c"),
    ("\u00e2\u20ac\u009d", "\u201d"),
    ("\u00e2\u20ac\u2122", "\u2019"),
    ("\u00e2\u20ac\u02dc", "\u2018"),
    ("\u00e2\u20ac\u201c", "\u2013"),
    ("\u00e2\u20ac\u201d", "\u2014"),
    ("\u00e2\u20ac\u00a2", "\u2022"),
    ("\u00e2\u20ac\u00a6", "\u2026"),
    ("\u00e2\u2013\u00a0", "\u25a0"),
    ("\u00c2\u00ae", "\u00ae"),
    ("\u00c2\u00a9", "\u00a9"),
    ("\u00c2\u00b0", "\u00b0"),
    ("\u00c2\u00b1", "\u00b1"),
    ("\u00c2\u00b7", "\u00b7"),
    ("\u00c2\u00a0", " "),
    ("\u00c3\u201a\u00c2\u00bb", "\u00bb"),
    ("\u00c3\u00a2\u00e2\u201a\u00ac\u00c2\u009d", "\u201d"),
    ("\u00c3\u00a2\u00e2\u201a\u00ac\u00c5\u201c", "\u201c"),
    ("\u00c3\u00a2\u00e2\u201a\u00ac\u00e2\u201e\u00a2", "\u2019"),
    ("\u00c3\u00a2\u00e2\u201a\u00ac\u00e2\u20ac\u0153", "\u2013"),
    ("\u00c3\u00a2\u00e2\u201a\u00ac\u00e2\u20ac\u009d", "\u2014"),
    ("\u00c3\u00af\u00c2\u00bf\u00c2\u00bd", ""),
]
LIGATURES = [("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st")]
#: Warning types and the characters that they count, before any repair.
WARNINGS = {
    "replacement-character": "\ufffd",
    "mojibake": "\u00c3|\u00c2|\u00e2\u20ac|\u00ef\u00bf\u00bd",
    "private-use": "[\ue000-\uf8ff]",
    "control-character": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]",
    "variation-selector": "[\ufe00-\ufe0f]",
}
SUSPICIOUS = "[\ufffd\ue000-\uf8ff]|\u00c3|\u00c2|\u00e2\u20ac"
SUSPICIOUS_SHARE = 0.08
#: Fixed value: what scripts of the web take for white space.
SPACE = "[\\t\\n\\x0b\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
DAMAGED = "\u00c3[\u0080-\u00bf]|\u00c2[\u0080-\u00bf]|\u00e2[\u20ac\u0080-\u00bf]"


def replace_all(value: Column, table: list[tuple[str, str]]) -> Column:
    for source, target in table:
        value = F.replace(value, F.lit(source), F.lit(target))
    return value


_DAMAGED = re.compile(DAMAGED)


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def latin1_repair(values: pd.Series) -> pd.Series:
    """The text's low bytes read as UTF-8, where that gives a whole text; else the text."""

    def one(x):
        if x is None or not _DAMAGED.search(x):
            return x
        y = bytes(ord(c) & 255 for c in x).decode("utf-8", "replace")
        return x if not y or "\ufffd" in y else y

    return values.map(one)


def units(value: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(value) + F.regexp_count(value, F.lit("[\\x{10000}-\\x{10ffff}]"))


def warning_counts(value: Column) -> Column:
    """array<struct<type, count>> of the warnings that occur."""
    each = F.array(*[F.struct(F.lit(k).alias("type"), F.regexp_count(value, F.lit(p)).alias("count")) for k, p in WARNINGS.items()])
    return F.filter(each, lambda w: w["count"] > 0)


def tidy(value: Column) -> Column:
    """Without selectors and controls, white space squeezed, letter-spaced capitals joined."""
    value = F.regexp_replace(value, WARNINGS["variation-selector"], "")
    value = F.regexp_replace(value, WARNINGS["control-character"], "")
    value = F.trim(F.regexp_replace(value, SPACE + "+", " "))
    return once(value, lambda v: F.when(v.rlike("^(?:[A-Z0-9] +){2,}[A-Z0-9]$"), F.replace(v, F.lit(" "), F.lit(""))).otherwise(v))


def profile_replace(value: Column, entries: Column) -> Column:
    """A profile's replacements (array<struct<src, dst>>), each on the result of those before it."""
    return F.aggregate(F.coalesce(entries, F.array().cast("array<struct<src:string,dst:string>>")), value, lambda a, e: F.when(e["src"] == "", a).otherwise(F.replace(a, e["src"], e["dst"])))


def normalise(value: Column, entries: Column | None = None, unicode: bool = True) -> Column:
    """The whole pipeline; unicode: with composition and repair, which leave the JVM."""
    value = nfc(value) if unicode else value
    value = replace_all(value, MOJIBAKE)
    if unicode:
        value = latin1_repair(value)
    value = replace_all(value, LIGATURES)
    if entries is not None:
        value = profile_replace(value, entries)
    return tidy(nfc(value) if unicode else value)


def suspicious(value: Column) -> Column:
    return F.regexp_count(value, F.lit(SUSPICIOUS)) / F.greatest(units(value), F.lit(1)) >= SUSPICIOUS_SHARE


def replacement_log(value: Column) -> Column:
    """array<struct<source, target, reason>>: a row for each rule that fires, one for each selector or control."""
    now, each = value, []
    for reason, table in (("legacy", MOJIBAKE), ("ligature", LIGATURES)):
        for source, target in table:
            each.append(F.when(F.contains(now, F.lit(source)), F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(reason).alias("reason"))))
            now = F.replace(now, F.lit(source), F.lit(target))
    single = lambda kind, reason: F.transform(F.regexp_extract_all(now, F.lit(f"({WARNINGS[kind]})"), F.lit(1)), lambda c: F.struct(c.alias("source"), F.lit("").alias("target"), F.lit(reason).alias("reason")))
    return F.concat(F.array_compact(F.array(*each)), single("variation-selector", "variation"), single("control-character", "control"))


def loose(value: Column) -> Column:
    """A key for comparing read text: lower case, plain quotes and dashes, letters and digits."""
    value = F.regexp_replace(F.lower(value), "[\u2018\u2019\u201c\u201d]", "'")
    value = F.regexp_replace(value, "[\u2013\u2014]", "-")
    value = F.regexp_replace(value, r"[^\p{L}\p{N}\s'-]", " ")
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two arrays of distinct words."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def text_score(a: Column, b: Column, sets: tuple[Column, Column] | None = None) -> Column:
    """Agreement of two loose texts: 1 if equal or both blank, 0 if one is, 0.82 if one holds the other, else Jaccard.

    sets: their distinct words, where the caller has them."""
    words = sets or tuple(F.array_distinct(F.split(x, " ")) for x in (a, b))
    return (
        F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.82).otherwise(jaccard(*words))
    )


#: Named entities in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]


def decode_entities(value: Column) -> Column:
    """Numeric entities, then the named ones in order (so that &amp;lt; becomes a bracket)."""
    runs = F.split(value, "&#", -1)

    def one(part: Column) -> Column:
        hexa, dec = F.regexp_extract(part, "^x([0-9a-fA-F]{1,6});", 1), F.regexp_extract(part, "^([0-9]{1,7});", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(dec != "", dec).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.concat(F.lit("&#"), part)).otherwise(F.concat(char, F.regexp_replace(part, "^[^;]*;", "")))

    numbers = F.concat(F.get(runs, F.lit(0)), F.array_join(F.transform(F.slice(runs, 2, 1 << 30), one), ""))
    return replace_all(F.when(F.contains(value, F.lit("&#")), numbers).otherwise(value), ENTITIES)


def strip_tags(value: Column) -> Column:
    return F.regexp_replace(value, "<[^>]*>", "")


def escape_html(value: Column) -> Column:
    return replace_all(value, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def escape_css(value: Column) -> Column:
    return replace_all(value, [("\\", "\\\\"), ("'", "\\'")])


def slug(value: Column, most: int = 80, default: str = "file") -> Column:
    value = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(value, 1, most), F.lit("")), F.lit(default))


def css_declarations(body: Column) -> Column:
    """array<struct<key, value>> in order; a key's last value wins at its first place."""
    pairs = F.transform(F.filter(F.split(body, ";"), lambda d: F.instr(d, ":") > 0), lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("key"), F.trim(F.regexp_replace(d, "^[^:]*:", "")).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))
