"""Fonts: names, formats, look-up, grouping of sources, manifests, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order in which sources of a face are offered, and their CSS formats.
PRIORITY = ["woff2", "woff", "truetype", "opentype", "type1"]
CSS_FORMAT = {"woff2": "woff2", "woff": "woff", "truetype": "truetype", "opentype": "opentype"}


def clean_name(name: Column) -> Column:
    """Without the subset's tag, other characters as spaces."""
    name = F.regexp_replace(F.coalesce(name, F.lit("")), "^[A-Z]{6}\\+", "")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_\\s-]", " "), "\\s+", " "))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("pdffont"))


def key(name: Column) -> Column:
    return F.lower(F.regexp_replace(clean_name(name), "[^A-Za-z0-9]", ""))


def is_bold(name: Column, demi: bool = False) -> Column:
    """demi: as font files are read, where demi counts too."""
    return name.rlike("(?i)bold|black|heavy" + "|demi" * demi)


def is_italic(name: Column) -> Column:
    return name.rlike("(?i)italic|oblique")


def fallback(found: DataFrame, other: DataFrame, by: str = "job") -> DataFrame:
    """found, and the other reading's fonts for those jobs of which found has none."""
    return found.unionByName(other.join(found.select(by).distinct(), by, "left_anti"))


def priority(kind: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), kind)
    return F.when(kind == "type1", 4).when(place == 0, 5).otherwise(place).cast("int")


def css_format(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CSS_FORMAT.items() for x in kv])[kind], kind)


def browser_safe(kind: Column) -> Column:
    return kind.isin(*CSS_FORMAT)


def resolve(names: DataFrame, fonts: DataFrame) -> DataFrame:
    """family for each name: of the first font with that key, else of the first whose family's key holds the name's or is held by it, else the cleaned name.

    names: name. fonts: seq, base_font, family. Exact keys meet in an equi-join; only the rest is tried against the distinct keys, whose number is that of fonts, not of names."""
    own = fonts.select("seq", "family", F.explode(F.array_distinct(F.array(key(F.col("base_font")), key(F.col("family"))))).alias("key")).groupBy("key").agg(F.min_by("family", "seq").alias("family"), F.min("seq").alias("seq"))
    asked = names.select("name", key(F.col("name")).alias("k")).distinct()
    exact = asked.join(own, asked["k"] == own["key"], "left").select("name", "k", F.col("family").alias("exact"))
    left = exact.where("exact is null").select("k").distinct()
    families = fonts.groupBy(key(F.col("family")).alias("key")).agg(F.min_by("family", "seq").alias("family"), F.min("seq").alias("seq"))
    near = left.join(families, F.contains(F.col("key"), F.col("k")) | F.contains(F.col("k"), F.col("key"))).groupBy("k").agg(F.min_by("family", "seq").alias("near"))
    return exact.join(near, "k", "left").select("name", F.coalesce("exact", "near", clean_name(F.col("name"))).alias("family"))


def faces(fonts: DataFrame) -> DataFrame:
    """Sources of each face (family, weight, style) by priority, as one text."""
    weight = F.when(is_bold(F.col("base_font")), "bold").otherwise("normal")
    sources = F.array_sort(F.collect_list(F.struct(priority(F.col("format")).alias("p"), "seq", "format")))
    return fonts.groupBy("family", weight.alias("weight"), "style").agg(F.count("*").alias("n"), F.array_join(F.transform(sources, lambda s: F.concat(s["format"], F.lit(":"), s["seq"].cast("string"))), ",").alias("sources"))


def dedupe(fonts: DataFrame) -> DataFrame:
    """One row for each job, family, format and content (text: what 8 digits of its hash stand for), with all pages that it was found on."""
    return fonts.groupBy("job", F.lower("family").alias("family"), "format", F.substring(F.sha2("content", 256), 1, 8).alias("hash")).agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))


def merge_manifest(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows whose (job, seq, format) is not among the new ones, and the new ones."""
    return existing.join(new, ["job", "seq", "format"], "left_anti").unionByName(new)


def merge_rules(rules: DataFrame) -> DataFrame:
    """The first of the rules that are equal but for white space."""
    return rules.groupBy(F.trim(F.regexp_replace("rule", "\\s+", " ")).alias("norm")).agg(F.min_by("rule", "seq").alias("rule"), F.min("seq").alias("seq"))


def fingerprint(pages: DataFrame, by: str = "job", first: int = 3) -> DataFrame:
    """16 hexadecimal digits over the number of pages and, for the first ones, bounds and sorted font names.

    pages: by, page (from 0), bounds (text), fonts (array of cleaned names)."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("page") < first, F.struct("page", "bounds", F.array_sort(F.array_distinct("fonts")).alias("fonts"))))), lambda s: F.concat(s["bounds"], F.lit("|"), F.array_join(s["fonts"], ","))), ";")
    return pages.groupBy(by).agg(F.substring(F.sha2(F.concat(F.lit("pageCount="), F.count("*").cast("string"), F.lit(";"), parts), 256), 1, 16).alias("fingerprint"))
