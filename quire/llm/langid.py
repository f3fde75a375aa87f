"""Language ID by Bayesian evidence fusion.

Evidence is a text's likelihood under a model of hashed byte trigrams for each language, the
language declared in the markup (or a column), and a prior of the page's host, smoothed towards that
of the address suffix, which is smoothed towards that of all pages. How often a declared language
goes with a true one, and the priors, are estimated from the text's posteriors by grouped
aggregation over all rows; a page's own share is taken out of its host's.

The trigram model is fitted on about PER_LABEL labelled rows a language, chosen by hash of text:
a documented bound. All other counts cover all rows. Every label of a text is a language; each
takes a quarter of a MB in a worker.

A null or empty text, or one without letters, has no evidence of its own: it is judged by the rest
and not accepted. Null hosts, suffixes and declared languages are values of their own. Ties go to
the label that sorts first. Repeated rows count each. Very long texts are read whole. Without any
labelled row nothing is fitted: language and posterior are then null, and texts with letters are
accepted, since nothing speaks against them. No rows to judge give no rows. Columns of any name are
kept, but those that are named as an added one are replaced."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, join_sized, materialise, text_array, text_batches

PER_LABEL = 2000
GRAMS = 1 << 16
#: Trigrams overlap and are not independent: a text's log-likelihood is divided by this.
TEMPER = 3.0
PRIOR_PAGES = 10.0
ACCEPT = 0.5

_SCRIPT = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)")


def _grams(text: str) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    v = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (v * np.uint32(2654435761)) >> np.uint32(16)


class Model:
    """Log-probabilities of hashed trigrams by language."""

    def __init__(self, labels: list[str], counts: np.ndarray, rows: np.ndarray):
        self.labels = labels
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)  # gram, label; no label: unfitted
        self.prior = np.log((rows + 1) / (rows + 1).sum())

    def score(self, text: str) -> np.ndarray:
        total = np.zeros(len(self.labels))
        for at in range(0, max(1, len(text)), 1 << 20):  # whole texts, a piece at a time
            total += self.table[_grams(text[at : at + (1 << 20)])].sum(axis=0, dtype=np.float64)
        return total / TEMPER


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> Model:
    bounded_arrow(df.sparkSession)
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("text is not null and text != '' and label is not null")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((GRAMS, 0)), np.zeros(0))
    labels = sorted(sizes)
    share = F.coalesce(*[F.when(F.col("label") == x, F.lit(min(1.0, per_label / sizes[x]))) for x in labels])
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(labels), GRAMS), np.int64)
        place = {x: i for i, x in enumerate(labels)}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts[place[label]] += np.bincount(_grams(text), minlength=GRAMS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts.ravel()[at])], names=["cell", "n"])

    counts = np.zeros(len(labels) * GRAMS)
    for cell, n in some.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # labels x GRAMS cells at most
        counts[cell] = n
    return Model(labels, counts.reshape(len(labels), GRAMS).T, np.array([sizes[x] for x in labels], float))


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1)


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def evidence(df: DataFrame, model: Model, text_col: str, markup: bool = False) -> DataFrame:
    """df with _score (of each label), _own (posterior by text alone), _letters, _markup (the declared language, if markup)."""
    bounded_arrow(df.sparkSession)
    fields = df.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, names[at]):
            texts = text_array(batch.column(names[at])).to_pylist()
            said = [None] * len(texts)
            if markup:
                said = [m[1].lower() if (m := _LANG.search(t)) else None for t in texts]
                texts = [html.unescape(_TAG.sub(" ", _SCRIPT.sub(" ", t))) for t in texts]
            scores = np.array([model.score(t) for t in texts]).reshape(len(texts), len(model.labels))
            z = scores + model.prior
            own = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
            own /= own.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(scores), pa.list_(pa.float64())), pa.array(list(own), pa.list_(pa.float64())), pa.array([any(map(str.isalpha, t)) for t in texts]), pa.array(said, pa.string())], names=[*names, "_score", "_own", "_letters", "_markup"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields))
    out = df.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string")).mapInArrow(run, f"{schema}, _score array<double>, _own array<double>, _letters boolean, _markup string")
    return out.toDF(*df.columns, "_score", "_own", "_letters", "_markup")


def _sums(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("_own")[i]) for i in range(n)]).alias("_sums"), F.count("*").cast("double").alias("_n"))


def _keys(df: DataFrame, host: Column, suffix: Column, declared: Column) -> DataFrame:
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return df.withColumn("_host", empty(host)).withColumn("_suffix", empty(suffix)).withColumn("_declared", F.lower(empty(declared)))


def fuse(rows: DataFrame, gathered: DataFrame, labels: list[str]) -> DataFrame:
    """Adds language, posterior and accepted to rows of evidence; gathered: evidence of all rows, for the priors (_host, _suffix, _declared, _own)."""
    n = len(labels)
    spark = rows.sparkSession
    by = materialise(_sums(gathered, ["_host", "_suffix", "_declared"], n), "sums")  # counts, not rows, from here on

    def up(*cols: str) -> DataFrame:
        return by.groupBy(*cols).agg(F.array(*[F.sum(F.col("_sums")[i]) for i in range(n)]).alias("_sums"), F.sum("_n").alias("_n"))

    whole = up().first()
    total = [x or 0.0 for x in (whole["_sums"] or [0.0] * n)]
    base = [(x + 1.0) / (sum(total) + n) for x in total]
    arr = lambda f: F.array(*[f(i) for i in range(n)])
    suffixes = materialise(up("_suffix").select("_suffix", arr(lambda i: (F.col("_sums")[i] + PRIOR_PAGES * base[i]) / (F.col("_n") + PRIOR_PAGES)).alias("_wide")), "suffixes")
    said = materialise(up("_declared").select("_declared", arr(lambda i: (F.col("_sums")[i] + 0.1) / F.lit(total[i] + 0.1 * 64)).alias("_fit")), "declared")
    hosts = materialise(up("_host").select("_host", F.col("_sums").alias("_of_host"), F.col("_n").alias("_host_n")), "host_sums")
    for table, key in ((suffixes, "_suffix"), (said, "_declared"), (hosts, "_host")):
        rows = join_sized(rows, table, [key], "left")
    prior = lambda i: (F.greatest(F.col("_of_host")[i] - F.col("_own")[i], F.lit(0.0)) + PRIOR_PAGES * F.col("_wide")[i]) / (F.col("_host_n") - 1 + PRIOR_PAGES)
    rows = rows.withColumn("_log", arr(lambda i: F.col("_score")[i] + F.log(F.col("_fit")[i]) + F.log(prior(i))))
    rows = rows.withColumn("_top", F.array_max("_log"))
    mass = F.aggregate("_log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    names = F.array(*[F.lit(x) for x in labels])
    rows = rows.withColumn("language", F.element_at(names, F.array_position("_log", F.col("_top")).cast("int"))).withColumn("posterior", F.lit(1.0) / mass)
    rows = rows.withColumn("accepted", F.col("_letters") & (F.col("posterior") >= ACCEPT))
    return rows.drop("_score", "_own", "_letters", "_markup", "_host", "_suffix", "_declared", "_wide", "_fit", "_of_host", "_host_n", "_log", "_top")


def _unfitted(rows: DataFrame, text: Column) -> DataFrame:
    return rows.withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "accepted": F.coalesce(text.cast("string"), F.lit("")).rlike(r"\p{L}")})


def identify_pages(pages: DataFrame, model: Model, id_col: str = "page_id") -> DataFrame:
    """id_col, language, posterior and accepted for pages of html and url."""
    if not model.labels:
        return _unfitted(pages, F.regexp_replace(F.col("html"), r"(?s)<[^>]*>", " ")).select(id_col, "language", "posterior", "accepted")
    small = pages.select(F.col(id_col), F.col("url").cast("string").alias("_url"), F.col("html").cast("string").alias("_html"))
    host = host_of(F.col("_url"))
    seen = evidence(small, model, "_html", markup=True).drop("_html")
    seen = materialise(_keys(seen, host, suffix_of(host), F.col("_markup")).drop("_url"), "evidence")
    return fuse(seen, seen, model.labels)


def identify_documents(docs: DataFrame, model: Model, text_col: str = "text", host_col: str = "source", declared_col: str = "lang") -> DataFrame:
    """docs with language, posterior and accepted; texts are read twice rather than dealt out."""
    if not model.labels:
        return _unfitted(docs, F.col(text_col))
    columns = docs.columns
    text, host, declared = (f"c{columns.index(c)}" for c in (text_col, host_col, declared_col))
    rows = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    keyed = lambda d: _keys(d, F.col(host), suffix_of(F.col(host)), F.col(declared))
    first = keyed(evidence(rows.select(*dict.fromkeys((text, host, declared))), model, text)).select("_host", "_suffix", "_declared", "_own")
    found = fuse(keyed(evidence(rows, model, text)), first, model.labels)
    added = ("language", "posterior", "accepted")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c not in added], *added)
