"""A corpus from raw documents to packed sequences, in stages that each call one operator.

Every stage but the last returns the columns of documents; n_chars follows the text. Documents whose
text becomes empty stay. Each stage's docstring names what it decides.

In all stages a null text is an empty one, texts are read whole whatever their length, other columns are kept
whatever their names, and no rows give no rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, line_dedup, packing, simhash, suffix_dedup
from quire.llm.common import materialise


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """Columns beyond those of documents under names that no stage uses."""
    return docs.toDF(*[c if c in COLUMNS else f"_extra{i}" for i, c in enumerate(docs.columns)])


def _as_before(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars by the text."""
    names = _plain(docs).columns
    if "n_chars" in names:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*names).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those of which no language is more likely than all others together.

    Null and empty texts have no letters and go. Null hosts and declared languages are values of their own; repeated rows are judged each."""
    found = langid.identify_documents(_plain(docs), langid.fit(docs))
    return found.where("accepted").select(*_plain(docs).columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the lines that are boilerplate of their source.

    Null sources are one host, repeated rows pages of their own; a null text stays, as an empty one."""
    return _as_before(line_dedup.dedup_lines(_plain(docs)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of SimHash fingerprints (three-word shingles) that link at 2 or fewer differing bits.

    The smallest id stays, rows without one after all others; of repeated rows one stays. Texts without words are copies of each other."""
    return simhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 200 bytes or more that occur elsewhere.

    Every occurrence goes, also within one text; repeated rows take out each other's text."""
    return _as_before(suffix_dedup.cut_texts(_plain(docs)), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens.

    An empty text is its end token alone; repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("sequences", sequences)]
#: Fingerprints, suffixes and packing go beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
