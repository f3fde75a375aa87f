"""Review logs: edit summaries, visits, accurate pages, job lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: All types of fixes.
TYPES = ["move", "resize", "merge", "split", "tag-change", "text-correct", "style-change", "delete", "create-group"]


def latest_visits(visits: DataFrame) -> DataFrame:
    """One visit for each job and page: the last that was written."""
    last = F.max_by(F.struct("reviewer", "ts", "seq"), "seq").alias("v")
    return visits.groupBy("job", "page").agg(last).select("job", "page", "v.*")


def last_visited(visits: DataFrame) -> DataFrame:
    return latest_visits(visits).groupBy("job").agg(F.max_by("page", F.struct("ts", "seq")).alias("last_page"))


def by_page(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("job", "page").agg(F.count("*").alias("edits"))


def by_type(fixes: DataFrame) -> DataFrame:
    """All types of each job, with 0 where none occurred."""
    counts = fixes.groupBy("job").agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPES])
    return counts.unpivot("job", TYPES, "type", "edits")


def accurate_pages(fixes: DataFrame, visits: DataFrame) -> DataFrame:
    """Pages that were reviewed and not edited."""
    return visits.select("job", "page").distinct().join(fixes.select("job", "page").distinct(), ["job", "page"], "left_anti")


def summary(fixes: DataFrame, visits: DataFrame) -> DataFrame:
    """Counts, pages, reviewers and last time of each job; reviewers are made distinct before they are counted, so no job's are gathered."""
    both = fixes.select("job", "page", "reviewer", "ts", F.lit(1).alias("edit")).unionByName(visits.select("job", "page", "reviewer", "ts", F.lit(0).alias("edit")))
    pages = both.groupBy("job", "page").agg(F.sum("edit").alias("edits"), F.max(1 - F.col("edit")).alias("seen"), F.max(F.when(F.col("edit") == 1, F.col("ts"))).alias("last"))
    people = both.where("reviewer IS NOT NULL").groupBy("job", "reviewer").agg(F.lit(1)).groupBy("job").agg(F.count("*").alias("_reviewers"))
    jobs = pages.groupBy("job").agg(
        F.sum("edits").alias("edits"), F.sum("seen").cast("long").alias("reviewed"), F.count_if(F.col("edits") > 0).alias("edited"), F.count_if((F.col("seen") == 1) & (F.col("edits") == 0)).alias("accurate"),
        F.max("last").alias("last_edit"),
    )
    return jobs.join(people, "job", "left").select("job", "edits", "reviewed", "edited", "accurate", F.coalesce("_reviewers", F.lit(0)).cast("long").alias("reviewers"), "last_edit")


def summary_maps(fixes: DataFrame) -> DataFrame:
    """Edits by page and by type of each job, as maps."""
    pages = by_page(fixes).groupBy("job").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "edits")))).alias("edits_by_page"))
    types = by_type(fixes).groupBy("job").agg(F.map_from_entries(F.collect_list(F.struct("type", "edits"))).alias("edits_by_type"))
    return pages.join(types, "job")


def job_list(jobs: DataFrame, fixes: DataFrame, visits: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """Jobs (id, status, updated, and job, by which reviews name them) with their summary, last visited page and, given drafts (job, page), the pages of those."""
    if drafts is not None:
        held = drafts.select("job", "page").distinct().groupBy("job").agg(F.array_sort(F.collect_list("page")).alias("draft_pages"))
        none = F.array().cast(held.schema["draft_pages"].dataType)
        return job_list(jobs, fixes, visits).join(jobs.select("id", "job"), "id").join(held, "job", "left").drop("job").withColumn("draft_pages", F.coalesce("draft_pages", none))
    return jobs.join(summary(fixes, visits), "job", "left").join(last_visited(visits), "job", "left").select("id", "status", "updated", F.coalesce("edits", F.lit(0)).alias("edits"), F.coalesce("reviewed", F.lit(0)).alias("reviewed"), "last_page")


def training_status(n: int, running: bool = False, every: int = 50) -> dict:
    return {"should_train": n > 0 and n % every == 0 and not running, "next_at": every if n == 0 else -(-n // every) * every}


def pending_summary(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("type").agg(F.count("*").alias("n"))


def any_open(jobs: DataFrame) -> DataFrame:
    """Whether any job is pending or being processed."""
    return jobs.agg(F.coalesce(F.bool_or(F.col("status").isin("pending", "processing")), F.lit(False)).alias("any_open"))


#: The numbers that describe a block for training, in their order.
FEATURES = ["size", "bold", "font_hash", "x", "y", "w", "h", "length", "words", "indented", "text_indent", "padding_left"]


def features(fixes: DataFrame) -> DataFrame:
    """seq, the classifier that a fix teaches (tag or join), its label and FEATURES of the block as the fix leaves it; other fixes teach nothing.

    fixes: seq, type, tag, size, weight, font, x, y, w, h, text, indented, text_indent, padding_left. A delete teaches artifact, by the
    block before it; a style change teaches an indented paragraph if it has an indent over 0."""
    teaches = F.when(F.col("type").isin("tag-change", "delete") | (F.col("type") == "style-change") & (F.col("text_indent") > 0), "tag").when(F.col("type").isin("merge", "split"), "join")
    label = F.when(F.col("type") == "tag-change", F.coalesce("tag", F.lit("p"))).when(F.col("type") == "delete", "artifact").when(F.col("type") == "style-change", "p").otherwise(F.col("type"))
    number = lambda c, default=0.0: F.coalesce(F.col(c).cast("double"), F.lit(default))
    text = F.coalesce("text", F.lit(""))
    made = {
        "size": number("size", 12.0), "bold": F.when(F.col("weight") == "bold", 1.0).otherwise(0.0), "font_hash": (F.aggregate(F.split(F.coalesce("font", F.lit("")), ""), F.lit(0), lambda a, c: a + F.ascii(c)) % 1000).cast("double"),
        "x": number("x"), "y": number("y"), "w": number("w"), "h": number("h"), "length": F.length(text).cast("double"), "words": F.size(F.filter(F.split(text, "\\s+"), lambda t: t != "")).cast("double"),
        "indented": F.when((F.col("type") == "style-change") | F.coalesce("indented", F.lit(False)), 1.0).otherwise(0.0), "text_indent": number("text_indent"), "padding_left": number("padding_left"),
    }
    rows = fixes.withColumns({"target": teaches, "label": label}).where("target is not null")
    return rows.select("seq", "target", "label", *[made[c].alias(c) for c in FEATURES])


def train(rows: DataFrame, target: str, least: int = 20, seed: int = 42) -> dict | None:
    """A boosted or forest classifier of the features of one target: model, accuracy, precision and recall of each label, importances.

    A fifth of the rows, chosen by hash, is held out. Two labels are boosted; more go to a forest. None under least rows, or where either part has no rows."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = rows.where(F.col("target") == target).withColumn("part", F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(5)))
    if rows.count() < least:
        return None
    names = StringIndexer(inputCol="label", outputCol="index").fit(rows)
    held = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(names.transform(rows))
    kind = GBTClassifier if len(names.labels) == 2 else RandomForestClassifier
    model = kind(featuresCol="features", labelCol="index", seed=seed).fit(held.where("part <> 0"))
    counts = model.transform(held.where("part = 0")).groupBy("index", "prediction").agg(F.count("*").alias("n")).collect()  # labels squared at most
    total = sum(r["n"] for r in counts)
    if not total:
        return None
    right = {i: sum(r["n"] for r in counts if r["index"] == r["prediction"] == i) for i in range(len(names.labels))}
    share = lambda i, column: right[i] / max(1, sum(r["n"] for r in counts if r[column] == i))
    scores = {name: (share(i, "prediction"), share(i, "index")) for i, name in enumerate(names.labels)}
    return {"model": model, "labels": names.labels, "accuracy": sum(right.values()) / total, "scores": scores, "importances": dict(zip(FEATURES, model.featureImportances.toArray().tolist()))}
