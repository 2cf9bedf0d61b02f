"""Batch summaries, reviewer decisions, resumed runs, and similarity of stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_summary(diagnosed: DataFrame) -> DataFrame:
    """One row: documents, documents with findings, findings, mean and largest score."""
    return diagnosed.agg(F.count("*").alias("documents"), F.sum((F.col("findings") > 0).cast("long")).alias("with_findings"), F.sum("findings").alias("findings"), F.round(F.avg("signal_score"), 4).alias("mean_score"), F.max("signal_score").alias("max_score"))


def rule_decisions(decided: DataFrame) -> DataFrame:
    """Accepted, rejected and undecided edits for each rule; an edit by several rules (comma-separated) counts for each."""
    e = decided.select(F.explode(F.split("rules", ",")).alias("rule"), "decision")
    n = lambda d: F.sum((F.col("decision") == d).cast("long")).alias(d)
    return e.groupBy(F.trim("rule").alias("rule")).agg(n("accepted"), n("rejected"), n("undecided"))


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """One row, text: the rows as a Markdown table under a title. For reports, whose rows are few."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\\|", "\\\\|"), "\n", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{' --- |' * len(rows.columns)}"
    return rows.select(line.alias("line")).agg(F.concat_ws("\n", F.lit(head), F.sort_array(F.collect_list("line"))).alias("text"))


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items of a batch that an earlier run has not finished."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def backfilled(old: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with missing values taken from fresh ones; values that exist are never overwritten."""
    f = fresh.select(key, *[F.col(c).alias(f"fresh_{c}") for c in columns])
    return old.join(f, key, "left").select(*[c for c in old.columns if c not in columns], *[F.coalesce(c, f"fresh_{c}").alias(c) for c in columns])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def label_similarity(vectors: DataFrame) -> DataFrame:
    """Cosine of each vector to its label's mean direction: vec_id, label, similarity."""
    flat = vectors.select("vec_id", "label", F.posexplode("embedding").alias("k", "x"))
    mean = flat.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))
    j = vectors.join(centre, "label")
    size = lambda v: F.sqrt(dot(v, v))
    return j.select("vec_id", "label", F.round(dot(F.col("embedding"), F.col("c")) / (size(F.col("embedding")) * size(F.col("c"))), 4).alias("similarity"))
