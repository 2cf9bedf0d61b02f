"""Reference profiles built from a corpus, calibration against them, and the review of answers.

All of it reads the document table (`documents.document_table`), so the texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import documents, metrics

THRESHOLD, BAND, FLOOR = 0.25, 0.035, 0.5
FAMILIES = documents.FAMILIES
# Metrics that are compared, the side on which they exceed, and their weights.
SIGNALS = [("sentence_length_cv", "low", 1.5), ("sentence_burstiness", "low", 1.0), ("sentence_entropy", "low", 1.0), ("paragraph_shape_cv", "low", 1.0), ("mean_sentence_words", "low", 0.5), ("connective_density", "high", 1.0)]


def exceedance_high(observed: Column, p95: Column) -> Column:
    t = F.greatest(p95, F.lit(FLOOR))
    return F.when(observed <= t, 0.0).otherwise(F.round(F.least(F.lit(1.0), (observed - t) / t), 4))


def exceedance_low(observed: Column, p50: Column) -> Column:
    return F.when((p50 <= 0) | (observed >= p50), 0.0).otherwise(F.round(F.least(F.lit(1.0), (p50 - observed) / (0.5 * p50)), 4))


def observations(table: DataFrame) -> DataFrame:
    """row, doc_id, half, signal, value of each document with words: family rates (0 where it lacks the family) and metrics."""
    names = [s for s, _, _ in SIGNALS] + ["opening_diversity"]
    rate = lambda f: F.round(F.size(F.filter("found", lambda x: x["family"] == f)) / F.col("words") * 1000, 4)
    values = [F.struct(F.lit(f"family:{f}").alias("signal"), rate(f).alias("value")) for f in FAMILIES] + [F.struct(F.lit(n).alias("signal"), F.col(n).alias("value")) for n in names]
    return table.where("words > 0").select("row", "doc_id", half().alias("half"), F.explode(F.array(*values)).alias("o")).select("row", "doc_id", "half", "o.signal", "o.value")


def half() -> Column:
    """The half that a document is of: odd ids and all others."""
    return F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))


def reference_profile(table: DataFrame, *by: str) -> DataFrame:
    """signal and its distribution over the documents (or over those of each half); paragraph shape counts only where positive."""
    o = observations(table).where("signal <> 'paragraph_shape_cv' OR value > 0")
    return o.groupBy(*by, "signal").agg(*metrics.distribution(F.col("value")))


def crossed(table: DataFrame) -> DataFrame:
    """Each document's observations beside the profile of the half it is not of."""
    profile = reference_profile(table, "half").withColumn("half", ~F.col("half"))
    return observations(table).join(F.broadcast(profile), ["half", "signal"])  # at most two rows for each signal


def exceedances(table: DataFrame) -> DataFrame:
    """row, doc_id, signal, observed, baseline, exceedance, weight of each document's signals, against the other half's profile."""
    o = crossed(table)
    weight = F.when(F.col("signal").startswith("family:"), 1.0)
    side = F.when(F.col("signal").startswith("family:"), "high")
    for name, s, w in SIGNALS:
        weight, side = weight.when(F.col("signal") == name, w), side.when(F.col("signal") == name, s)
    o = o.withColumn("weight", weight.otherwise(0.0)).withColumn("side", side.otherwise("none"))
    # A baseline that says nothing takes no part.
    o = o.where("signal NOT IN ('sentence_burstiness', 'paragraph_shape_cv') OR p50 > 0").where("signal <> 'paragraph_shape_cv' OR value > 0")
    e = F.when(F.col("side") == "high", exceedance_high(F.col("value"), F.col("p95"))).when(F.col("side") == "low", exceedance_low(F.col("value"), F.col("p50"))).otherwise(0.0)
    return o.select("row", "doc_id", "signal", F.col("value").alias("observed"), F.when(F.col("side") == "low", F.col("p50")).otherwise(F.col("p95")).alias("baseline"), e.alias("exceedance"), "weight")


def calibrate(table: DataFrame) -> DataFrame:
    """doc_id, signal, observed, baseline, exceedance, weight."""
    return exceedances(table).drop("row")


def verdicts(signals: DataFrame, *more: Column) -> DataFrame:
    """row, doc_id, score and verdict of each document, and further aggregates of its signals; signals as exceedances() gives them."""
    # In integers (weights are halves), so that ties round alike everywhere.
    s = signals.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.round(F.col("exceedance") * F.col("weight") * 10000).cast("long")).alias("n"), F.sum((F.col("weight") * 2).cast("long")).alias("w2"), *more)
    s = s.select(*[c for c in s.columns if c not in ("n", "w2")], F.least(F.lit(1.0), F.expr("(4 * n + w2) div (2 * w2)") / 10000.0).alias("score"))
    return s.withColumn("verdict", F.when(F.abs(F.col("score") - THRESHOLD) <= BAND, "borderline").when(F.col("score") >= THRESHOLD, "above_human_range").otherwise("within_human_range"))


def review(docs: DataFrame) -> DataFrame:
    """doc_id, score, violations, first_family, needs_revision: the gate for answers."""
    table = documents.document_table(docs, first=True)
    over = F.sum((F.col("exceedance") > 0).cast("long")).alias("violations")
    out = verdicts(exceedances(table), over).join(table.select("row", "first_family"), "row")
    return out.select("doc_id", "score", "violations", "first_family", (F.col("score") >= THRESHOLD).alias("needs_revision"))


def tone(table: DataFrame) -> DataFrame:
    """Metrics whose gap to the profile's span is wide: doc_id, signal, direction, gap."""
    o = crossed(table).where(~F.col("signal").startswith("family:")).where("p50 > 0")
    floor = F.when((F.col("p95") - F.col("p50")) / F.col("p50") < 0.10, 0.50).otherwise(0.15)
    high = (F.col("p95") > 0) & (F.col("value") > F.col("p95"))
    gap = F.when(high, (F.col("value") - F.col("p95")) / F.col("p95")).when(F.col("value") < F.col("p50"), (F.col("p50") - F.col("value")) / F.col("p50"))
    return o.withColumn("gap", F.round(gap, 4)).where(F.col("gap") >= floor).select("doc_id", "signal", F.when(high, "above").otherwise("below").alias("direction"), "gap")


def diagnosis(table: DataFrame) -> DataFrame:
    """The flagship: counts, raw and calibrated score, verdict of each document; metrics are null without a sentence."""
    m = ["sentences", "mean_sentence_words", "sentence_length_cv", "sentence_burstiness", "opening_diversity"]
    shown = documents.signal(table, "row", *[F.when(F.col("sentences") > 0, F.col(c)).alias(c) for c in m])
    return shown.join(verdicts(exceedances(table)).drop("doc_id"), "row", "left").drop("row")
