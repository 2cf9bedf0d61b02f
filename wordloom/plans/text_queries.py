"""Text, metric, finding and calibration queries over the whole documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.functions.plans import table
from wordloom.operators import calibrate, detect, documents, metrics
from wordloom.operators import text as T

from .fixtures import seeded


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(_docs(spark, sf_dir))


def queries() -> dict:
    plain = lambda f: lambda s, d: f(_docs(s, d))
    seed = lambda f: lambda s, d: f(_seeded(s, d))
    whole = lambda f: lambda s, d: f(documents.document_table(_seeded(s, d)))
    return {
        "split_paragraphs": plain(T.split_paragraphs),
        "split_sentences": plain(T.split_sentences),
        "token_counts": plain(lambda d: T.ngram_counts(d, 1)),
        "ngram_counts_2": plain(lambda d: T.ngram_counts(d, 2)),
        "ngram_counts_3": plain(lambda d: T.ngram_counts(d, 3)),
        "sentence_openings": plain(T.sentence_openings),
        "sentence_metrics": plain(metrics.sentence_metrics),
        "sentence_entropy": plain(metrics.sentence_entropy),
        "paragraph_shape": plain(metrics.paragraph_shape),
        "mtld": plain(metrics.mtld),
        "connective_density": seed(metrics.connective_density),
        "readability": seed(metrics.readability),
        "findings": seed(lambda d: detect.findings(d).drop("ord")),
        "lookaround_findings": seed(detect.lookaround_findings),
        "repeated_openings": seed(detect.repeated_openings),
        "family_rates": seed(documents.family_rates),
        "document_signal": seed(documents.document_signal),
        "paragraph_diagnosis": seed(detect.paragraph_diagnosis),
        "reference_profile": whole(calibrate.reference_profile),
        "calibration_signals": whole(calibrate.calibrate),
        "calibration": whole(lambda t: calibrate.verdicts(calibrate.exceedances(t)).drop("row")),
        "review_gate": seed(calibrate.review),
        "tone": whole(calibrate.tone),
        "document_diagnosis": whole(calibrate.diagnosis),
    }
