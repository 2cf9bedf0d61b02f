"""The subpackage's queries over whole tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, decontamination, funnels, html_extract, licences, mixing, pii, sharding, simhash, suffix_dedup, token_alignment, topk, toxicity
from .common import table


BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    """Where the public tokenizer of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_pii_pseudonyms": lambda s, d: pii.pii_digest(table(s, d, "documents")),
        "op2_licence_scan": lambda s, d: licences.licence_digest(table(s, d, "documents")),
        "op3_benchmark_decontamination": lambda s, d: decontamination.contamination_digest(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_toxicity": lambda s, d: toxicity.toxicity_digest(table(s, d, "documents"), table(s, d, "labels")),
        "op5_html_extraction": lambda s, d: html_extract.extract_digest(table(s, d, "pages")),
        "op6_source_mixing": lambda s, d: mixing.mixture_digest(table(s, d, "documents")),
        "op7_suffix_dedup": lambda s, d: suffix_dedup.repeats_digest(table(s, d, "documents")),
        "op8_exact_topk": lambda s, d: topk.topk_digest(table(s, d, "embeddings")),
        "op9_simhash": lambda s, d: simhash.simhash_digest(table(s, d, "documents")),
        "op10_sharding": lambda s, d: sharding.shard_digest(table(s, d, "documents")),
        "op11_funnels": lambda s, d: funnels.funnel_digest(table(s, d, "clicks")),
        "op12_token_alignment": lambda s, d: token_alignment.alignment_digest(table(s, d, "documents"), tokenizer(BYTE_BPE), tokenizer(PIECE_BPE)),
        "op13_bpe": lambda s, d: bpe.bpe_digest(table(s, d, "documents"), tokenizer(BYTE_BPE)),
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op3_benchmark_decontamination": decontamination.ORACLE, "op6_source_mixing": mixing.ORACLE, "op8_exact_topk": topk.ORACLE, "op11_funnels": funnels.ORACLE}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
