"""Document metrics: rhythm, diversity, readability, distributions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import patterns as P
from wordloom.functions.plans import with_rows

from . import text as T

# Connectives.
CONNECTIVES = ["ponadto", "jednakże", "tymczasem", "zatem", "więc", "mianowicie", "w konsekwencji", "co więcej", "jednak", "chociaż", "mimo to", "dlatego", "ponieważ", "z kolei", "reansumując", "reasumując", "konkludując", "nadto", "wobec tego", "co za tym idzie"]
CONNECTIVE = "<(?:" + "|".join(c.replace(" ", "_") for c in CONNECTIVES) + ")>"
VOWELS = "aeiouyąęó"


def sentence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, sentence_index, text, words of each sentence."""
    return T.split_sentences(docs).withColumn("words", T.word_count(F.col("text")))


def sentence_metrics(docs: DataFrame) -> DataFrame:
    """A row for each document with a sentence: words, sentences, mean, cv, burstiness, opening diversity."""
    s = sentence_rows(with_rows(docs))
    has = F.when(F.col("words") > 0, F.col("words"))
    opening = F.array_join(F.slice(F.split(F.lower(F.col("text")), f"[{P.BLANK}]+"), 1, 2), " ")
    a = s.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("words").cast("long").alias("words"), F.count("*").alias("sentences"), F.avg(has).alias("m"), F.stddev_pop(has).alias("sd"), F.count(has).alias("k"), F.countDistinct(opening).alias("o")
    )
    m, sd = F.coalesce("m", F.lit(0.0)), F.coalesce("sd", F.lit(0.0))
    return a.select(
        "doc_id", "words", "sentences", F.round(m, 4).alias("mean_sentence_words"), F.when(m > 0, F.round(sd / m, 4)).otherwise(0.0).alias("sentence_length_cv"),
        F.when((F.col("k") >= 3) & (sd + m > 0), F.round((sd - m) / (sd + m), 4)).otherwise(0.0).alias("sentence_burstiness"), F.round(F.col("o") / F.col("sentences"), 4).alias("opening_diversity"),
    )


def sentence_entropy(docs: DataFrame, width: int = 5) -> DataFrame:
    """Shannon bits of the sentence lengths in bins of five words."""
    bins = sentence_rows(with_rows(docs)).where("words > 0").groupBy("row", F.floor(F.col("words") / width).alias("bin")).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    total = bins.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select("doc_id", F.round(F.log2("t") - F.col("s") / F.col("t"), 4).alias("sentence_entropy"))


def paragraph_shape(docs: DataFrame) -> DataFrame:
    """cv of sentences per paragraph; 0 below three paragraphs."""
    per = sentence_rows(with_rows(docs)).groupBy("row", "paragraph_index").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    a = per.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("k"), F.avg("n").alias("m"), F.stddev_pop("n").alias("sd"))
    return a.select("doc_id", F.when(F.col("k") >= 3, F.round(F.col("sd") / F.col("m"), 4)).otherwise(0.0).alias("paragraph_shape_cv"))


def factors(words: list[str], threshold: float) -> float:
    """How often a text's diversity runs out: each stretch whose share of distinct words falls to the threshold is one, the rest its part of one."""
    whole, seen, begun = 0, set(), 0
    for at, w in enumerate(words, 1):
        seen.add(w)
        if len(seen) <= threshold * (at - begun):
            whole, begun, seen = whole + 1, at, set()
    left = len(words) - begun
    return whole + ((left - len(seen)) / left / (1 - threshold) if left else 0.0)


def mtld(docs: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Measure of textual lexical diversity: words per factor, mean of both directions; 0 where a direction has no factor.

    The fold is sequential in each text and needs a growing set, which array functions copy at each word; so it runs
    over Arrow batches. Words are runs of letters that touch no digit or underscore.
    """
    @F.pandas_udf("double")
    def diversity(texts: pd.Series) -> pd.Series:
        import regex

        letters = regex.compile(r"(?<![\p{L}\p{N}_])\p{L}++(?![\p{N}_])")

        def both(text: str | None) -> float:
            words = letters.findall((text or "").lower())
            per = [len(words) / f if f else 0.0 for f in (factors(words, threshold), factors(words[::-1], threshold))]
            return round(sum(per) / 2, 4)

        return texts.map(both)

    return docs.select("doc_id", diversity("text").alias("mtld"))


def connective_density(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    n = T.word_count(text)
    return docs.select("doc_id", F.when(n > 0, F.round(P.count(text, CONNECTIVE) / n * 1000, 4)).otherwise(0.0).alias("connective_density"))


def syllables(word: Column) -> Column:
    """Vowel groups' vowels, where i before another vowel only softens."""
    w = F.regexp_replace(F.lower(word), "i+([aeouyąęó])", "$1")
    return F.regexp_count(F.regexp_replace(w, "i+", "i"), F.lit(f"[{VOWELS}]"))


def readability(docs: DataFrame) -> DataFrame:
    """fog_pl (hard words have four syllables or more) and lix (long words have over six letters)."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", T.tokens(text).alias("w"), F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: s.rlike(r"\p{L}"))).alias("lix_s"))
    s = sentence_rows(docs).where("words > 0").groupBy("doc_id").agg(F.count("*").alias("s"))
    d = d.withColumn("n", F.size("w")).withColumn("hard", F.size(F.filter("w", lambda x: syllables(x) >= 4))).withColumn("long", F.size(F.filter("w", lambda x: F.char_length(x) > 6)))
    j = d.join(s, "doc_id", "left")
    fog = F.when((F.col("n") > 0) & (F.col("s") > 0), F.round(0.4 * (F.col("n") / F.col("s") + 100.0 * F.col("hard") / F.col("n")), 2)).otherwise(0.0)
    lix = F.round(F.greatest("n", F.lit(1)) / F.greatest("lix_s", F.lit(1)) + 100.0 * F.col("long") / F.greatest("n", F.lit(1)), 2)
    return j.select("doc_id", fog.alias("fog_pl"), lix.alias("lix"))


def distribution(x: Column) -> list[Column]:
    """mean, sd, p50, p90, p95, p99 of a column, to four places; zeros if it is empty."""
    names = ("p50", "p90", "p95", "p99")
    ps = F.percentile(x, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    out = [F.round(F.coalesce(F.avg(x), F.lit(0.0)), 4).alias("mean"), F.round(F.coalesce(F.stddev_pop(x), F.lit(0.0)), 4).alias("sd")]
    return out + [F.round(F.coalesce(ps[i], F.lit(0.0)), 4).alias(n) for i, n in enumerate(names)]
