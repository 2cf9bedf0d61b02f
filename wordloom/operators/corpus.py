"""Corpus statistics: log-odds with a prior, support by model, candidates for over-used n-grams, ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import patterns as P
from wordloom.functions.plans import cut

from . import features
from . import text as T

Z_FLOOR, MIN_MODELS, DOC_SHARE, HOLDOUT_RATIO = 1.96, 2, 0.10, 2.0


def log_odds(a: DataFrame, b: DataFrame, min_count: int = 5, prior_scale: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """term, z, log_odds, count_a, count_b of terms (term, n) in corpus a against b, with a Dirichlet prior from both.

    With `by`, a holds those columns too and each of their values is set against all of b.
    """
    by = by or []
    a = a.withColumnRenamed("n", "count_a")
    b = b.withColumnRenamed("n", "count_b")
    if by:
        sizes = a.groupBy(*by).agg(F.sum("count_a").alias("na"))
        j = a.join(b, "term", "left").fillna(0, ["count_b"]).join(F.broadcast(sizes), by)
        j = j.crossJoin(F.broadcast(b.agg(F.sum("count_b").alias("nb"))))
    else:
        j = a.join(b, "term", "full").fillna(0, ["count_a", "count_b"])
        j = j.crossJoin(F.broadcast(j.agg(F.sum("count_a").alias("na"), F.sum("count_b").alias("nb"))))
    j = j.where((F.col("count_a") + F.col("count_b") >= min_count) & (F.col("na") > 0) & (F.col("nb") > 0))
    prior = (F.col("count_a") + F.col("count_b")) * prior_scale
    total = (F.col("na") + F.col("nb")) * prior_scale
    num_a, num_b = F.col("count_a") + prior, F.col("count_b") + prior
    delta = F.log(num_a / (F.col("na") + total - num_a)) - F.log(num_b / (F.col("nb") + total - num_b))
    z = delta / F.sqrt(1 / num_a + 1 / num_b)
    return j.select(*by, "term", F.round(z, 4).alias("z"), F.round(delta, 4).alias("log_odds"), "count_a", "count_b")


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve of score against label 0/1, by rank sums; scored has score, label."""
    per = scored.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    # Ranges of scores, kept as they fell: sums run within a range, and over the few ranges.
    per = cut(per.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    ranges = per.groupBy("part").agg(F.sum("q").alias("all"))
    ahead = ranges.select("part", F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    below = W.partitionBy("part").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    won = per.join(F.broadcast(ahead), "part").withColumn("b", F.col("ahead") + F.coalesce(F.sum("q").over(below), F.lit(0)))
    t = won.agg(F.sum(F.col("p") * F.col("b") + 0.5 * F.col("p") * F.col("q")).alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return t.select(F.round(F.col("w") / (F.col("p") * F.col("q")), 4).alias("auc"))


def candidates(model_terms: DataFrame, human: DataFrame, doc_share: DataFrame, holdout: DataFrame) -> DataFrame:
    """Terms over-used by the models: z at least 1.96, support of two models, document share, and a holdout ratio of 2.

    model_terms: model, term, n; human and holdout: term, n; doc_share: term, share of the models' documents.
    """
    pooled = log_odds(model_terms.groupBy("term").agg(F.sum("n").alias("n")), human)
    support = log_odds(model_terms, human, min_count=1, by=["model"]).where((F.col("log_odds") > 0) & (F.col("count_a") >= 2))
    support = support.groupBy("term").agg(F.count("*").alias("models"))
    totals = pooled.agg(F.sum("count_a").alias("ta"))
    held_total = holdout.agg(F.sum("n").alias("th"))
    out = pooled.where(F.col("z") >= Z_FLOOR).join(support.where(F.col("models") >= MIN_MODELS), "term").join(doc_share.where(F.col("share") >= DOC_SHARE), "term")
    out = out.join(holdout.withColumnRenamed("n", "h"), "term", "left").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(held_total))
    rate, held = F.col("count_a") / F.col("ta"), F.coalesce("h", F.lit(0)) / F.col("th")
    return out.where((held == 0) | (rate / held >= HOLDOUT_RATIO)).select("term", "z", "models", F.round("share", 4).alias("doc_share"))


def common_terms(docs: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent words of over four letters; ties in alphabetical order."""
    w = docs.select(F.explode_outer(F.filter(T.tokens(F.coalesce("text", F.lit(""))), lambda x: F.char_length(x) > 4)).alias("term")).where("term IS NOT NULL")
    return w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def merged(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """Reviewed entries (term, z, status, note) with the numbers of a new measurement; status and note never change, new terms are candidates."""
    j = entries.alias("o").join(fresh.select("term", F.col("z").alias("z_new")).alias("f"), "term", "full")
    return j.select("term", F.coalesce("z_new", "z").alias("z"), F.coalesce("status", F.lit("candidate")).alias("status"), F.coalesce("note", F.lit("")).alias("note"))


# Words of references, amounts and dates, and the words of one letter that stand for themselves.
REFERENCE_WORDS = "art ust pkt lit nr poz dz kc kpc kp par".split()
AMOUNT_DATE_WORDS = "zł złotych pln eur euro gr r rok roku stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia".split()
ONE_LETTER = "a i o u w z".split()


def protected(terms: DataFrame) -> DataFrame:
    """terms with protected: whether a term touches a reference, an amount, a date, an abbreviation's letter, or modality."""
    w = F.split("term", " ")
    modal = F.greatest(*[F.col("term").rlike(P.spark_pattern(p)) for p in (features.PROHIBITION, features.PERMISSION, features.OBLIGATION)])
    named = F.arrays_overlap(w, F.array(*map(F.lit, REFERENCE_WORDS + AMOUNT_DATE_WORDS)))
    return terms.withColumn("protected", named | F.exists(w, lambda x: (F.char_length(x) == 1) & ~x.isin(ONE_LETTER)) | modal)


# What an entry of the reviewed list may be.
KINDS, STATUSES = ["word", "bigram", "trigram", "opening_2", "opening_3"], ["candidate", "accepted", "rejected"]


def entry_problems(entries: DataFrame) -> DataFrame:
    """term, problem: the first rule that an entry (term, kind, status, note, protected) breaks."""
    c = F.col
    problem = (
        F.when(~c("kind").isin(KINDS), "unknown kind").when(~c("status").isin(STATUSES), "unknown status")
        .when((c("status") == "accepted") & c("protected"), "a protected term is accepted").when((c("status") == "rejected") & (F.trim("note") == ""), "rejected without a reason")
    )
    return entries.select("term", problem.alias("problem")).where("problem IS NOT NULL")


def heading_support(headings: DataFrame, documents: int, required: float = 0.8) -> DataFrame:
    """heading (without its number), share of documents that have it, required or expected, median line: a checklist learnt from examples."""
    h = headings.withColumn("heading", F.lower(F.trim(F.regexp_replace("heading", r"^(?:§\s*\d+[a-z]?\.?|[IVXLC]+\.|\d+(?:\.\d+)*[.)]?)\s*", "")))).where("heading <> ''")
    a = h.groupBy("heading").agg(F.countDistinct("doc_id").alias("k"), F.percentile("line", F.lit(0.5)).alias("line")).where("k >= 2")
    share = F.col("k") / F.lit(documents)
    return a.select("heading", F.round(share, 4).alias("share"), F.when(share >= required, "required").otherwise("expected").alias("severity"), F.col("line").alias("median_line"))
