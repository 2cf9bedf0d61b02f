"""Summaries of runs: outcomes of a batch, the model's share, benchmark rows, quality, style statistics, separation of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import patterns as P
from wordloom.functions.plans import checked, cut

from . import detect, documents, structure
from . import text as T

SEPARATION = 3.0


def _n(flag: Column) -> Column:
    return F.coalesce(F.sum(flag.cast("long")), F.lit(0))


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)


def _mean(value: Column, where: Column) -> Column:
    return F.round(F.coalesce(F.avg(F.when(where, value)), F.lit(0.0)), 4)


def readiness(outcomes: DataFrame) -> DataFrame:
    """outcomes with readiness: ready unless a review is due, findings can still be acted on, or there are warnings; failed items are failed."""
    open_ = F.col("needs_review") | (F.col("unresolved") > 0) | (F.col("warnings") > 0)
    return outcomes.withColumn("readiness", F.when(F.col("status") != "ok", "failed").when(open_, "ready_with_warnings").otherwise("ready"))


def flow_summary(outcomes: DataFrame) -> DataFrame:
    """One row: items by status and readiness, sums, and mean signals before and after, over the items that ended well."""
    o, ok = readiness(outcomes), F.col("status") == "ok"
    done = lambda name: F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0)).cast("long").alias(name)
    before, after = F.col("signal_before"), F.col("signal_after")
    return o.agg(
        F.count("*").alias("items"), _n(ok).alias("ok"), _n(~ok).alias("failed"), _n(ok & F.col("needs_review")).alias("needs_review"), _n(F.col("readiness") == "ready").alias("ready"), _n(F.col("readiness") == "ready_with_warnings").alias("ready_with_warnings"),
        done("words"), done("changes_applied"), done("findings_before"), done("findings_after"), _mean(before, ok).alias("mean_signal_before"), _mean(after, ok).alias("mean_signal_after"), _mean(after - before, ok).alias("mean_signal_delta"),
    )


def ai_use_summary(outcomes: DataFrame) -> DataFrame:
    """One row: the models that took part, documents they edited, segments by model and rule, rejections, errors, and runs without the model."""
    o = outcomes.where("status = 'ok'")
    return o.agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("model") != "", F.col("model")))), ", ").alias("models"), _n(F.col("model_segments") > 0).alias("documents_with_model_edits"),
        _total("model_segments"), _total("rule_segments"), _total("model_rejections"), _total("model_errors"), _n(F.col("backend") == "rules_fallback").alias("model_unavailable"),
    )


def benchmark_summary(outcomes: DataFrame) -> DataFrame:
    """One row: runs by status, accepted and rejected edits, and the mean risk of the runs that changed something."""
    status = lambda s: _n(F.col("status") == s).alias(s)
    return outcomes.agg(
        F.count("*").alias("runs"), status("ok"), status("failed_safety"), status("failed_quality"), status("model_unavailable"), _total("changes_applied"), _total("model_rejections"),
        _mean(F.col("risk"), F.col("changes_applied") > 0).alias("average_risk"),
    )


def quality_summary(outcomes: DataFrame) -> DataFrame:
    """status, runs, share of runs that changed something, and mean changes and signal gain, of each status."""
    gain = F.col("signal_before") - F.col("signal_after")
    return outcomes.groupBy("status").agg(F.count("*").alias("runs"), F.round(F.avg((F.col("changes_applied") > 0).cast("double")), 4).alias("changed_share"), F.round(F.avg("changes_applied"), 4).alias("mean_changes"), F.round(F.avg(gain), 4).alias("mean_gain"))


def edit_rates(outcomes: DataFrame, genre: str, of: str, against: str) -> DataFrame:
    """One row: edits per 1,000 words of two genres and their ratio (the second counts as 0.01 at least)."""
    rate = lambda g: 1000 * F.sum(F.when(F.col(genre) == g, F.col("changes_applied"))) / F.sum(F.when(F.col(genre) == g, F.col("words")))
    r = outcomes.agg(rate(of).alias("a"), rate(against).alias("b"))
    return r.select(F.round("a", 2).alias("edits_per_1k"), F.round("b", 2).alias("edits_per_1k_against"), F.round(F.round("a", 2) / F.greatest("b", F.lit(0.01)), 2).alias("edit_ratio"))


# The letters that style statistics count as words.
STYLE_WORD = "[A-Za-zĄ-ż]+"


def style_statistics(docs: DataFrame) -> DataFrame:
    """One row over all documents: mean words of a sentence, distinct words over words, mean words of a document."""
    text = F.coalesce("text", F.lit(""))
    parts = F.filter(F.split(text, rf"[{P.BLANK}](?<=[.!?][{P.BLANK}])[{P.BLANK}]*"), lambda s: T.strip(s) != "")
    d = docs.select(F.regexp_extract_all(F.lower(text), F.lit(STYLE_WORD), 0).alias("w"), F.size(parts).alias("s"))
    # Words are counted once by value and once by document: two small tables instead of a distinct over all words.
    values = d.select(F.explode_outer("w").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))
    sizes = d.agg(F.count("*").alias("documents"), F.sum("s").alias("sentences"))
    share = lambda a, b, k: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), k)).otherwise(0.0)
    return values.crossJoin(F.broadcast(sizes)).select(share("tokens", "sentences", 2).alias("mean_sentence_words"), share("types", "tokens", 4).alias("type_token_ratio"), share("tokens", "documents", 2).alias("mean_document_words"))


MIN_PROFILE, HIGH_SIGNAL = 5, 0.5


def style_profile(docs: DataFrame) -> DataFrame:
    """One row: the dominant kind of the documents, how many are of it and how many are left out, the style statistics of
    its documents, and whether one of them has a high signal. No row below five documents of a kind; ties by name."""
    kinds = cut(structure.classify_family(docs).select("doc_id", "family"))
    counts = kinds.groupBy("family").agg(F.count("*").alias("documents"))
    top = counts.orderBy(F.desc("documents"), "family").limit(1).where(F.col("documents") >= MIN_PROFILE)
    total = counts.agg(F.sum("documents").alias("all"))
    found = top.select("family").first()
    kind = F.lit(found["family"] if found else None).cast("string")
    # Texts are told by what they say themselves, so they are not shuffled; an id that other rows have too brings those along.
    ids = kinds.where(F.col("family") == kind).select("doc_id").distinct()
    more = checked(cut(kinds.where(F.col("family") != kind).join(ids, "doc_id", "left_semi").select("doc_id").distinct()))
    own = structure.classify_family(docs, "text").select("doc_id", "text", (F.col("family") == kind).alias("own"))
    mine = own.join(more.withColumn("also", F.lit(True)), "doc_id", "left").where("doc_id IS NOT NULL AND (own OR also)").select("doc_id", "text")
    high = documents.document_signal(mine).agg(F.coalesce(F.max(F.col("signal_score") >= HIGH_SIGNAL), F.lit(False)).alias("warned"))
    return top.withColumnRenamed("family", "kind").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(style_statistics(mine))).crossJoin(F.broadcast(high)).withColumn("excluded", F.col("all") - F.col("documents")).drop("all")


def separation(docs: DataFrame, is_model: Column, ratio: float = SEPARATION) -> DataFrame:
    """rule, findings per 1,000 words of the models' and of human documents, ratio: the rules that tell them apart.

    A rule that human documents lack counts one tenth of a finding there.
    """
    s = detect.sentences(docs.withColumn("model", F.coalesce(is_model, F.lit(False))), "model")
    flat = s.select("model", "words", F.posexplode_outer("f").alias("k", "x"))
    per = flat.groupBy("model", F.col("x.rule").alias("rule")).agg(F.count("x").alias("n"), F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, F.col("words")).otherwise(0)).alias("words"))
    total = per.groupBy("model").agg(F.sum("words").alias("all"))
    side = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    sizes = total.agg(side(True, "all").alias("wa"), side(False, "all").alias("wb"))
    n = per.where("rule IS NOT NULL").groupBy("rule").agg(F.coalesce(side(True, "n"), F.lit(0)).alias("na"), F.coalesce(side(False, "n"), F.lit(0)).alias("nb")).crossJoin(F.broadcast(sizes))
    a, b = 1000 * F.col("na") / F.col("wa"), 1000 * F.greatest(F.col("nb").cast("double"), F.lit(0.1)) / F.col("wb")
    return n.where((F.col("wa") > 0) & (F.col("wb") > 0)).select("rule", F.round(a, 4).alias("model_rate"), F.round(1000 * F.col("nb") / F.col("wb"), 4).alias("human_rate"), F.round(a / b, 4).alias("ratio")).where(F.col("ratio") >= ratio)
