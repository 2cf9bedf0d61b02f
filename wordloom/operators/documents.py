"""One row for each document with all that signals, rates, metrics and calibration read, from one pass over the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import patterns as P
from wordloom.functions.plans import cut, with_rows

from . import detect, metrics

FAMILIES = sorted({r[0] for r in detect.RULES} | {"vague_reference", "nominalization", "repeated_opening"})


#: Ten times the weight of an opening that repeats.
REPEATED = 6


def _entropy(bins: Column) -> Column:
    """Shannon bits of a list of bins: runs of the sorted list are its counts."""
    start = F.struct(F.lit(None).cast("bigint").alias("bin"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    closed = lambda s: s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0)
    step = lambda s, b: F.struct(b.alias("bin"), F.when(b == s["bin"], s["run"] + 1).otherwise(1.0).alias("run"), F.when(b == s["bin"], s["sum"]).otherwise(closed(s)).alias("sum"))
    n = F.size(bins)
    return F.when(n > 0, F.round(F.log2(n.cast("double")) - F.aggregate(F.sort_array(bins), start, step, closed) / n, 4)).otherwise(0.0)


def _beside(keys: str, i: Column) -> Column:
    """Whether the i-th of sorted keys has its like beside it."""
    k = F.get(keys, i)
    return F.coalesce(F.get(keys, i - 1) == k, F.lit(False)) | F.coalesce(F.get(keys, i + 1) == k, F.lit(False))


def document_table(docs: DataFrame, first: bool = False) -> DataFrame:
    """One row for each row of docs (numbered: row), kept in the shared folder: sizes, rhythm, diversity, found (family, weight10, rewritable of each finding).

    With `first`, first_family too, the family of the finding that comes first.
    """
    text = F.coalesce("text", F.lit(""))
    s = detect.sentences(with_rows(docs).select("row", "doc_id", "text", P.count(text, metrics.CONNECTIVE).alias("connectives")), "row", "connectives")
    opening = F.array_join(F.slice(F.split(F.lower("text"), f"[{P.BLANK}]+", 3), 1, 2), " ")
    small = F.transform("f", lambda x: F.struct(x["family"].alias("family"), x["weight10"].alias("weight10"), x["rewritable"].alias("rewritable")))
    place = ["paragraph_index", "sentence_index"]
    least = F.array_min(F.transform("f", lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["family"].alias("family"))))
    at = [F.when(F.size("f") > 0, F.struct(*place, least.alias("x"))).alias("least"), F.when(F.col("key").isNotNull(), F.struct("key", *place)).alias("at")]
    # Texts end here: no sentence goes into the grouping.
    s = s.select("row", "doc_id", "connectives", "words", "of", "sentence_index", "key", F.col("text").isNotNull().alias("shown"), F.xxhash64(opening).alias("opening"), F.when(F.size("f") > 0, small).alias("small"), *(at if first else []))
    has, begins = F.when(F.col("words") > 0, F.col("words")), F.col("sentence_index") == 0
    a = s.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum("words").cast("long").alias("words"), F.count(F.when(F.col("shown"), 1)).alias("sentences"), F.avg(has).alias("m0"), F.stddev_pop(has).alias("sd0"), F.count(has).alias("k"),
        F.size(F.collect_set("opening")).alias("openings"), F.collect_list(F.when(F.col("words") > 0, F.floor(F.col("words") / 5))).alias("bins"),
        F.count(F.when(begins, 1)).alias("paragraphs"), F.avg(F.when(begins, F.col("of"))).alias("pm"), F.stddev_pop(F.when(begins, F.col("of"))).alias("psd"),
        F.max("connectives").alias("connectives"), F.flatten(F.collect_list("small")).alias("inside"), F.array_sort(F.collect_list("key")).alias("keys"),
        *([F.min("least").alias("least"), F.array_sort(F.collect_list("at")).alias("at")] if first else []),
    )
    m, sd = F.coalesce("m0", F.lit(0.0)), F.coalesce("sd0", F.lit(0.0))
    # Sorted, what repeats stands beside its like.
    again = F.filter("keys", lambda k, i: _beside("keys", i))
    opened = F.transform(again, lambda k: F.struct(F.lit("repeated_opening").alias("family"), F.lit(REPEATED).alias("weight10"), F.lit(False).alias("rewritable")))
    named = []
    if first:
        a = a.withColumn("names", F.transform("at", lambda x: x["key"]))
        opening = F.struct(F.lit(0).alias("start"), F.lit(200).alias("ord"), F.lit("repeated_opening").alias("family"))
        repeated = F.transform(F.filter("at", lambda x, i: _beside("names", i)), lambda x: F.struct(*[x[p].alias(p) for p in place], opening.alias("x")))
        named = [F.array_min(F.array_compact(F.array("least", F.array_min(repeated))))["x"]["family"].alias("first_family")]
    return cut(a.select(
        "row", "doc_id", "words", "sentences", F.round(m, 4).alias("mean_sentence_words"), F.when(m > 0, F.round(sd / m, 4)).otherwise(0.0).alias("sentence_length_cv"),
        F.when((F.col("k") >= 3) & (sd + m > 0), F.round((sd - m) / (sd + m), 4)).otherwise(0.0).alias("sentence_burstiness"), F.when(F.col("sentences") > 0, F.round(F.col("openings") / F.col("sentences"), 4)).alias("opening_diversity"),
        _entropy(F.col("bins")).alias("sentence_entropy"), F.when(F.col("paragraphs") >= 3, F.round(F.col("psd") / F.col("pm"), 4)).otherwise(0.0).alias("paragraph_shape_cv"),
        F.when(F.col("words") > 0, F.round(F.col("connectives") / F.col("words") * 1000, 4)).otherwise(0.0).alias("connective_density"),
        F.concat("inside", opened).alias("found"), *named,
    ))


def _weight(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + x["weight10"])


def signal(table: DataFrame, *more: Column) -> DataFrame:
    """words, findings and the raw density score of every document, and further columns."""
    found = F.filter("found", lambda x: ~x["family"].isin(*detect.INFORMATIONAL))
    return table.select("doc_id", "words", F.size(found).cast("long").alias("findings"), detect.score(_weight(found), F.col("words")).alias("signal_score"), *more)


def document_signal(docs: DataFrame) -> DataFrame:
    """words, findings and the raw density score of every document, without what only metrics need."""
    counted = F.filter("f", lambda x: ~x["family"].isin(*detect.INFORMATIONAL))
    s = detect.sentences(with_rows(docs).select("row", "doc_id", "text"), "row").select("row", "doc_id", "words", "key", counted.alias("f"))
    s = s.select("row", "doc_id", "words", "key", F.size("f").alias("n"), _weight(F.col("f")).alias("w"))
    a = s.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("words").cast("long").alias("words"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.array_sort(F.collect_list("key")).alias("keys"))
    a = a.select("doc_id", "words", "n", "w", F.size(F.filter("keys", lambda k, i: _beside("keys", i))).alias("opened"))
    return a.select("doc_id", "words", (F.col("n") + F.col("opened")).cast("long").alias("findings"), detect.score(F.col("w") + REPEATED * F.col("opened"), F.col("words")).alias("signal_score"))


def rates(table: DataFrame) -> DataFrame:
    """Count, rate and weight of each family in each document that has it."""
    mine = lambda family: F.filter("found", lambda x: x["family"] == family)
    each = F.transform(F.array_distinct(F.transform("found", lambda x: x["family"])), lambda f: F.struct(f.alias("family"), mine(f).alias("of")))
    t = table.select("doc_id", "words", F.explode_outer(each).alias("e")).where("e IS NOT NULL")
    rewritable = F.size(F.filter("e.of", lambda x: x["rewritable"])).cast("long")
    return t.select("doc_id", "e.family", F.size("e.of").cast("long").alias("n"), F.round(F.size("e.of") / F.col("words") * 1000, 4).alias("per_1000_words"), F.round(_weight(F.col("e.of")) / 10.0, 4).alias("weight_total"), rewritable.alias("rewritable"))


def family_rates(docs: DataFrame) -> DataFrame:
    return rates(document_table(docs))
