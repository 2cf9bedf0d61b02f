"""Sentence and paragraph features, content anchors, modality, inventories of values that edits must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import patterns as P

from . import detect
from . import text as T

# Word patterns.
TRANSITION = "<(?:ponadto|co_więcej|dodatkowo|w_tym_kontekście|warto_(?:wskazać|zauważyć|podkreślić)|należy_(?:wskazać|zauważyć|podkreślić|odnotować))>"
PROHIBITION = r"<(?:nie_może|nie_mogą|nie_wolno|zakazuje_się|zakaz\p{L}*)>"
PERMISSION = r"<(?:może|mogą|uprawnien\p{L}*)>"
OBLIGATION = r"<(?:musi|muszą|jest_zobowiązan\p{L}*|są_zobowiązan\p{L}*|należy|obowiązk\p{L}*)>"
NEGATION = r"<(?:nie|brak\p{L}*|bez)>"
NUMBER = r"\d+(?:[,.]\d+)?"
# Words that carry no content, and endings that a stem of at least five letters loses.
LOW_SIGNAL = (
    "albo bardzo bowiem czyli danej danych danego dany duże duży duża jego jednak jeżeli które który która mają może mogą oraz przez również samo samą samego samych także takich takie takim tego temu tych ważne "
    "właśnie znaczenie była było były jest ma mają oznacza polega przejawia widać został została zostało zostały"
).split()
SUFFIXES = "owanie owania owaniu owana owany owane ono ego emu ych ymi ami ach owi owa owy owe ona ony one enie ania anie ę ą a u e y i".split()


def artifact_score(text: Column) -> Column:
    """Transitions, vague words and nominalisations of a sentence as one score, as `sentence_features` has it."""
    w = T.tokens(text)
    n = F.greatest(F.size(w), F.lit(1))
    vague = F.size(F.filter(w, lambda x: x.rlike(detect.VAGUE)))
    nominal = F.size(F.filter(w, lambda x: (F.char_length(x) >= 7) & x.rlike(detect.NOMINAL)))
    return F.least(F.lit(1.0), P.count(text, TRANSITION) * 0.18 + F.least(F.lit(0.30), vague / n) + F.least(F.lit(0.20), nominal / n * 2))


def sentence_features(docs: DataFrame) -> DataFrame:
    """A row for each sentence: words, commas, negations, transitions, vague words, nominalisations, numbers, modality, density scores."""
    s = T.split_sentences(docs).withColumn("w", T.tokens(F.col("text"))).withColumn("n", F.size("w"))
    t = F.col("text")
    share = lambda k: k / F.greatest("n", F.lit(1))
    vague = F.size(F.filter("w", lambda w: w.rlike(detect.VAGUE)))
    nominal = F.size(F.filter("w", lambda w: (F.char_length(w) >= 7) & w.rlike(detect.NOMINAL)))
    trans = P.count(t, TRANSITION)
    prohibited = P.count(t, PROHIBITION)
    left = F.regexp_replace(t, P.spark_pattern(PROHIBITION), " ")
    return s.select(
        "doc_id", "paragraph_index", "sentence_index", F.col("n").alias("words"), F.regexp_count(t, F.lit(",")).alias("commas"), P.count(t, NEGATION).alias("negations"), trans.alias("transitions"), vague.alias("vague"), nominal.alias("nominalisations"),
        F.regexp_count(t, F.lit(NUMBER)).alias("numbers"), prohibited.alias("prohibitions"), P.count(left, PERMISSION).alias("permissions"), P.count(left, OBLIGATION).alias("obligations"),
        F.round(F.least(F.lit(1.0), trans * 0.18 + F.least(F.lit(0.30), share(vague)) + F.least(F.lit(0.20), share(nominal) * 2)), 4).alias("artifact_score"),
    )


def paragraph_features(docs: DataFrame) -> DataFrame:
    """words, variance of sentence lengths, and the mean Jaccard similarity of neighbouring sentences."""
    s = T.split_sentences(docs).withColumn("w", T.tokens(F.col("text")))
    order = W.partitionBy("doc_id", "paragraph_index").orderBy("sentence_index")
    s = s.withColumn("prev", F.lag("w").over(order)).withColumn("n", F.size("w"))
    j = F.when(F.col("prev").isNotNull() & (F.size(F.array_union("w", "prev")) > 0), F.size(F.array_intersect("w", "prev")) / F.size(F.array_union("w", "prev")))
    return s.groupBy("doc_id", "paragraph_index").agg(F.sum("n").cast("long").alias("words"), F.round(F.avg("n"), 4).alias("mean_words"), F.round(F.var_pop("n"), 4).alias("var_words"), F.round(F.coalesce(F.avg(j), F.lit(0.0)), 4).alias("topic_continuity"))


STEM = rf"^(\p{{L}}{{5,}}?)(?:{'|'.join(SUFFIXES)})$"


def stem(word: Column) -> Column:
    """The word without its longest listed ending, if five letters stay."""
    return F.regexp_replace(word, STEM, "$1")


def anchors(text: Column) -> Column:
    """Distinct stems of content words: five letters or more, no low-signal words, no infinitives of -ować and -owić."""
    kept = F.filter(T.tokens(text), lambda w: (F.char_length(w) >= 5) & ~w.isin(LOW_SIGNAL) & ~w.rlike("ow(?:ać|ić)$"))
    return F.array_distinct(F.transform(kept, stem))


def anchor_retention(pairs: DataFrame) -> DataFrame:
    """id, anchors, retention (share of the original's anchors in the candidate; 1 without anchors), lost."""
    p = pairs.select("id", anchors(F.col("original")).alias("a"), anchors(F.col("candidate")).alias("b"))
    return p.select("id", F.size("a").alias("anchors"), F.when(F.size("a") > 0, F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 4)).otherwise(1.0).alias("retention"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("lost"))


# Values that an edit must keep, by category.
INVENTORY = {
    "legal_references": r"(?iu)art\.\s*\d+[a-z]?|§\s*\d+[a-z]?|(?:ust\.|pkt)\s*\d+[a-z]?|Dz\.\s*U\.[^,.;)]*",
    "dates": r"(?iu)\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}\s*r\.",
    "amounts": r"(?iu)(?:\d{1,3}(?:[ .]\d{3})+(?:,\d+)?|\d+(?:[,.]\d+)?)\s*(?:%|zł|PLN|EUR|USD)",
    "identifiers": r"(?iu)(?:PESEL|NIP|REGON|KRS)\s*[:#]?\s*[A-Z0-9 -]{6,20}|PL\d{26}",
    "quotes": r"„[^”]+”|\"[^\"]+\"",
}


def inventory(text: Column, category: str) -> Column:
    """The sorted values of a category, lower-cased, repeats included."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(INVENTORY[category]), 0), F.lower))


def sensitive_inventory(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[F.array_join(inventory(F.coalesce("text", F.lit("")), c), " | ").alias(c) for c in INVENTORY])


def deontic_profile(docs: DataFrame) -> DataFrame:
    """Prohibitions, permissions and obligations of each document; a prohibition's words count as nothing else."""
    t = F.coalesce("text", F.lit(""))
    left = F.regexp_replace(t, P.spark_pattern(PROHIBITION), " ")
    return docs.select("doc_id", P.count(t, PROHIBITION).alias("prohibitions"), P.count(left, PERMISSION).alias("permissions"), P.count(left, OBLIGATION).alias("obligations"))


DUTY = OBLIGATION.replace("należy|", "")


def signed_modality(docs: DataFrame) -> DataFrame:
    """prohibitions, permissions, obligations, where a negation up to two words before turns a duty or a ban into a permission, and "należy" into a ban; "nie tylko" negates nothing."""
    t = F.coalesce("text", F.lit(""))
    left = F.regexp_replace(t, P.spark_pattern(PROHIBITION), " ")
    negated = lambda spec, text: P.count(text, f"<nie_{spec[1:]}") + P.count(text, f"<nie_\\p{{L}}+_{spec[1:]}") - P.count(text, f"<nie_tylko_{spec[1:]}")
    duty, must = negated(DUTY, left), negated("<należy>", left)
    return docs.select(
        "doc_id", (P.count(t, PROHIBITION) + must).alias("prohibitions"), (P.count(left, PERMISSION) + duty).alias("permissions"), (P.count(left, OBLIGATION) - duty - must).alias("obligations")
    )


def style_compliance(docs: DataFrame, forbidden: list[str], preferred: dict[str, str]) -> DataFrame:
    """Forbidden phrases that occur, and deprecated terms that occur without the preferred one."""
    t = F.lower(F.coalesce("text", F.lit("")))
    bad = F.array(*[F.when(F.contains(t, F.lit(p)), F.lit(p)) for p in forbidden])
    old = F.array(*[F.when(F.contains(t, F.lit(o)) & ~F.contains(t, F.lit(n)), F.lit(o)) for o, n in preferred.items()])
    keep = lambda a: F.array_join(F.filter(a, lambda x: x.isNotNull()), ", ")
    return docs.select("doc_id", keep(bad).alias("forbidden"), keep(old).alias("deprecated"))
