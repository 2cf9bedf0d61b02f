"""A user's table of word forms (form, lemma, tag) and what rules ask of it.

Tags are colon-separated, the class first; where a class has a case, it is the third part, alternatives
joined by dots (`subst:sg:nom.acc:m3`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.plans import checked

# Classes of tags.
FINITE = ["fin", "praet", "imps", "bedzie", "winien"]
PAST = ["praet", "winien"]
PRESENT = ["fin", "bedzie"]
NOMINAL = ["subst", "ger", "depr", "adj", "pact", "ppas", "num", "ppron3"]
NO_SUBJECT = ["pred", "part", "qub", "impt", "conj", "comp", "prep", "adv", "interj"]
NOUNS, ADJECTIVES = ["subst", "depr", "ger"], ["adj", "adja", "adjp", "adjc"]
BREAKS, GENITIVE = ["prep", "conj", "comp"], "gen"
PREDICATIVES = ["można", "trzeba", "warto", "wiadomo", "wolno"]
#: Copies of the lexicon among which a frequent word's rows are dealt, if it is too large for a broadcast.
SALT = 16


def readings(forms: DataFrame) -> DataFrame:
    """word and info of each form: whether it can open a subject, is a third-person predicate, is finite, is nominal, is genitive, begins a new phrase; its
    adjective and noun lemmas; the infinitive that it is a gerund of, and whether that takes an object (has a passive participle)."""
    part = lambda i: F.get(F.split("tag", ":"), i)
    kind, case, person = part(0), F.split(F.coalesce(part(2), F.lit("")), r"\."), part(2)
    nominative = kind.isin(NOMINAL) & F.array_contains(case, "nom")
    third = kind.isin(PAST) | (kind.isin(PRESENT) & F.coalesce(person == "ter", F.lit(False)))
    finite = kind.isin(FINITE) | ((kind == "pred") & (F.col("word").isin(PREDICATIVES) | F.col("lemma").isin(PREDICATIVES)))
    lemmas = lambda kinds: F.array_sort(F.collect_set(F.when(kind.isin(kinds), F.col("lemma"))))
    r = forms.where("form IS NOT NULL AND tag IS NOT NULL").select(F.lower("form").alias("word"), "lemma", "tag")
    passive = r.where(kind == "ppas").select("lemma", F.lit(True).alias("object")).distinct()
    r = r.join(passive, "lemma", "left")
    genitive = kind.isin(NOMINAL) & F.array_contains(case, GENITIVE)
    gerund = F.when(kind == "ger", F.struct("lemma", F.coalesce("object", F.lit(False)).alias("object")))
    a = r.groupBy("word").agg(F.bool_or(kind.isin([*NOMINAL, "brev"])).alias("nominal"), F.bool_or(kind.isin(BREAKS)).alias("breaks"), F.bool_or(genitive).alias("genitive"), F.min(gerund).alias("gerund"), F.bool_or(nominative).alias("n"), F.bool_or(kind.isin(NO_SUBJECT)).alias("no"), F.bool_or(third).alias("third"), F.bool_or(finite).alias("finite"), lemmas(ADJECTIVES).alias("adjectives"), lemmas(NOUNS).alias("nouns"))
    return a.select("word", F.struct((F.col("n") & ~F.col("no")).alias("subject"), "third", "finite", "nominal", "breaks", "genitive", "adjectives", "nouns", "gerund").alias("info"))


def looked_up(rows: DataFrame, keys: list[str], words: Column, forms: DataFrame) -> DataFrame:
    """keys and `known`, a map from each of the row's words that has readings to its info; rows without any are left out.

    Of a table too large for a broadcast, only the readings of words that occur take part in the join.
    """
    asked = rows.select(*keys, F.explode_outer(F.array_distinct(words)).alias("word")).where("word IS NOT NULL")
    lexicon = readings(forms)
    sent = checked(lexicon)
    if sent is lexicon:
        lexicon = lexicon.join(asked.select("word").distinct(), "word", "left_semi")
        sent = checked(lexicon)
    if sent is lexicon:
        lexicon = lexicon.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = asked.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALT)).cast("int")).join(lexicon, ["word", "salt"])
    else:
        found = asked.join(sent, "word")
    return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "info"))).alias("known"))
