"""Redundancy rules: an opening that the output before it already has, a repeated subject, doubled adjectives and nouns.

Only a repeated opening looks at another sentence, and at the one before as it was rewritten. So all
candidates and gates are worked out for each sentence by itself, every outcome with the openings that it shows
to the next sentence; what is left is a sequential choice along a paragraph, made in one pass over its sorted
sentences with candidates that keeps nothing but the openings of the last output. Sentences without candidates are neither
shuffled nor taken apart: each sentence brings the one before along.

Defined results: rows with null or repeated ids are documents of their own; a null text has no sentences; without
forms no rule fires that needs them; equal scores go by the rules' order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import patterns as P
from wordloom.functions.plans import checked, cut, with_rows

from . import features, lexicon, rewrite
from . import text as T

KEY = ["row", "paragraph_index", "sentence_index"]
#: What goes along with a sentence.
PLACE = [*KEY, "doc_id", "previous"]
# Lengths of openings, scores and risks by rule, connectors that may open the rest, what an opening must not hold.
LENGTHS = {"standard": (4, 3, 2), "strong": (4, 3, 2, 1)}
OPENING = {1: (0.46, 0.23), 2: (0.52, 0.18), 3: (0.52, 0.18), 4: (0.52, 0.18)}
SUBJECT, ADJECTIVES, NOUNS = "redundancy:drop_repeated_subject_in_sentence", "redundancy:drop_tautological_adj_pair", "redundancy:drop_tautological_noun_pair"
SCORE, RISK = {"standard": 0.50, "strong": 0.54}, {SUBJECT: 0.20, ADJECTIVES: 0.18, NOUNS: 0.20}
CONNECTORS = ["jednak", "natomiast", "ponadto", "dlatego"]
REFERENCE = r"<art\.|§|<ust\.|<pkt>|<Dz\.\s*U\.|<Kodeksu>|<Konstytucji>|__PROTECTED_\d+__"
MIN_WORDS = 3
#: A subject of up to three words, its verb, and after a comma and a conjunction the same subject with another verb.
WORD_START, WORD_END = f"(?<![{P.WORDCHAR}])", f"(?![{P.WORDCHAR}])"
#: Holds wherever AGAIN and DOUBLE may; without backtracking.
JOINED = rf"(?iu)\s(?:i|oraz|a\s+także)\s"
AGAIN = rf"(?iu){WORD_START}(\p{{L}}+(?:\s+\p{{L}}+){{0,2}})\s+(\p{{L}}+){WORD_END}([^.!?]{{8,160}}?),\s+(oraz|a także|i)\s+\1\s+(\p{{L}}+){WORD_END}"
DOUBLE = rf"(?iu){WORD_START}(\p{{L}}+)(\s+(?:i|oraz|a\s+także)\s+)(\p{{L}}+){WORD_END}"


def opening(text: Column, k: int) -> Column:
    """The text up to its k-th word; null if it has fewer."""
    found = F.regexp_substr(text, F.lit(rf"(?u)^\P{{L}}*\p{{L}}+(?:\P{{L}}+\p{{L}}+){{{k - 1}}}(?!\p{{L}})"))
    return found


def subject_of(text: Column, k: int) -> Column:
    """The sorted anchors of the first k words as one string, if each word is an anchor of its own; null else."""
    a = features.anchors(opening(text, k))
    return F.when(F.size(a) == k, F.array_join(F.array_sort(a), " "))


def shown(text: Column) -> Column:
    """What a sentence shows to the next one: the sorted anchors of its first 1, 2, 3 and 4 words."""
    return F.array(*[F.array_join(F.array_sort(features.anchors(opening(text, k))), " ") for k in sorted(OPENING)])


def sentence_case(text: Column) -> Column:
    t = T.strip(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.char_length(t)))


def numbered(docs: DataFrame) -> DataFrame:
    """The sentences of all rows: row (a number for each row of docs), doc_id, paragraph_index, sentence_index, text, previous (the sentence before, null for a paragraph's first).

    Not kept: who reads them more than once has to keep them, or row may differ.
    """
    p = with_rows(docs).select("row", "doc_id", F.posexplode_outer(T.paragraph_list(F.col("text"))).alias("paragraph_index", "text")).where("text IS NOT NULL")
    s = p.select("row", "doc_id", "paragraph_index", T.sentence_list(F.col("text")).alias("list")).select("*", F.posexplode_outer("list").alias("sentence_index", "text"))
    return s.select("row", "doc_id", *KEY[1:], "text", F.get("list", F.col("sentence_index") - 1).alias("previous")).where("text IS NOT NULL")


def _words(text: Column) -> Column:
    """The lower-cased words that a rule may ask the lexicon for: the first six, those beside conjunctions, and the verbs of repeated subjects."""
    none = F.array().cast("array<string>")
    beside = lambda pattern, *groups: F.when(text.rlike(pattern), F.concat(*[F.regexp_extract_all(text, F.lit(pattern), g) for g in groups])).otherwise(none)
    joined = F.when(text.rlike(JOINED), F.transform(F.concat(beside(DOUBLE, 1, 3), beside(AGAIN, 2, 5)), F.lower)).otherwise(none)
    first = F.regexp_substr(F.lower(text), F.lit(r"^\P{L}*(?:\p{L}+\P{L}*){1,6}"))
    return F.concat(F.coalesce(F.regexp_extract_all(first, F.lit(T.LETTERS), 0), none), joined)


def _info(word: Column, field: str) -> Column:
    return F.coalesce(F.try_element_at("known", F.lower(word))[field], F.lit(False))


def _repeated_subject(s: DataFrame, mode: str) -> DataFrame:
    """The first repeated subject of a sentence, left out."""
    t = F.col("text")
    hits = s.where(t.rlike(JOINED) & t.rlike(AGAIN)).select(*PLACE, "text", "known", F.posexplode(F.arrays_zip(P.spans(t, AGAIN).alias("at"), *[F.regexp_extract_all(t, F.lit(AGAIN), g).alias(f"g{g}") for g in range(1, 6)])).alias("n", "m"))
    subject = F.col("m.g1")
    good = (F.size(features.anchors(subject)) > 0) & ~subject.rlike(P.spark_pattern(REFERENCE)) & _info(F.col("m.g2"), "finite") & _info(F.col("m.g5"), "finite")
    fresh = F.concat(F.substring(t, F.lit(1), F.col("m.at.start")), subject, F.lit(" "), F.col("m.g2"), F.col("m.g3"), F.lit(", "), F.col("m.g4"), F.lit(" "), F.col("m.g5"), F.substring(t, F.col("m.at.end") + 1, F.char_length(t)))
    first = hits.where(good).groupBy(*PLACE).agg(F.min_by(F.struct("text", fresh.alias("candidate")), "n").alias("c"))
    return first.select(*PLACE, F.lit(0).alias("place"), "c.text", "c.candidate", F.lit(SUBJECT).alias("rule"), F.lit(SCORE[mode]).alias("score"), F.lit(RISK[SUBJECT]).alias("risk"))


def _doubles(s: DataFrame, pairs: DataFrame, mode: str) -> DataFrame:
    """The first of two words that a pair of lemmas names as doubled, left out with the conjunction; each pair once in a sentence."""
    t = F.col("text")
    hits = s.where(t.rlike(JOINED) & t.rlike(DOUBLE)).select(*PLACE, "text", "known", F.posexplode(F.arrays_zip(P.spans(t, DOUBLE).alias("at"), *[F.regexp_extract_all(t, F.lit(DOUBLE), g).alias(f"g{g}") for g in (1, 2, 3)])).alias("n", "m"))
    kinds = {"adj": ("adjectives", ADJECTIVES), "noun": ("nouns", NOUNS)}
    lemmas = lambda g, field: F.coalesce(F.try_element_at("known", F.lower(F.col(f"m.g{g}")))[field], F.array().cast("array<string>"))

    def crossed(kind: str, field: str) -> Column:
        pair = lambda a: F.transform(lemmas(3, field), lambda b: F.struct(F.lit(kind).alias("kind"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
        return F.flatten(F.transform(lemmas(1, field), pair))

    both = F.concat(*[crossed(kind, field) for kind, (field, _) in kinds.items()])
    usable = pairs if mode == "strong" else pairs.where(~F.coalesce("strong", F.lit(False)))
    named = usable.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = hits.select(*PLACE, "text", "n", "m", F.explode(both).alias("p")).select("*", "p.kind", "p.a", "p.b").join(checked(named), ["kind", "a", "b"])
    each = found.groupBy(*PLACE, "kind", "n").agg(F.min(F.struct("a", "b")).alias("pair"), F.first("text").alias("text"), F.first("m").alias("m"))
    once = each.groupBy(*PLACE, "kind", "pair").agg(F.min_by(F.struct("n", "text", "m"), "n").alias("h"))
    gap = F.col("h.m.at.start") + F.char_length("h.m.g1") + F.char_length("h.m.g2")
    whole = F.col("h.text")
    fresh = sentence_case(F.concat(F.substring(whole, F.lit(1), F.col("h.m.at.start")), F.substring(whole, gap + 1, F.char_length(whole))))
    rule = F.when(F.col("kind") == "adj", ADJECTIVES).otherwise(NOUNS)
    place = F.when(F.col("kind") == "adj", 1000).otherwise(2000) + F.col("h.n")
    return once.select(*PLACE, place.cast("int").alias("place"), whole.alias("text"), fresh.alias("candidate"), rule.alias("rule"), F.lit(SCORE[mode]).alias("score"), F.when(F.col("kind") == "adj", RISK[ADJECTIVES]).otherwise(RISK[NOUNS]).alias("risk"))


def _dropped(s: DataFrame, mode: str) -> DataFrame:
    """Each opening that may go, with `needs`: the length and anchors that the output before must open with."""
    t = F.col("text")
    options = []
    for i, k in enumerate(LENGTHS[mode]):
        head = opening(t, k)
        rest = F.regexp_replace(F.substring(t, F.char_length(head) + 1, F.char_length(t)), r"^[ ,;:\-]+", "")
        words = T.tokens(rest)
        predicate = F.when(F.get(words, F.lit(0)).isin(CONNECTORS), F.get(words, F.lit(1))).otherwise(F.get(words, F.lit(0)))
        fits = (F.size(words) >= 1) & (T.word_count(t) >= MIN_WORDS) & subject_of(t, k).isNotNull() & ~head.rlike(P.spark_pattern(REFERENCE)) & rest.rlike(r"^\p{L}") & _info(F.get(T.tokens(t), F.lit(0)), "subject") & _info(predicate, "third")
        score, risk = OPENING[k]
        options.append(F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(3000 + i).alias("place"), sentence_case(rest).alias("candidate"), F.lit(k).alias("length"), subject_of(t, k).alias("needs"), F.lit(score).alias("score"), F.lit(risk).alias("risk"))))
    # A subject's anchors stand in two sentences of the paragraph wherever the output before opens with them.
    starts = _info(F.regexp_substr(F.lower(t), F.lit(T.LETTERS)), "subject")
    o = s.where((F.col("sentence_index") > 0) & starts).select(*PLACE, "text", F.explode(F.array_compact(F.array(*options))).alias("o"))
    return o.select(*PLACE, "o.place", "text", "o.candidate", F.lit("redundancy:drop_repeated_opening").alias("rule"), "o.score", "o.risk", "o.length", "o.needs")


def _taken(s: DataFrame, forms: DataFrame, pairs: DataFrame, mode: str) -> DataFrame:
    """row, doc_id, paragraph_index, sentence_index, text, output and rule of the sentences with candidates; s, as numbered() gives it, is read once."""
    rich = cut(lexicon.looked_up(s, [*PLACE, "text"], _words(F.col("text")), forms))
    inside = _repeated_subject(rich, mode).unionByName(_doubles(rich, pairs, mode)).withColumns({"length": F.lit(None).cast("int"), "needs": F.lit(None).cast("string")})
    made = inside.unionByName(_dropped(rich, mode)).where("candidate <> '' AND candidate <> text").withColumnRenamed("text", "original")
    passed = rewrite.gates(made).where("reason IS NULL")
    option = F.struct((-F.col("score")).alias("order"), "place", "candidate", "rule", "length", "needs", shown(F.col("candidate")).alias("shows"))
    options = passed.groupBy(*PLACE, "original").agg(F.array_sort(F.collect_list(option)).alias("options"))
    rows = options.select("row", "doc_id", *KEY[1:], F.col("original").alias("text"), shown(F.col("original")).alias("shows"), "options", F.when(F.col("previous").isNotNull(), shown(F.col("previous"))).alias("earlier"))

    def along(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, before = None, None
        for table in tables:
            outputs, rules = [], []
            columns = [table.column(c).to_pylist() for c in ("row", "paragraph_index", "sentence_index", "text", "shows", "options", "earlier")]
            for row, paragraph, sentence, text, shows, options, earlier in zip(*columns):
                # The sentence before has no candidates, unless it came right before this one.
                before = before if place == (row, paragraph, sentence - 1) else earlier
                place = (row, paragraph, sentence)
                took = next((o for o in options if o["needs"] is None or (before and before[o["length"] - 1] == o["needs"])), None)
                outputs.append(took["candidate"] if took else text)
                rules.append(took["rule"] if took else None)
                before = took["shows"] if took else shows
            yield pa.RecordBatch.from_arrays([*[table.column(i) for i in range(5)], pa.array(outputs, pa.string()), pa.array(rules, pa.string())], ["row", "doc_id", *KEY[1:], "text", "output", "rule"])

    id_type = s.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartition("row", "paragraph_index").sortWithinPartitions(*KEY)
    return ordered.mapInArrow(along, f"row bigint, doc_id {id_type}, paragraph_index int, sentence_index int, text string, output string, rule string")


def chosen(docs: DataFrame, forms: DataFrame, pairs: DataFrame, mode: str = "standard") -> DataFrame:
    """row, doc_id, paragraph_index, sentence_index, text, output and rule (null where a sentence stays) of all sentences.

    forms: form, lemma, tag. pairs: kind (adj, noun), a, b (lemmas), strong (only for mode strong). A conservative
    mode changes nothing.
    """
    s = cut(numbered(docs))
    if mode == "conservative":
        return s.select("row", "doc_id", *KEY[1:], "text", F.col("text").alias("output"), F.lit(None).cast("string").alias("rule"))
    changed = _taken(s, forms, pairs, mode).where("rule IS NOT NULL").select(*KEY, "output", "rule")
    return s.join(changed, KEY, "left").select("row", "doc_id", *KEY[1:], "text", F.coalesce("output", "text").alias("output"), "rule")


def edits(docs: DataFrame, forms: DataFrame, pairs: DataFrame, mode: str = "standard") -> DataFrame:
    """The sentences that change: doc_id, paragraph_index, sentence_index, before, after, rule."""
    made = chosen(docs, forms, pairs, mode) if mode == "conservative" else _taken(numbered(docs), forms, pairs, mode)
    return made.where("rule IS NOT NULL").select("doc_id", *KEY[1:], F.col("text").alias("before"), F.col("output").alias("after"), "rule")
