"""Style findings with exact spans, and their aggregates.

Each rule is a pattern in the word notation (`wordloom.functions.patterns`). `first` rules report their
first hit in a sentence, `all` rules every hit. Density rules look at the sentence's words. Order of
rules is the order of the findings; equal (rule, start, end) are reported once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import patterns as P
from wordloom.functions.plans import has_rows, with_rows

from . import text as T

# Rules as (family, rule, kind, pattern, ten times the weight, rewritable).
SAY = "(?:wskazać|zauważyć|podkreślić|odnotować|zaznaczyć)"
RULES = [
    ("discourse_frame", "drop_discourse_intro", "first", f"^<(?:warto|należy)_(?:również_)?{SAY}>(?: ?, ?| )<że>", 9, True),
    ("discourse_frame", "drop_repetitive_transition", "first", "^<(?:ponadto|co_więcej|dodatkowo)>", 9, True),
    ("discourse_frame", "drop_context_filler", "first", "^<w_tym_kontekście>", 9, True),
    ("transition_marker", "transition", "all", "<(?:ponadto|co_więcej|dodatkowo|w_tym_kontekście|warto_(?:wskazać|zauważyć|podkreślić)|należy_(?:wskazać|zauważyć|podkreślić|odnotować))>", 5, False),
    ("abstract_frame", "key_feature_frame", "first", "<jedną_z_najważniejszych_cech>", 7, True),
    ("abstract_frame", "special_importance_frame", "first", "<szczególne_znaczenie_ma>", 7, True),
    ("abstract_frame", "very_important_frame", "first", "<ma_bardzo_istotne_znaczenie>", 7, True),
    ("abstract_frame", "important_frame", "first", "<ma_istotne_znaczenie>", 7, True),
    ("abstract_frame", "important_frame_pl", "first", "<mają_istotne_znaczenie>", 7, True),
    ("abstract_frame", "special_importance_direct", "first", "<ma_szczególne_znaczenie>", 7, True),
    ("abstract_frame", "role_frame", "first", "<odgrywa_istotną_rolę>", 7, True),
    ("abstract_frame", "special_role_frame", "first", "<odgrywa_szczególną_rolę>", 7, True),
    ("abstract_frame", "important_plural_frame", "first", "<ważne_znaczenie_mają>", 7, True),
    ("abstract_frame", "important_function_frame", "first", "<drugą_istotną_funkcją_jest>", 7, True),
    ("empty_emphasis", "drop_most_classic", "first", "<najbardziej_klasyczną_postacią>", 7, True),
    ("abstract_frame", "practical_importance_frame", "first", r"<ma_(?:\p{L}+_)?znaczenie_praktyczne>", 7, True),
    ("abstract_frame", "style_frame", "all", "<(?:ma_(?:bardzo_)?(?:istotne|duże|szczególne)_znaczenie|(?:odgrywa|pełni)_(?:istotną|szczególną|ważną)_rolę|w_znacznym_stopniu)>", 6, False),
    ("empty_emphasis", "to_wlasnie", "first", "=<[Tt]o_właśnie>", 5, True),
    ("empty_emphasis", "znaczny_stopien_rowniez", "first", "=<w_znacznym_stopniu_również>", 5, True),
    ("empty_emphasis", "juz", "first", "=^<Już_", 5, True),
    ("typography_artifact", "em_dash", "all", f"[{P.BLANK}]*(?:—|--)[{P.BLANK}]*", 8, True),
    ("balanced_pair", "z_jednej_strony", "first", "<z_jednej_strony>", 7, False),
    ("concessive_reversal", "nie_oznacza_to_ze", "first", "<nie_oznacza_to(?:_jednak)?>(?: ?, ?| )<że>", 6, False),
    ("practical_implication", "w_praktyce_oznacza", "first", "<w_praktyce_oznacza_to>", 6, False),
    ("abstract_frame", "stanowi_jedno_z", "first", "<stanowi_(?:jedno|jedną|jeden)_z_(?:kluczowych|najważniejszych|podstawowych|istotnych)>", 7, False),
    ("summary_frame", "summary_opener", "first", "^<(?:podsumowując|reasumując|konkludując)>", 6, False),
    ("abstract_frame", "kluczowe_znaczenie", "first", "<kluczowe_znaczenie_ma>", 7, False),
]
#: Rules that hold only where the sentence matches this too.
ONLY_IF = {"juz": r"=^<Już_z_\p{L}+_wynika>"}
#: Characters around a hit that its evidence shows.
AROUND = {"em_dash": 10}
# Rules that need look-around or lazy matching, without a twin in RE2, and openings.
LOOKAROUND = [("antithesis", "nie_lecz", r"(?iu)(?<![\p{L}\p{N}_])nie\s+(?:chodzi|jest\s+to)(?![\p{L}\p{N}_])[^.;]{3,80}?(?<![\p{L}\p{N}_])lecz(?![\p{L}\p{N}_])", 7)]
TRICOLON = r"(?iu)(?<![,;:])(?<![\p{L}\p{N}_])\p{L}[^,;:.()]{10,70}?,\s+(\p{L}[^,;:.()]{10,70}?)\s+(?:oraz|a\s+także|i)\s+(\p{L}[^,;:.()]{10,70}?)(?=[.,;]|$)"
OPENING = f"^<(?:warto_{SAY}|należy_{SAY}|ponadto|dodatkowo|co_więcej|z_kolei|oznacza_to|duże_znaczenie_ma|istotne_znaczenie_ma)>"
# Words that point at nothing named, and endings of nouns made from verbs.
VAGUE_WORDS = r"(?:powyższ\p{L}*|niniejsz\p{L}*|przedmiotow\p{L}*|ten|ta|to|taki|taka|takie|ona|ono|on)"
NOMINAL_ENDS = "(?:anie|enie|cie|ość|acja|izja|yzja)"
VAGUE, NOMINAL = f"^{VAGUE_WORDS}$", f"{NOMINAL_ENDS}$"
VAGUE_RATE, NOMINAL_RATE, MIN_WORDS, NOMINAL_LETTERS = 0.14, 0.11, 8, 7
INFORMATIONAL = ("slop_ngram",)
SCALE = 18.0
SCHEMA = "array<struct<ord:int,family:string,rule:string,start:int,end:int,evidence:string,weight10:int,rewritable:boolean>>"


def _finding(order: int, family: str, rule: str, weight: int, rewritable: bool, s: Column) -> Column:
    return F.struct(F.lit(order).alias("ord"), F.lit(family).alias("family"), F.lit(rule).alias("rule"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("evidence"), F.lit(weight).alias("weight10"), F.lit(rewritable).alias("rewritable"))


def _hits(order: int, rule: tuple) -> Column:
    family, name, kind, spec, weight, rewritable = rule
    found = P.spans(F.col("text"), P.spark_pattern(spec))
    found = F.slice(found, 1, 1) if kind == "first" else found
    if name == "transition":
        found = F.filter(found, lambda s: s["start"] > 2)
    if name in AROUND:
        k = AROUND[name]
        shown = lambda s: F.substring(F.col("text"), F.greatest(s["start"] - k, F.lit(0)) + 1, s["end"] + k - F.greatest(s["start"] - k, F.lit(0)))
        found = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), shown(s).alias("value")))
    if name in ONLY_IF:
        found = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), T.strip(s["value"]).alias("value")))
    return F.when(F.col("text").rlike(P.spark_pattern(ONLY_IF.get(name, spec))), F.transform(found, lambda s: _finding(order, family, name, weight, rewritable, s))).otherwise(F.array().cast(SCHEMA))


def _density() -> Column:
    """Counts by one pattern over the lower-cased sentence, in sentences that are long enough only."""
    n = F.col("words")
    whole = F.struct(F.lit(0).alias("start"), F.char_length("text").cast("int").alias("end"), F.substring("text", 1, 120).alias("value"))
    vague = F.regexp_count(F.lower("text"), F.lit(rf"(?<!\p{{L}}){VAGUE_WORDS}(?!\p{{L}})"))
    nominal = F.regexp_count(F.lower("text"), F.lit(rf"(?<!\p{{L}})(?=\p{{L}}{{{NOMINAL_LETTERS}}})\p{{L}}*{NOMINAL_ENDS}(?!\p{{L}})"))
    one = lambda order, family, rule, k, rate, rewritable: F.when((n >= MIN_WORDS) & (k / n >= rate), F.array(_finding(order, family, rule, 4, rewritable, whole))).otherwise(F.array().cast(SCHEMA))
    return F.concat(one(100, "vague_reference", "vague_density", vague, VAGUE_RATE, False), one(101, "nominalization", "nominal_density", nominal, NOMINAL_RATE, True))


def _any() -> str:
    """A pattern that holds wherever a rule may match; it looks at word starts only, with one look-behind for all rules."""
    starts = [r[3].lstrip("=^")[1:] for r in RULES if "<" in r[3]]
    others = [r[3] for r in RULES if "<" not in r[3]]
    return P.spark_pattern("<(?:" + "|".join(starts) + ")|" + "|".join(f"(?:{o})" for o in others))


def sentences(docs: DataFrame, *keep: str) -> DataFrame:
    """One row for each sentence, and one with a null text for what has none: doc_id, kept columns, paragraph_index, sentence_index, of (sentences of the paragraph), text, words, f (its findings), key (its opening frame).

    All that findings and metrics need is computed here, in one pass over the texts.
    """
    p = docs.select("doc_id", *keep, F.posexplode_outer(T.paragraph_list(F.col("text"))).alias("paragraph_index", "text"))
    p = p.select("doc_id", *keep, "paragraph_index", T.sentence_list(F.col("text")).alias("list"))
    s = p.select("doc_id", *keep, "paragraph_index", F.size("list").alias("of"), F.posexplode_outer("list").alias("sentence_index", "text"))
    s = s.withColumn("words", F.coalesce(T.word_count(F.col("text")), F.lit(0)))
    # One pattern decides whether any rule can match; most sentences take the short way.
    rules = F.when(F.col("text").rlike(_any()), F.concat(*[_hits(i, r) for i, r in enumerate(RULES)])).otherwise(F.array().cast(SCHEMA))
    s = s.withColumn("f", F.concat(rules, F.when(F.col("words") >= MIN_WORDS, _density()).otherwise(F.array().cast(SCHEMA))))
    framed = F.filter("f", lambda x: (x["weight10"] == 7) & x["rewritable"])
    clear = F.filter("f", lambda x: (x["rule"] != "style_frame") | ~F.exists(framed, lambda y: (x["start"] >= y["start"]) & (x["start"] < y["end"])))
    opening = P.spark_pattern(OPENING)
    key = F.lower(F.regexp_replace(F.regexp_substr(F.col("text"), F.lit(opening)), f"[{P.BLANK}]+", " "))
    f = F.when(F.exists("f", lambda x: x["rule"] == "style_frame"), clear).otherwise(F.col("f"))
    return s.select("doc_id", *keep, "paragraph_index", "sentence_index", "of", "text", "words", f.alias("f"), F.when(F.col("text").rlike(opening), key).alias("key"))


PLACE = ("doc_id", "paragraph_index", "sentence_index")


def _rows(s: DataFrame, found: Column, *keep: str) -> DataFrame:
    s = s.select(*keep, *PLACE, F.explode_outer(found).alias("x")).where("x IS NOT NULL")
    return s.select(*keep, *PLACE, "x.family", "x.rule", "x.start", "x.end", "x.evidence", "x.weight10", "x.rewritable", "x.ord")


def sentence_findings(docs: DataFrame) -> DataFrame:
    """One row for each finding inside a sentence: doc_id, paragraph_index, sentence_index, family, rule, start, end, evidence, weight10, rewritable, ord."""
    return _rows(sentences(docs), F.col("f"))


def repeated_openings(docs: DataFrame) -> DataFrame:
    """Sentences that open with a frame which opens another sentence of the document too."""
    key = F.lower(F.regexp_replace(F.regexp_substr(F.col("text"), F.lit(P.spark_pattern(OPENING))), f"[{P.BLANK}]+", " "))
    s = T.split_sentences(with_rows(docs)).where(F.col("text").rlike(P.spark_pattern(OPENING))).withColumn("key", key)
    s = s.withColumn("n", F.count("*").over(W.partitionBy("row", "key"))).where("n >= 2")
    return s.select(*PLACE, "key", F.col("n").cast("long").alias("n"))


def findings(docs: DataFrame) -> DataFrame:
    """All findings with a stable order inside each document, in one pass: openings come along as findings and stay where they repeat."""
    opened = F.struct(F.lit(200).alias("ord"), F.lit("repeated_opening").alias("family"), F.lit("repeated_frame").alias("rule"), F.lit(0).alias("start"), F.char_length("key").cast("int").alias("end"), F.col("key").alias("evidence"), F.lit(6).alias("weight10"), F.lit(False).alias("rewritable"))
    rows = _rows(sentences(with_rows(docs), "row"), F.when(F.col("key").isNull(), F.col("f")).otherwise(F.concat("f", F.array(opened))), "row")
    repeated = F.count("*").over(W.partitionBy("row", F.when(F.col("ord") == 200, F.col("evidence"))))
    return rows.withColumn("n", repeated).where("ord <> 200 OR n >= 2").drop("n", *([] if has_rows(docs) else ["row"]))


#: Reviewed n-grams that models over-use, as (kind, term); openings stand at a sentence's start only.
ACCEPTED = [("bigram", "najemca płaci"), ("opening_2", "każda strona"), ("bigram", "w terminie"), ("opening_3", "strony ustalają najem"), ("word", "zawsze")]


def slop_ngrams(docs: DataFrame, entries: list[tuple[str, str]] | None = None) -> DataFrame:
    """Hits of the reviewed n-grams that touch no other finding of their sentence: they inform and never count in a score.

    Words may stand apart by anything but letters; a hit starts at its first letter.
    """
    s = sentences(docs).where("text IS NOT NULL")
    found = []
    for kind, term in ACCEPTED if entries is None else entries:
        body = r"\P{L}+".join(term.split())
        pattern = rf"(?iu){'^' + chr(92) + 'P{L}*' if kind.startswith('opening') else '(?<!' + chr(92) + 'p{L})'}{body}(?!\p{{L}})"
        lead = lambda x: F.char_length(F.regexp_extract(x["value"], r"^\P{L}*", 0))
        hits = F.transform(P.spans(F.col("text"), pattern), lambda x: F.struct((x["start"] + lead(x)).alias("start"), x["end"].alias("end"), F.regexp_replace(x["value"], r"^\P{L}+", "").alias("value")))
        free = F.filter(hits, lambda x: ~F.exists("f", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
        rule = F.lit(f"slop.{kind}.{term.replace(' ', '_')}")
        named = F.transform(free, lambda x: F.struct(rule.alias("rule"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("evidence")))  # noqa: B023
        found.append(F.when(F.col("text").rlike(pattern), named).otherwise(F.array().cast("array<struct<rule:string,start:int,end:int,evidence:string>>")))
    rows = s.select(*PLACE, F.explode_outer(F.concat(*found)).alias("x")).where("x IS NOT NULL")
    return rows.select(*PLACE, F.lit("slop_ngram").alias("family"), "x.rule", "x.start", "x.end", "x.evidence", F.lit(4).alias("weight10"))


def lookaround_findings(docs: DataFrame) -> DataFrame:
    """Antitheses, and coordinated triples whose last two members have like numbers of words."""
    s = T.split_sentences(docs)
    family, rule, pattern, weight = LOOKAROUND[0]
    a = s.select("doc_id", "paragraph_index", "sentence_index", F.explode_outer(F.slice(P.spans(F.col("text"), pattern), 1, 1)).alias("x")).where("x IS NOT NULL").select("*", F.lit(family).alias("family"), F.lit(rule).alias("rule"), F.lit(weight).alias("weight10"))
    k = lambda g: F.transform(F.regexp_extract_all(F.col("text"), F.lit(TRICOLON), g), T.word_count)
    t = s.where(F.col("text").rlike(TRICOLON)).select("doc_id", "paragraph_index", "sentence_index", F.explode(F.arrays_zip(P.spans(F.col("text"), TRICOLON).alias("x"), k(1).alias("b"), k(2).alias("c"))).alias("z"))
    t = t.where((F.least("z.b", "z.c") >= 2) & (F.greatest("z.b", "z.c") / F.least("z.b", "z.c") <= 1.6)).select("doc_id", "paragraph_index", "sentence_index", F.col("z.x").alias("x"), F.lit("tricolon").alias("family"), F.lit("tricolon").alias("rule"), F.lit(6).alias("weight10"))
    return a.unionByName(t).select("doc_id", "paragraph_index", "sentence_index", "family", "rule", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.value").alias("evidence"), "weight10")


def score(weight: Column, words: Column) -> Column:
    return F.when(words > 0, F.round(F.least(F.lit(1.0), weight / 10.0 / words * 1000 / SCALE), 4)).otherwise(0.0)


def paragraph_diagnosis(docs: DataFrame) -> DataFrame:
    """words, sentences, findings inside sentences, and score of each paragraph."""
    weight = F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x["weight10"])
    s = sentences(with_rows(docs), "row").where("text IS NOT NULL").groupBy("row", "paragraph_index").agg(F.first("doc_id").alias("doc_id"), F.sum("words").cast("long").alias("words"), F.count("*").alias("sentences"), F.sum(F.size("f")).cast("long").alias("findings"), F.sum(weight).alias("w"))
    return s.select("doc_id", "paragraph_index", "words", "sentences", "findings", score(F.col("w"), F.col("words")).alias("signal_score"))
