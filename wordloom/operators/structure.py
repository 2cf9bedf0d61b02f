"""Headings, section checklists, numbering, classification by terms, nearest template by shared word pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions.plans import BROADCAST_ROWS, cut

from . import text as T

NUMBERED = r"(?iu)^(?:§\s*\d+[a-z]?\.?|[IVXLC]+\.|\d+(?:\.\d+)*[.)]?|art\.\s*\d+[a-z]?\.?)(?:\s+\S.*)?$"
MAX_HEADING = 90
# Sections as (id, label, severity, phrases).
SECTIONS = [("przedmiot", "Przedmiot", "required", ["przedmiot umowy", "przedmiotem umowy"]), ("czynsz", "Czynsz", "required", ["czynsz", "wynagrodzenie"]), ("wypowiedzenie", "Wypowiedzenie", "expected", ["wypowiedzenie", "wypowiedzieć"]), ("kary", "Kary", "expected", ["kara umowna", "kary umowne"])]
# Families and categories with their terms (3 points strong, 1 weak).
FAMILIES = [("contract", ["umowa", "umowę", "strony", "wykonawca", "najemca"]), ("filing_official", ["pozew", "sąd", "powód", "pozwany", "odwołanie"]), ("policy", ["regulamin", "dane osobowe", "polityka"]), ("opinion", ["opinia", "podsumowując", "roszczenie"])]
CATEGORIES = [("umowa_najmu", ["najem lokalu", "najemca"], ["czynsz", "lokal"], ["najem"]), ("pozew", ["pozew o zapłatę"], ["powód", "pozwan"], ["wnoszę", "pozew"]), ("odwolanie", ["służy odwołanie"], ["decyzji", "organu"], ["odwołanie"]), ("umowa_uslug", ["wykonawca musi"], ["zamawiający", "wady"], ["wykonawca"])]


def is_heading(line: Column) -> Column:
    t = T.strip(line)
    numbered = t.rlike(NUMBERED) & ~t.rlike(r"[;]$") & ~(t.rlike(r"\.$") & t.rlike(r"\s"))
    plain = ~t.rlike(r":\s*\S|_{4,}|\.{4,}") & ~t.rlike(r"[.,;:]$") & t.rlike(r"^\p{Lu}")
    return (F.char_length(t) <= MAX_HEADING) & (t != "") & (numbered | plain)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), text of non-blank lines."""
    return T.split_paragraphs(docs).select("doc_id", F.col("paragraph_index").alias("line"), "text")


def headings(docs: DataFrame) -> DataFrame:
    return lines(docs).where(is_heading(F.col("text"))).select("doc_id", "line", T.strip(F.col("text")).alias("heading"))


def numbering_issues(docs: DataFrame) -> DataFrame:
    """Numbered § headings whose number is not one above the one before: gaps and repeats."""
    h = headings(docs).withColumn("value", F.regexp_extract("heading", r"^§\s*(\d{1,9})", 1)).where("value <> ''").withColumn("value", F.col("value").cast("long"))
    h = h.withColumn("before", F.lag("value").over(W.partitionBy("doc_id").orderBy("line")))
    return h.where("value <> before + 1").select("doc_id", "line", "value", (F.col("before") + 1).alias("expected"), F.when(F.col("value") <= F.col("before"), "repeat").otherwise("gap").alias("issue"))


#: Units by kind of numbering: the pattern of a line and what its number is written in.
UNITS = {"paragraph": r"^§\s*(\d{1,9})", "roman": r"^([IVXLC]+)\.(?:\s|$)", "arabic": r"^(\d{1,9})[.)](?:\s|$)"}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def roman(number: Column) -> Column:
    """The value of a Roman number: a sign before a larger one is taken off."""
    signs = F.filter(F.split(number, ""), lambda c: c != "")
    value = lambda c: sum((F.when(c == k, v).otherwise(0) for k, v in ROMAN.items()), F.lit(0))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("seen"))
    step = lambda s, c: F.struct((s["sum"] + F.when(value(c) < s["seen"], -value(c)).otherwise(value(c))).alias("sum"), value(c).alias("seen"))
    return F.aggregate(F.reverse(signs), start, step, lambda s: s["sum"])


def unit_issues(docs: DataFrame, numbering: str) -> DataFrame:
    """Lines whose unit number is not one above the unit before: gaps, and repeats or steps back."""
    u = lines(docs).withColumn("raw", F.regexp_extract(T.strip(F.col("text")), UNITS[numbering], 1)).where("raw <> ''")
    u = u.withColumn("value", (roman(F.col("raw")) if numbering == "roman" else F.col("raw")).cast("long"))
    u = u.withColumn("before", F.lag("value").over(W.partitionBy("doc_id").orderBy("line")))
    return u.where("value <> before + 1").select("doc_id", "line", "raw", "value", (F.col("before") + 1).alias("expected"), F.when(F.col("value") <= F.col("before"), "repeat").otherwise("gap").alias("issue"))


def section_check(docs: DataFrame) -> DataFrame:
    """doc_id, section, status, position of each section; the first phrase of the list that occurs decides the position."""
    t = F.lower(F.coalesce("text", F.lit("")))
    made = []
    for name, _, severity, phrases in SECTIONS:
        at = F.coalesce(*[F.when(F.contains(t, F.lit(p)), F.instr(t, F.lit(p)) - 1) for p in phrases])
        made.append(F.struct(F.lit(name).alias("section"), F.when(at.isNotNull(), "present").otherwise(f"missing_{severity}").alias("status"), at.alias("position")))
    return docs.select("doc_id", F.explode(F.array(*made)).alias("s")).select("doc_id", "s.section", "s.status", "s.position")


UNIT = r"^(?:§\s*\d+[a-z]?|[IVXLC]+\.|\d+(?:\.\d+)*[.)])"
EXTRA_WORDS, MIN_BODY = 2, 4


def section_bodies(docs: DataFrame) -> DataFrame:
    """doc_id, section, line, body_words, empty of each section that a heading titles.

    A section stands at the first line with the first phrase of its list that occurs; the line titles it if it is a numbered heading, or one with
    few words beside the phrase. The body runs to the later of the next heading and the next section, else to the end.
    """
    low = F.lower("text")
    rank = {name: F.coalesce(*[F.when(F.contains(low, F.lit(p)), j) for j, p in enumerate(phrases)], F.lit(None)) for name, _, _, phrases in SECTIONS}
    d = lines(docs).select("doc_id", "line", "text", is_heading(F.col("text")).alias("is_heading"), F.regexp_count("text", F.lit(f"[^{T.BLANK}]+")).alias("words"), *[F.when(j.isNotNull(), F.struct(j.alias("j"), "line")).alias(name) for name, j in rank.items()])
    doc = W.partitionBy("doc_id")
    first = {name: F.min(name).over(doc) for name in rank}
    starts = {name: F.coalesce(m["line"] == F.col("line"), F.lit(False)) for name, m in first.items()}
    d = d.withColumn("total", F.sum("words").over(doc)).withColumn("up_to", F.sum("words").over(doc.orderBy("line").rowsBetween(W.unboundedPreceding, 0)))
    d = d.select("doc_id", "line", "text", "is_heading", "words", "total", "up_to", *[F.when(at, F.col(name)["j"]).alias(name) for name, at in starts.items()])
    # Words before the next heading or section; backwards, because only frames that grow are cheap.
    later = doc.orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, -1)
    before = lambda flag: F.coalesce(F.min(F.when(flag, F.col("up_to") - F.col("words"))).over(later), F.col("total"))
    d = d.withColumn("body_words", F.greatest(before(F.col("is_heading")), before(F.coalesce(*rank).isNotNull())) - F.col("up_to"))
    titled = lambda name, phrases: F.col("text").rlike(UNIT) | (F.size(T.tokens(F.replace(low, F.element_at(F.array(*map(F.lit, phrases)), F.col(name) + 1), F.lit(" ")))) <= EXTRA_WORDS)
    found = F.array(*[F.when(F.col(name).isNotNull() & titled(name, phrases), F.lit(name)) for name, _, _, phrases in SECTIONS])
    d = d.where("is_heading").select("doc_id", "line", "body_words", F.explode(found).alias("section")).where("section IS NOT NULL")
    return d.select("doc_id", "section", "line", "body_words", (F.col("body_words") < MIN_BODY).alias("empty"))


def order_issues(docs: DataFrame) -> DataFrame:
    """The first section of a document that stands before one that the list has earlier."""
    rank = F.create_map(*[x for i, (n, *_) in enumerate(SECTIONS) for x in (F.lit(n), F.lit(i))])
    p = section_check(docs).where("position IS NOT NULL").withColumn("rank", rank[F.col("section")])
    order = W.partitionBy("doc_id").orderBy("position", "rank")
    p = p.withColumn("next_rank", F.lead("rank").over(order)).withColumn("next_section", F.lead("section").over(order)).withColumn("next_at", F.lead("position").over(order))
    bad = p.where("next_rank < rank AND next_at > position")
    return bad.groupBy("doc_id").agg(F.min_by(F.struct("section", "next_section"), "position").alias("b")).select("doc_id", F.col("b.section").alias("section"), F.col("b.next_section").alias("before"))


def classify_family(docs: DataFrame, *more: str) -> DataFrame:
    """family and confidence by matched terms; ties keep the list's order; without any term client_communication. Columns `more` come along."""
    t = F.lower(F.coalesce("text", F.lit("")))
    made = F.array(*[F.struct(sum((F.contains(t, F.lit(x)).cast("int") for x in terms), F.lit(0)).alias("n"), F.lit(-i).alias("rank"), F.lit(f).alias("family")) for i, (f, terms) in enumerate(FAMILIES)])
    d = docs.select("doc_id", *more, F.reverse(F.array_sort(made)).alias("r"))
    best, second = F.col("r")[0]["n"], F.col("r")[1]["n"]
    conf = F.round(F.least(F.lit(0.98), 0.52 + 0.08 * best + 0.08 * F.greatest(F.lit(0), best - second)), 2)
    return d.select("doc_id", *more, F.when(best > 0, F.col("r")[0]["family"]).otherwise("client_communication").alias("family"), F.when(best > 0, conf).otherwise(0.34).alias("confidence"))


#: Families that have a profile to be measured against.
PROFILED = ["filing_official"]


def family_profile(docs: DataFrame) -> DataFrame:
    """doc_id, family, profile: the profile of the document's family, or uncalibrated."""
    return classify_family(docs).select("doc_id", "family", F.when(F.col("family").isin(PROFILED), F.concat(F.lit("profile:"), F.col("family"))).otherwise("uncalibrated").alias("profile"))


def classify_category(docs: DataFrame) -> DataFrame:
    """category, score, note: weighted terms behind a required one; close runners-up leave it unspecified."""
    t = F.lower(F.coalesce("text", F.lit("")))
    hit = lambda words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))
    made = F.array(*[F.struct((-F.when(hit(need) > 0, 3 + 3 * hit(strong) + hit(weak)).otherwise(0)).alias("neg"), F.lit(c).alias("category")) for c, strong, weak, need in sorted(CATEGORIES)])
    d = docs.select("doc_id", F.array_sort(made).alias("r"))
    best, second = -F.col("r")[0]["neg"], -F.col("r")[1]["neg"]
    close = (second >= 3) & (best - second <= 2)
    category = F.when((best < 3) | close, "nieokreslony").otherwise(F.col("r")[0]["category"])
    return d.select("doc_id", category.alias("category"), best.alias("score"), F.when(category == "nieokreslony", 0.0).when(best >= 9, 0.92).otherwise(0.63).alias("confidence"))


def check_document(docs: DataFrame) -> DataFrame:
    """doc_id, missing_required, missing_expected, empty, numbering, order (counts), blocking: all checks of a document's sections together."""
    n = lambda flag: F.coalesce(F.sum(flag.cast("long")), F.lit(0))
    s = section_check(docs).groupBy("doc_id").agg(n(F.col("status") == "missing_required").alias("missing_required"), n(F.col("status") == "missing_expected").alias("missing_expected"))
    per = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    for rows, name in ((section_bodies(docs).where("empty"), "empty"), (numbering_issues(docs), "numbering"), (order_issues(docs), "order")):
        s = s.join(per(rows, name), "doc_id", "left")
    return s.fillna(0, ["empty", "numbering", "order"]).withColumn("blocking", F.col("missing_required") + F.col("empty") > 0)


# Corpora by the first title word that occurs in a document's first line, in this order.
PARTITIONS = [("umowy", ["umowa", "umowy", "aneks"]), ("pisma", ["pozew", "wniosek", "odwołanie", "skarga"]), ("opinie", ["opinia", "warto", "kluczowe"]), ("regulaminy", ["regulamin", "polityka"])]
REST = "inne"


def partition(docs: DataFrame) -> DataFrame:
    """doc_id and the part of the corpus that the first matching rule names, by the document's title, its first line that is not blank."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n+"), lambda x: T.strip(x) != "")
    title = F.lower(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    part = F.coalesce(*[F.when(F.greatest(*[F.contains(title, F.lit(w)) for w in words], F.lit(False)), F.lit(name)) for name, words in PARTITIONS], F.lit(REST))
    return docs.select("doc_id", part.alias("part"))


#: Shares of a template that decide before the signals do, and after them.
SURE_SHARE, LIKELY_SHARE = 0.5, 0.25


def classify_cascade(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, category, by: a template that the document mostly holds, else its signals, else a template that it holds a quarter of."""
    near = nearest_template(docs, templates, LIKELY_SHARE).select("doc_id", "item_id", "recall")
    j = classify_category(docs).select("doc_id", "category").join(near, "doc_id", "left")
    named = F.concat(F.lit("template:"), F.col("item_id").cast("string"))
    by = F.when(F.col("recall") >= SURE_SHARE, "template").when(F.col("category") != "nieokreslony", "signals").when(F.col("item_id").isNotNull(), "template_share").otherwise("none")
    return j.select("doc_id", F.when(by.startswith("template"), named).otherwise(F.col("category")).alias("category"), by.alias("by"))


def pairs(text: Column) -> Column:
    """Distinct adjacent word pairs."""
    return F.array_distinct(T.ngrams(T.tokens(F.coalesce(text, F.lit(""))), 2))


def nearest_template(docs: DataFrame, templates: DataFrame, floor: float = 0.4, top: int = 1) -> DataFrame:
    """doc_id, item_id, f1, recall of the templates (`top` of them) that share most word pairs, if they share at least `floor` of the template's.

    An inverted index of the templates' pairs is joined with the documents' pairs, which are not moved for an index that can be broadcast. Rows without an id have no row.
    """
    t = templates.select("item_id", pairs(F.col("text")).alias("ps"))
    d = docs.where("doc_id IS NOT NULL").select("doc_id", pairs(F.col("text")).alias("ps"))
    posting = cut(t.select("item_id", F.size("ps").alias("nt"), F.explode_outer("ps").alias("pair")))
    if posting.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        posting = F.broadcast(posting)
    else:
        # A pair of many templates is the last to be read: what shares `floor` of a template shares one of its rarest pairs.
        held = posting.groupBy("pair").agg(F.count("*").alias("of"))
        ranked = posting.join(held, "pair").withColumn("nth", F.row_number().over(W.partitionBy("item_id").orderBy("of", "pair")))
        key = ranked.where(F.col("nth") <= F.col("nt") - F.ceil(F.col("nt") * floor) + 1).select("pair").distinct()
        may = d.select("doc_id", F.explode_outer("ps").alias("pair")).join(key, "pair", "left_semi").select("doc_id").distinct()
        d = d.join(may, "doc_id", "left_semi")
    flat = d.select("doc_id", F.size("ps").alias("nd"), F.explode_outer("ps").alias("pair"))
    shared = flat.join(posting, "pair").groupBy("doc_id", "item_id").agg(F.count("*").alias("k"), F.max("nt").alias("nt"), F.max("nd").alias("nd"))
    s = shared.where(F.col("k") / F.col("nt") >= floor).select("doc_id", "item_id", F.round(2 * F.col("k") / (F.col("nt") + F.col("nd")), 4).alias("f1"), F.round(F.col("k") / F.col("nt"), 4).alias("recall"))
    return s.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("f1"), "item_id"))).where(F.col("r") <= top).drop("r")
