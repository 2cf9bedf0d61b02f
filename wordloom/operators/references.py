"""References to statutes and cases that are bound to their act, with offsets, and their verification.

An article belongs to the code named right after it, or to a journal citation later in the same sentence
when no other article, act or sentence end stands between. Null and empty texts have no references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import patterns as P

from . import text as T

# How codes are written after a unit, by key.
FORMS = {
    "kc": ["k.c.", "kc", "Kodeksu cywilnego"], "kpc": ["k.p.c.", "kpc", "Kodeksu postępowania cywilnego"], "kp": ["k.p.", "kp", "Kodeksu pracy"], "kk": ["k.k.", "kk", "Kodeksu karnego"],
    "kkw": ["k.k.w.", "kkw", "Kodeksu karnego wykonawczego"], "kks": ["k.k.s.", "kks", "Kodeksu karnego skarbowego"], "kpk": ["k.p.k.", "kpk", "Kodeksu postępowania karnego"], "kw": ["k.w.", "kw", "Kodeksu wykroczeń"],
    "ksh": ["k.s.h.", "ksh", "Kodeksu spółek handlowych"], "kro": ["k.r.o.", "kro", "Kodeksu rodzinnego i opiekuńczego"], "kpa": ["k.p.a.", "kpa", "Kodeksu postępowania administracyjnego"], "op": ["o.p.", "Ordynacji podatkowej"],
}
# Other acts that break a binding, and the symbols of tribunals that have no division.
OTHER_ACT = r"(?iu)rozporządzeni|dyrektyw|Konstytucj|(?<![\p{L}\p{N}_])(?:RODO|TFUE|TUE)(?![\p{L}\p{N}_])"
UNDIVIDED = ["KIO", "Kpt", "SK", "Kp", "Pp", "Tw", "Ts", "K", "P", "U"]
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹"

_S = f"[{P.BLANK}]*"
_LIST = rf"\d+[a-z]?(?:{_S}(?:,|i|oraz){_S}\d+[a-z]?)*"
ARTICLE = rf"(?<![{P.WORDCHAR}])[Aa]rt\.{_S}(\d+)([a-z])?(?!\d)([{RAISED}]+|\^\d+|\(\d+\))?(?:{_S}§{_S}({_LIST}))?(?:{_S}ust\.{_S}({_LIST}))?(?:{_S}pkt\.?{_S}({_LIST}))?"
JOURNAL = rf"Dz\.{_S}U\.{_S}(?:z{_S})?(\d{{4}})(?:{_S}r\.)?{_S},?{_S}(?:Nr{_S}\d+{_S},?{_S})?poz\.{_S}(\d+)"
CASE = rf"(?<![\p{{L}}\d/])(?:[IVX]{{1,6}}[{P.BLANK}]+[A-Z][A-Za-z]{{0,4}}|(?:{'|'.join(UNDIVIDED)}))[{P.BLANK}]+\d{{1,6}}/(?:\d{{4}}|\d{{2}})(?![\d/])"
#: A full word and a period right before a citation end the sentence there.
CLOSED = rf"\p{{Ll}}{{3,}}\.{_S}$"
_FORMS = sorted((f for fs in FORMS.values() for f in fs), key=len, reverse=True)
_BODY = "|".join(f.replace(".", rf"\.{_S}").replace(" ", f"[{P.BLANK}]+") for f in _FORMS)
CODE = rf"(?iu)^{_S},?{_S}({_BODY})(?!\p{{L}})"
CODE_ANYWHERE = rf"(?iu)(?<!\p{{L}})(?:{_BODY})(?!\p{{L}})"
#: Stand for the capitals of a citation while sentences are cut, so that it does not end one.
HELD = "\ue000\ue001\ue002"


def sentences(docs: DataFrame, wanted: str) -> DataFrame:
    """doc_id, at, sentence: the sentences that hold a pattern, cut from the text, with their offsets."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), f"D(?={JOURNAL[1:]})", HELD[0])
    text = F.regexp_replace(text, rf"({HELD[0]}z\.{_S})U\.", f"$1{HELD[1]}.")
    text = F.regexp_replace(text, rf"({HELD[1]}\.{_S}(?:z{_S})?\d{{4}}(?:{_S}r\.)?{_S},?{_S})Nr", f"$1{HELD[2]}r")
    gap = rf"\n+|{T.SENTENCE_GAP}"
    none = F.array().cast("array<struct<at:int,sentence:string>>")
    pieces = F.arrays_zip(F.split("text", gap, -1).alias("s"), F.regexp_extract_all("text", F.lit(gap), 0).alias("gap"))

    def step(s: Column, p: Column) -> Column:
        plain = F.translate(p["s"], HELD, "DUN")
        held = F.when(plain.rlike(wanted), F.array(F.struct(s["at"].alias("at"), plain.alias("sentence")))).otherwise(none)
        return F.struct((s["at"] + F.char_length(p["s"]) + F.coalesce(F.char_length(p["gap"]), F.lit(0))).alias("at"), F.concat(s["out"], held).alias("out"))

    d = docs.where(F.col("text").rlike(wanted)).select("doc_id", text.alias("text"))
    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return d.select("doc_id", F.explode_outer(found).alias("x")).where("x IS NOT NULL").select("doc_id", "x.at", "x.sentence")


def statutes(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, text, act, article, paragraphs, passages, points, flattened of each bound article.

    Acts are keys of codes, or DU/year/position. Numbers are lists joined by commas, empty without one. A superscript is written
    `449_1`; flattened marks an article whose last digit may have been one.
    """
    names = ["digits", "letter", "raised", "paragraphs", "passages", "points"]
    s = sentences(docs, ARTICLE)
    groups = [F.regexp_extract_all("sentence", F.lit(ARTICLE), i).alias(n) for i, n in enumerate(names, 1)]
    z = s.select("doc_id", "at", "sentence", F.explode_outer(F.arrays_zip(P.spans(F.col("sentence"), ARTICLE).alias("s"), *groups)).alias("z")).where("z IS NOT NULL")
    z = z.withColumn("rest", F.substring(F.col("sentence"), F.col("z.s.end") + 1, F.char_length("sentence")))
    z = z.withColumn("named", F.regexp_extract("rest", CODE, 1)).withColumn("upto", F.char_length(F.regexp_extract("rest", CODE, 0)))
    cited = rf"(?s)^(.*?){JOURNAL}"
    z = z.withColumn("between", F.regexp_extract("rest", cited, 1))
    free = F.col("rest").rlike(cited) & ~F.greatest(*[F.col("between").rlike(p) for p in (ARTICLE, CLOSED, OTHER_ACT, CODE_ANYWHERE)])
    form = F.lower(F.regexp_replace(F.regexp_replace(F.col("named"), rf"\.{_S}", "."), f"[{P.BLANK}]+", " "))
    keys = F.create_map(*[F.lit(x) for k, fs in FORMS.items() for f in fs for x in (f.lower(), k)])
    act = F.when(F.col("named") != "", keys[form]).when(free, F.concat_ws("/", F.lit("DU"), F.regexp_extract("rest", cited, 2), F.regexp_extract("rest", cited, 3)))
    end = F.col("z.s.end") + F.col("upto")
    index = F.regexp_replace(F.translate("z.raised", RAISED, "0123456789"), r"[\^()]", "")
    article = F.concat("z.digits", "z.letter", F.when(index != "", F.concat(F.lit("_"), index)).otherwise(""))
    listed = lambda n: F.array_join(F.regexp_extract_all(F.col(f"z.{n}"), F.lit(r"\d+[a-z]?"), 0), ",").alias(n)
    shown = T.strip(F.substring(F.col("sentence"), F.col("z.s.start") + 1, end - F.col("z.s.start")))
    flat = (index == "") & (F.col("z.letter") == "") & (F.char_length("z.digits") >= 2)
    out = z.select("doc_id", (F.col("at") + F.col("z.s.start")).alias("start"), (F.col("at") + end).alias("end"), shown.alias("text"), act.alias("act"), article.alias("article"), *map(listed, names[3:]), flat.alias("flattened"))
    return out.where("act IS NOT NULL")


def cases(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, text, signature (single blanks, a year of two digits) of each case number."""
    d = docs.where(F.col("text").rlike(CASE)).select("doc_id", F.explode_outer(P.spans(F.col("text"), CASE)).alias("s")).where("s IS NOT NULL")
    plain = F.regexp_replace(F.regexp_replace("s.value", f"[{P.BLANK}]+", " "), r"/(?:19|20)(\d{2})$", "/$1")
    return d.select("doc_id", "s.start", "s.end", F.col("s.value").alias("text"), plain.alias("signature"))


def verdicts(refs: DataFrame, units: DataFrame, reachable: DataFrame) -> DataFrame:
    """Distinct (doc_id, act, article) with status and hint, against units (act, article) of the acts in reachable (act, available).

    confirmed, not_found, unavailable (an act that could not be read) or unknown_act. The hint is the superscript form where a
    flattened article is not found but that form is: `4491` for `449_1`.
    """
    r = refs.groupBy("doc_id", "act", "article").agg(F.max("flattened").alias("flattened"))
    split = F.when(F.col("flattened"), F.concat(F.expr("substring(article, 1, char_length(article) - 1)"), F.lit("_"), F.substring("article", -1, 1)))
    known = units.select("act", "article").distinct()
    j = r.withColumn("split", split).join(known.withColumn("found", F.lit(True)), ["act", "article"], "left")
    j = j.join(known.select("act", F.col("article").alias("split"), F.lit(True).alias("apart")), ["act", "split"], "left")
    j = j.join(reachable.groupBy("act").agg(F.max("available").alias("available")), "act", "left")
    status = F.when(F.col("available").isNull(), "unknown_act").when(~F.col("available"), "unavailable").when(F.col("found"), "confirmed").otherwise("not_found")
    return j.withColumn("status", status).select("doc_id", "act", "article", "status", F.when((F.col("status") == "not_found") & F.col("apart"), F.col("split")).alias("hint"))


def tree_units(trees: DataFrame, depth: int = 6) -> DataFrame:
    """act and article of each unit in a tree of units: rows (act, tree), the tree JSON of nodes with id and children, at most `depth` deep.

    Ids name their path (`art_449_1-par_2`); the part of the article counts. Broken or null JSON has no units.
    """
    node = F.from_json(F.coalesce("tree", F.lit("")), "id string, children array<string>")
    level = trees.select("act", node.alias("n"))
    out = None
    for _ in range(depth):
        ids = level.select("act", F.regexp_extract(F.coalesce("n.id", F.lit("")), r"(?:^|-)art_([0-9]+[a-z]?(?:_[0-9]+)?)", 1).alias("article"))
        out = ids if out is None else out.union(ids)
        level = level.select("act", F.explode("n.children").alias("c")).select("act", F.from_json("c", "id string, children array<string>").alias("n"))
    return out.where("article <> ''").distinct()
