"""Statute and case references, their verification, letters, and procedural deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import patterns as P

from . import text as T

ARTICLE = r"(?iu)(?<![\p{L}\p{N}_])art\.\s*(\d+[a-z]?)(?:\s*§\s*(\d+[a-z]?))?(?:\s*ust\.\s*(\d+[a-z]?))?(?:\s*pkt\s*(\d+[a-z]?))?"
CODE = r"(?iu)^\s*(k\.c\.|k\.p\.c\.|k\.p\.a\.|k\.k\.|k\.p\.|Kodeksu? cywiln\p{L}*|Kodeksu? pracy|Kodeksu? karn\p{L}*)"
CASE = r"(?<![\p{L}\p{N}_])([IVXLC]+)\s+([A-Z][A-Za-z]{0,4})\s+(\d{1,6})/(\d{4}|\d{2})(?!\d)"
# Keys of codes by written form.
CODES = {"k.c.": "kc", "k.p.c.": "kpc", "k.p.a.": "kpa", "k.k.": "kk", "k.p.": "kp"}


def statute_references(docs: DataFrame) -> DataFrame:
    """doc_id, start, article, paragraph, section, point, code of each article; the code is what follows at once."""
    text = F.coalesce("text", F.lit(""))
    groups = [F.regexp_extract_all(text, F.lit(ARTICLE), g) for g in range(1, 5)]
    after = F.slice(F.split(text, ARTICLE, -1), 2, 2**30)
    d = docs.where(F.col("text").rlike(ARTICLE)).select("doc_id", F.explode(F.arrays_zip(P.spans(text, ARTICLE).alias("s"), *[g.alias(n) for g, n in zip(groups, ("article", "paragraph", "section", "point"))], after.alias("rest"))).alias("z"))
    form = F.lower(F.regexp_extract("z.rest", CODE, 1))
    key = F.when(form == "", None)
    for f, k in CODES.items():
        key = key.when(form == f, k)
    key = key.when(form.contains("cywiln"), "kc").when(form.contains("pracy"), "kp").when(form.contains("karn"), "kk")
    null = lambda c: F.nullif(c, F.lit(""))
    return d.select("doc_id", F.col("z.s.start").alias("start"), "z.article", null(F.col("z.paragraph")).alias("paragraph"), null(F.col("z.section")).alias("section"), null(F.col("z.point")).alias("point"), key.alias("code"))


def case_references(docs: DataFrame) -> DataFrame:
    """doc_id and normalised signatures (two-digit years)."""
    text = F.coalesce("text", F.lit(""))
    z = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(CASE), g).alias(n) for g, n in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))])
    d = docs.where(F.col("text").rlike(CASE)).select("doc_id", F.explode(z).alias("z"))
    return d.select("doc_id", F.concat_ws(" ", "z.a", "z.b", F.concat(F.col("z.c"), F.lit("/"), F.substring("z.d", -2, 2))).alias("signature")).distinct()


def verify(references: DataFrame, units: DataFrame) -> DataFrame:
    """Distinct references with status against units (code, article): confirmed, not_found, or unknown_act."""
    r = references.select("doc_id", "code", "article").distinct()
    acts = units.select("code").distinct().withColumn("known", F.lit(True))
    j = r.join(units.select("code", "article").distinct().withColumn("found", F.lit(True)), ["code", "article"], "left").join(acts, "code", "left")
    status = F.when(F.col("found"), "confirmed").when(F.col("known"), "not_found").otherwise("unknown_act")
    return j.select("doc_id", "code", "article", status.alias("status"))


REMEDY = "<(?:odwołanie|skarga|skargę|sprzeciw|zażalenie|apelacja|apelację)>"
TERM = r"(?iu)w terminie\s+(\d{1,3})\s+(dni|tygodni|miesięcy)\s+od\s+(?:dnia\s+)?(\p{L}+)"
AMOUNT = r"(?iu)(\d{1,3}(?:[ .]\d{3})+(?:,\d{2})?|\d+(?:,\d{2})?)\s*(?:zł|PLN|EUR)(?![\p{L}])"
DATE = r"(?<!\d)(\d{1,2}\.\d{1,2}\.\d{4})(?!\d)"


# Numbers that name a person, a company or a case, and units of statutes.
IDENTIFIER = r"(?iu)((?:PESEL|NIP|REGON|KRS)\s*[:#]?\s*[0-9-]{6,20}|sygn\.\s*[IVXLC]+\s+[A-Z]{1,4}\s+\d{1,6}/\d{2,4})"
UNIT = r"(?iu)(art\.\s*\d+[a-z]?(?:\s*§\s*\d+[a-z]?)?)"


def letter_facts(docs: DataFrame) -> DataFrame:
    """Distinct dates, amounts, identifiers and units of statutes, in order of first appearance, and the first term with its unit and start."""
    text = F.coalesce("text", F.lit(""))
    joined = lambda p: F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(p), 1)), "; ")
    null = lambda c: F.nullif(c, F.lit(""))
    return docs.select("doc_id", joined(DATE).alias("dates"), joined(AMOUNT).alias("amounts"), joined(IDENTIFIER).alias("identifiers"), joined(UNIT).alias("units"), null(F.regexp_extract(text, TERM, 1)).cast("int").alias("term_value"), null(F.regexp_extract(text, TERM, 2)).alias("term_unit"), null(F.regexp_extract(text, TERM, 3)).alias("term_start"))


def remedies(docs: DataFrame) -> DataFrame:
    """doc_id, remedy, start, window: each remedy and the text up to the next one, 400 characters at most."""
    p = P.spark_pattern(REMEDY)
    s = F.col("s")
    d = docs.where(F.col("text").rlike(p)).select("doc_id", "text", P.spans(F.col("text"), p).alias("s"))
    d = d.select("doc_id", "text", F.posexplode("s").alias("i", "x"), s)
    end = F.coalesce(F.get(F.col("s"), F.col("i") + 1)["start"], F.char_length("text"))
    return d.select("doc_id", F.lower("x.value").alias("remedy"), F.col("x.start").alias("start"), F.substring(F.col("text"), F.col("x.start") + 1, F.least(F.lit(400), end - F.col("x.start"))).alias("window"))


# Titles of letters, and the verbs that grant a remedy.
TITLES = ["decyzja", "postanowienie", "wyrok", "nakaz zapłaty", "wezwanie", "upomnienie", "pozew", "wypowiedzenie"]
GRANTS = ["przysługuje", "można wnieść", "może wnieść", "można złożyć", "może złożyć", "wnosi się", "należy wnieść"]
HEAD_LINES, TITLE_CHARS, TITLE_LINES = 15, 90, 45
LINE_END = r"\r\n|\n|\r"
#: In both dialects but for the flags: from a line's "Pouczenie" to the end.
INSTRUCTION = rf"^[{P.BLANK}]*(pouczeni[ea](?:[^\p{{L}}\p{{N}}_].*)?)\z"


def letter_parts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, head, titles, instruction of a letter.

    The head is what stands above the title within the first lines that are not blank, or all of these without a title; titles are the short
    lines of the beginning; the instruction starts at its heading, without one it is the sentences that grant a remedy. A null text is empty. `more`: text, lines.
    """
    flat = lambda x: F.lower(T.strip(F.regexp_replace(x, f"[{P.BLANK}]+", " ")))
    is_title = lambda x: (F.char_length(flat(x)) <= TITLE_CHARS) & flat(x).rlike(rf"^(?:{'|'.join(TITLES)})(?!\p{{L}})")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("lines", F.split("text", LINE_END, -1))
    d = d.withColumn("first", F.slice(F.filter("lines", lambda x: x.rlike(f"[^{P.BLANK}]")), 1, HEAD_LINES))
    d = d.withColumn("title_at", F.array_position(F.transform("first", is_title), True).cast("int"))
    head = F.when(F.col("title_at") > 0, F.slice("first", F.lit(1), F.greatest(F.col("title_at") - 1, F.lit(0)))).otherwise(F.col("first"))
    short = F.filter(F.slice("lines", 1, TITLE_LINES), lambda x: F.char_length(T.strip(x)).between(1, TITLE_CHARS))
    grants = f"(?iu)(?:{'|'.join(GRANTS)})"
    granting = F.filter(F.split("text", T.SENTENCE_GAP, -1), lambda x: x.rlike(grants))
    headed = F.regexp_extract("text", f"(?imsud){INSTRUCTION}", 1)
    # Texts that grant nothing are not split.
    instruction = F.when(headed != "", headed).when(F.col("text").rlike(grants), F.array_join(granting, " ")).otherwise("")
    return d.select("doc_id", F.array_join(head, "\n").alias("head"), F.array_join(F.transform(short, flat), " | ").alias("titles"), instruction.alias("instruction"), *more)


# Public holidays of every year as (month, day).
HOLIDAYS = [(1, 1), (1, 6), (5, 1), (5, 3), (8, 15), (11, 1), (11, 11), (12, 25), (12, 26)]
EVE_SINCE = 2025


def easter(year: Column) -> Column:
    """Easter Sunday of a year by the anonymous Gregorian rule, in integers."""
    div = lambda x, n: F.floor(x / n)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * k, 451)
    n = h + k - 7 * m + 114
    return F.make_date(year, div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def holidays(years: DataFrame) -> DataFrame:
    """day of every public holiday in the years (a column year)."""
    y = F.col("year")
    fixed = [F.make_date(y, F.lit(m), F.lit(d)) for m, d in HOLIDAYS]
    moving = [F.date_add(easter(y), 1), F.date_add(easter(y), 60)]
    eve = F.when(y >= EVE_SINCE, F.make_date(y, F.lit(12), F.lit(24)))
    return years.select("year", F.explode(F.array(*fixed, *moving, eve)).alias("day")).where("day IS NOT NULL").distinct()


def deadlines(deliveries: DataFrame, value: int = 14, unit: str = "day") -> DataFrame:
    """id, delivered, term_end, last_day (the first working day from term_end on), moved (days)."""
    end = {"day": F.date_add("delivered", value), "week": F.date_add("delivered", 7 * value), "month": F.add_months("delivered", value)}[unit]
    d = deliveries.select("id", F.col("delivered").cast("date").alias("delivered")).withColumn("term_end", end)
    ends = d.select("term_end").where("term_end IS NOT NULL").distinct()
    years = ends.select(F.explode(F.array(F.year("term_end"), F.year("term_end") + 1)).alias("year")).distinct()
    # At most nine days in a row are off; the first that is not is the last day.
    days = ends.select("term_end", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).withColumn("day", F.date_add("term_end", F.col("k")))
    open_ = days.where(~F.dayofweek("day").isin(1, 7)).join(holidays(years).select("day"), "day", "left_anti").groupBy("term_end").agg(F.min("day").alias("last_day"))
    return d.join(open_, "term_end", "left").select("id", "delivered", "term_end", "last_day", F.datediff("last_day", "term_end").alias("moved"))


SOON = 7


def deadline_status(found: DataFrame, today: Column) -> DataFrame:
    """The deadlines with days_left and status at a day: passed, today, soon (a week) or open; unknown without a last day."""
    left = F.datediff("last_day", today)
    status = F.when(left.isNull(), "unknown").when(left < 0, "passed").when(left == 0, "today").when(left <= SOON, "soon").otherwise("open")
    return found.select("id", "last_day", left.alias("days_left"), status.alias("status"))


def document_facts(docs: DataFrame) -> DataFrame:
    """Counts of references and remedies for each document that has one."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    d = docs.select("doc_id", n(ARTICLE).alias("articles"), n(CASE).alias("cases"), n(P.spark_pattern(REMEDY)).alias("remedies"))
    return d.where("articles + cases + remedies > 0")
