"""What an incoming letter is, who sent it, under which procedure, and the replies that it allows.

A catalogue (acts, senders, procedures, replies) is a parameter of bounded size; it becomes part of the
expressions, so a letter is read in one pass without a shuffle. A null text is empty: nothing is
recognised, and only the replies that fit every letter are offered. Rows are letters, repeated ids too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import patterns as P

from . import legal

# Weights of phrases and titles, the floor of a guess, and the numbers and units of terms.
TITLE, STRONG, WEAK, HEAD, FLOOR = 5, 3, 1, 2, 3
NUMBERS = {"jednego": 1, "dwóch": 2, "dwu": 2, "trzech": 3, "czterech": 4, "pięciu": 5, "siedmiu": 7, "dziesięciu": 10, "czternastu": 14, "dwudziestu jeden": 21, "trzydziestu": 30}
ADJECTIVES = {"tygodniowym": (1, "week"), "dwutygodniowym": (2, "week"), "miesięcznym": (1, "month"), "siedmiodniowym": (7, "day"), "czternastodniowym": (14, "day"), "trzydziestodniowym": (30, "day")}
UNITS = {"dni": "day", "dnia": "day", "tygodni": "week", "tygodnia": "week", "tygodnie": "week", "miesięcy": "month", "miesiąca": "month", "miesiące": "month"}
WINDOW = 400
#: A time limit: a length in one word, or a number and a unit.
GAP = f"[{P.BLANK}]+"
_NUMBERS, _UNITS = "|".join(n.replace(" ", GAP) for n in sorted(NUMBERS, key=len, reverse=True)), "|".join(sorted(UNITS, key=len, reverse=True))
TERM = rf"(?iu)w(?<![{P.WORDCHAR}]w){GAP}(?:terminie|ciągu){GAP}(?:(\d+-dniowym|{'|'.join(ADJECTIVES)})|(?:(\d+|{_NUMBERS}){GAP})?({_UNITS}))(?![{P.WORDCHAR}])"


@dataclass(frozen=True)
class Kind:
    """An act or a sender: strong and weak phrases, an act's headers, a sender's procedure."""

    id: str
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    headers: tuple[str, ...] = ()
    procedure: str | None = None


@dataclass(frozen=True)
class Reply:
    """A reply: the letters it fits (empty: all), remedies that name it, its statutory term, phrases that rule it out."""

    id: str
    acts: tuple[str, ...] = ()
    senders: tuple[str, ...] = ()
    procedures: tuple[str, ...] = ()
    remedies: tuple[str, ...] = ()
    term: tuple[int, str] | None = None
    instruction_only: bool = False
    term_from_letter: bool = False
    ruled_out: tuple[str, ...] = ()

    @property
    def general(self) -> bool:
        return not (self.acts or self.senders or self.procedures)


@dataclass(frozen=True)
class Catalogue:
    acts: list[Kind] = field(default_factory=list)
    senders: list[Kind] = field(default_factory=list)
    procedures: list[Kind] = field(default_factory=list)
    replies: list[Reply] = field(default_factory=list)


def phrase_pattern(phrase: str, whole: bool = False) -> str:
    """From a word's start; abbreviations and words of up to three letters end there too, longer ones are stems."""
    closed = whole or phrase.endswith(".") or len(phrase) <= 3
    body = "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in phrase)
    return f"(?<![{P.WORDCHAR}]){body}" + (f"(?![{P.WORDCHAR}])" if closed else "")


def _once(d: DataFrame) -> DataFrame:
    """d behind an explode, so that the columns made so far are evaluated once, however often they are used."""
    return d.select(F.explode_outer(F.array(F.struct("*"))).alias("x")).select("x.*")


def _holds(text: Column, phrase: str) -> Column:
    """Whether text has the phrase: looked for as plain characters first, which is much cheaper than its pattern."""
    return F.contains(text, F.lit(phrase)) & text.rlike(phrase_pattern(phrase))


def _times(text: Column, phrase: str) -> Column:
    return F.when(F.contains(text, F.lit(phrase)), F.regexp_count(text, F.lit(phrase_pattern(phrase)))).otherwise(0)


def _score(kind: Kind, head: Column, lowered: Column, factor: int) -> Column:
    points = F.lit(0)
    for weight, phrases in ((STRONG, kind.strong), (WEAK, kind.weak)):
        for p in phrases:
            points = points + F.when(_holds(head, p), weight * factor).when(_holds(lowered, p), weight).otherwise(0)
    return points


def _best(kinds: list[Kind], scores: list[Column]) -> Column:
    """id and score of the highest score above the floor; ties keep the catalogue's order."""
    made = [F.struct(s.cast("int").alias("score"), F.lit(-i).alias("rank"), F.lit(k.id).alias("id")) for i, (k, s) in enumerate(zip(kinds, scores))]
    nothing = F.struct(F.lit(FLOOR - 1).alias("score"), F.lit(-len(made)).alias("rank"), F.lit(None).cast("string").alias("id"))
    return F.array_max(F.array(nothing, *made))


def letter_kind(docs: DataFrame, cat: Catalogue) -> DataFrame:
    """doc_id, text, instruction, act, act_score, titled, sender, sender_score, procedure, cited of each letter.

    A title names the act with the longest header that it begins with. The sender's procedure holds if the letter cites it, else the most
    cited one, else the sender's.
    """
    d = legal.letter_parts(docs, "text").withColumn("lowered", F.lower("text")).withColumn("head", F.lower("head"))
    d = _once(d)
    headers = sorted(((h, a.id) for a in cat.acts for h in a.headers), key=lambda x: (len(x[0]), x[1]), reverse=True)
    names = lambda t: F.coalesce(*[F.when(t.rlike(f"^{re.escape(h)}(?!\\p{{L}})"), F.lit(a)) for h, a in headers], F.lit(""))
    d = d.withColumn("named", F.array_distinct(F.transform(F.split("titles", r" \| "), names)))
    d = _once(d)
    is_titled = lambda a: F.array_contains("named", a.id)
    act = _best(cat.acts, [_score(a, F.col("head"), F.col("lowered"), 1) + F.when(is_titled(a), TITLE).otherwise(0) for a in cat.acts])
    sender = _best(cat.senders, [_score(x, F.col("head"), F.col("lowered"), HEAD) for x in cat.senders])
    d = _once(d.withColumn("a", act).withColumn("s", sender))
    own = F.coalesce(*[F.when(F.col("s.id") == x.id, F.lit(x.procedure)) for x in cat.senders], F.lit(None).cast("string"))
    times = [F.struct(sum((_times(F.col("lowered"), p) for p in k.strong), F.lit(0)).cast("int").alias("n"), F.lit(-i).alias("rank"), F.lit(k.id).alias("id")) for i, k in enumerate(cat.procedures)]
    nothing = F.struct(F.lit(0).alias("n"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("id"))
    d = _once(d.withColumn("own", own).withColumn("ps", F.array(nothing, *times)))
    of_own = F.coalesce(F.get(F.filter("ps", lambda x: (x["id"] == F.col("own")) & (x["n"] > 0)), F.lit(0))["n"], F.lit(0)) if cat.procedures else F.lit(0)
    top = F.array_max("ps")
    procedure = F.when(of_own > 0, F.col("own")).when(top["n"] > 0, top["id"]).otherwise(F.col("own"))
    cited = F.when(of_own > 0, of_own).otherwise(top["n"])
    got = lambda x: F.when(F.col(f"{x}.id").isNotNull(), F.col(f"{x}.score")).otherwise(0)
    titled = F.coalesce(F.array_contains("named", F.col("a.id")), F.lit(False))
    return _once(d.select("doc_id", "text", "instruction", F.col("a.id").alias("act"), got("a").alias("act_score"), titled.alias("titled"), F.col("s.id").alias("sender"), got("s").alias("sender_score"), procedure.alias("procedure"), cited.alias("cited")))


def term(window: Column) -> Column:
    """(value, unit) of the first time limit that a passage states, else null."""
    g = lambda i: F.lower(F.regexp_replace(F.regexp_extract(window, TERM, i), GAP, " "))
    by = lambda table: F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    number = F.when(g(2) == "", 1).when(g(2).rlike(r"^\d{1,9}$"), F.expr("1") * F.regexp_extract(g(2), r"^\d{1,9}$", 0).try_cast("int")).otherwise(by(NUMBERS)[g(2)])
    value = F.when(g(1).endswith("-dniowym"), F.regexp_extract(g(1), r"^\d{1,9}", 0).try_cast("int")).when(g(1) != "", by({k: v for k, (v, _) in ADJECTIVES.items()})[g(1)]).otherwise(number)
    unit = F.when(g(1).endswith("-dniowym"), "day").when(g(1) != "", by({k: u for k, (_, u) in ADJECTIVES.items()})[g(1)]).otherwise(by(UNITS)[g(3)])
    found = F.regexp_extract(window, TERM, 0) != ""
    return F.when(found & value.isNotNull(), F.struct(value.cast("int").alias("value"), unit.alias("unit")))


def _days(t: Column) -> Column:
    return F.struct(F.when(t["unit"] == "month", "month").otherwise("day").alias("unit"), (t["value"] * F.when(t["unit"] == "week", 7).otherwise(1)).alias("value"))


def offered(docs: DataFrame, cat: Catalogue) -> DataFrame:
    """doc_id, place (from 0), reply, from_instruction, remedy, term_value, term_unit, term_source, conflict, confidence.

    First the replies to remedies that the instruction names (one that fits the letter, else one for its act, else any that has the
    remedy), then those of the catalogue that fit, then the general ones. The instruction's term wins over the statute's; a
    conflict is marked. Confidence is high if a title and a named remedy agree on the act, middle if the act is known, else low.
    """
    d = letter_kind(docs, cat).withColumn("lowered", F.lower("instruction"))
    phrases = sorted({p for r in cat.replies for p in r.remedies}, key=lambda p: (-len(p), p))
    remedy = "|".join(phrase_pattern(p, whole=True) for p in phrases) or r"\b\B"
    d = _once(d.withColumn("found", P.spans(F.col("lowered"), remedy)))
    upto = lambda x, i: F.coalesce(F.get("found", i + 1)["start"], F.char_length("lowered"))
    window = lambda x, i: F.substring("instruction", x["start"] + 1, F.least(F.lit(WINDOW), upto(x, i) - x["start"]))
    d = d.withColumn("remedies", F.transform("found", lambda x, i: F.struct(x["value"].alias("phrase"), term(window(x, i)).alias("term"))))
    # The first passage is found once, and only it is taken apart.
    d = _once(d.withColumn("passage", F.regexp_substr("text", F.lit(TERM))))
    d = _once(d.withColumn("told", F.when(F.col("passage").isNotNull(), term(F.col("passage")))))

    among = lambda name, wanted: F.coalesce(F.col(name).isin(list(wanted)), F.lit(False)) if wanted else F.lit(True)
    told = F.col("told")
    no_term = F.lit(None).cast("struct<value:int,unit:string>")
    rows = []
    for i, r in enumerate(cat.replies):
        open_ = ~F.greatest(*[_holds(F.col("lowered"), p) for p in r.ruled_out], F.lit(False), F.lit(False))
        statute = F.struct(F.lit(r.term[0]).alias("value"), F.lit(r.term[1]).alias("unit")) if r.term else no_term
        own = told if r.term_from_letter else statute
        rows.append(
            F.struct(
                F.lit(i).alias("i"), F.lit(r.id).alias("reply"), F.array(*[F.lit(p) for p in r.remedies]).cast("array<string>").alias("phrases"), (among("act", r.acts) & among("sender", r.senders) & among("procedure", r.procedures)).alias("fits"), among("act", r.acts).alias("answers"),
                open_.alias("open"), F.lit(r.general).alias("general"), F.lit(r.instruction_only).alias("only"), statute.alias("statute"), own.alias("term"), F.when(own.isNotNull(), "letter" if r.term_from_letter else "statute").otherwise("").alias("source"),
            )
        )
    d = _once(d.withColumn("rs", F.array(*rows)))

    def owners(phrase: Column) -> Column:
        own = lambda more: F.filter("rs", lambda r: F.array_contains(r["phrases"], phrase) & more(r))
        fit, answer, every = own(lambda r: r["fits"]), own(lambda r: r["answers"]), own(lambda r: F.lit(True))
        return F.filter(F.when(F.size(fit) > 0, fit).when(F.size(answer) > 0, answer).otherwise(every), lambda r: r["open"])

    def shown(r: Column, phrase: Column, t: Column) -> Column:
        differs = t.isNotNull() & r["statute"].isNotNull() & (_days(t) != _days(r["statute"]))
        best, source = F.coalesce(t, r["term"]), F.when(t.isNotNull(), "instruction").otherwise(r["source"])
        return F.struct(r["i"].alias("i"), r["reply"].alias("reply"), phrase.alias("remedy"), best.alias("term"), source.alias("source"), F.coalesce(differs, F.lit(False)).alias("conflict"), r["answers"].alias("answers"))

    none = F.lit(None).cast("string")
    by_remedy = F.flatten(F.transform("remedies", lambda x: F.transform(owners(x["phrase"]), lambda r: shown(r, x["phrase"], x["term"]))))
    plain = lambda keep: F.transform(F.filter("rs", keep), lambda r: shown(r, none, no_term))
    listed = plain(lambda r: F.col("act").isNotNull() & ~r["general"] & ~r["only"] & r["fits"] & r["open"])
    d = _once(d.withColumn("cs", F.concat(by_remedy, listed, plain(lambda r: r["general"]))))
    first = F.transform("cs", lambda c, k: F.when(F.size(F.filter(F.slice("cs", F.lit(1), k), lambda o: o["i"] == c["i"])) == 0, c))
    d = _once(d.withColumn("cs", F.filter(first, lambda c: c.isNotNull())))
    agreed = F.exists("cs", lambda c: c["remedy"].isNotNull() & c["answers"])
    confidence = F.when(F.col("act").isNotNull() & F.col("titled") & agreed, "high").when(F.col("act").isNotNull(), "middle").otherwise("low")
    out = d.select("doc_id", confidence.alias("confidence"), F.posexplode("cs").alias("place", "c"))
    return out.select("doc_id", "place", "c.reply", F.col("c.remedy").isNotNull().alias("from_instruction"), "c.remedy", F.col("c.term.value").alias("term_value"), F.col("c.term.unit").alias("term_unit"), F.col("c.source").alias("term_source"), "c.conflict", "confidence")
