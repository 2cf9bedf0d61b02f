"""Nominalisations: light verbs with a noun as plain verbs, and purposes with a gerund as clauses.

The phrases are a trie of words, built once for a task; a sentence is read once, with a look-up for each word, however many
phrases there are. What follows a phrase decides whether its noun may go, by the readings of a user's table of forms: a nominal
that may belong to the noun keeps it.

Defined results: rows with null or repeated ids are documents of their own; a null text has no sentences; without readings of the word
after a phrase nothing speaks against it; without a table (None) any word after it does. No replacement may hold a word that
begins or ends a phrase, so one replacement never makes another phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import patterns as P
from wordloom.functions.plans import cut

from . import lexicon, rewrite
from .redundancy import KEY, numbered

PLACE = [*KEY, "doc_id"]

# Phrases with their verbs, risks and modes, scores and risks, words that attach to the noun before, and conjunctions.
PHRASES = [
    ("dokonać analizy", "przeanalizować", 0.10, "both"), ("dokonywać analizy", "analizować", 0.10, "both"), ("dokonano analizy", "przeanalizowano", 0.08, "both"), ("dokonać zmiany", "zmienić", 0.10, "both"),
    ("dokonywać zmiany", "zmieniać", 0.10, "both"), ("dokonano zmiany", "zmieniono", 0.08, "both"), ("dokonać wyboru", "wybrać", 0.11, "both"), ("dokonywać wyboru", "wybierać", 0.11, "both"),
    ("dokonano wyboru", "wybrano", 0.08, "both"), ("dokonać ustalenia", "ustalić", 0.10, "both"), ("dokonywać ustalenia", "ustalać", 0.10, "both"), ("dokonano ustalenia", "ustalono", 0.08, "both"),
    ("dokonać rozliczenia", "rozliczyć", 0.10, "both"), ("dokonywać rozliczenia", "rozliczać", 0.10, "both"), ("dokonano rozliczenia", "rozliczono", 0.08, "both"), ("dokonać podziału", "podzielić", 0.11, "both"),
    ("dokonywać podziału", "dzielić", 0.11, "both"), ("dokonano podziału", "podzielono", 0.08, "both"), ("dokonać pomiaru", "zmierzyć", 0.10, "both"), ("dokonywać pomiaru", "mierzyć", 0.10, "both"),
    ("dokonano pomiaru", "zmierzono", 0.08, "both"), ("dokonać naprawy", "naprawić", 0.10, "both"), ("dokonywać naprawy", "naprawiać", 0.10, "both"), ("dokonano naprawy", "naprawiono", 0.08, "both"),
    ("dokonać przeglądu", "przejrzeć", 0.11, "both"), ("dokonywać przeglądu", "przeglądać", 0.11, "both"), ("dokonano przeglądu", "przejrzano", 0.08, "both"), ("dokonać płatności", "zapłacić", 0.14, "strong"),
    ("dokonywać płatności", "płacić", 0.14, "strong"), ("dokonano płatności", "zapłacono", 0.12, "strong"), ("dokonać zakupu", "kupić", 0.14, "strong"), ("dokonywać zakupu", "kupować", 0.14, "strong"),
    ("dokonano zakupu", "kupiono", 0.12, "strong"), ("przeprowadzić analizę", "przeanalizować", 0.10, "both"), ("przeprowadzać analizę", "analizować", 0.10, "both"), ("przeprowadzono analizę", "przeanalizowano", 0.08, "both"),
    ("przeprowadzić kontrolę", "skontrolować", 0.10, "both"), ("przeprowadzać kontrolę", "kontrolować", 0.10, "both"), ("przeprowadzono kontrolę", "skontrolowano", 0.08, "both"),
    ("przeprowadzić weryfikację", "zweryfikować", 0.10, "both"), ("przeprowadzać weryfikację", "weryfikować", 0.10, "both"), ("przeprowadzono weryfikację", "zweryfikowano", 0.08, "both"),
    ("przeprowadzić badanie", "zbadać", 0.10, "both"), ("przeprowadzać badanie", "badać", 0.10, "both"), ("przeprowadzono badanie", "zbadano", 0.08, "both"), ("przeprowadzić ocenę", "ocenić", 0.10, "both"),
    ("przeprowadzać ocenę", "oceniać", 0.10, "both"), ("przeprowadzono ocenę", "oceniono", 0.08, "both"), ("sprawować kontrolę", "kontrolować", 0.10, "both"), ("sprawuje kontrolę", "kontroluje", 0.10, "both"),
    ("sprawują kontrolę", "kontrolują", 0.10, "both"), ("sprawowano kontrolę", "kontrolowano", 0.08, "both"), ("sprawować nadzór", "nadzorować", 0.10, "both"), ("sprawuje nadzór", "nadzoruje", 0.10, "both"),
    ("sprawują nadzór", "nadzorują", 0.10, "both"), ("sprawowano nadzór", "nadzorowano", 0.08, "both"), ("podjąć uchwałę", "uchwalić", 0.10, "both"), ("podejmować uchwałę", "uchwalać", 0.10, "both"),
    ("podjęto uchwałę", "uchwalono", 0.08, "both"), ("podjąć decyzję", "zdecydować", 0.14, "strong"), ("podejmować decyzję", "decydować", 0.14, "strong"), ("podjęto decyzję", "zdecydowano", 0.12, "strong"),
    ("wydać zezwolenie", "zezwolić", 0.11, "both"), ("wydawać zezwolenie", "zezwalać", 0.11, "both"), ("wydano zezwolenie", "zezwolono", 0.09, "both"), ("wydać pozwolenie", "pozwolić", 0.11, "both"),
    ("wydawać pozwolenie", "pozwalać", 0.11, "both"), ("wydano pozwolenie", "pozwolono", 0.09, "both"), ("wydać postanowienie", "postanowić", 0.14, "strong"), ("wydawać postanowienie", "postanawiać", 0.14, "strong"),
    ("wydano postanowienie", "postanowiono", 0.12, "strong"), ("udzielić zezwolenia", "zezwolić", 0.11, "both"), ("udzielać zezwolenia", "zezwalać", 0.11, "both"), ("udzielono zezwolenia", "zezwolono", 0.09, "both"),
    ("udzielić odpowiedzi", "odpowiedzieć", 0.10, "both"), ("udzielać odpowiedzi", "odpowiadać", 0.10, "both"), ("udzielono odpowiedzi", "odpowiedziano", 0.08, "both"), ("złożyć oświadczenie", "oświadczyć", 0.11, "both"),
    ("składać oświadczenie", "oświadczać", 0.11, "both"), ("złożono oświadczenie", "oświadczono", 0.09, "both"),
]
COMBINED, SINGLE, PURPOSE, PURPOSE_RISK = 0.62, 0.56, 0.58, 0.14
ATTACHED, AGENT, REFLEXIVE = ["nad", "o", "do"], "przez", "się"
CONJUNCTION = "<(?:i|oraz|lub|albo|bądź|ani|a_także)>"
IN_ORDER_TO = r"(?iu)(?<![\p{L}\p{N}_])w\s+celu\s+(\p{L}+)"
SPANS = "array<struct<start:int,end:int,rule:int,next:string>>"
WORD = re.compile(r"\w+")
NEXT = re.compile(r"\s+([^\W\d_]+)")


@dataclass(frozen=True)
class Phrase:
    words: str
    replacement: str
    risk: float
    modes: tuple[str, ...] = ("standard", "strong")


RULES = [Phrase(words, verb, risk, ("strong",) if modes == "strong" else ("standard", "strong")) for words, verb, risk, modes in PHRASES]


@dataclass
class Trie:
    """Phrases by their words."""

    root: dict = field(default_factory=dict)

    @classmethod
    def of(cls, phrases: list[Phrase]) -> Trie:
        ends = {w for p in phrases for w in (p.words.lower().split()[0], p.words.lower().split()[-1])}
        if any(w in ends for p in phrases for w in WORD.findall(p.replacement.lower())):
            raise ValueError("a replacement has a word that begins or ends a phrase")
        made = cls()
        for i, p in enumerate(phrases):
            node = made.root
            for word in p.words.lower().split():
                node = node.setdefault(word, {})
            node.setdefault("", []).append(i)  # no word is empty
        return made

    def find(self, text: str) -> list[dict]:
        """Where phrases stand whose words are parted by white space only: start, end, rule, and the word right after."""
        if self.root.keys().isdisjoint(map(str.lower, WORD.findall(text))):
            return []
        tokens = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
        out = []
        for i, (word, start, _) in enumerate(tokens):
            node, k = self.root.get(word), i
            while node is not None:
                end = tokens[k][2]
                if "" in node:
                    after = NEXT.match(text, end)
                    out += [{"start": start, "end": end, "rule": r, "next": after[1].lower() if after else None} for r in node[""]]
                k += 1
                node = node.get(tokens[k][0]) if k < len(tokens) and text[end : tokens[k][1]].isspace() else None
        return out


def found(sentences: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """The sentences that have a phrase or a purpose: KEY, doc_id, text, purpose (whether it has one), spans."""
    trie = Trie.of(phrases)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.int32()), ("next", pa.string())]))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            spans = [trie.find(t) for t in table.column("text").to_pylist()]
            kept = [i for i, (s, purpose) in enumerate(zip(spans, table.column("purpose").to_pylist())) if s or purpose]
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(kept, pa.int64())) for c in table.columns], pa.array([spans[i] for i in kept], kind)], [*PLACE, "text", "purpose", "spans"])

    id_type = sentences.schema["doc_id"].dataType.simpleString()
    return sentences.select(*PLACE, "text", F.col("text").rlike(IN_ORDER_TO).alias("purpose")).mapInArrow(run, f"row bigint, paragraph_index int, sentence_index int, doc_id {id_type}, text string, purpose boolean, spans {SPANS}")


def _known(word: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at("known", F.lower(word))[name], F.lit(False))


def _reduced(hits: DataFrame, forms: DataFrame | None, phrases: list[Phrase]) -> DataFrame:
    """All phrases of a sentence replaced at once, and each one by itself at its first place."""
    hits = hits.where(F.size("spans") > 0)
    if forms is None:
        hits = hits.withColumn("known", F.lit(None).cast("map<string,struct<breaks:boolean,nominal:boolean>>"))
        follows = lambda w: w.isNotNull()
    else:
        hits = hits.join(lexicon.looked_up(hits, KEY, F.filter(F.transform("spans", lambda x: x["next"]), lambda w: w.isNotNull()), forms), KEY, "left")
        follows = lambda w: w.isNotNull() & (w.isin(ATTACHED) | (_known(w, "nominal") & ~_known(w, "breaks")))
    t = F.col("text")
    table = F.array(*[F.struct(F.lit(p.words).alias("words"), F.lit(p.replacement).alias("fresh"), F.lit(p.risk).alias("risk")) for p in phrases])
    entry = lambda x: F.get(table, x["rule"])

    def fresh(x: Column) -> Column:
        """The verb, with a capital where the phrase had one."""
        head, verb = F.substring(t, x["start"] + 1, F.lit(1)), entry(x)["fresh"]
        return F.when((F.upper(head) == head) & (F.lower(head) != head), F.concat(F.upper(F.substring(verb, 1, 1)), F.substring(verb, F.lit(2), F.char_length(verb)))).otherwise(verb)

    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rule"].alias("rule"), fresh(x).alias("fresh"), entry(x)["risk"].alias("risk"), entry(x)["words"].alias("words"), (~follows(x["next"])).alias("free")))
    d = hits.select(*PLACE, "text", spans.alias("spans"))
    free = F.filter("spans", lambda x: x["free"])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda st, x: F.struct(x["end"].alias("at"), F.concat(st["out"], F.substring(t, st["at"] + 1, x["start"] - st["at"]), x["fresh"]).alias("out"))
    whole = F.aggregate(free, begin, step, lambda st: F.concat(st["out"], F.substring(t, st["at"] + 1, F.char_length(t))))
    combined = d.where(F.size(free) > 0).select(*PLACE, F.lit(0).alias("gen_order"), "text", whole.alias("candidate"), F.lit("nominalizacja:combined").alias("rule"), F.lit(COMBINED).alias("score"), F.array_max(F.transform(free, lambda x: x["risk"])).alias("risk"))
    each = d.select(*PLACE, "text", F.explode("spans").alias("x")).groupBy(*PLACE, "x.rule").agg(F.min_by(F.struct("text", "x"), "x.start").alias("f")).select(*PLACE, "f.text", "f.x").where("x.free")
    alone = F.concat(F.substring(t, F.lit(1), F.col("x.start")), F.col("x.fresh"), F.substring(t, F.col("x.end") + 1, F.char_length(t)))
    single = each.select(*PLACE, (F.col("x.rule") + 1).alias("gen_order"), "text", alone.alias("candidate"), F.concat(F.lit("nominalizacja:"), F.col("x.words")).alias("rule"), F.lit(SINGLE).alias("score"), "x.risk")
    return combined.unionByName(single)


def _purposes(hits: DataFrame, forms: DataFrame) -> DataFrame:
    """"w celu" and a gerund as a clause: only after a main clause with a finite verb, where nothing that the gerund governs follows and its verb needs no object."""
    t = F.col("text")
    hits = hits.where("purpose").select(*PLACE, "text")
    hits = hits.join(lexicon.looked_up(hits, KEY, F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}+"), 0), forms), KEY)
    d = hits.select(*PLACE, "text", "known", F.posexplode(F.arrays_zip(P.spans(t, IN_ORDER_TO).alias("at"), F.regexp_extract_all(t, F.lit(IN_ORDER_TO), 1).alias("noun"))).alias("n", "m"))
    d = d.withColumns({"lead": F.regexp_replace(F.substring(t, F.lit(1), F.col("m.at.start")), rf"[{P.BLANK}]+$", ""), "tail": F.substring(t, F.col("m.at.end") + 1, F.char_length(t)), "gerund": F.try_element_at("known", F.lower("m.noun"))["gerund"]})
    after = F.regexp_extract("tail", r"^\s+(\p{L}+)", 1)
    finite = F.exists(F.regexp_extract_all(F.lower("lead"), F.lit(r"\p{L}+"), 0), lambda w: _known(w, "finite"))
    governed = (F.lower(after) == AGENT) | _known(after, "genitive")
    joined = F.col("tail").rlike(P.spark_pattern(rf"^[^,;:.!?]*?{CONJUNCTION}")) | F.col("lead").rlike(P.spark_pattern(rf"{CONJUNCTION}\s*$"))
    lacks = F.col("gerund.object") & (F.lower(after) != REFLEXIVE)
    good = F.col("gerund").isNotNull() & F.col("lead").rlike(r"[\p{L}\p{N},)_]$") & finite & ~governed & ~joined & ~lacks
    fresh = F.concat("lead", F.when(F.col("lead").endswith(","), " ").otherwise(", "), F.lit("aby "), "gerund.lemma", "tail")
    return d.where(good).select(*PLACE, (F.col("n") + 100_000).cast("int").alias("gen_order"), "text", fresh.alias("candidate"), F.lit("nominalizacja:w_celu_ger").alias("rule"), F.lit(PURPOSE).alias("score"), F.lit(PURPOSE_RISK).alias("risk"))


def candidates(docs: DataFrame, forms: DataFrame | None, mode: str = "standard", phrases: list[Phrase] | None = None) -> DataFrame:
    """row, doc_id, paragraph_index, sentence_index, gen_order, original, candidate, rule, score, risk of all candidates."""
    active = [p for p in (RULES if phrases is None else phrases) if mode in p.modes]
    # One pass over the sentences; only those that have something to rewrite are kept.
    hits = cut(found(numbered(docs), active))
    made = _reduced(hits, forms, active)
    if forms is not None and mode != "conservative":
        made = made.unionByName(_purposes(hits, forms))
    return made.withColumnRenamed("text", "original")


def edits(docs: DataFrame, forms: DataFrame | None, mode: str = "standard") -> DataFrame:
    """The best candidate of each sentence that passes the gates: doc_id, paragraph_index, sentence_index, before, after, rule."""
    passed = rewrite.gates(candidates(docs, forms, mode)).where("reason IS NULL")
    best = passed.groupBy(*KEY).agg(F.min_by(F.struct("doc_id", "original", "candidate", "rule"), F.struct(-F.col("score"), F.col("gen_order"))).alias("b"))
    return best.select("b.doc_id", *KEY[1:], F.col("b.original").alias("before"), F.col("b.candidate").alias("after"), "b.rule")
