"""Lines of a document as blocks with roles, blanks and captions: a state machine over lines, written as windows.

What a line is by itself (marker, blanks, captions) are expressions. What depends on other lines is read from windows over the
document's lines: the block that a caption explains is the last one before it that is no caption, a header holds until another
block ends it, a note left open on a colon takes the list below, and an optional blank makes the line optional that it continues.

Defined results: each line is a block, empty ones are spacers; rows with null or repeated ids are documents of their own; a
null text is one empty line. Plain text has no alignment, so no title is told from its look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import patterns as P
from wordloom.functions.plans import dealt, with_rows

from . import text as T

# List markers, blanks, captions, and the wordings that tell conditions, notes, parties and signatures.
MARKER = r"^\s*(§\s*\d+[a-z]?\s*[.)]?|\d+(?:\.\d+)*\s*[.)]|\(?[a-z]\)|[IVXLC]+[.)](?=\s+\p{Lu})|[-–—•·▪●○])\s+(?=\S)"
BARE_PARAGRAPH = r"^\s*(§\s*\d+[a-z]?\s*[.)]?)\s*$"
PLACEHOLDER = r"(?iu)\[[^\]\n]{0,60}(?:uzupełnij|do uzupełnienia|wpisz|tbd)[^\]\n]{0,60}\]"
CAPTION = r"\([^()]+\)|\[[^\[\]]+\]"
CONDITIONAL = r"(?iu)dotyczy|nie jest obowiązkow|w przypadku|jeżeli|jeśli|tylko |opcjonaln|rekomenduje|fakultatyw|o ile |skreślić|niepotrzebne"
INSTRUCTION = r"(?iu)należy|o której mowa|o którym mowa|art\.|dotyczy|nie jest obowiązkow|rekomenduje|np\.|w przypadku|jeżeli|jeśli|zgodnie z"
ALIAS = r"[zZ](?<![\p{L}\p{N}_].)wan\p{L}*\s+(?:łącznie\s+)?(?:(?:dalej(?:\s+jako)?|w\s+(?:dalszej\s+)?(?:treści|części)\s+\p{L}+)\s+)?(?:łącznie\s+)?[„\"]?(\p{Lu}[\p{L}\p{N}]+(?:\s+(?:nr\s+)?(?:\d+|[A-Z])(?![\p{L}\p{N}]))?)"
SIGNATURE = r"(?iu)(?<![\p{L}\p{N}_])podpis(?:u|y|ie|em|ów|ami|ach|om)?(?![\p{L}\p{N}_])"
PARTY_CELL = r"(?u)^(?:Za\s+)?\p{Lu}[\p{L}\p{N}]*(?:\s+(?:nr\s+)?[\p{L}\p{N}]+){0,2}\s*[:,]?$"
CLOSING = r"(?iu)^z\s+(?:wyrazami\s+)?(?:poważaniem|szacunkiem)\s*[,.]?$"
CONNECTORS = ["a", "oraz", "i", "pomiędzy", "pomiedzy"]
TYPES = [
    ("place_date", r"miejscowo\p{L}*\s+i\s+data|data\s+i\s+miejscowo"),
    ("pesel", "pesel"),
    ("id_number", "<nip>|<krs>|regon|ceidg|dowod|dokument"),
    ("signature", "<podpis(?:u|y|ie|em|ów|ami|ach|om)?>"),
    ("amount", "wynagrodzen|słownie|slownie|<zł>|kwot|wysokości|wysokosci"),
    ("date", r"<data>|<dniu>|<dnia>|<dzień>|<od>|<do>|<r\.$"),
    ("address", r"adres|siedzib|zamieszkania|<ul\."),
    ("person", "imię|imie|nazwisk|reprezentowan|przez"),
    ("company", "nazwa firmy|firm"),
    ("place", "miejscowo|miejsce|<w$"),
]
#: Longest text of a clause heading, a label caption, a short caption, a field label; words of a heading over an optional blank.
HEADING_CHARS, NOTE_CHARS, SHORT_NOTE, LABEL_CHARS, HEADING_WORDS = 60, 70, 40, 70, 5
#: A run of dots weighs a dot as 1 and an ellipsis as 3. Under 4 it is none by itself, but with 2 or 3 it may lead one.
WEAK, MORE = r"(?:\.{1,3}|…|\.[-–]\.)", r"(?![….]|[-–][….])"
STRONG = rf"(?:(?!{WEAK}{MORE})[….]++(?:[-–][….]++)?+|_{{4,}}+)"
GAP = r"[ \x{00A0}]{0,3}"
BLANKS = rf"(?:(?:(?<=\s)|^)(?:\.{{2,3}}|…|\.[-–]\.){MORE}{GAP})?{STRONG}(?:{GAP}{STRONG})*"
#: A list item that is nothing but a short run.
LONE = r"^(?:\s*\(?[0-9a-z]{1,3}[.)]\s+|\s*)(…|\.{2,3})\s*$"
TAIL = r"(?:…|\.{3,}|_{3,})\s*$"
SPACER, HINT, DEPENDENT = "spacer", "hint", ["hint", "blank_line", "signature_line"]
#: What a line has to hold for a blank or a placeholder, and for a caption; most lines hold neither and are not searched.
MAY_BLANK, MAY_CAPTION = r"[….]{2}|…|\.[-–]\.|__|\[", r"[(\[]"
ANCHORS = ["title", "body", "item", "clause_heading", "field", "field_header", "party_alias", "party_connector"]


def blanks(text: Column) -> Column:
    """array<struct<start, end, kind, value>>: blanks and placeholders of a line."""
    found = P.spans(text, f"{PLACEHOLDER}|{BLANKS}")
    lone = F.regexp_extract(text, LONE, 1)
    at = F.char_length(F.rtrim(text)) - F.char_length(lone)
    one = F.array(F.struct(at.cast("int").alias("start"), (at + F.char_length(lone)).cast("int").alias("end"), lone.alias("value")))
    # A lone run is too weak to be a blank of the other kind, so a line has one or the other.
    found = F.when(lone != "", one).otherwise(found)
    made = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["value"].startswith("["), "placeholder").otherwise("blank").alias("kind"), x["value"].alias("value")))
    return F.when(text.rlike(MAY_BLANK), made).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))


def captions(text: Column) -> Column:
    """array<struct<start, end, value>>: bracketed texts that are no placeholders; value without its brackets."""
    found = F.filter(P.spans(text, CAPTION), lambda x: ~x["value"].rlike(f"^(?:{PLACEHOLDER})$"))
    made = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.trim(F.substring(x["value"], F.lit(2), F.char_length(x["value"]) - 2)).alias("value")))
    return F.when(text.rlike(MAY_CAPTION), made).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def without(text: Column, marks: Column) -> Column:
    """The text with spaces in the place of marked spans (array of structs with start and end, ascending)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, m: F.struct(m["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.repeat(F.lit(" "), m["end"] - m["start"])).alias("out"))
    return F.when(F.size(marks) > 0, F.aggregate(marks, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))).otherwise(text)


def groups_of(text: Column) -> Column:
    """The captions of a line that holds nothing else, with letters in them; null for another line."""
    t = F.trim(text)
    whole = t.rlike(rf"^(?:(?:{CAPTION})[ \t\x{{00A0}}.,;]*)+$") & ~t.rlike(PLACEHOLDER)
    inner = F.transform(captions(t), lambda x: x["value"])
    note = t.rlike(r"^\([^)]*$") & t.rlike(INSTRUCTION)
    return F.when(note, F.array(F.trim(F.substring(t, F.lit(2), F.char_length(t))))).when(whole & F.array_join(inner, " ").rlike(r"\p{L}"), inner)


def lines(docs: DataFrame) -> DataFrame:
    """Each line by itself: row, doc_id, p, text, label, label_fmt, level, body_start, body, slots, caps, groups."""
    d = with_rows(docs).select("row", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r", -1)).alias("p", "text"))
    t = F.col("text")
    raw = F.when(t.rlike(MARKER), F.regexp_extract(t, MARKER, 0)).otherwise(F.regexp_extract(t, BARE_PARAGRAPH, 0))
    d = d.withColumns({"label": F.nullif(T.strip(raw), F.lit("")), "body_start": F.char_length(raw)})
    label = F.col("label")
    fmt = F.when(label.startswith("§"), "paragraph").when(label.rlike(r"^\(?[a-z]\)$"), "lowerLetter").when(label.rlike(r"^[IVXLC]+[.)]$"), "upperRoman").when(label.rlike(r"^\d"), "decimal").when(label.isNotNull(), "bullet")
    level = F.when(fmt == "lowerLetter", 1).when(fmt == "bullet", 2).when((fmt == "decimal") & label.rlike(r"\.[^.]*.$") & label.rlike(r"\d\.\d"), 1).when(label.isNotNull(), 0)
    return d.select("row", "doc_id", "p", "text", "label", fmt.alias("label_fmt"), level.alias("level"), "body_start", T.strip(F.substring(t, F.col("body_start") + 1, F.char_length(t))).alias("body"), blanks(t).alias("slots"), captions(t).alias("caps"), groups_of(t).alias("groups"))


def blocks(docs: DataFrame, by_row: bool = False) -> DataFrame:
    """A row for each line, and a document's lines in one part: row, doc_id, p, text, role, label, label_fmt, level, body_start, slots, alias, field_label, header, hint_kind, hint_for, hint (captions of the blanks), inline (captions beside blanks), optional, condition, alternatives.

    by_row: docs are numbered and dealt by row already.
    """
    # Texts are dealt before they are split, so that no window moves the lines with all that is known of them.
    d, t = lines(docs if by_row else dealt(with_rows(docs), "row", by_size=True)), F.col("text")
    by_line = W.partitionBy("row").orderBy("p")
    up, down = by_line.rowsBetween(W.unboundedPreceding, -1), by_line.rowsBetween(1, W.unboundedFollowing)
    shown = T.strip(t) != ""
    content = W.partitionBy("row", "shown").orderBy("p")  # lines that are not empty, in order
    d = d.withColumn("shown", shown)
    depth = lambda c: F.regexp_count(c, F.lit(r"[(\[]")) - F.regexp_count(c, F.lit(r"[)\]]"))
    t2, t3 = F.lead("text", 1).over(content), F.lead("text", 2).over(content)
    d = d.withColumns({"t2": F.when(depth(t) > 0, t2), "t3": F.when(depth(t) > 0, t3)})
    two, three = F.concat_ws(" ", T.strip(t), T.strip(F.col("t2"))), F.concat_ws(" ", T.strip(t), T.strip(F.col("t2")), T.strip(F.col("t3")))
    opens = F.col("shown") & t.rlike(r"^\s*[(\[]") & F.col("t2").isNotNull()
    d2, d3 = depth(two), depth(three)
    d = d.withColumn("over", F.when(opens & (d2 <= 0) & groups_of(two).isNotNull(), F.struct(F.lit(2).alias("n"), groups_of(two).alias("g"))).when(opens & (d2 > 0) & (d3 <= 0) & F.col("t3").isNotNull() & groups_of(three).isNotNull(), F.struct(F.lit(3).alias("n"), groups_of(three).alias("g"))))
    earlier = F.greatest(F.coalesce((F.lag("over.n", 1).over(content) >= 2).cast("int"), F.lit(0)), F.coalesce((F.lag("over.n", 2).over(content) >= 3).cast("int"), F.lit(0)))
    d = d.withColumns({"rest_of": (earlier == 1) & F.col("shown"), "groups": F.coalesce("over.g", "groups")})
    # A note that ends on a colon owns the marked lines directly below.
    listed = F.col("shown") & F.col("label").isNotNull() & (F.size("slots") == 0)
    opener = F.coalesce(F.col("groups").isNotNull() & t.rlike(r":\s*\)?\s*$") & t.rlike(r":\s*$"), F.lit(False))
    d = d.withColumn("opener", F.when(~listed, opener))
    note = listed & F.coalesce(F.last("opener", ignorenulls=True).over(up), F.lit(False))
    d = d.withColumn("is_hint", F.col("shown") & (F.col("groups").isNotNull() | F.col("rest_of") | note))
    d = d.withColumn("slots", F.when(F.col("is_hint"), F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")).otherwise(F.col("slots")))
    n, body = F.size("slots"), F.col("body")
    bare = (n > 0) & ~F.exists("slots", lambda s: s["kind"] != "blank") & ~without(t, F.col("slots")).rlike(r"[^\s,;.:]")
    named = F.regexp_extract(body, r"(?s)^([^:…._]{2,70}?)\s*:", 1)
    after = F.regexp_extract(body, r"(?s)^[^:…._]{2,70}?\s*:\s*(.*)$", 1)
    role = (
        F.when(~F.col("shown"), SPACER).when(F.col("is_hint"), HINT).when(bare & F.col("label").isNull(), F.when((n >= 2) & t.contains("\t"), "signature_line").otherwise("blank_line"))
        .when((F.col("label_fmt") == "paragraph") & (F.char_length(body) <= HEADING_CHARS), "clause_heading").when(F.col("label").isNotNull(), "item").when(t.rlike(ALIAS), "party_alias")
        .when((F.char_length(body) <= 10) & F.lower(F.trim(F.translate(body, ".,:", ""))).isin(CONNECTORS), "party_connector")
        .when((named != "") & (n > 0) & ~after.startswith("(") & (F.get("slots", F.lit(0))["start"] >= F.instr(t, ":") - 1), "field").when(body.endswith(":") & (F.char_length(body) <= LABEL_CHARS) & (n == 0), "field_header").otherwise("body")
    )
    joined = F.array_join("groups", " ")
    inline = F.when(F.col("is_hint"), F.array().cast("array<struct<start:int,end:int,value:string>>")).otherwise(F.filter("caps", lambda c: _beside(t, c)))
    d = d.select(
        "row", "doc_id", "p", "text", role.alias("role"), "label", "label_fmt", "level", "body_start", "body", "slots", "groups", F.when(t.rlike(ALIAS), F.regexp_extract(t, ALIAS, 1)).alias("alias"), F.nullif(named, F.lit("")).alias("field_label"), inline.alias("inline"),
        F.when(F.col("is_hint"), F.when((F.char_length(joined) > NOTE_CHARS) | joined.rlike(INSTRUCTION), "instruction").otherwise("label")).alias("hint_kind"), F.when(F.col("is_hint") & joined.rlike(CONDITIONAL), joined).alias("own_condition"), _alternatives(t).alias("alternatives"),
    )
    return _bound(d, up, down)


def _beside(text: Column, c: Column) -> Column:
    """Whether a caption explains a blank right before it, or (in square brackets) right after it."""
    before, after = F.substring(text, F.lit(1), c["start"]), F.substring(text, c["end"] + 1, F.char_length(text))
    plain = ~c["value"].rlike(BLANKS) | c["value"].rlike(INSTRUCTION)
    trails = before.rlike(r"(?:…|\.{3,}|_{3,})(?:[\s;,.]{0,4}|[ \t\x{00A0}]+)$")
    return plain & (trails | ((F.substring(text, c["start"] + 1, F.lit(1)) == "[") & after.rlike(r"^[\s;,.]{0,4}(?:…|\.{3,}|_{3,})")))


def _alternatives(text: Column) -> Column:
    """Parts of a choice "a / b / c" of which two have blanks; 0 for none."""
    parts = F.split(F.regexp_replace(text, CAPTION, " "), r"\s*/\s*", -1)
    some = F.when((F.size(parts) >= 3) & (F.size(F.filter(parts, lambda x: x.rlike(f"{PLACEHOLDER}|{BLANKS}"))) >= 2), F.size(parts)).otherwise(0)
    return F.when(F.contains(text, F.lit("/")), some).otherwise(0)


def _bound(d: DataFrame, up, down) -> DataFrame:  # noqa: ANN001
    """Captions with the blocks that they explain, headers, and what is optional."""
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    real = ~F.col("role").isin(SPACER, HINT)
    d = d.withColumn("target", F.when(F.col("role") == HINT, last(F.when(real, F.struct("p", F.size("slots").alias("slots"))), up)))
    # Of several captions after a block the first explains it, a later one only what the first left without.
    nth = F.row_number().over(W.partitionBy("row", "target.p").orderBy("p"))
    first = F.first("groups").over(W.partitionBy("row", "target.p").orderBy("p"))
    left = (nth == 1) | (F.col("target.slots") == 0) | ((F.size(first) > 1) & (F.size(first) < F.col("target.slots"))) | F.col("groups").isNull()
    d = d.withColumn("hint_for", F.when(F.col("target").isNotNull() & left, F.col("target.p"))).drop("target")
    mine = W.partitionBy("row", F.coalesce("hint_for", F.when(real, F.col("p")), -1 - F.col("p"))).orderBy("p")
    whole = mine.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bound = F.when(F.col("hint_for").isNotNull(), F.struct("groups", "own_condition"))
    d = d.withColumns({"hint": F.when(real, F.first(F.when(F.col("hint_for").isNotNull(), F.col("groups")), ignorenulls=True).over(whole)), "from_hint": F.when(real, F.first(F.when(bound.isNotNull(), F.col("own_condition")), ignorenulls=True).over(whole))})
    beside = F.get(F.filter(F.transform("inline", lambda c: c["value"]), lambda v: v.rlike(CONDITIONAL)), F.lit(0))
    d = d.withColumn("own", F.coalesce("from_hint", beside))
    # An optional blank continues the lines above it up to the one that it carries on from, and a short heading over that.
    line = F.col("role") == "blank_line"
    stop = F.first(F.when((F.col("role") != SPACER) & (~line | F.col("from_hint").isNotNull()), F.struct(F.when(F.col("role") != "clause_heading", F.col("from_hint")).alias("c"))), ignorenulls=True).over(down)
    following = F.when(line | ((F.col("role") == "body") & F.col("text").rlike(TAIL)), stop["c"])
    d = d.withColumn("spread", following)
    heads = F.col("role").isin("body", "clause_heading") & (F.size("slots") == 0) & (F.regexp_count("text", F.lit(r"\S+")) <= HEADING_WORDS) & ~F.rtrim("text").rlike(r"[.,;:]$")
    below = F.first(F.when(F.col("role") != SPACER, F.struct(F.when(F.col("role") == "body", F.col("spread")).alias("c"))), ignorenulls=True).over(down)
    d = d.withColumn("condition", F.coalesce("own", "spread", F.when(heads, below["c"])))
    flow = last(F.when((F.col("role") != SPACER) & (~F.col("role").isin(DEPENDENT) | F.col("condition").isNotNull()), F.struct(F.col("condition").isNotNull().alias("o"))), up)
    optional = F.col("condition").isNotNull() | (F.col("role").isin(DEPENDENT) & F.coalesce(flow["o"], F.lit(False)))
    # A header's label holds until a block of another kind ends it.
    own_header = F.when(F.col("role").isin("item", "field_header", "body") & (F.size("slots") == 0), F.nullif(F.regexp_extract("body", r"(?s)^([^:…._]{2,70}?)\s*:\s*$", 1), F.lit("")))
    header = last(F.when(real & (own_header.isNotNull() | ~F.col("role").isin("blank_line", "party_alias", "field")), F.struct(own_header.alias("h"))), up)["h"]
    return d.select("row", "doc_id", "p", "text", "role", "label", "label_fmt", "level", "body_start", "slots", "alias", "field_label", header.alias("header"), "hint_kind", "hint_for", "hint", "inline", optional.alias("optional"), "condition", "alternatives")


def slots(made: DataFrame) -> DataFrame:
    """A row for each blank of blocks(): row, doc_id, p, k, start, end, kind, value, hint, label, context, type, id (readable, unique in its document), optional."""
    t = F.col("text")
    s = _signed(made).where(F.size("slots") > 0).select("*", F.posexplode("slots").alias("k", "s")).select("*", "s.start", "s.end", "s.kind", "s.value")
    others = F.filter("slots", lambda o: o["start"] != F.col("start"))
    caps = F.filter(captions(t), lambda c: ~((c["start"] <= F.col("start")) & (F.col("start") < c["end"])))
    marks = F.array_sort(F.concat(F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"))), F.transform(caps, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end")))))
    marks = F.filter(marks, lambda m: ~F.exists(caps, lambda c: (c["start"] < m["start"]) & (m["end"] <= c["end"])))
    s = s.withColumn("plain", without(t, marks))
    words = lambda c: F.filter(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_§.…]+"), 0), lambda w: w.rlike("[^.…]"))
    before, after = words(F.substring("plain", F.col("body_start") + 1, F.col("start") - F.col("body_start"))), words(F.substring("plain", F.col("end") + 1, F.char_length(t)))
    context = F.concat(F.array_join(F.slice(before, F.greatest(F.lit(1), F.size(before) - 3), 4), " "), F.lit(" ▢ "), F.array_join(F.slice(after, 1, 2), " "))
    label = F.when(F.col("field_label").isNotNull() & (F.col("start") >= F.instr(t, ":") - 1), F.col("field_label")).when(F.col("role").isin("blank_line", "party_alias", "field"), F.col("header"))
    follows = F.filter("inline", lambda c: (c["start"] >= F.col("end")) & F.substring(t, F.col("end") + 1, c["start"] - F.col("end")).rlike(r"^(?:[\s;,.]{0,4}|[ \t\x{00A0}]+)$"))
    leads = F.filter("inline", lambda c: (c["end"] <= F.col("start")) & (F.col("start") <= c["end"] + 5) & ~F.exists("slots", lambda o: (c["start"] >= o["end"]) & (c["start"] - o["end"] <= 4)))
    given = F.coalesce(F.get("hint", F.col("k")), F.when(F.size("hint") == 1, F.get("hint", F.lit(0))))
    s = s.withColumns({"label_": label, "hint_": F.when(F.col("role") != "clause_heading", given), "context": context})
    s = s.withColumn("hint_", F.coalesce("hint_", F.get(F.transform(follows, lambda c: c["value"]), F.lit(0)), F.get(F.transform(leads, lambda c: c["value"]), F.lit(0))))
    instruction = F.coalesce((F.char_length("hint_") > SHORT_NOTE) | F.col("hint_").rlike(INSTRUCTION), F.lit(False))
    lead = F.greatest(F.coalesce(F.array_max(F.transform(F.filter("slots", lambda o: o["end"] <= F.col("start")), lambda o: o["end"])), F.lit(0)), F.col("body_start"))
    own = words(F.substring(t, lead + 1, F.col("start") - lead))
    blob = F.lower(F.concat_ws(" ", F.when(~instruction, F.col("hint_")), "label_", F.get(own, F.size(own) - 1)))
    kind = F.coalesce(F.when(F.col("hint_").rlike(SIGNATURE), "signature"), *[F.when(blob.rlike(P.spark_pattern(p)), name) for name, p in TYPES], F.lit("text"))
    s = s.withColumns({"type": kind, "joins": (F.col("k") > 0) & (F.size(own) == 0) & ~F.substring(t, lead + 1, F.col("start") - lead).rlike(r"[(\[]")})
    # Parts of one value ("…/…/… r.") have the type of the first that tells it.
    along = W.partitionBy("row", "p").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumn("type", F.when((F.col("type") == "text") & F.col("joins"), F.coalesce(F.last(F.when(~(F.col("joins") & (F.col("type") == "text")), F.col("type")), ignorenulls=True).over(along), F.lit("text"))).otherwise(F.col("type")))
    base = F.coalesce(F.when(~instruction, F.col("hint_")), "label_", "hint_", F.concat(F.lit("p"), F.col("p"), F.lit("_"), F.col("k") + 1))
    name = F.replace(T.slug(base), F.lit("-"), F.lit("_"))
    s = s.withColumn("name", F.when(name == "", "pole").otherwise(name))
    again = F.row_number().over(W.partitionBy("row", "name").orderBy("p", "k"))
    ident = F.when(again > 1, F.concat("name", F.lit("_"), again)).otherwise(F.col("name"))
    s = s.withColumn("type", F.when(F.col("signs") & F.col("hint_").isNull(), "signature").otherwise(F.col("type")))
    return s.select("row", "doc_id", "p", "k", "start", "end", "kind", "value", F.col("hint_").alias("hint"), F.col("label_").alias("label"), "context", "type", ident.alias("id"), "optional", "role")


def _signed(made: DataFrame) -> DataFrame:
    """made with signs: lines of dots alone, below the last clause heading, beside a line that names who signs: two parties in columns, the word itself, or a closing above."""
    by = W.partitionBy("row").orderBy("p")
    up, down = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(1, W.unboundedFollowing)
    # Empty lines are passed over: they hold no words, blanks or headings.
    d = made.withColumn("words", T.strip(without(F.col("text"), F.col("slots"))))
    dotted = (F.size("slots") > 0) & ~F.col("words").rlike(r"[\p{L}\p{N}_]")
    cells = F.filter(F.split("words", r"\t+|\s{2,}"), lambda c: c != "")
    parties = (F.size(cells) >= 2) & ~F.exists(cells, lambda c: ~F.trim(c).rlike(PARTY_CELL))
    short = (F.col("role") == HINT) | F.col("words").rlike(r"^[(\[]") | (F.regexp_count("words", F.lit(r"\S+")) <= 6)
    d = d.withColumns({"dotted": dotted, "says": (short & F.col("words").rlike(SIGNATURE)) | parties, "closes": F.col("words").rlike(CLOSING)})
    other = F.when(~F.col("dotted") & (F.col("words") != ""), F.struct("says", "closes"))
    above, below = F.last(other, ignorenulls=True).over(up), F.first(other, ignorenulls=True).over(down)
    heading = F.max(F.when(F.col("role") == "clause_heading", F.col("p"))).over(W.partitionBy("row"))
    signs = F.col("dotted") & (F.col("p") > F.coalesce(heading, F.lit(-1))) & (F.coalesce(above["says"] | above["closes"], F.lit(False)) | F.coalesce(below["says"], F.lit(False)))
    return d.select(*made.columns, signs.alias("signs"))
