"""A document against a template, block by block: one row for each finding.

A document's blocks are gathered once, by row, and meet their templates there. What goes by the order of a pair's blocks (places,
captions, lines between matched blocks, what is left over) is a small routine in Arrow batches that gets the words of both sides
and returns places by number; everything that is read from texts (values of blanks, what is filled) are expressions on these.

A pair's cost is its template's blocks times the document's; callers bound it by choosing pairs (`alignment.match_template`
has a size guard). Defined results: a template without words matches nothing and misses nothing; empty tables give none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.plans import checked, cut

from . import layout
from . import text as T
from .alignment import CHANGED, MATCH, graded, heaviest, in_order

# What counts as unfilled, words of a label, words from which a block is worth a row as extra, similarity from which order is judged, words up to which a block with blanks may match by its pattern.
FILL_ONLY = r"^[\s….,;:_ -]*$"
LABEL_WORDS, LABEL_SLACK, EXTRA_WORDS, SAME, PATTERN_WORDS = 3, 3, 4, 0.75, 6
ISSUES, BLOCKING = ["missing", "unfilled", "order"], ["missing", "unfilled"]
MARK = "kind:string,t:int,c:int,k:int,at:int"
#: Lines of dots, and the roles of lines in which an open blank is left over.
DOTTED, OPEN = ["blank_line", "signature_line"], ["body", "item", "field", "title", "party_alias", "field_header"]
#: Pairs whose blocks are Python objects at once.
STEP = 128
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _fixed(chunk: Column) -> Column:
    """A pattern of a chunk's words; on a side that the template spaces off a word is whole."""
    escaped = lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")
    words = F.filter(F.split(chunk, r"\s+"), lambda w: w != "")
    body = F.array_join(F.transform(words, escaped), r"\s*")
    whole = F.concat(F.when(chunk.rlike(r"^\s"), EDGE_L).otherwise(""), body, F.when(chunk.rlike(r"\s$"), EDGE_R).otherwise(""))
    return F.when(F.size(words) > 0, whole).otherwise("")


def _marks(d: DataFrame) -> Column:
    """Blanks and captions beside them, in order; those inside the list marker are none."""
    mark = lambda a, slot: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(slot).alias("slot")))
    both = F.filter(F.array_sort(F.concat(mark(F.col("slots"), True), mark(F.col("inline"), False))), lambda m: m["start"] >= F.col("body_start"))
    return F.when(F.size("slots") + F.size("inline") > 0, both).otherwise(F.array().cast("array<struct<start:int,end:int,slot:boolean>>"))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0)


def seen(blocks: DataFrame) -> DataFrame:
    """row, texts, held of each document: its lines' texts, and of each line what is compared: role, body_start, note (an instruction), open (has a blank), words (of the text without blanks and captions), all_words (of the body)."""
    body = lambda c: F.substring(c, F.col("body_start") + 1, F.char_length("text"))
    d = blocks.withColumn("marks", _marks(blocks)).withColumn("all_words", _words(body(F.col("text"))))
    own = F.when(F.size("marks") > 0, _words(body(layout.without(F.col("text"), F.col("marks"))))).otherwise(F.col("all_words"))
    note = F.coalesce((F.col("role") == layout.HINT) & (F.col("hint_kind") == "instruction"), F.lit(False))
    left = F.col("role").isin(OPEN) & F.exists("slots", lambda s: s["kind"] == "blank")
    d = d.select("row", F.struct("p", "text", "role", "body_start", note.alias("note"), left.alias("open"), own.alias("words"), "all_words").alias("b"))
    d = d.groupBy("row").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return d.select("row", F.transform("b", lambda b: b["text"]).alias("texts"), F.transform("b", lambda b: b.dropFields("p", "text")).alias("held"))


def shaped(blocks: DataFrame) -> DataFrame:
    """blocks with static (the text without blanks and their captions), words (of it), all_words (of the body), need (words that a copy has to hold), pattern (of a filled copy, a group for each blank), starts, ends (with a blank)."""
    t = F.col("text")
    d = blocks.withColumn("marks", _marks(blocks))
    start = F.struct(F.col("body_start").alias("at"), F.lit("").alias("out"))
    filler = lambda m: F.when(m["slot"], r"\s*(.*?)").otherwise(r"\s*(?:\([^()]*\)|\[[^\[\]]*\])?\s*")
    step = lambda s, m: F.struct(m["end"].alias("at"), F.concat(s["out"], _fixed(F.substring(t, s["at"] + 1, m["start"] - s["at"])), filler(m)).alias("out"))
    rest = lambda s: F.substring(t, s["at"] + 1, F.char_length(t))
    pattern = F.aggregate("marks", start, step, lambda s: F.concat(s["out"], F.when(T.strip(rest(s)) != "", _fixed(rest(s))).otherwise(r"\s*$")))
    words = _words
    body = lambda c: F.substring(c, F.col("body_start") + 1, F.char_length(t))
    d = d.withColumn("static", body(layout.without(t, F.col("marks"))))
    parts = F.transform(F.split("static", r"\s*/\s*"), lambda x: F.size(words(x)))
    total = F.aggregate(parts, F.lit(0), lambda s, x: s + x)
    need = F.size(words(F.col("static"))) - F.when(F.col("alternatives") > 0, total - F.array_max(parts)).otherwise(0)
    first, last = F.get("slots", F.lit(0)), F.element_at("slots", -1)
    return d.select(
        *blocks.columns, "static", words(F.col("static")).alias("words"), words(body(t)).alias("all_words"), F.greatest(need, F.lit(1)).alias("need"), pattern.alias("pattern"),
        ((F.size("slots") > 0) & (first["start"] <= F.col("body_start") + 2)).alias("starts"), ((F.size("slots") > 0) & F.coalesce(F.when(F.size("slots") > 0, last["end"]) >= F.char_length(F.rtrim(t)) - 2, F.lit(False))).alias("ends"),
    )


def wanted(templates: DataFrame) -> DataFrame:
    """item, size, wanted, read of each template: of each of its blocks what is compared, and what is read when its place is known (shown, alternatives, pattern, and id, type and nth group of each blank)."""
    ids = layout.slots(templates).groupBy("row", "p").agg(F.array_sort(F.collect_list(F.struct("k", "id", "type"))).alias("ids"))
    d = shaped(templates).join(ids, ["row", "p"], "left")
    nth = lambda k: F.size(F.filter("slots", lambda s: (s["start"] >= F.col("body_start")) & (s["start"] <= F.get("slots", k)["start"])))
    blanks = F.coalesce(F.transform("ids", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), nth(x["k"]).alias("nth"))), F.array().cast("array<struct<id:string,type:string,nth:int>>"))
    by_pattern = (F.col("alternatives") == 0) & (F.size("words") <= PATTERN_WORDS) & (F.size("slots") + F.size("inline") > 0)
    caption = F.when((F.col("role") == layout.HINT) & F.col("text").rlike(r"^\s*[(\[]"), F.col("hint_for"))
    shown = T.strip(F.concat_ws(" ", "label", T.strip(F.col("static"))))
    one = F.struct("p", "role", "optional", "words", "all_words", "need", "pattern", by_pattern.alias("by_pattern"), "starts", "ends", F.size(blanks).alias("blanks"), caption.alias("caption_of"))
    two = F.struct("p", "text", shown.alias("shown"), "alternatives", "pattern", blanks.alias("blanks"))
    d = d.select(F.col("row").alias("item"), (8 * F.octet_length("text") + 500).alias("size"), one.alias("one"), two.alias("two"))
    return d.groupBy("item").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list("one")).alias("wanted"), F.array_sort(F.collect_list("two")).alias("read"))


@lru_cache(maxsize=4096)
def _pattern(spec: str) -> regex.Pattern:
    return regex.compile(r"(?s)\s*" + spec)


def _places(held: list[dict], words: str) -> dict[str, set[int]]:
    """The blocks that hold each word."""
    out: dict[str, set[int]] = {}
    for j, c in enumerate(held):
        for w in c[words]:
            out.setdefault(w, set()).add(j)
    return out


def _met(b: dict, places: dict[str, set[int]], n: int) -> list[int]:
    """The blocks that b may be like: those with a word of it, or all where a pattern decides."""
    return list(range(n)) if b["by_pattern"] else sorted(set().union(*[places.get(w, ()) for w in b["bag"]]))


def likeness(b: dict, c: dict, strict: bool = False) -> float:
    """How well block c of a document carries the fixed words of template block b; strict: how equal both sides' fixed words are."""
    want, held = b["words"], c["words"] if strict else c["all_words"]
    if not want:
        return 0.0
    if b["by_pattern"] and _pattern(b["pattern"]).match(c["body"]):
        return 1.0
    if len(want) <= LABEL_WORDS:  # a label or a tail has to stand where the template has it
        heads, tails = held[: len(want)] == want, held[-len(want) :] == want
        if b["ends"] != b["starts"]:
            return float(heads if b["ends"] else tails)
        return float(heads and len(held) <= len(want) + LABEL_SLACK)
    bag = c["bag"] if not strict else c["own_bag"]
    if sum(min(k, bag[w]) for w, k in b["bag"].items()) < CHANGED * b["need"]:
        return 0.0
    common = in_order(want, held)
    if not strict:
        return graded(common, b["need"], len(held))
    recall, precision = min(1.0, common / b["need"]), common / len(held) if held else 0.0
    return 2 * recall * precision / (recall + precision) if recall + precision else 0.0


def rising(values: list[int]) -> set[int]:
    """Places of a longest strictly ascending subsequence."""
    tails, last, before = [], [], []
    for k, v in enumerate(values):
        i = bisect_left(tails, v)
        before.append(last[i - 1] if i else None)
        tails[i : i + 1], last[i : i + 1] = [v], [k]
    kept, k = set(), last[-1] if last else None
    while k is not None:
        kept.add(k)
        k = before[k]
    return kept


def assigned(wanted: list[dict], held: list[dict]) -> tuple[list[dict], list[int]]:
    """Places of template blocks in a document (matched in order, or changed), and the template blocks that stand elsewhere in the order."""
    # Words are counted once for each block, not once for each pair.
    wanted = [b | {"bag": Counter(b["words"])} for b in wanted]
    held = [c | {"bag": Counter(c["all_words"]), "own_bag": Counter(c["words"])} for c in held]
    among, own = _places(held, "all_words"), _places(held, "words")
    sims = {(i, j): s for i, b in enumerate(wanted) for j in _met(b, among, len(held)) if (s := likeness(b, held[j])) >= CHANGED}
    matched = heaviest({(i, j): s * len(wanted[i]["words"]) for (i, j), s in sims.items() if s >= MATCH}, len(wanted), len(held))
    used, out = set(matched.values()), []
    for i in range(len(wanted)):
        if i in matched:
            out.append((i, matched[i], "matched"))
        elif near := max(((s, j) for (k, j), s in sims.items() if k == i and j not in used), default=None):
            used.add(near[1])
            out.append((i, near[1], "changed"))
    best = [max(((likeness(b, held[j], strict=True), -j) for j in _met(b, own, len(held))), default=(0.0, 0)) for b in wanted]
    free = [(i, -j) for i, (s, j) in enumerate(best) if s >= SAME]
    kept = rising([j for _, j in free])
    places = [{"t": wanted[i]["p"], "c": held[j]["p"], "state": state, "sim": sims[i, j]} for i, j, state in out]
    return places, [wanted[i]["p"] for k, (i, _) in enumerate(free) if k not in kept]


def _by_gap(lines: list[int], bounds: list[int]) -> dict[int, list[int]]:
    """Lines by the number of matched blocks that stand before."""
    out: dict[int, list[int]] = {}
    for p in lines:
        out.setdefault(bisect_left(bounds, p), []).append(p)
    return out


def marked(template: list[dict], held: list[dict], texts: list[str]) -> list[tuple]:
    """What is found, by number: kind, the template's block, the document's, which blank of the template's block, where the document's body begins."""
    role = [c["role"] for c in held]
    blocks = [{"p": p, "words": c["words"], "all_words": c["all_words"], "body": (texts[p] or "")[c["body_start"] :]} for p, c in enumerate(held) if c["role"] not in (layout.SPACER, *layout.DEPENDENT)]
    anchors = [b for b in template if b["role"] in layout.ANCHORS and b["words"]]
    places, turned = assigned(anchors, blocks)
    there = {x["t"]: x for x in places}
    by_p = {b["p"]: b for b in template}
    out = [("optional_missing" if b["optional"] else "missing", b["p"], None, None, None) for b in anchors if b["p"] not in there]
    out += [("order", t, None, None, None) for t in turned]
    for x in places:
        if x["state"] == "changed":
            out.append(("changed", x["t"], x["c"], None, None))
        else:
            out += [("inside", x["t"], x["c"], k, held[x["c"]]["body_start"]) for k in range(by_p[x["t"]]["blanks"])]
    # Captions under lines of blanks: the line above the same caption in the document holds the values.
    above, last, before = {}, {}, None
    for p, c in enumerate(held):
        if role[p] == layout.HINT and c["all_words"]:
            last[" ".join(c["all_words"])], above[p] = p, before
        before = p if role[p] != layout.SPACER else before
    taken, captioned = {x["c"] for x in places}, set()
    for b in template:
        if b["caption_of"] is None:
            continue
        captioned.add(b["caption_of"])
        line = by_p[b["caption_of"]]
        if line["role"] not in DOTTED:
            continue
        h = last.get(" ".join(b["all_words"]))
        if h is None:
            if not line["optional"]:
                out.append(("caption_missing", b["p"], None, None, None))
            continue
        a = above[h]
        usable = a is not None and role[a] != layout.HINT
        out += [("under" if usable else "under_nothing", line["p"], a, k, None) for k in range(line["blanks"])]
        if usable:
            taken.add(a)
    # Lines of blanks without a caption: between the same two matched blocks the k-th one holds the document's k-th free line.
    matched = [x for x in places if x["state"] == "matched"]
    free = [p for p in range(len(held)) if role[p] not in (layout.SPACER, layout.HINT) and p not in taken]
    gaps = _by_gap(free, sorted(x["c"] for x in matched))
    for gap, lines in _by_gap([b["p"] for b in template if b["role"] == "blank_line" and b["p"] not in captioned], sorted(x["t"] for x in matched)).items():
        for n, t in enumerate(lines):
            c = gaps[gap][n] if n < len(gaps.get(gap, ())) else None
            taken.add(c)
            if c is not None or not by_p[t]["optional"]:
                out += [("line", t, c, k, None) for k in range(by_p[t]["blanks"])]
    # What the document has beyond the template.
    out += [("extra", None, p, None, None) for p in free if p not in taken and role[p] not in layout.DEPENDENT and len(held[p]["words"]) >= EXTRA_WORDS]
    out += [("residue_note", None, p, None, None) for p, c in enumerate(held) if c["note"]]
    return out + [("residue_blank", None, p, None, None) for p, c in enumerate(held) if c["open"]]


def _marked(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, item, texts and marks of pairs; a template is read once for a batch."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("t", pa.int32()), ("c", pa.int32()), ("k", pa.int32()), ("at", pa.int32())]))
    names = ["kind", "t", "c", "k", "at"]
    for whole in tables:
        for begin in range(0, whole.num_rows, STEP):
            table, known, made = whole.slice(begin, STEP), {}, []
            for n, item in enumerate(table.column(1).to_pylist()):
                if item not in known:
                    known[item] = table.column(2)[n].as_py() or []
                made.append([dict(zip(names, m)) for m in marked(known[item], table.column(3)[n].as_py() or [], table.column(4)[n].as_py() or [])])
            yield pa.RecordBatch.from_arrays([table.column(0), table.column(1), table.column(4), pa.array(made, kind)], ["row", "item", "texts", "marks"])


def _state(value: Column, kind: Column) -> Column:
    """Of a blank: by what stands in its place."""
    return F.when(value.isNull() | (T.strip(value) == ""), "unresolved").when(value.rlike(FILL_ONLY), F.when(kind == "signature", "to_sign").otherwise("unfilled")).otherwise("filled")


def findings(pairs: DataFrame, docs: DataFrame, templates: DataFrame) -> DataFrame:
    """row, item, finding, template_p, document_p, text, value: one row for each thing found.

    missing, optional_missing, changed, order: blocks of the template. filled, unfilled, unresolved, to_sign, choice: its blanks
    (text is the blank's id). caption_missing: its captions. extra, residue_note, residue_blank: blocks of the document.
    pairs: row, item, the numbers that layout.blocks gave to both sides; docs and templates: what it made of them.
    """
    # A pair's blocks are found and read where its document's lines are; only pairs move, to them.
    tpl = cut(wanted(templates))
    tpl = checked(tpl, size=F.col("size"))
    both = pairs.select("row", "item").join(seen(docs), "row", "left").join(tpl.select("item", "wanted"), "item", "left").select("row", "item", "wanted", "held", "texts")
    made = both.mapInArrow(_marked, f"row bigint, item bigint, texts array<string>, marks array<struct<{MARK}>>").join(tpl.select("item", "read"), "item", "left")
    block = lambda m: F.get("read", m["t"])
    blank = lambda m: F.get(block(m)["blanks"], m["k"])
    # The caption that is missing is shown as it is written, another block by its label and fixed words.
    title = lambda m: F.when(m["kind"] == "caption_missing", T.strip(block(m)["text"])).otherwise(block(m)["shown"])
    each = F.transform("marks", lambda m: F.struct(m["kind"].alias("kind"), m["t"].alias("t"), m["c"].alias("c"), m["at"].alias("at"), F.get("texts", m["c"]).alias("now"), title(m).alias("title"), block(m)["alternatives"].alias("alternatives"), F.when(m["kind"] == "inside", block(m)["pattern"]).alias("pattern"), blank(m).alias("blank")))
    m = made.select("row", "item", F.explode(each).alias("m")).select("row", "item", "m.*", "m.blank.*")
    kind, now, typ = F.col("kind"), F.col("now"), F.col("type")
    # A blank inside a matched block holds what the pattern's group holds; no match and an empty group leave it as open.
    body = F.substring(now, F.col("at") + 1, F.char_length(now))
    inside = F.when(F.col("nth") > 0, F.call_function("regexp_extract", body, F.concat(F.lit("(?s)"), F.col("pattern")), F.col("nth")))
    m = m.withColumn("v", F.when(kind == "inside", inside).when(kind == "under", F.regexp_replace(T.strip(now), r"[,;]\s*$", "")).when(kind == "line", now))
    v = F.col("v")
    open_or = F.when(v.rlike(FILL_ONLY), "unfilled").otherwise("filled")
    state = (
        F.when(kind == "inside", F.when(F.col("alternatives") > 0, "choice").otherwise(_state(v, typ))).when(kind == "under_nothing", "unresolved").when(kind == "under", F.when(typ == "signature", "to_sign").otherwise(open_or))
        .when(kind == "line", F.when(F.col("c").isNull(), "unresolved").when(v.rlike(FILL_ONLY), F.when(typ == "signature", "to_sign").otherwise("unfilled")).otherwise("filled")).otherwise(kind)
    )
    m = m.withColumn("finding", state)
    of_blank, of_document = F.col("blank").isNotNull(), kind.isin("extra", "residue_note", "residue_blank")
    value = F.when(of_blank & (F.col("finding") == "filled"), F.when(kind == "under", v).otherwise(T.strip(v))).when(kind == "changed", T.strip(now))
    return m.select("row", "item", "finding", F.col("t").alias("template_p"), F.col("c").alias("document_p"), F.when(of_blank, F.col("id")).when(of_document, T.strip(now)).otherwise(F.col("title")).alias("text"), value.alias("value"))


def verdicts(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """row, item, issues (missing blocks, unfilled blanks, other order) and blocking (one of the first two)."""
    n = found.groupBy("row", "item").agg(F.count_if(F.col("finding").isin(ISSUES)).alias("issues"), F.max(F.col("finding").isin(BLOCKING)).alias("blocking"))
    return pairs.select("row", "item").join(n, ["row", "item"], "left").select("row", "item", F.coalesce("issues", F.lit(0)).cast("long").alias("issues"), F.coalesce("blocking", F.lit(False)).alias("blocking"))
