"""What a reader sees of edits: chains of steps as one change, and the fragments that went and came.

Defined results: texts differ visibly if they differ after runs of white space become one space and the edges go;
an empty side, or sides that are equal then, are no change. A chain's place is its first step's.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from re import compile as pattern

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions.patterns import BLANK
from wordloom.functions.plans import cut

# The sentences of a description, what joins fragments, and the length from which one is shortened.
SWAPPED, GONE, CAME, NOTHING = "Zastąpiono „{}” sformułowaniem „{}”.", "Usunięto fragment „{}”.", "Dodano fragment „{}”.", "Brak widocznej zmiany."
JOINT, LONGEST, CUT_MARK = " […] ", 90, "…"
#: Words, and runs of signs.
TOKEN = pattern(r"\w+|[^\w\s]+")
FRAGMENTS = "array<struct<op:string,start:int,end:int,removed:string,added:string>>"


def visible(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", " "))


def collapsed(edits: DataFrame, key: str = "row", order: str = "step") -> DataFrame:
    """Chains A, B, C of edits (key, order, paragraph_index, sentence_index, before, after, rule) as one change from A to C: key, paragraph_index, sentence_index, before, after, rules, steps.

    An edit with a place continues the last visible edit of its place if that left what it starts from. One without a place
    continues the last edit without a place that left its text and that no other has continued. Chains that end where they began are left out.
    """
    e = edits.withColumns({"before": visible(F.col("before")), "after": visible(F.col("after"))}).where("before <> '' AND after <> '' AND before <> after")
    placed = e.where("paragraph_index IS NOT NULL AND sentence_index IS NOT NULL")
    at = W.partitionBy(key, "paragraph_index", "sentence_index").orderBy(order)
    fresh = F.coalesce((F.lag("after").over(at) != F.col("before")).cast("int"), F.lit(1))
    chain = ["paragraph_index", "sentence_index", "chain"]
    placed = placed.withColumn("chain", F.sum(fresh).over(at.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("string"))
    free = _free_chains(e.where("paragraph_index IS NULL OR sentence_index IS NULL"), key, order)
    both = placed.unionByName(free)
    ends = both.groupBy(key, *chain).agg(F.min_by("before", order).alias("before"), F.max_by("after", order).alias("after"), F.transform(F.array_sort(F.collect_list(F.struct(order, "rule"))), lambda x: x["rule"]).alias("rules"), F.count("*").alias("steps"))
    return ends.where("before <> after").select(key, "paragraph_index", "sentence_index", "before", "after", "rules", "steps")


def _free_chains(e: DataFrame, key: str, order: str) -> DataFrame:
    """Edits without a place, with the chain that each belongs to (named by its first edit)."""
    e = e.withColumns({"paragraph_index": F.lit(None).cast("int"), "sentence_index": F.lit(None).cast("int")})
    # Each text of a document is left by edits and taken up by others; an edit takes up what the event just before it left.
    events = e.select(key, F.col("after").alias("at"), F.col(order).alias("o"), F.lit(1).alias("left")).unionByName(e.select(key, F.col("before").alias("at"), F.col(order).alias("o"), F.lit(0).alias("left")))
    by_text = W.partitionBy(key, "at").orderBy("o", "left")
    events = events.withColumns({"was": F.lag("left").over(by_text), "earlier": F.lag("o").over(by_text)})
    follows = events.where("left = 0 AND was = 1").select(key, F.col("o").alias("node"), F.col("earlier").alias("up"))
    links = cut(e.select(key, F.col(order).alias("node")).join(follows, [key, "node"], "left").withColumn("up", F.coalesce("up", "node")))
    while True:  # each round doubles the way up
        higher = links.select(key, F.col("node").alias("up"), F.col("up").alias("top"))
        links, before = cut(links.join(higher, [key, "up"]).select(key, "node", F.col("top").alias("up"))), links
        if links.exceptAll(before).isEmpty():
            break
    return e.join(links.select(key, F.col("node").alias(order), F.col("up").cast("string").alias("chain")), [key, order])


def pieces(before: str, after: str) -> list[dict]:
    """The differences of two texts as fragments: places in `before` (characters, end exclusive), what went and what came.

    Tokens are matched by longest common runs, left and right of each again; a fragment reaches from its first token to its last, so
    what stands between two unchanged tokens is in no fragment.
    """
    a, b = list(TOKEN.finditer(before)), list(TOKEN.finditer(after))
    out = []
    for op, i, j, k, m in SequenceMatcher(None, [t[0] for t in a], [t[0] for t in b], autojunk=False).get_opcodes():
        if op != "equal":
            start, end = (a[i].start(), a[j - 1].end()) if j > i else (a[i].start() if i < len(a) else len(before),) * 2
            out.append({"op": op, "start": start, "end": end, "removed": before[start:end], "added": after[b[k].start() : b[m - 1].end()] if m > k else ""})
    return out


def with_fragments(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs with `fragments`, from the visible texts of two columns; Arrow batches, a short list for each row."""
    rows = pairs.withColumns({before: visible(F.col(before)), after: visible(F.col(after))})
    names = rows.columns
    i, j = names.index(before), names.index(after)
    kind = pa.list_(pa.struct([("op", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("removed", pa.string()), ("added", pa.string())]))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            found = [pieces(a, b) for a, b in zip(table.column(i).to_pylist(), table.column(j).to_pylist())]
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(found, kind)], [*names, "fragments"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, fragments {FRAGMENTS}")


def description(fragments: Column) -> Column:
    """One sentence for a reader: what was replaced, removed or added."""
    short = lambda t: F.when(F.char_length(t) <= LONGEST, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, LONGEST - 1)), F.lit(CUT_MARK)))
    side = lambda field: F.array_join(F.transform(F.filter(fragments, lambda x: x[field] != ""), lambda x: short(x[field])), JOINT)
    gone, came = side("removed"), side("added")

    def filled(sentence: str, *values: Column) -> Column:
        parts = sentence.split("{}")
        return F.concat(F.lit(parts[0]), *[c for v, p in zip(values, parts[1:]) for c in (v, F.lit(p))])

    return F.when((gone != "") & (came != ""), filled(SWAPPED, gone, came)).when(gone != "", filled(GONE, gone)).when(came != "", filled(CAME, came)).otherwise(NOTHING)


def visible_changes(edits: DataFrame, key: str = "row", order: str = "step") -> DataFrame:
    """collapsed() with fragments and their description."""
    return with_fragments(collapsed(edits, key, order)).withColumn("description", description(F.col("fragments")))
