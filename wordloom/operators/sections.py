"""Sections learnt from approved documents: headings grouped by wording, in reading order.

A heading joins the first group that holds a wording like its own: one contains the other, or the
ratio of their longest matching blocks is at least `SAME`. Groups are numbered by the heading that
founded them, so the group of a heading depends on what was read before. Reading in order is not
needed for that: a wording's group changes only when a group of smaller number has gained a wording
like it, and only at the wording's next place. So the places where a wording enters a group
("entries") are a fixed point over the links between wordings, found in rounds of joins; each
round settles every entry whose causes are settled, and a state that a round leaves unchanged is
that of the sequential reading.

Links are found exactly. A contained wording is joined by its rarest pair of letters alone. For the
ratio any two wordings may be alike, so all are compared, block by block: wordings are dealt to
chunks by a hash, and each pair of chunks is a task of bounded size. There the counts of their
letters bound the ratio, then the letters that both have in order do; few pairs are left for the
comparison itself.

Defined results: documents are read by doc_id (nulls last), then by text; rows that repeat are
documents of their own; null and empty texts have no headings; an empty table gives no sections.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions.plans import cut, dealt, with_rows

from . import structure
from . import text as T

# Share of matching letters that makes two wordings one section; share of documents from which a section is suggested as required; lines among which a title stands.
SAME, REQUIRED, TITLE_LINES = 0.75, 0.8, 3
#: The number before a heading. A Roman number needs a dot, bracket or space after it, so that no word loses its first letters.
NUMBER = r"^(?:§\s*\d+[a-z]?\s*[.)]?|[IVXLC]+(?:[.)]|(?=\s))|\d+(?:\.\d+)*\s*[.)]?)\s*"
UNITS = {"paragraph": r"^§\s*\d+", "roman": r"^[IVXLC]+[.)]\s+\p{Lu}", "arabic": r"^\d+[.)]\s+\p{Lu}"}
#: Parts that the places of one wording are dealt to, so that a wording of every document is many tasks' work.
SALT = 16
#: Wordings of a chunk, and how many chunks there are at least and at most; beyond that chunks grow.
CHUNK, LEAST, MOST = 2048, 8, 64
#: Classes of letters, the last one of none; rare letters share one, which never lessens a bound.
CLASSES = 64
#: Pairs whose common letters are counted at once.
STEP = 1 << 17


def unit_flags(line: Column) -> list[Column]:
    return [line.rlike(p) for p in UNITS.values()]


def places(docs: DataFrame) -> DataFrame:
    """row, at (the place in reading order), position (among the document's headings), heading (without its number); titles left out."""
    base = with_rows(docs).select("row", F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("key"), "text")
    listed = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: T.strip(x)), lambda x: x != "")
    flat = base.select("row", "none", "doc_id", "key", F.posexplode(listed).alias("line", "text")).where(structure.is_heading(F.col("text")))
    flat = flat.withColumn("unit", F.greatest(*unit_flags(F.col("text"))))
    whole, read = W.partitionBy("row"), W.partitionBy("row").orderBy("line")
    flat = flat.withColumn("nth", F.row_number().over(read)).withColumn("any_unit", F.max("unit").over(whole))
    title = (F.col("nth") == 1) & ~F.col("unit") & F.col("any_unit") & (F.col("line") < TITLE_LINES)
    kept = flat.withColumn("title", title).withColumn("shift", F.max(F.col("title").cast("int")).over(whole)).where("NOT title")
    heading = F.trim(F.regexp_replace(F.regexp_replace("text", NUMBER, ""), r"(?U)\s+", " "))
    position = (F.col("nth") - 1 - F.col("shift")).cast("int")
    at = F.struct("none", F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), "key", "row", position.alias("position"))
    return kept.select("row", at.alias("at"), position.alias("position"), heading.alias("heading")).where("heading <> ''")


def folded(headings: DataFrame) -> DataFrame:
    """heading and wording (case folded) of distinct headings."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"heading": f["heading"], "wording": [h.casefold() for h in f["heading"]]})

    return headings.select("heading").distinct().mapInPandas(fold, "heading string, wording string")


def _numbered(tokens: Column) -> Column:
    """Each token with how often it stood before, so that a set of them counts repeats."""
    return F.transform(tokens, lambda x, i: F.concat(x, F.size(F.filter(F.slice(tokens, 1, i), lambda y: y == x)).cast("string")))


def alike(a: str, b: str) -> bool:
    """Whether a heading (a) is of the section that b names; the ratio may depend on the order."""
    return a in b or b in a or SequenceMatcher(None, a, b, autojunk=False).ratio() >= SAME


@lru_cache(maxsize=1024)
def _letters(text: str) -> dict[str, int]:
    """Of each letter the places, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def may_be_alike(a: str, b: str) -> bool:
    """Whether the letters that both have in order suffice; matching blocks never hold more, so what fails is not alike in either order."""
    places, full = _letters(a), (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    common = len(a) - v.bit_count()
    return 2 * common >= SAME * (len(a) + len(b)) or common == min(len(a), len(b))


def _coded(wordings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes (of each wording its letters' classes, then that of none), lengths, and counts of each class."""
    size = np.array([len(w) for w in wordings], np.int64)
    flat = np.frombuffer("".join(wordings).encode("utf-32-le", "surrogatepass"), np.uint32)
    names, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.minimum(np.arange(len(names)), CLASSES - 2)
    row = np.repeat(np.arange(len(size)), size)
    codes = np.full((len(size), max(1, int(size.max(initial=0)))), CLASSES - 1, np.uint8)
    codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = rank[at]
    counts = np.bincount(row * CLASSES + rank[at], minlength=len(size) * CLASSES).reshape(-1, CLASSES)
    return codes, size, np.minimum(counts, 255).astype(np.uint8)


def _bits(codes: np.ndarray) -> np.ndarray:
    """Of each wording and class the places as bits: row, class, word of 64."""
    out = np.zeros((len(codes), CLASSES, -(-codes.shape[1] // 64)), np.uint64)
    row = np.arange(len(codes))
    for k in range(codes.shape[1]):
        out[row, codes[:, k], k // 64] |= np.uint64(1 << k % 64)
    out[:, CLASSES - 1] = 0
    return out


def _in_order(bits: np.ndarray, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters the wordings a and b have in order, at most; with each letter of b the last places lose bits that it reaches."""
    v = np.full((bits.shape[2], len(a)), np.iinfo(np.uint64).max)
    for k in range(codes.shape[1]):
        m = bits[a, codes[b, k]]
        carry = np.zeros(len(a), np.uint64)
        for w in range(len(v)):
            u = v[w] & m[:, w]
            total = v[w] + u
            over = total < v[w]
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            v[w] = total | (v[w] - u)
    return np.bitwise_count(~v).sum(axis=0, dtype=np.int64)


def near_pairs(wordings: list[str], first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of the pairs, one of `first` and one of `second` (a pair of both once), whose ratio the letters do not rule out."""
    codes, size, counts = _coded(wordings)
    bits = _bits(codes)
    second = second[np.argsort(size[second], kind="stable")]
    lengths, held = size[second], counts[second]
    shares = np.zeros(len(size), bool)
    shares[np.intersect1d(first, second)] = True
    left: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def judged() -> Iterator[tuple[int, int]]:
        a, b = (np.concatenate(x) for x in zip(*left))
        ok = 2 * _in_order(bits, codes, a, b) >= SAME * (size[a] + size[b])
        yield from zip(a[ok].tolist(), b[ok].tolist())
        left.clear()

    for i in first:
        # Both have as many letters in common as the shorter at most.
        n = size[i]
        lo, hi = np.searchsorted(lengths, SAME / (2 - SAME) * n - 0.5, "left"), np.searchsorted(lengths, n * (2 - SAME) / SAME + 0.5, "right")
        common = np.minimum(held[lo:hi], counts[i]).sum(axis=1, dtype=np.int64)
        j = second[lo:hi][2 * common >= SAME * (n + lengths[lo:hi])]
        j = j[j != i] if not shares[i] else j[(j > i) | ~shares[j]]
        left.append((np.full(len(j), i), j))
        waiting += len(j)
        if waiting >= STEP:
            yield from judged()
            waiting = 0
    if left:
        yield from judged()


def links(wordings: DataFrame) -> DataFrame:
    """wording, like: every ordered pair of different wordings of which the first is alike to the second."""
    n = F.char_length("wording")
    letters = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("wording"), i, F.lit(1)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col("wording"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    w = cut(wordings.select("wording", _numbered(pairs).alias("pairs"), F.array_distinct(letters).alias("letters")))
    # A contained wording has all its pairs in the other.
    often = w.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("k"))
    ranked = w.select("wording", F.explode("pairs").alias("pair")).join(often, "pair").groupBy("wording").agg(F.min(F.struct("k", "pair"))["pair"].alias("rarest"))
    part = w.join(ranked, "wording", "left").select(F.col("wording").alias("a"), F.coalesce("rarest", F.get("letters", F.lit(0))).alias("token"))
    rest = w.select(F.col("wording").alias("b"), F.explode(F.concat("pairs", "letters")).alias("token"))
    inside = part.join(rest, "token").where((F.col("a") != F.col("b")) & F.contains(F.col("b"), F.col("a"))).select("a", "b")
    chunks = min(MOST, max(LEAST, ceil(w.count() / CHUNK)))
    own = F.pmod(F.xxhash64("wording"), F.lit(chunks)).cast("int")
    block = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda j: F.least("own", j) * chunks + F.greatest("own", j))
    blocks = w.select("wording", own.alias("own")).select("wording", "own", F.explode(block).alias("block"))

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = divmod(int(frame["block"].iloc[0]), chunks)
        words, of = frame["wording"].tolist(), frame["own"].to_numpy()
        near = near_pairs(words, np.flatnonzero(of == x), np.flatnonzero(of == y))
        both = [(p, q) for i, j in near for p, q in ((words[i], words[j]), (words[j], words[i])) if alike(p, q)]
        return pd.DataFrame(both, columns=["wording", "like"])

    found = dealt(blocks, "block").groupBy("block").applyInPandas(judge, "wording string, like string")
    return cut(found.union(inside).union(inside.select("b", "a")).distinct())


def entries(held: DataFrame, like: DataFrame) -> DataFrame:
    """wording, section (the place of the section's first heading), at (where the wording enters it), as a sequential reading would have them.

    held: wording, at of every heading; like: wording, like.
    """
    first = held.groupBy("wording").agg(F.min("at").alias("section"))
    spots = cut(held.select("wording", F.pmod(F.xxhash64("at"), F.lit(SALT)).alias("salt"), "at"))
    # A wording founds a section at its first place, unless some section is smaller there.
    own = first.select("wording", "section", F.lit(None).cast(held.schema["at"].dataType).alias("since"))
    both = like.union(first.select("wording", F.col("wording").alias("like")))
    before = W.partitionBy("wording").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    now = cut(own.select("wording", "section", F.col("section").alias("at")))
    sign = None
    while True:
        gained = both.join(now.select(F.col("wording").alias("like"), "section", F.col("at").alias("since")), "like").groupBy("wording", "section").agg(F.min("since").alias("since"))
        asked = own.unionByName(gained.select("wording", "section", "since"))
        dealt = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        after = dealt.join(spots, ["wording", "salt"]).where(F.col("since").isNull() | (F.col("at") > F.col("since"))).groupBy("wording", "section").agg(F.min("at").alias("at"))
        least = after.groupBy("wording", "at").agg(F.min("section").alias("section")).withColumn("had", F.min("section").over(before))
        now = cut(least.where(F.col("had").isNull() | (F.col("section") < F.col("had"))).select("wording", "section", "at"))
        new = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("wording", "section", "at"), F.lit(1 << 40)))).first()
        if new == sign:
            return now
        sign = new


def members(docs: DataFrame) -> DataFrame:
    """row, heading, position, at and section (its first heading's place) of every heading; kept in the shared folder."""
    named = cut(places(docs))
    held = cut(named.join(folded(named), "heading"))
    enter = entries(held, links(held.select("wording").distinct()))
    until = F.lead("at").over(W.partitionBy("wording").orderBy("at"))
    spans = enter.withColumn("until", until).withColumnRenamed("at", "enter").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALT)))
    inside = (F.col("at") >= F.col("enter")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    return cut(salted.join(spans, ["wording", "salt"]).where(inside).select("row", "heading", "position", "at", "section"))


def variants(member: DataFrame) -> DataFrame:
    """section, heading, n, first (where the section has it first) of each wording of a section."""
    return member.groupBy("section", "heading").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def sections(docs: DataFrame, member: DataFrame | None = None) -> DataFrame:
    """A checklist learnt from docs: section (its number), label, documents, share, severity, median_position, wordings, kept.

    The label is the shortest wording without digits (of equals the first); a section whose wordings all
    hold digits belongs to single documents and is not kept. A section of one document is a section.
    """
    docs = with_rows(docs)
    member = members(docs) if member is None else member
    v = variants(member).withColumn("plain", ~F.col("heading").rlike(r"\d"))
    size = F.struct(F.char_length("heading"), "first")
    label = v.groupBy("section").agg(
        F.min_by("heading", F.when(F.col("plain"), size)).alias("plain_label"), F.min_by("heading", F.col("first")).alias("founder"), F.sum(F.col("plain").cast("long")).alias("plain_wordings"), F.count("*").alias("wordings"),
    )
    seen = member.groupBy("section", "row").agg(F.lit(1)).groupBy("section").agg(F.count("*").alias("documents"))
    middle = member.groupBy("section", "position").agg(F.count("*").alias("k")).groupBy("section").agg(F.percentile("position", F.lit(0.5), F.col("k")).alias("median_position"))
    out = label.join(seen, "section").join(middle, "section").crossJoin(F.broadcast(docs.agg(F.count("*").alias("total"))))
    kept = F.col("plain_wordings") > 0
    name = F.when(kept, F.col("plain_label")).otherwise(F.col("founder"))
    share = F.col("documents") / F.col("total")
    return out.select(
        F.col("section.doc").alias("first_doc_id"), F.col("section.position").alias("first_position"), name.alias("label"), "documents", F.round(share, 4).alias("share"),
        F.when(share >= REQUIRED, "required").otherwise("expected").alias("severity"), "median_position", F.when(kept, F.col("plain_wordings")).otherwise(F.col("wordings")).alias("wordings"), kept.alias("kept"),
    )


def numbering(docs: DataFrame) -> DataFrame:
    """One row: documents, paragraph, roman, arabic (documents that number so), numbering (the unit of at least REQUIRED of them, or null)."""
    listed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: T.strip(x))
    any_line = lambda p: F.exists(listed, lambda x: x.rlike(p)).cast("long")
    has = [any_line(p).alias(u) for u, p in UNITS.items()]
    k = with_rows(docs).select(*has).agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(u), F.lit(0)).alias(u) for u in UNITS])
    top = F.array_max(F.array(*[F.struct(F.col(u).alias("k"), F.lit(u).alias("u")) for u in UNITS]))
    return k.withColumn("numbering", F.when((F.col("documents") > 0) & (top["k"] / F.col("documents") >= REQUIRED), top["u"]))
