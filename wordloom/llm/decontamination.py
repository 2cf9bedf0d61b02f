"""Benchmark decontamination with a positional inverted index.

The index stores the postings (term, doc_id, position) of every benchmark term in the training
documents. A lookup takes for each window of an item the two terms rarest in the index, adjusts
their lists by the terms' offsets and intersects them; the alignments that are left are compared
word by word, so the matches are exact. `phrase_hits` returns exact phrases, `near_hits` documents
that hold all terms of an item within a span of words.

Defined results: null and wordless texts have no words and no hits; a row without an id is a document,
known by its text; rows that repeat a doc_id are each judged on their own text; an item without words never occurs;
items that repeat an item_id count once; empty tables give no hits; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small, stored

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark tables up to which they are broadcast (their words' bytes are checked too); above it they are joined by shuffles.
BROADCAST_ROWS = 2_000_000
WINDOW = 13


def words(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings (term, doc_id, pos) of those terms (a column term) in all documents."""
    flat = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words(F.col(text_col))).alias("pos", "word"))
    return stored(flat.join(small(terms, BROADCAST_ROWS, F.octet_length("word") + 16), flat.word == terms.word).select("term", "doc_id", "pos"))


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and item: the words of each item that has any."""
    return items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("item")).where(F.size("item") > 0)


def vocabulary(items: DataFrame) -> DataFrame:
    """word and its number, term, of every word of the items."""
    from pyspark.sql import Window as W

    distinct = items.select(F.explode("item").alias("word")).distinct()
    return cut(distinct.select("word", F.row_number().over(W.orderBy("word")).alias("term")))


def rarest_pairs(items: DataFrame, terms: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """item_key, item_id, item, len, pairs: for each window its two offsets whose terms are rarest in the index."""
    seen = index.groupBy("term").count()
    counts = terms.join(seen, "term", "left").select("word", F.coalesce("count", F.lit(0)).alias("n"))
    flat = items.select("item_key", F.posexplode("item").alias("off", "word")).join(counts, "word")
    ranked = flat.groupBy("item_key").agg(F.sort_array(F.collect_list(F.struct("off", "n"))).alias("offs"))
    each = items.join(ranked, "item_key").withColumn("len", F.least(F.size("item"), F.lit(window)))
    two = lambda s: F.slice(F.sort_array(F.transform(F.slice("offs", s + 1, F.col("len")), lambda o: F.struct(o["n"].alias("n"), o["off"].alias("off")))), 1, 2)
    pairs = F.transform(F.sequence(F.lit(0), F.size("item") - F.col("len")), lambda s: F.transform(two(s), lambda o: o["off"]))
    return cut(each.select("item_key", "item_id", "item", "len", F.array_distinct(pairs).alias("pairs")))


def alignments(index: DataFrame, terms: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_key, at: where an item could lie in a document, from intersected lists."""
    anchors = items.select("item_key", "item", F.explode(F.array_distinct(F.flatten("pairs"))).alias("off"))
    anchors = anchors.select("item_key", "off", F.element_at("item", F.col("off") + 1).alias("word")).join(terms, "word").select("term", "item_key", "off")
    lists = index.join(small(cut(anchors), BROADCAST_ROWS), "term").select("doc_id", "item_key", (F.col("pos") - F.col("off")).alias("at"), "off")
    met = lists.groupBy("doc_id", "item_key", "at").agg(F.collect_set("off").alias("offs"))
    met = met.join(small(items.select("item_key", "pairs"), BROADCAST_ROWS, F.size("pairs") * 24), "item_key")
    return met.where(F.exists("pairs", lambda p: F.size(F.array_except(p, F.col("offs"))) == 0)).select("doc_id", "item_key", "at")


def _span(cand: Column, doc: Column) -> Column:
    """Flags for an item's words: whether the document has the same word there."""
    return F.transform(cand["item"], lambda w, j: F.coalesce(F.get(doc, cand["at"] + j) == w, F.lit(False)))


def _windows(cand: Column, eq: Column) -> Column:
    """Offsets of the item's windows that match in full."""
    return F.filter(F.sequence(F.lit(0), F.size(cand["item"]) - cand["len"]), lambda s: ~F.exists(F.slice(eq, s + 1, cand["len"]), lambda e: ~e))


def phrase_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For each document row: doc_id, n_words, hits (item_id, start: each match of a window, in words), hit_words, and the kept columns."""
    item = cut(item_words(items, item_id, item_text).distinct().withColumn("item_key", F.monotonically_increasing_id()))
    terms = vocabulary(item)
    # Rows without an id go by their text, so that they are no single list.
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)) - F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 61)))
    index = build_index(docs.select(key.alias("key"), F.col(text_col).alias("text")), terms, "key", "text")
    pairs = rarest_pairs(item, terms, index, window)
    bytes_of = F.aggregate("item", F.lit(0).cast("long"), lambda s, w: s + F.octet_length(w) + 16)
    found = alignments(index, terms, pairs).join(small(pairs.select("item_key", "item_id", "item", "len"), BROADCAST_ROWS, bytes_of), "item_key")
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item", "len", "at")).alias("cands"))
    per_doc = per_doc.select(F.col("doc_id").alias("found_id"), "cands")
    base = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("body"), *[F.col(c).alias(f"kept_{c}") for c in keep or [] if c != text_col])
    joined = base.join(per_doc, base.key == per_doc.found_id, "left").withColumn("doc", words(F.col("body")))
    hit = F.transform("cands", lambda c: F.struct(c["item_id"].alias("item_id"), c["at"].alias("at"), c["len"].alias("len"), _windows(c, _span(c, F.col("doc"))).alias("wins")))
    joined = joined.withColumn("n_words", F.size("doc").cast("long")).withColumn("m", F.when(F.col("cands").isNotNull(), F.filter(hit, lambda h: F.size(h["wins"]) > 0)))
    hits = F.coalesce(F.flatten(F.transform("m", lambda h: F.transform(h["wins"], lambda s: F.struct(h["item_id"].alias("item_id"), (h["at"] + s).alias("start"), h["len"].alias("len"))))), F.array().cast(f"array<struct<item_id:{items.schema[item_id].dataType.simpleString()},start:int,len:int>>"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))))
    return joined.withColumn("hits", hits).select("doc_id", "n_words", "hits", covered.alias("hit_words"), *[F.col("body" if c == text_col else f"kept_{c}").alias(c) for c in keep or []])


def near_hits(docs: DataFrame, items: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Distinct (doc_id, item_id) where all distinct terms of the item lie within `span` consecutive words.

    Reads the rarest term's list first: each of its places opens a window, and the other lists are
    intersected with the windows by blocks of `span` words.
    """
    item = cut(item_words(items, item_id, item_text).distinct().withColumn("item_key", F.monotonically_increasing_id()))
    terms = vocabulary(item)
    index = build_index(docs, terms, id_col, text_col)
    counts = index.groupBy("term").count()
    need = item.select("item_key", "item_id", F.explode(F.array_distinct("item")).alias("word")).join(terms, "word").join(counts, "term")
    size = item.select("item_key", F.size(F.array_distinct("item")).alias("size"))
    rare = need.groupBy("item_key", "item_id").agg(F.min(F.struct("count", "term")).alias("r"), F.count("*").alias("have")).join(size, "item_key").where("have = size")
    seeds = index.join(small(cut(rare.select("item_key", "item_id", "size", F.col("r.term").alias("term"))), BROADCAST_ROWS), "term")
    starts = seeds.select("doc_id", "item_key", "item_id", "size", F.col("pos").alias("seed"), F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("pos") / span) + d))).alias("block"))
    posts = index.join(small(cut(need.select("term", "item_key")), BROADCAST_ROWS), "term").withColumn("block", F.floor(F.col("pos") / span))
    met = starts.join(posts, ["doc_id", "item_key", "block"]).where(F.abs(F.col("pos") - F.col("seed")) < span)
    around = met.groupBy("doc_id", "item_key", "item_id", "size", "seed").agg(F.collect_set(F.struct("pos", "term")).alias("ps"))
    inside = lambda lo: F.size(F.array_distinct(F.transform(F.filter("ps", lambda p: (p["pos"] >= lo) & (p["pos"] < lo + span)), lambda p: p["term"]))) == F.col("size")
    return around.where(F.exists(F.sequence(F.col("seed") - span + 1, F.col("seed")), inside)).select("doc_id", "item_id").distinct()


def contamination_digest(docs: DataFrame, items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The contract's columns: a document is contaminated if at least a twentieth of its words are hit."""
    out = phrase_hits(docs, items, keep=keep)
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string"))))
    n_hit = F.size("hit_words").cast("long")
    out = out.withColumn("ids", ids).withColumn("n_hit", n_hit)
    kept = [c for c in keep or []]
    return out.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *kept)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bl AS (SELECT item_id, ws, least(13, len(ws)) AS l FROM b WHERE len(ws) > 0
), g AS (SELECT DISTINCT item_id, l, array_to_string(ws[s:s + l - 1], ' ') AS gram FROM (SELECT item_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS s FROM bl)
), ls AS (SELECT DISTINCT l FROM g
), dg AS (SELECT doc_id, l, s, array_to_string(ws[s:s + l - 1], ' ') AS gram FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS s FROM d, ls WHERE len(ws) >= l)
), h AS (SELECT doc_id, item_id, s, l FROM dg JOIN g USING (l, gram)
), c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY doc_id
), i AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
