"""Mixing sources to target weights by Pareto order sampling.

A source's target is a share of all words by the weight of its place in code point order, at
most `max_copies` times its own words (the excess goes to the others by weight). Whole copies
that a target holds in full are certain; the rest of the target is a fixed-size sample: documents
are ranked by the random odds u/(1-u) over their inclusion odds p/(1-p), and the ranking is read
until its words are nearest to what is left. p is the left share of the target, times the
document's weight over its source's mean weight if a weight column is named.

Defined results: a null text has size 0; a null source is a source of its own, the last; equal
ranks go by doc_id, and repeated rows are documents of their own; an empty table gives an empty
result; columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, small

SEED = "mix-1"
#: Steps into which a source's ranking is cut; only the step at the boundary is sorted in one task.
STEPS = 4096
PLACES = 2.0**52


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """src, source_size, target, copies, left of each source; sizes has src and size.

    Sources are filled like vessels: in order of capacity over weight, each is capped if the level
    that shares out what the capped ones before it leave is above it.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy("src")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("w"), "src")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    # Levels rise while sources are capped and fall after that, so the highest is the one that all open sources share.
    fill = F.max("level").over(everything)
    per = per.withColumn("level", level)
    per = per.withColumn("target", F.least("cap", F.col("w") * fill))
    per = per.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.lit(max_copies), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    return per.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).select("src", "source_size", "target", "copies", "left")


def identity(source_col: str, text_col: str) -> dict:
    """src_key, size_key and text_key: a row's source (null last), size and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"src_key": F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")), "size_key": F.regexp_count(text, F.lit(WORD)).cast("long"), "text_key": F.xxhash64(text)}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (1, 2, 3), max_copies: int = 3, weight_col: str | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, src, size, text_key, source_size, target and copies (times the mix takes the document) for each row."""
    keys = identity(source_col, text_col)
    # In thousandths, as whole numbers: sums then agree in every order.
    weight = F.greatest(F.lit(0.0), F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))) if weight_col else F.sqrt(keys["size_key"].cast("double"))
    drawn = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            keys["src_key"].alias("src"),
            keys["size_key"].alias("size"),
            keys["text_key"].alias("text_key"),
            F.floor(weight * 1000).cast("long").alias("weight"),
            F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), drawn)), 1, 13), 16, 10).cast("long").alias("h"),
        )
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    means = base.groupBy("src").agg((F.sum((wide("size") * wide("weight")).cast("decimal(38,0)")).cast("double") / F.sum("size").cast("double")).alias("mean"))
    targets = cut(source_targets(base, weights, max_copies).join(means, "src"))
    u = (F.col("h") + 0.5) / PLACES
    share = F.col("left") / F.col("source_size")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), share * F.when(F.col("mean") > 0, F.col("weight").cast("double") / F.col("mean")).otherwise(1.0)))
    ranked = base.join(small(targets, 10_000), "src").withColumn("odds", F.when(F.col("source_size") > 0, (u / (1 - u)) / (p / (1 - p))).otherwise(0.0))
    # Steps are equal spans of odds/(1+odds) over the source's own p, so that each holds about as many documents.
    spread = F.col("odds") * (F.greatest(share, F.lit(1e-12)) / F.greatest(1 - share, F.lit(1e-12)))
    ranked = ranked.withColumn("step", F.coalesce(F.floor(spread / (1 + spread) * STEPS).cast("int"), F.lit(0)))
    per_step = ranked.groupBy("src", "step").agg(F.sum("size").alias("words"), F.max("left").alias("left"))
    run = W.partitionBy("src").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    per_step = per_step.withColumn("upto", F.sum("words").over(run)).where((F.col("upto") > F.col("left")))
    edge = per_step.groupBy("src").agg(F.min_by(F.struct("step", (F.col("upto") - F.col("words")).alias("read")), "step").alias("e"))
    edge = cut(edge.select("src", F.col("e.step").alias("edge"), F.col("e.read").alias("read")))
    state = ranked.join(small(edge, 10_000), "src", "left")
    inner = W.partitionBy("src", "step").orderBy("odds", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    at_edge = state.where(F.col("step") == F.col("edge")).withColumn("before", F.col("read") + F.sum("size").over(inner) - F.col("size"))
    chosen = at_edge.withColumn("extra", (2 * F.col("before") + F.col("size") <= 2 * F.col("left")).cast("long")).drop("before")
    others = state.where(F.col("edge").isNull() | (F.col("step") != F.col("edge")))
    others = others.withColumn("extra", ((F.col("left") > 0) & (F.col("edge").isNull() | (F.col("step") < F.col("edge")))).cast("long"))
    return chosen.unionByName(others).select("doc_id", "src", "size", "text_key", "source_size", "target", F.when(F.col("size") == 0, F.greatest("copies", F.lit(1))).otherwise(F.least(F.lit(max_copies), F.col("copies") + F.col("extra"))).cast("long").alias("copies"))


def mixture_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: words taken instead of copies."""
    out = mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = """
WITH b AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))), 1, 13))::BIGINT AS h
  FROM documents
), v AS (SELECT *, floor(sqrt(size::DOUBLE) * 1000)::BIGINT AS weight, (h + 0.5) / 4503599627370496.0::DOUBLE AS u FROM b
), p AS (SELECT src, sum(size)::BIGINT AS source_size, sum(size::HUGEINT * weight)::DOUBLE / sum(size)::DOUBLE AS mean, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS w FROM v GROUP BY src
), q AS (SELECT *, (source_size * 3)::DOUBLE AS cap FROM p
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM q
), f AS (SELECT max(level) AS fill FROM l
), t AS (SELECT src, source_size, mean, least(cap, w * fill) AS target FROM l, f
), c AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS copies FROM t
), o AS (
  SELECT doc_id, size, v.src, source_size, target, copies, target - copies * source_size AS rest, u,
    greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, (target - copies * source_size) / source_size * (weight::DOUBLE / mean))) AS p FROM v JOIN c USING (src)
), r AS (
  SELECT *, sum(size) OVER (PARTITION BY src ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM o
)
SELECT doc_id, size, source_size, target,
  (size * least(3, copies + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
