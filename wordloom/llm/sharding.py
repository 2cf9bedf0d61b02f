"""Sharding by vector bin packing over bytes, tokens and rows.

Groups of equal texts are placed whole, each on the shard where the dot product of its vector
(bytes, tokens, rows, as shares of a shard) with the shard's residual capacity is highest. So that
the packing stays bounded at any size, groups above 1/64 of a shard in any dimension are packed one
by one (at most `3 * 64 * shards` groups can be that large) and all others travel whole in a fixed
number of bundles, by a hash of the text. Only a group that alone exceeds a whole shard is split, by
a hash of its rows, into pieces of 1/64 of a shard: no shard could hold it beside the law of near-equal bytes.

Defined results: a null text counts no bytes and is grouped with the empty text; repeated rows
(of one id and text too) are rows of their own with slots of their own, and are split as others are; an empty table
gives an empty result; other columns are not read. Shards are numbered from 0, slots from 0 without gaps within a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

BUNDLES = 8192
#: A group above one part in so many of a shard, in any dimension, is packed by itself.
ALONE = 64
#: Rows numbered by one task.
SLOT_ROWS = 4096
DIMENSIONS = ("bytes", "tokens", "rows")


def pack(units: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit (rows of vectors), largest unit first; ties go to the smallest shard."""
    total = units.sum(axis=0)
    v = units / np.where(total > 0, total / shards, 1)
    residual = np.ones((shards, v.shape[1]))
    out = np.zeros(len(v), dtype=np.int64)
    for i in np.lexsort((np.arange(len(v)), -v.max(axis=1))):
        out[i] = int(np.argmax(np.round(residual @ v[i], 12)))
        residual[out[i]] -= v[i]
    return out


def numbered(base: DataFrame, parts: int) -> DataFrame:
    """base with row: a number made of a row's id and text and its place among the rows that repeat both.

    Rows that repeat are alike, so which of them gets which place doesn't show and reruns agree. They are
    counted in parts, so that no task gets all of them.
    """
    same = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "g")
    base = base.withColumn("same", same).withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(parts)))
    nth = F.row_number().over(W.partitionBy("same", "part").orderBy("mark")).cast("long")  # the hash below goes by the type too
    if parts == 1:
        placed = base.withColumn("nth", nth)
    else:
        held = base.groupBy("same", "part").agg(F.count("*").alias("k"))
        held = held.withColumn("before", F.sum("k").over(W.partitionBy("same").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("k")).drop("k")
        placed = base.withColumn("nth", nth).join(held.where("before > 0"), ["same", "part"], "left").withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0))).drop("before")
    return cut(placed.withColumn("row", F.xxhash64("same", "nth")).drop("same", "part", "nth", "mark"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Kept before it is used, so that the rows' numbers stay what they are.
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("mark"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
        )
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = base.agg(*sums).first()
    if not total["rows"]:
        return spark.createDataFrame([], "doc_id long, size long, tokens long, text_crc32 long, shard int, slot long")
    base = numbered(base, max(1, total["rows"] // SLOT_ROWS))
    share = F.greatest(*[F.col(d) * shards / max(1, total[d]) for d in DIMENSIONS])
    groups = base.groupBy("g", "text_crc32").agg(*sums).withColumn("share", share)
    large = cut(groups.where(F.col("share") * ALONE > 1).select("g", "text_crc32", F.when(F.col("share") > 1, F.ceil(F.col("share") * ALONE)).otherwise(1).cast("int").alias("pieces")))
    unit = F.when(F.col("pieces").isNull(), F.struct(F.lit(0).cast("long").alias("a"), F.pmod("g", F.lit(BUNDLES)).alias("b"))).otherwise(
        F.struct(F.col("g").alias("a"), (F.pmod(F.xxhash64("row", "g"), F.col("pieces")) + BUNDLES).alias("b"))
    )
    placed = base.join(F.broadcast(large), ["g", "text_crc32"], "left").select("doc_id", "row", "size", "tokens", "text_crc32", unit.alias("unit"))
    units = placed.groupBy("unit").agg(*sums).select("unit.a", "unit.b", *DIMENSIONS).orderBy("a", "b").collect()  # bounded: bundles and pieces
    where = pack(np.array([[u[d] for d in DIMENSIONS] for u in units], dtype=float), shards)
    homes = spark.createDataFrame([(u["a"], u["b"], int(s)) for u, s in zip(units, where)], "a long, b long, shard int")
    rows = placed.join(F.broadcast(homes), (F.col("unit.a") == homes.a) & (F.col("unit.b") == homes.b)).select("doc_id", "row", "size", "tokens", "text_crc32", "shard")
    subs = max(1, -(-total["rows"] // (shards * SLOT_ROWS)))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("row", "text_crc32"), F.lit(subs)))
    ahead = rows.groupBy("shard", "sub").count()
    ahead = ahead.withColumn("ahead", F.sum("count").over(W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("count")).drop("count")
    nth = F.row_number().over(W.partitionBy("shard", "sub").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("nth", nth).join(ahead, ["shard", "sub"]).select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("ahead") + F.col("nth") - 1).cast("long").alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The contract's columns, under the law of near-equal bytes."""
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
