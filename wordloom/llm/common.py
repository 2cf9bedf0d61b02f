"""Helpers that the operators share: materialised steps, checked broadcasts, hot groups in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.plans import cut, shared_dir, stored, table  # noqa: F401  (used from here by the operators)

#: Code points that the contracts count as white space: space, tab, line feed, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes up to which a table with a size column is broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, max_rows: int, size: Column | None = None) -> DataFrame:
    """df marked for broadcast if a count shows at most max_rows rows (and sizes of at most BROADCAST_BYTES), else df as it is (a shuffle join)."""
    rows, held = df.select((size if size is not None else F.lit(0)).cast("long").alias("size")).limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= BROADCAST_BYTES else df


def dealt_out(pieces: DataFrame, limit: int) -> DataFrame:
    """pieces (cell, n, data, ...) with a column `block`; what shares cell and block fits a task, and all that shares a cell meets in some block.

    A cell of more than `limit` (by the sum of n) is cut into chunks by a hash of the data, and each pair of
    chunks is a block; other cells are block 0. Chunks hold about limit / 2.
    """
    hot = pieces.groupBy("cell").agg(F.sum("n").alias("all")).where(F.col("all") > limit).select("cell", F.ceil(F.col("all") * 2 / limit).cast("long").alias("chunks"))
    hot = cut(hot)
    if hot.isEmpty():
        return pieces.withColumn("block", F.lit(0).cast("long"))
    dealt = pieces.join(F.broadcast(hot), "cell", "left")  # at most a row for each `limit` of the input
    own = F.pmod(F.xxhash64("data"), F.col("chunks"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: j != own), lambda j: F.least(own, j) * F.col("chunks") + F.greatest(own, j) + 1)
    return dealt.withColumn("block", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))).drop("chunks")


def ascii_lower(text: Column) -> Column:
    """Only A-Z lower-cased. The plain lower() serves texts that are ASCII throughout."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
