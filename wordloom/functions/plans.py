"""Plan helpers: steps kept in the shared folder, and small inputs spread over all cores."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input up to which a table of fewer parts than cores is dealt out anew.
SPREAD_BYTES = 1 << 30


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one, on a local master only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="wordloom-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; for tables of a few columns."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back; for large tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wordloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Marks a column `row` as made by with_rows; a user's own column of that name has no such mark.
NUMBERED = "wordloom.row"


def has_rows(docs: DataFrame) -> bool:
    return "row" in docs.columns and bool(docs.schema["row"].metadata.get(NUMBERED))


def with_rows(docs: DataFrame) -> DataFrame:
    """row (a number for each row of docs, whatever its doc_id), doc_id and text; docs that have been numbered stay as they are. The number is made before any explode: beside one it would count the exploded rows."""
    return docs if has_rows(docs) else docs.select(F.monotonically_increasing_id().alias("row", metadata={NUMBERED: True}), "doc_id", "text")


#: Rows up to which a table is broadcast.
BROADCAST_ROWS = 200_000


#: Bytes up to which a table whose sizes are known is broadcast.
BROADCAST_BYTES = 64 << 20


def checked(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """df marked for broadcast if a count shows no more rows than that (and sizes of at most BROADCAST_BYTES), else df as it is (a shuffle join); without sizes rows should be of a few short values."""
    n, held = df.select((F.lit(0) if size is None else size).cast("long").alias("size")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """df over as many parts as there are cores, if it is small and a scan would leave cores idle; a file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table of that name below sf_dir."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Parts for each core that slow work on few bytes is dealt to; bytes of a part where a size is known, and parts at most for that; a size from which it counts as unknown.
DEALT, PART_BYTES, MOST_PARTS, UNKNOWN = 4, 4 << 20, 4096, 1 << 50


def dealt(df: DataFrame, *keys: str, by_size: bool = False) -> DataFrame:
    """df over a fixed number of parts, for work in Python: parts by bytes alone would leave a table of small rows to one task. by_size: more of them for a large table, whose rows grow in what follows."""
    spark = df.sparkSession
    parts = max(DEALT * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if by_size:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = max(parts, min(MOST_PARTS, ceil(size / PART_BYTES))) if size < UNKNOWN else parts
    return df.repartition(parts, *keys)
