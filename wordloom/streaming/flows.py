"""The diagnosis over streams: documents don't depend on one another, so each micro-batch is a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators import documents


def diagnose_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Parquet files that arrive in `source` are diagnosed and appended to `sink`; the checkpoint makes reruns resume."""
    docs = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        # A batch that is run again overwrites its own folder only.
        documents.document_signal(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
