"""Grounding as a stream: documents that arrive in a folder become mentions, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from caseweave.operators.grounding import ground


def stream_mentions(spark: SparkSession, folder: str, schema: str, phrases: DataFrame, to: str, checkpoint: str, keep: tuple[str, ...] = ("doc_id",)) -> StreamingQuery:
    """Starts the query; a file is grounded once even if the query is restarted."""
    docs = spark.readStream.schema(schema).parquet(folder)
    found = ground(docs, phrases, keep=keep)
    return found.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
