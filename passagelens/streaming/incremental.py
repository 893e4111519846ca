"""Incremental corpora: a stream of new documents is chunked as it arrives, each micro-batch written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import long_sentences
from ..operators.chunking import fixed_chunks


def chunk_stream(docs: DataFrame, path: str, checkpoint: str, size: int = 10, overlap: int = 1) -> StreamingQuery:
    """docs: a streaming DataFrame (doc_id, text). A batch that is run again after a failure replaces its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = batch.select("doc_id", F.posexplode(fixed_chunks(long_sentences(F.col("text")), size, overlap)).alias("pos", "chunk"))
        out = chunks.select("doc_id", "pos", F.array_join("chunk", " ").alias("text"), F.size("chunk").alias("size"))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
