"""Structured Streaming ingest: new documents become chunks of an index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.config import DEFAULTS, Settings
from ragloom.operators import chunking
from ragloom.sources import index as store
from ragloom.sources.staging import scope


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, strategy: str = "heuristic", key: str = "doc_id", text: str = "text", settings: Settings = DEFAULTS, embedder=None, trigger: dict | None = None, **knobs):
    """A started query that chunks the new Parquet files of `source` and adds them to the index at `target`.

    Each micro-batch is a batch of the index with postings, counts of terms, lengths and vectors of its own, which a
    search adds up: after any number of batches it answers as an index made anew of all documents. A batch that runs
    again replaces itself. Batch numbers start at 1, so an index that was written before is extended. Statistics are
    those of the last sources.index.write or write_stats. trigger: by default what is there now, then the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        with scope(batch.sparkSession):
            store.add(chunking.chunk(strategy, batch, key, text, **knobs), target, strategy, number + 1, settings, embedder)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
