"""Labels for samples as they arrive: each micro-batch adds what the store lacks. An extra beside the batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomline.config import DEFAULT, Settings
from loomline.operators.labels import heuristic_labels, keyed
from loomline.sources.jsonl import SAMPLE_SCHEMA
from loomline.sources.label_store import LabelStore


def label_stream(spark: SparkSession, samples: str, store: str, checkpoint: str, s: Settings = DEFAULT) -> StreamingQuery:
    """Start a query over JSON Lines samples; a batch that runs twice leaves the same store."""

    def each(batch: DataFrame, _: int) -> None:
        LabelStore(batch.sparkSession, store).add(heuristic_labels(keyed(batch.fillna("", ["source_path", "thread_id"]), s), s))

    stream = spark.readStream.schema(SAMPLE_SCHEMA).option("recursiveFileLookup", True).json(samples)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
