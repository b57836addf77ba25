"""Incremental embedding: new files are encoded once, also across restarts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.store import materialize_embeddings


def incremental_cache(
    stream: DataFrame, payload: str, store: str, checkpoint: str, contract: str, dim: int,
    modality: str = "text", encoder: Callable | None = None,
) -> StreamingQuery:
    """Append the vectors of unseen payloads of every new micro-batch to the store.

    The stream's checkpoint remembers consumed files; the anti-join against the store
    makes a repeated batch (after a failure between write and commit) encode nothing.
    """

    def run(batch: DataFrame, _batch_id: int) -> None:
        cached = batch.select(payload).persist()
        try:
            materialize_embeddings(cached, payload, store, contract, dim, modality, encoder)
        finally:
            cached.unpersist()

    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_new_files(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
