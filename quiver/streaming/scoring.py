"""Structured Streaming form of the evaluation loop.

The reference scores one unit at a time and appends a result row after each. Here new
rows arrive as a stream: each micro-batch is scored against the trained (materialized)
models, soft-voted and joined with truth inside ``foreachBatch``, and predictions are
written to a folder per batch id, which a replayed batch replaces. A running confusion table is a stateful streaming
aggregation, so report metrics can be recomputed from it at any time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiver.operators import score


def score_micro_batches(rows: DataFrame, models: DataFrame, truth: DataFrame, key: str, out_path: str,
                        checkpoint: str, model_cols: Sequence[str] = ("replica",), on: Sequence[str] = ("task",),
                        available_now: bool = True) -> StreamingQuery:
    """Stream ``rows`` (with ``on`` columns and the vector) through the ensemble; write
    ``(batch_id, key, y_pred, y_true)`` as parquet under ``out_path``, one folder per batch.
    The models are broadcast once; a replayed batch replaces its own folder."""
    truth = truth.select(key, F.col("label").alias("_label"))
    blocks = score.model_blocks(models, on, model_cols)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        pred = score.score_centroids(batch, models, key, model_cols=model_cols, on=on, blocks=blocks, vote_by=[], predict=True)
        out = pred.join(truth, key).select(key, "y_pred", F.col("_label").alias("y_true"))
        out.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def running_confusion(predictions: DataFrame, query_name: str, checkpoint: str) -> StreamingQuery:
    """Stateful streaming count by (y_true, y_pred) over a stream of predictions (complete mode)."""
    counts = predictions.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return (counts.writeStream.outputMode("complete").format("memory").queryName(query_name)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
