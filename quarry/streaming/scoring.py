"""Incremental scoring of newly arriving parts of a table.

The reference scores a large table in manually numbered parts and appends
each part's predictions to a target table, so a rerun duplicates rows.
Here new parquet files dropped into a folder are the parts: a Structured
Streaming file source picks them up, ``foreachBatch`` scores each micro-
batch with the saved ``PipelineModel`` and writes it under
``batch_id=<n>`` with dynamic partition overwrite. A micro-batch replayed
after a failure rewrites the same partition, so the output never holds a
part twice; the stream's checkpoint (on shared storage) records which
files were processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.ml import load_model, score


def score_new_parts(spark: SparkSession, model_path: str, source_dir: str,
                    schema: T.StructType, out_dir: str, checkpoint: str,
                    keep: list[str] | None = None, available_now: bool = True,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there
    (in as many micro-batches as ``max_files_per_trigger`` asks) and stops."""
    model = load_model(model_path)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = score(model, batch)
        if keep:
            scored = scored.select(*keep, "prediction_label", "prediction_score")
        scored.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
