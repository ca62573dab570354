"""Status of training jobs, kept up to date while outcomes of their sources come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragtables.operators.training import JOB_CHANGES, job_status
from ragtables.sources.snapshots import Store


def roll_up_stream(outcomes: DataFrame, store: Store, checkpoint: str, now: Column) -> StreamingQuery:
    """Merge a stream of (job_id, source_no, ok) into the table ``jobs`` of a store, read with ``JOB_CHANGES``.

    State is two flags per job that has outcomes; a micro-batch gives out the jobs whose flags it has touched, as marks of
    their status and end, published once under the id of the query and the number of the batch. So the table agrees with
    ``job_status_rollup`` over all outcomes so far after every batch, a repeated batch changes nothing, and the job rows are
    written anew only when the marks have become heavy. Outcomes of jobs that the table lacks change nothing there. An
    outcome that comes twice has no effect the second time.
    """
    flags = outcomes.groupBy("job_id").agg(F.bool_or("ok").alias("any_ok"), F.bool_or(~F.col("ok")).alias("any_bad"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        writer = store.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        marks = batch.select("job_id", job_status().alias("status"), now.alias("completed_at"))
        store.publish(marks={"jobs": ("job_id", marks)}, writer=writer, batch=batch_id)
        store.compact("jobs", JOB_CHANGES, share=1.0)

    return (flags.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
