"""Where events and metrics go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logspark.operators.metrics import format_metric_lines


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by date of the event (null times: date null)."""
    events.withColumn("date", F.to_date("ts")).write.mode(mode).option("compression", "zstd").partitionBy("date").parquet(path)


def stream_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same from a stream, each row once: the sink lists the files that a committed batch wrote."""
    return events.withColumn("date", F.to_date("ts")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("date").trigger(availableNow=True).start()


def write_batches(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """From a stream, batch by batch, under the batch's number: a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_metric_lines(metrics: DataFrame, path: str) -> None:
    format_metric_lines(metrics).write.text(path)
