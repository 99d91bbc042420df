"""Reports on streams: what each batch did, from its observations, and sessions as their logs fall silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Names of the counts, in the order of a report's columns (see operators.reports.processing_report).
COUNTS = ("lines_read", "bytes_read", "lines_copied", "bytes_copied", "lines_dropped", "bytes_dropped", "lines_redacted", "lines_failed", "bytes_failed", "lines_skipped", "bytes_skipped")


def observed(lines: DataFrame, name: str, sampled: Column, redacted: Column, failed: Column, skipped: Column, size: str = "raw_len") -> DataFrame:
    """The same lines; as they pass, what processing_report counts is counted for each batch, and rows needn't be read again for it.

    Spark keeps one set of counts for a batch, not one for each log. A batch that is run again counts again, under its number.
    """
    copied = sampled & ~failed & ~skipped
    n = lambda c: F.count_if(c)
    b = lambda c: F.coalesce(F.sum(F.when(c, F.col(size))), F.lit(0)).cast("long")
    made = [F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)).cast("long"), n(copied), b(copied), n(~sampled), b(~sampled), n(redacted & copied), n(failed), b(failed), n(skipped), b(skipped)]
    return lines.observe(name, *(c.alias(k) for c, k in zip(made, COUNTS)))


class BatchReports(StreamingQueryListener):
    """Collects the counts of each batch of the queries that observe under `name`: a few numbers a batch. Add it by spark.streams.addListener before the query starts."""

    def __init__(self, name: str):
        self.name = name
        self.rows: dict[tuple[str, int], tuple[int, ...]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.name)
        # Spark also reports on batches without input
        if row is not None and row["lines_read"]:
            self.rows[str(p.id), p.batchId] = tuple(row[c] for c in COUNTS)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """query, batch_id and the counts. Events come a little after their batches: wait for spark's listeners where that matters (see settled)."""
        rows = [(q, b, *counts) for (q, b), counts in sorted(self.rows.items())]
        return spark.createDataFrame(rows, ", ".join(["query string", "batch_id bigint", *(f"{c} bigint" for c in COUNTS)]))


def settled(spark: SparkSession, seconds: int = 30) -> None:
    """Waits until listeners have had all events so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(seconds * 1000)


def stream_sessions(lines: DataFrame, key: str, ts: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """session_expiry on a stream: key, opened, last_seen, lines of each period, when it is over, that is when time has passed its end by `late`.

    A session is over a `gap` after its last line. Lines that are later than `late` no longer count. Append mode; the state is a row for each open session.
    """
    s = lines.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = s.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.min("_ts").alias("opened"), F.max("_ts").alias("last_seen"), F.count("*").alias("lines"))
    return out.select(key, "opened", "last_seen", "lines")
