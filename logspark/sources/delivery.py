"""Delivery of batches with a ledger: every attempt is a row, what is given up is counted, readers see what was delivered."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "batch_id bigint, attempt bigint, state string, rows bigint, bytes bigint, error string, part string, at timestamp"


class Drop(Exception):
    """Raised by a sender whose receiver won't ever take the batch."""


def deliver(events: DataFrame, send: Callable[[DataFrame, str], None], path: str, checkpoint: str, size: str | None = None, attempts: int = 3, pause_seconds: float = 0.0, give_up: str = "drop") -> StreamingQuery:
    """A stream sent batch by batch. send(batch, part): writes a batch below the folder `part`, which is new at every attempt; any exception means that it failed.

    After a failure the batch is sent again, `attempts` times in all; then, or at once if send raises Drop, it is dropped and counted (give_up `drop`), or the query ends
    with the error, and the next run sends the batch again (`fail`). size: a column of bytes. path/ledger has a row for each attempt: done, retried or dropped. A batch that was done or dropped isn't
    sent again, even where the query's own commit of it was lost; what an attempt wrote that wasn't finished stays unseen (see delivered).
    """
    if give_up not in ("drop", "fail"):
        raise ValueError("give_up is drop or fail")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = read_ledger(spark, path).where(F.col("batch_id") == number).select("attempt", "state").collect()
        if any(r["state"] in ("done", "dropped") for r in known):
            return
        before = max((r["attempt"] for r in known), default=0)
        batch = batch.persist()
        try:
            n, b = batch.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)).cast("long") if size else F.lit(None).cast("long")).first()
            for k in range(1, attempts + 1):
                part, error, state = f"part-{number}-{before + k}-{uuid.uuid4().hex}", None, "done"
                try:
                    send(batch, f"{path}/{part}")
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"[:1000]
                    last = k == attempts
                    state = "dropped" if isinstance(e, Drop) or (last and give_up == "drop") else "retried"
                    note(spark, path, number, before + k, state, n, b, error, part)
                    if state == "dropped":
                        return
                    if last:
                        raise
                    time.sleep(pause_seconds)
                else:
                    note(spark, path, number, before + k, state, n, b, None, part)
                    return
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def note(spark: SparkSession, path: str, number: int, attempt: int, state: str, rows: int, size: int | None, error: str | None, part: str) -> None:
    """One row of the ledger, in a file of its own, which appears whole."""
    row = spark.createDataFrame([(number, attempt, state, rows, size, error, part)], LEDGER.rpartition(",")[0]).withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("ignoreMissingFiles", "true").parquet(f"{path}/ledger") if _exists(spark, f"{path}/ledger") else spark.createDataFrame([], LEDGER)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the done attempts wrote, as Parquet. The list of their folders has an entry for each batch."""
    done = [f"{path}/{r['part']}" for r in read_ledger(spark, path).where("state = 'done'").select("part").collect()]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def delivery_report(ledger: DataFrame) -> DataFrame:
    """state, batches, attempts, rows, bytes: what was delivered, what was dropped, and attempts that were repeated. Rows and bytes of repeated attempts are counted each time."""
    return ledger.groupBy("state").agg(F.count_distinct("batch_id").alias("batches"), F.count("*").alias("attempts"), F.sum("rows").cast("long").alias("rows"), F.sum("bytes").cast("long").alias("bytes"))
