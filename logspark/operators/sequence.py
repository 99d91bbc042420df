"""Sequence numbers and times of events, and packing into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.model import KNOWN_BACKLOG_BYTES, NEW_BACKLOG_BYTES, REQUEST_BYTES, SEQUENCE_LIMIT
from logspark.operators.chains import SizeCuts, chained
from logspark.operators.ordered import in_blocks, previous, running

KEY, ORDER = ["log_path"], ["line_seq"]


def sequence(lines: DataFrame, limit: int = SEQUENCE_LIMIT, block: Column | None = None) -> DataFrame:
    """Adds seq_id and seq_num: the bytes before the line in its log, with a new id and 0 after every `limit` of them."""
    df, by = in_blocks(lines, block)
    df = running(df, KEY, ORDER, F.col("raw_len").cast("long"), "_before", before=True, block=by).withColumn("_before", F.coalesce("_before", F.lit(0)))
    epoch = F.floor(F.col("_before") / limit)
    return df.withColumns({"seq_id": F.sha2(F.concat_ws("#", "log_path", epoch.cast("string")), 256), "seq_num": F.pmod("_before", F.lit(limit))}).drop("_before", "_block")


def encode_sequence(events: DataFrame, session: list[str], order: list[str], block: Column | None = None) -> DataFrame:
    """Adds si (the id, where it changed), sn (the number, then) and sd (else the difference to the number before). block: see ordered."""
    df, by = in_blocks(events, block)
    df = previous(df, session, order, ["seq_id", "seq_num"], "_before", by)
    last = F.col("_before.seq_num")
    changed = ~F.col("seq_id").eqNullSafe(F.col("_before.seq_id")) | last.isNull()
    df = df.withColumn("_changed", changed & F.col("seq_id").isNotNull())
    new = F.col("_changed")
    return df.withColumns({"si": F.when(new, F.col("seq_id")), "sn": F.when(new, F.col("seq_num")), "sd": F.when(~new, F.col("seq_num") - last)}).drop("_changed", "_before", "_block")


def monotonic_time(events: DataFrame, session: list[str], order: list[str], column: str = "ts_nanos", block: Column | None = None) -> DataFrame:
    """Raises times so that each is at least one more than the one before: max(t - n) so far, plus n. block: see ordered."""
    df, by = in_blocks(events, block)
    df = running(df, session, order, F.lit(1).cast("long"), "_n", block=by)
    df = running(df, session, order, F.col(column) - F.col("_n"), "_most", how="max", block=by)
    return df.withColumn(column, F.col("_most") + F.col("_n")).drop("_n", "_most", "_block")


def fresh_versions(rows: DataFrame, keys: list[str], order: list[str], version: str, block: Column | None = None) -> DataFrame:
    """Rows whose version is null or greater than all since the last null. block: see ordered."""
    df, by = in_blocks(rows, block)
    df = running(df, keys, order, F.when(F.col(version).isNull(), 1).otherwise(0).cast("long"), "_segment", block=by)
    df = running(df, [*keys, "_segment"], order, F.col(version), "_seen", how="max", before=True, block=by)
    return df.where(F.col(version).isNull() | F.col("_seen").isNull() | (F.col(version) > F.col("_seen"))).drop("_segment", "_seen", "_block")


def pack_batches(events: DataFrame, session: str, position: str, size: Column, max_bytes: int = REQUEST_BYTES) -> DataFrame:
    """session, position, size, batch_id: events in order go into one batch until the next would overflow it. A larger event is a batch alone, a null size is 0. A session may be many tasks' (see chains)."""
    df = events.select(F.col(session).cast("string").alias("session"), F.col(position).cast("long").alias("position"), size.cast("long").alias("size"))
    out = chained(df, ["session"], ["position", "size"], SizeCuts("size", max_bytes))
    return out.select("session", "position", "size", (F.col("nth") - 1).alias("batch_id"))


def backlog(lines: DataFrame, known: DataFrame | None = None, new_bytes: int = NEW_BACKLOG_BYTES, known_bytes: int = KNOWN_BACKLOG_BYTES) -> DataFrame:
    """log_path, bytes, lines and skipped of each log: whether what is unread is over the limit, that of known logs (a table of log_path) or of new ones."""
    totals = lines.groupBy("log_path").agg(F.sum("raw_len").alias("bytes"), F.count("*").alias("lines"))
    if known is None:
        return totals.withColumn("skipped", F.col("bytes") > new_bytes)
    totals = totals.join(known.select("log_path", F.lit(True).alias("_known")).distinct(), "log_path", "left")
    return totals.withColumn("skipped", F.col("bytes") > F.when(F.col("_known"), known_bytes).otherwise(new_bytes)).drop("_known")


def trim_backlog(lines: DataFrame, known: DataFrame | None = None, new_bytes: int = NEW_BACKLOG_BYTES, known_bytes: int = KNOWN_BACKLOG_BYTES) -> DataFrame:
    """Lines of logs whose unread bytes are within their limit (see backlog); all lines of others are skipped."""
    gone = backlog(lines, known, new_bytes, known_bytes).where("skipped").select("log_path")
    return lines.join(gone, "log_path", "left_anti")


def cap_outputs(lines: DataFrame, output: str, order: list[str], max_files: int, base: str) -> DataFrame:
    """Keeps the first max_files distinct outputs by first arrival; rows of later ones go to `base`."""
    first = lines.groupBy(output).agg(F.min(F.struct(*order)).alias("_first"))
    # a top-k over the outputs: each task keeps max_files of them
    kept = first.orderBy("_first").limit(max_files).select(F.col(output).alias("_kept"))
    df = lines.join(kept, F.col(output) == F.col("_kept"), "left")
    return df.withColumn(output, F.coalesce("_kept", F.lit(base))).drop("_kept")
