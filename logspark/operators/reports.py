"""Reports over status rows and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_stats(status: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """The sum of every counter."""
    return status.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))


def count_by_state(rows: DataFrame, state: str, keys: list[str] = ()) -> DataFrame:
    """keys, state (lower case, spaces as _), count."""
    return rows.groupBy(*keys, F.regexp_replace(F.lower(state), " ", "_").alias("state")).agg(F.count("*").alias("count"))


def timing_stats(calls: DataFrame, name: str, value: str) -> DataFrame:
    return calls.groupBy(name).agg(F.min(value).alias("least"), F.avg(value).alias("average"), F.max(value).alias("greatest"))


def processing_report(lines: DataFrame, keys: list[str], sampled: Column, redacted: Column, failed: Column, skipped: Column, size: str = "raw_len") -> DataFrame:
    """Lines and bytes read, copied, dropped by sampling, redacted, failed and skipped of each log."""
    copied = sampled & ~failed & ~skipped
    n = lambda c, name: F.count_if(c).alias(f"lines_{name}")
    b = lambda c, name: F.coalesce(F.sum(F.when(c, F.col(size))), F.lit(0)).cast("long").alias(f"bytes_{name}")
    return lines.groupBy(*keys).agg(F.count("*").alias("lines_read"), F.sum(size).cast("long").alias("bytes_read"), n(copied, "copied"), b(copied, "copied"), n(~sampled, "dropped"), b(~sampled, "dropped"), n(redacted & copied, "redacted"), n(failed, "failed"), b(failed, "failed"), n(skipped, "skipped"), b(skipped, "skipped"))


def rule_report(lines: DataFrame, keys: list[str], matches: str = "rule_matches") -> DataFrame:
    """keys, rule, matches, lines of every rule (from 0)."""
    df = lines.select(*keys, F.posexplode(matches).alias("rule", "n"))
    return df.groupBy(*keys, "rule").agg(F.sum("n").cast("long").alias("matches"), F.count_if(F.col("n") > 0).alias("lines"))


def throughput(stats: DataFrame, ts: str, every: str = "5 minutes", keys: list[str] = ()) -> DataFrame:
    """window_start, copied_per_second, produced_per_second, skipping: differences of the last counters of each interval to those of the one before.

    stats: cumulative copied, skipped, pending. skipping: skipped grew.
    """
    s = stats.withColumn("_ts", F.col(ts).cast("timestamp"))
    last = s.groupBy(*keys, F.window("_ts", every).alias("w")).agg(F.max_by(F.struct("copied", "skipped", "pending"), "_ts").alias("s"))
    df = last.select(*keys, F.col("w.start").alias("window_start"), F.unix_seconds("w.start").alias("_at"), "s.*").withColumn("produced", F.col("copied") + F.col("skipped") + F.col("pending"))
    w = Window.partitionBy(*keys).orderBy("_at") if keys else Window.partitionBy(F.lit(0)).orderBy("_at")
    before = lambda c: F.lag(c).over(w)
    seconds = F.col("_at") - before("_at")
    return df.select(*keys, "window_start", ((F.col("copied") - before("copied")) / seconds).alias("copied_per_second"), ((F.col("produced") - before("produced")) / seconds).alias("produced_per_second"), (F.col("skipped") > before("skipped")).alias("skipping")).where("copied_per_second is not null")


def latest_state(rows: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """The row of the greatest time (over 0) of each key; of equal times the first by the columns' order."""
    rows = rows.where(F.col(time) > 0)
    best = rows.groupBy(key).agg(F.max(time).alias("_t")).withColumnRenamed(key, "_k")
    tied = rows.join(best, (F.col(key) == F.col("_k")) & (F.col(time) == F.col("_t")))
    out = tied.groupBy(key, time).agg(F.min(F.struct(*columns)).alias("_s"))
    return out.select(key, time, *(F.col(f"_s.{c}").alias(c) for c in columns))


def session_expiry(lines: DataFrame, key: str, ts: str, gap: str = "10 minutes") -> DataFrame:
    """key, opened, last_seen, lines of each period in which a log was seen at least every `gap`."""
    s = lines.withColumn("_ts", F.col(ts).cast("timestamp"))
    return s.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.min("_ts").alias("opened"), F.max("_ts").alias("last_seen"), F.count("*").alias("lines")).drop("w")


def mark_stale(lines: DataFrame, threshold: str, log: str = "log_path", scan: str = "scan") -> DataFrame:
    """Adds skipped: whether the log's scan before the one that saw a line was longer ago than `threshold` (the first scan of a log skips nothing). Windows are over scans, of which a log has far fewer than lines."""
    w = Window.partitionBy(log).orderBy(scan)
    before = F.lag(scan).over(w)
    scans = lines.select(log, scan).distinct().withColumn("skipped", F.coalesce(F.col(scan) - before > F.expr(f"interval {threshold}"), F.lit(False)))
    names = {log: "_log", scan: "_scan"}
    scans = scans.withColumnsRenamed(names)
    return lines.join(scans, F.col(log).eqNullSafe(F.col("_log")) & F.col(scan).eqNullSafe(F.col("_scan")), "left").drop("_log", "_scan")
