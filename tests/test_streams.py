"""Streams over files in several steps give what the batch operators give."""

import os
import time

import pytest
from pyspark.sql import functions as F

from logspark.model import Grouper
from logspark.operators import lines as L
from logspark.operators import parse
from logspark.plans.stream_queries import PROVIDER, run_to_end
from logspark.sources import delivery, files, sinks
from logspark.operators.reports import mark_stale, processing_report, session_expiry
from logspark.streaming import reports, stateful


def _stream(spark, df, path, order, parts=3):
    """The table in files by order, one a trigger."""
    n = df.count()
    for k in range(parts):
        low, high = n * k // parts, n * (k + 1) // parts
        df.where((F.col(order) >= low) & (F.col(order) < high)).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_groups_are_held_over_batches(spark, tmp_path):
    df = spark.range(30).select(F.lit("log").alias("log_path"), F.col("id").alias("line_seq"), F.when(F.col("id") % 7 == 0, "start").otherwise("  more").alias("raw"))
    g = [Grouper("continueThrough", "^start", "^ ")]
    out = run_to_end(stateful.stream_groups(_stream(spark, df, tmp_path / "in", "line_seq"), g, wait_ms=None), "groups")
    batch = L.group_lines_by(df, g).orderBy("line_seq").collect()
    # the last group is still open
    assert out.orderBy("line_seq").collect() == batch[:-1]


def test_frames_are_held_over_batches(spark, tmp_path):
    df = spark.range(9).select(F.lit("c").alias("conn_id"), F.col("id").alias("chunk_seq"), F.concat(F.lit("12 hel"), F.lpad(F.col("id").cast("string"), 2, "0"), F.lit("\n")).cast("binary").alias("payload"))
    out = run_to_end(stateful.stream_frames(_stream(spark, df, tmp_path / "in", "chunk_seq"), wait_ms=None), "frames")
    want = parse.split_syslog_frames(df).where("complete")
    key = lambda r: r.frame_seq
    assert sorted(out.collect(), key=key) == sorted(want.collect(), key=key)


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [(0, "2024-01-05 00:00:00", 1.0), (1, "2024-01-09 00:00:00", 2.0), (2, "2024-01-01 00:00:00", 4.0), (3, "2024-01-20 00:00:00", 8.0)]
    df = spark.createDataFrame(rows, "id long, t string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz")).coalesce(1)
    report = stateful.interval_report(_stream(spark, df, tmp_path / "in", "id", 4), "ts", [], "1 day", "1 day")
    got = run_to_end(report, "late")
    # the third row is later than a day, the last one's interval isn't over
    assert sorted(r.total for r in got.collect()) == [1.0, 2.0]


def _until(df, path, enough, seconds=90):
    """Runs a stream on processing time until its output satisfies `enough`, and returns that."""
    spark = df.sparkSession
    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, stateful.ROCKSDB)
    q = df.writeStream.trigger(processingTime="500 milliseconds").option("checkpointLocation", str(path / "checkpoint")).format("parquet").option("path", str(path / "out")).start()
    try:
        end = time.time() + seconds
        while time.time() < end and q.exception() is None:
            if os.path.isdir(path / "out" / "_spark_metadata"):
                got = spark.read.schema(df.schema).parquet(str(path / "out")).collect()
                if enough(got):
                    return got
            time.sleep(1)
        raise AssertionError(q.exception() or "not in time")
    finally:
        q.stop()
        spark.conf.set(PROVIDER, provider)


def test_held_groups_are_released_by_a_timer(spark, tmp_path):
    df = spark.range(10).select(F.lit("log").alias("log_path"), F.col("id").alias("line_seq"), F.when(F.col("id") % 7 == 0, "start").otherwise("  more").alias("raw"))
    g = [Grouper("continueThrough", "^start", "^ ")]
    got = _until(stateful.stream_groups(_stream(spark, df, tmp_path / "in", "line_seq"), g, wait_ms=3000), tmp_path, lambda rows: sum(r.n_lines for r in rows) == 10)
    # what waits for three seconds is released: all lines come out, each once, in as many groups as the waits made
    assert sorted(r.line_seq for r in got)[0] == 0 and all(r.message.count("\n") == r.n_lines - 1 for r in got)
    assert {7} <= {r.line_seq for r in got}


def test_held_pieces_are_released_by_a_timer(spark, tmp_path):
    rows = [("a", k, f"2024-01-01T00:00:0{k}Z stdout {'F' if k == 2 else 'P'} p{k}") for k in range(5)]
    parsed = L.parse_cri(_stream(spark, spark.createDataFrame(rows, "log_path string, line_seq long, raw string"), tmp_path / "in", "line_seq", 1))
    got = _until(stateful.stream_pieces(parsed, wait_ms=1500), tmp_path, lambda rows: len(rows) == 2)
    assert sorted((r.line_seq, r.message, r.partial) for r in got) == [(0, "p0p1p2", False), (3, "p3p4", True)]


def test_unfinished_frames_are_released_by_a_timer(spark, tmp_path):
    df = spark.createDataFrame([("c", 0, bytearray(b"3 abc5 he"))], "conn_id string, chunk_seq long, payload binary")
    got = _until(stateful.stream_frames(_stream(spark, df, tmp_path / "in", "chunk_seq", 1), wait_ms=1500), tmp_path, lambda rows: len(rows) == 2)
    assert sorted((r.frame_seq, bytes(r.frame), r.complete) for r in got) == [(0, b"abc", True), (1, b"5 he", False)]


def test_series_are_counted(spark, tmp_path):
    rows = [(k, "app", str(k % 5), "m", float(k), "2024-01-01 00:00:00") for k in range(20)]
    df = spark.createDataFrame(rows, "id long, monitor string, instance string, metric string, value double, t string").withColumns({"extra": F.lit(None).cast("map<string,string>"), "ts": F.col("t").cast("timestamp")})
    out = run_to_end(stateful.series_count(_stream(spark, df, tmp_path / "in", "id"), "ts", "1 day"), "series", "complete")
    assert [r.series for r in out.collect()] == [5]


def test_the_last_batch_is_read(spark, tmp_path):
    """Complete results of a stream of three batches are those of the last."""
    df = spark.range(9).select("id", F.lit(1.0).alias("value"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    out = run_to_end(stateful.interval_report(_stream(spark, df, tmp_path / "in", "id"), "ts", [], "1 day"), "complete", "complete")
    assert [r.rows for r in out.collect()] == [9]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    """A batch whose commit is lost is run again, under the same number."""
    df = spark.range(9).select("id")
    for k in range(2):
        sinks.write_batches(_stream(spark, df, tmp_path / "in", "id", 1 if k == 0 else 0) if k == 0 else spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        if k == 0:
            for f in os.listdir(tmp_path / "c" / "commits"):
                os.remove(tmp_path / "c" / "commits" / f)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(9))


def test_lines_of_a_stream_are_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(b"".join(b"line %d\r\n" % i for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        out = run_to_end(files.stream_log_lines(spark, str(tmp_path / "in")), "lines")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.raw for r in out.orderBy("line_seq").collect()] == [f"line {i}\r" for i in range(3000)]


def test_batches_report_what_they_did(spark, tmp_path):
    """The observed counts of each batch are those of the batch report over its rows."""
    df = spark.range(40).select("id", (F.col("id") * 3).alias("raw_len"))
    flags = lambda: (F.col("id") % 4 != 0, F.col("id") % 5 == 0, F.col("id") % 7 == 0, F.col("id") % 9 == 0)
    listener = reports.BatchReports("mine")
    spark.streams.addListener(listener)
    try:
        run_to_end(reports.observed(_stream(spark, df, tmp_path / "in", "id", 4), "mine", *flags()), "observed")
        reports.settled(spark)
    finally:
        spark.streams.removeListener(listener)
    got = listener.table(spark).orderBy("batch_id").select(*reports.COUNTS).collect()
    files_ = df.withColumn("part", F.floor(F.col("id") / 10))
    want = processing_report(files_, ["part"], *flags()).select(*reports.COUNTS).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4


def test_sessions_end_as_their_logs_fall_silent(spark, tmp_path):
    rows = [(i, k, f"2024-01-01 {h:02d}:{m:02d}:00") for i, (k, h, m) in enumerate([("a", 0, 0), ("b", 0, 5), ("a", 0, 8), ("a", 0, 30), ("b", 0, 14), ("a", 2, 0), ("b", 5, 0), ("c", 9, 0)])]
    df = spark.createDataFrame(rows, "id long, key string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz")).coalesce(1)
    got = run_to_end(reports.stream_sessions(_stream(spark, df, tmp_path / "in", "id", 4), "key", "ts", "10 minutes", "1 hour"), "sessions")
    want = session_expiry(df, "key", "ts", "10 minutes").where("key <> 'c'")
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() == 5


def _deliver(spark, tmp_path, fails, **options):
    """Two batches through a receiver that fails as told: by batch, how often, and with what."""
    source = tmp_path / "in"
    stream = _stream(spark, spark.range(8).select("id"), source, "id", 2) if not source.exists() else spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))

    def send(batch, part):
        batch.write.parquet(part)
        key = 0 if batch.where("id = 0").count() else 1
        if fails.get(key):
            raise fails[key].pop()

    return delivery.deliver(stream, send, str(tmp_path / "out"), str(tmp_path / "c"), size="id", **options)


def _seen(spark, tmp_path):
    ledger = [(r.batch_id, r.attempt, r.state, r.rows, r.bytes) for r in delivery.read_ledger(spark, str(tmp_path / "out")).orderBy("batch_id", "attempt").collect()]
    return ledger, sorted(r.id for r in delivery.delivered(spark, str(tmp_path / "out"), "id long").collect())


def test_a_failed_delivery_is_repeated(spark, tmp_path):
    _deliver(spark, tmp_path, {0: [OSError("x")]}).awaitTermination()
    assert _seen(spark, tmp_path) == ([(0, 1, "retried", 4, 6), (0, 2, "done", 4, 6), (1, 1, "done", 4, 22)], list(range(8)))
    # a lost commit doesn't send it again
    for f in os.listdir(tmp_path / "c" / "commits"):
        os.remove(tmp_path / "c" / "commits" / f)
    _deliver(spark, tmp_path, {}).awaitTermination()
    assert len(_seen(spark, tmp_path)[0]) == 3 and _seen(spark, tmp_path)[1] == list(range(8))


def test_what_is_never_taken_is_dropped_and_counted(spark, tmp_path):
    _deliver(spark, tmp_path, {0: [OSError("x")] * 9, 1: [delivery.Drop("no")]}, attempts=2).awaitTermination()
    ledger, ids = _seen(spark, tmp_path)
    assert ledger == [(0, 1, "retried", 4, 6), (0, 2, "dropped", 4, 6), (1, 1, "dropped", 4, 22)] and ids == []
    report = {r.state: (r.batches, r.attempts, r.rows, r.bytes) for r in delivery.delivery_report(delivery.read_ledger(spark, str(tmp_path / "out"))).collect()}
    assert report == {"retried": (1, 1, 4, 6), "dropped": (2, 2, 8, 28)}


def test_a_query_that_may_not_drop_ends_and_goes_on(spark, tmp_path):
    with pytest.raises(Exception, match="gone"):
        _deliver(spark, tmp_path, {0: [OSError("gone")] * 2}, attempts=2, give_up="fail").awaitTermination()
    _deliver(spark, tmp_path, {}, attempts=2, give_up="fail").awaitTermination()
    assert _seen(spark, tmp_path) == ([(0, 1, "retried", 4, 6), (0, 2, "retried", 4, 6), (0, 3, "done", 4, 6), (1, 1, "done", 4, 22)], list(range(8)))


def test_state_is_a_table(spark, tmp_path):
    """What folds hold can be read from the checkpoint, by its columns."""
    df = spark.createDataFrame([("a", 0, "start"), ("a", 1, "  more"), ("b", 2, "single"), ("a", 3, "  end")], "log_path string, line_seq long, raw string")
    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, stateful.ROCKSDB)
    try:
        out = stateful.stream_groups(_stream(spark, df, tmp_path / "in", "line_seq", 4), [Grouper("continueThrough", "^start", "^ ")], wait_ms=None)
        out.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
        held = {r.key.log_path: (list(r.value.lines), r.value.seq, r.value.size) for r in stateful.state_of(spark, str(tmp_path / "c")).collect()}
    finally:
        spark.conf.set(PROVIDER, provider)
    assert held == {"a": (["start", "  more", "  end"], 0, 19), "b": ([], 2, 0)}


def test_series_are_forgotten_after_their_time_to_live(spark, tmp_path):
    """A series without samples for the time to live begins anew; another one, which goes on, doesn't."""
    columns = "id long, instance string, ts_ms long, value double"
    full = lambda rows: spark.createDataFrame(rows, columns).withColumns({"monitor": F.lit("app"), "metric": F.lit("m"), "extra": F.lit(None).cast("map<string,string>")})
    add = lambda rows: full(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add([(0, "old", 1000, 1.0), (1, "new", 1000, 1.0)])
    stream = spark.readStream.schema(full([]).schema).parquet(str(tmp_path / "in"))
    df = stateful.stream_rate(stream, ttl_ms=15_000)
    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, stateful.ROCKSDB)
    q = df.writeStream.trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).start()

    def rates(wanted):
        """The rates once that one is there: a stream on processing time has no end to wait for."""
        for _ in range(60):
            if os.path.isdir(tmp_path / "out" / "_spark_metadata"):
                got = {(x.split('"instance":"')[1][:3], t): r for x, t, r in map(tuple, spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect())}
                if wanted in got:
                    return got
            time.sleep(0.5)
        raise AssertionError(q.exception() or "not in time")

    try:
        for k in range(1, 6):
            add([(1 + k, "new", 1000 + 1000 * k, 1.0 + k)])
            rates(("new", 1000 + 1000 * k))
            time.sleep(5)
        add([(9, "old", 9000, 9.0), (10, "new", 9000, 9.0)])
        rates(("new", 9000))
        add([(11, "old", 10_000, 12.0)])
        got = rates(("old", 10_000))
    finally:
        q.stop()
        spark.conf.set(PROVIDER, provider)
    # the old series' sample at 9 s had nothing before it
    assert ("old", 9000) not in got and got["old", 10_000] == 3.0
    assert [got["new", 1000 + 1000 * k] for k in range(1, 6)] == [1.0] * 5 and got["new", 9000] == 1.0


def test_stale_logs_skip_to_their_ends(spark, tmp_path):
    times = [("a", "00:00"), ("a", "00:20"), ("b", "00:30"), ("a", "02:00"), ("a", "02:00"), ("a", "02:10"), ("b", "05:00"), ("c", "05:00"), ("b", "05:01"), ("d", "09:00")]
    df = spark.createDataFrame([(k, i, f"2024-01-01 {t}:00", 10 + i) for i, (k, t) in enumerate(times)], "log_path string, line_seq long, t string, raw_len long").withColumn("scan", F.col("t").cast("timestamp")).coalesce(1)
    want = {r.line_seq: r.skipped for r in mark_stale(df, "1 hour").collect()}
    assert {i for i, s in want.items() if s} == {3, 4, 6}
    out = run_to_end(stateful.skip_stale_logs(_stream(spark, df, tmp_path / "in", "line_seq", 5), "1 hour"), "stale").collect()
    assert {r.line_seq: r.skipped for r in out if r.line_seq is not None} == want
    # each log is told once when it has become stale
    notices = sorted((r.log_path, str(r.stale_since)[11:16]) for r in out if r.line_seq is None)
    assert {("b", "00:30"), ("a", "02:10"), ("b", "05:01"), ("c", "05:00")} <= set(notices)
