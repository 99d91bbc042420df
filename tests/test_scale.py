"""What shows only in larger tables: times close together, many keys, many ranges."""

import random
from types import SimpleNamespace

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from logspark import catalog
from logspark.operators import lines as L
from logspark.operators import metrics as M
from logspark.operators import parse
from logspark.operators.metrics import _Bucket, _Once, _Rate
from logspark.operators.ordered import ordered_fold
from logspark.plans.stream_queries import PROVIDER, run_to_end
from logspark.sources import tailing
from logspark.streaming import stateful
from tests.test_streams import _stream, _until


def test_replication_lag_of_close_times(spark, tmp_path):
    """Microseconds apart, changes per second are those of the SQL."""
    ts = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 3 + F.col("id") % 2).cast("timestamp_ntz")
    e = spark.range(1000).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 3).alias("user_id"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = ["host", "ts", "offset_diff", "master_change", "lag_seconds"]
    got = catalog.QUERIES["replication_lag"](spark, str(tmp_path)).select(*columns).collect()
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.SQL['replication_lag']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 999


def _samples(spark, n=400):
    rng = random.Random(4)
    rows = [(i, "app", rng.choice([f"h{k}" for k in range(40)]), "m", rng.choice([None, 1.0, 5.0, 5.0, 9.0]), 1000 * i) for i in range(n)]
    return spark.createDataFrame(rows, "id long, monitor string, instance string, metric string, value double, ts_ms long").withColumn("extra", F.lit(None).cast("map<string,string>"))


def test_series_of_a_bucket(spark, tmp_path, monkeypatch):
    """Forty series in two buckets, over three batches: what the batch operator gives."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    df = _samples(spark)
    got = run_to_end(stateful.stream_rate(_stream(spark, df, tmp_path / "in", "id"), ttl_ms=None), "rate")
    want = sorted(map(tuple, M.rate(df).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_a_bucket_is_called_once(monkeypatch):
    """A hundred series cost one question whether there is state, one write each and one frame; then one read and one write each."""
    calls, held = [], {}
    put = lambda k, v: (calls.append("put"), held.__setitem__(k, v))
    states = SimpleNamespace(exists=lambda: calls.append("exists") or bool(held), getValue=lambda k: calls.append("get") or held.get(k), updateValue=put)
    p = stateful._Processor(lambda: _Rate(660), {"series": "string"}, ["ts_ms"], ["series", "ts_ms", "rate"], None, None)
    p.init(SimpleNamespace(getMapState=lambda *_: states))
    batch = lambda *times: pd.DataFrame([(0, f"s{k}", t, t / 500) for t in times for k in range(100)], columns=["_bucket", "series", "ts_ms", "value"])
    (one,) = p.handleInputRows((0,), iter([batch(3000, 2000), batch(1000)]), None)
    assert len(one) == 200 and set(one.rate) == {2.0} and calls == ["exists", *["put"] * 100]
    (two,) = p.handleInputRows((0,), iter([batch(4000)]), None)
    assert len(two) == 100 and set(two.rate) == {2.0} and calls[101:] == ["exists", *["get", "put"] * 100]


def test_keys_of_a_bucket_end_each_in_its_time(spark, tmp_path, monkeypatch):
    """Two batches, one of which goes on with a key of the other: one timer after the other."""
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    rows = [(k, i, f"2024-01-01T00:00:0{i}Z stdout {'F' if i == 4 else 'P'} {k}{i}") for i, k in enumerate("aabbccd")]
    parsed = L.parse_cri(_stream(spark, spark.createDataFrame(rows, "log_path string, line_seq long, raw string"), tmp_path / "in", "line_seq", 2))
    got = _until(stateful.stream_pieces(parsed, wait_ms=8000), tmp_path, lambda found: len(found) == 5)
    assert sorted((r.log_path, r.message, r.partial) for r in got) == [("a", "a0a1", True), ("b", "b2b3", True), ("c", "c4", False), ("c", "c5", True), ("d", "d6", True)]


def test_state_of_buckets_has_a_row_a_series(spark, tmp_path, monkeypatch):
    """The entries of each bucket are read, with the last sample that each series holds."""
    monkeypatch.setattr(stateful, "BUCKETS", 3)
    df = _samples(spark).withColumn("value", F.col("id").cast("double"))
    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, stateful.ROCKSDB)
    try:
        out = stateful.stream_rate(_stream(spark, df, tmp_path / "in", "id"), ttl_ms=None)
        out.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
        held = {r.key.series: (r.value.time, r.value.value) for r in stateful.state_of(spark, str(tmp_path / "c")).collect()}
    finally:
        spark.conf.set(PROVIDER, provider)
    last = M.with_series(df).groupBy("series").agg(F.max("id").alias("id")).collect()
    assert held == {r.series: (float(r.id), float(r.id)) for r in last} and len(held) == 40


def test_chunks_of_a_bucket_are_called_once():
    """A thousand series cost a read and a write for each chunk, and what a chunk holds of other series stays."""
    calls, held = [], {}
    put = lambda k, v: (calls.append("put"), held.__setitem__(k, v))
    states = SimpleNamespace(exists=lambda: bool(held), getValue=lambda k: calls.append("get") or held.get(k), updateValue=put)
    p = stateful._processor(lambda: _Rate(660), {"series": "string"}, ["ts_ms", "value"], ["series", "ts_ms", "rate"], None, None)
    p.init(SimpleNamespace(getMapState=lambda *_: states))
    batch = lambda keys, *times: pd.DataFrame([(0, k, t, None if k is None else t / 500) for t in times for k in keys], columns=["_bucket", "series", "ts_ms", "value"])
    names = [f"s{k}" for k in range(1000)]
    (one,) = p.handleInputRows((0,), iter([batch([*names, None], 3000, 2000), batch(names, 1000)]), None)
    assert len(one) == 2000 and set(one.rate) == {2.0} and calls == ["put"] * stateful.CHUNKS
    # the null series has had no value yet; nine series go on
    nulls = pd.DataFrame([(0, None, t, 1.0 * t) for t in (1000, 2000)], columns=["_bucket", "series", "ts_ms", "value"])
    (two,) = p.handleInputRows((0,), iter([batch(names[:9], 4000), nulls]), None)
    assert sorted(two.rate) == [2.0] * 9 + [1000.0] and calls.count("get") == calls.count("put") - stateful.CHUNKS <= 10
    (three,) = p.handleInputRows((0,), iter([batch(names, 5000)]), None)
    assert len(three) == 1000 and set(three.rate) == {2.0} and len(calls) <= 20 + 3 * stateful.CHUNKS
    assert sorted(k for v in held.values() for k in v[0] if k is not None) == sorted(names)
    # a time to live or a timer is each key's own
    assert all(type(stateful._processor(lambda: _Rate(660), {}, [], [], *own)) is stateful._Processor for own in ((1, None), (None, 1)))


def test_keys_of_chunks_go_on(spark, tmp_path, monkeypatch):
    """Forty keys in one bucket, over three batches: what the folds of tables give."""
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    df = spark.range(300).select("id", F.when(F.col("id") % 41 != 7, (F.col("id") * 7 % 41).cast("string")).alias("key"), (F.col("id") * 10.5).alias("t"), (F.col("id") % 5 + 1).cast("double").alias("cost"))
    out = run_to_end(stateful.stream_once_per(_stream(spark, df, tmp_path / "once", "id"), 1000), "once")
    want = ordered_fold(df.select("key", "t"), ["key"], ["t"], lambda: _Once(1000), "key string, t double")
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(out) == rows(want) and 41 < want.count() < 200
    out = run_to_end(stateful.stream_rate_limit(_stream(spark, df, tmp_path / "limit", "id"), 6, 0.005), "limit")
    schema = "key string, t double, cost double, admitted boolean, dropped_before bigint"
    assert rows(out) == rows(ordered_fold(df.select("key", "t", "cost"), ["key"], ["t", "cost"], lambda: _Bucket(6, 0.005), schema))


def test_tasks_are_as_many_as_bytes_need(tmp_path):
    """Small ranges and files are put together, each range is read once, and little more than its bytes."""
    parts = [tailing.Range(f"f{k:03d}", 0, 100) for k in range(300)] + [tailing.Range("large", 0, 40 << 20), tailing.Range("none", 0, 0)]
    dealt = tailing.tasks(parts, 1 << 16)
    assert len(dealt) < 20 and max(sum(p.end - p.start for p in t.parts) for t in dealt) <= tailing.TASK_BYTES
    assert [(p.path, p.start // (1 << 16)) for t in dealt for p in t.parts] == sorted((p.path, p.start // (1 << 16)) for t in dealt for p in t.parts)
    cut = [r for t in dealt for p in t.parts for r in tailing.ranges(p.path, p.start, p.end, t.size, p.whole)]
    assert cut == [r for p in parts for r in tailing.ranges(p.path, p.start, p.end, 1 << 16, p.whole)]
    path = tmp_path / "a.log"
    path.write_bytes(b"".join(b"line %d\n" % i for i in range(150_000)) + b"x" * 1_000_000 + b"\nlast")
    data, read = path.read_bytes(), []
    whole = SimpleNamespace(read_at=lambda n, at: read.append(len(data[at : at + n])) or data[at : at + n])
    lines = [x for r in tailing.ranges(str(path), 0, len(data), 1 << 16, True) for b in tailing._lines(whole, r) for x in b["raw"].to_pylist()]
    assert lines == data.decode().split("\n") and sum(read) < 2.2 * len(data)
    (task,) = tailing.tasks([tailing.Range(str(path), 0, len(data))], 1 << 16)
    assert [x for b in tailing.read_task(task) for x in b["raw"].to_pylist()] == lines


def test_process_lines_are_split_once(spark):
    """A line with fields, one with few, one that is none."""
    stat = "7 (a b) " + " ".join(str(k) for k in range(45))
    df = spark.createDataFrame([(1, stat), (2, "7 (x) S 1 2"), (3, None)], "id long, raw string")
    out = parse.parse_proc_stat(df)
    got = {(r.id, r.metric, r.type): r.value for r in out.collect()}
    assert got == {(1, "app.cpu", "user"): 11.0, (1, "app.cpu", "system"): 12.0, (1, "app.nice", None): 16.0, (1, "app.threads", None): 17.0, (1, "app.mem.majflt", None): 9.0, (1, "app.io.wait", None): 390.0, (1, "app.start", None): 190.0}
    assert out.columns == ["id", "raw", "metric", "type", "value"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_fields_of_a_line_are_split_once(spark):
    """A filter on what was parsed doesn't split the line, or build it, for each mention of a field."""
    raw = F.concat(F.lit("2024-01-01T00:00:00Z stdout F "), F.col("id").cast("string"), F.lit("-built"))
    df = spark.range(3).select(F.lit("a").alias("log_path"), F.col("id").alias("line_seq"), F.when(F.col("id") < 2, raw).alias("raw"))
    ok = L.parse_cri(df)
    assert [(r.line_seq, r.message, r.error) for r in ok.orderBy("line_seq").collect()] == [(0, "0-built", None), (1, "1-built", None), (2, "", "tags")]
    plan = ok.where("error is null").select("line_seq", "ts_nanos", "message")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("-built") == 1
