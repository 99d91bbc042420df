"""The sources in Python: ranges, growing files, restarts, plugins."""

import random

from pyspark.sql import functions as F

from logspark.sources import tailing
from logspark.sources.tailing import LogTail, Monitor


class Load(Monitor):
    @classmethod
    def name(cls):
        return "load_monitor"

    def instances(self):
        return self.options["hosts"].split(",")

    def gather(self, instance):
        if instance == "bad":
            raise OSError("gone")
        yield "load.one", 1.5, {"cpu": "0"}, 1000
        yield "load.state", "up", None, 1000


def lines_of(data: bytes):
    at, out = 0, []
    for x in data.split(b"\n"):
        out.append((at, x.decode("utf-8", "replace")))
        at += len(x) + 1
    return out if out[-1][1] else out[:-1]


def test_every_line_is_in_one_range(tmp_path, monkeypatch):
    monkeypatch.setattr(tailing, "READ_BYTES", 11)
    rng = random.Random(1)
    for case in range(40):
        data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\n", "é".encode(), b"\r", b"long " * 5, b"\xff"]) for _ in range(rng.randrange(60)))
        path = tmp_path / f"{case}.log"
        path.write_bytes(data)
        for size in (1, 3, 10, 1000):
            rows = [r for part in tailing.ranges(str(path), 0, len(data), size, True) for b in tailing.read_range(part) for r in zip(b["line_seq"].to_pylist(), b["raw"].to_pylist())]
            assert rows == lines_of(data), (data, size)


def test_batch(spark, tmp_path):
    spark.dataSource.register(LogTail)
    data = b"".join(b"line %d\r\n" % i for i in range(5000)) + b"last"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_bytes(data)
    (tmp_path / "sub" / "b.log").write_bytes(b"one\n")
    (tmp_path / "_hidden.log").write_bytes(b"no\n")
    (tmp_path / "c.txt").write_bytes(b"c\n")
    read = lambda path, **o: spark.read.format("log_tail").options(path=path, **o).load()
    got = read(str(tmp_path), exclude="*.txt", rangeBytes="4096").orderBy("log_path", "line_seq").select("line_seq", "raw").collect()
    assert list(map(tuple, got)) == [*lines_of(data), (0, "one")]
    assert read(f"file://{tmp_path}/*.txt").count() == 1 and read(f"{tmp_path}/none*").count() == 0
    assert sum(r.raw_len for r in read(f"{tmp_path}/a.log").collect()) == len(data) + 1


def run(spark, tmp_path, start):
    s = spark.readStream.format("log_tail").options(path=f"{tmp_path}/in/*.log", start=start, rangeBytes="64").load()
    s.writeStream.format("parquet").option("path", f"{tmp_path}/out-{start}").option("checkpointLocation", f"{tmp_path}/c-{start}").trigger(availableNow=True).start().awaitTermination()
    return [r.raw for r in spark.read.schema(s.schema).parquet(f"{tmp_path}/out-{start}").orderBy("log_path", "line_seq").collect()]


def test_a_restart_reads_on(spark, tmp_path):
    """What was read isn't read again, half lines wait for their ends, new files are read from the beginning, old ones only by start=beginning."""
    spark.dataSource.register(LogTail)
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "a.log"
    old = [f"old {i}" for i in range(30)]
    log.write_text("\n".join(old) + "\nhal")
    assert run(spark, tmp_path, "beginning") == old
    assert run(spark, tmp_path, "end") == []
    with open(log, "a") as f:
        f.write("f\nnew")
    (tmp_path / "in" / "b.log").write_text("b\n")
    assert run(spark, tmp_path, "beginning") == [*old, "half", "b"]
    assert run(spark, tmp_path, "end") == ["half", "b"]
    assert run(spark, tmp_path, "end") == ["half", "b"]
    # a file that has shrunk is another one
    log.write_text("again\n")
    assert sorted(run(spark, tmp_path, "end")) == ["again", "b", "half"]


def test_plugins(spark):
    spark.dataSource.register(Load)
    df = spark.read.format("load_monitor").option("hosts", "a,bad,b").load()
    got = sorted((r.instance, r.metric, r.value, r.value_str) for r in df.collect())
    assert got == [("a", "load.one", 1.5, None), ("a", "load.state", None, "up"), ("b", "load.one", 1.5, None), ("b", "load.state", None, "up"), ("bad", "load_monitor.error", None, "OSError: gone")]
    assert df.where(F.col("extra")["cpu"] == "0").count() == 2
