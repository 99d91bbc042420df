"""Queries through files: what sinks write, sources read."""

from __future__ import annotations

import itertools
import uuid

from pyarrow import fs
from pyspark.sql import functions as F

from logspark.operators import inventory, parse
from logspark.operators.ordered import running
from logspark.plans.inventory_queries import _stats
from logspark.plans.line_queries import LINES
from logspark.plans.metric_queries import samples
from logspark.plans.registry import query, table
from logspark.plans.stream_queries import run_to_end, shared_folder
from logspark.sources import files, sinks
from logspark.sources.files import document_lines, line_block
from logspark.sources.tailing import LogTail, Monitor

#: A sum that tells whether lines have the same texts, in any order: of 32 bits of each one's MD5.
_DIGEST_SQL = "CAST(sum(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)) AS BIGINT)"


def _digest(c: str):
    return F.sum(F.conv(F.substring(F.md5(F.col(c).cast("binary")), 1, 8), 16, 10).cast("long")).alias("digest")


@query(f"WITH {LINES} SELECT log_path, count(*) AS lines, CAST(sum(raw_len) AS BIGINT) AS bytes, count(DISTINCT line_seq) AS places, {_DIGEST_SQL.format('raw')} AS digest FROM L WHERE log_path <> 'src7' GROUP BY 1")
def read_log_lines(spark, sf_dir):
    """A folder of text files for each log; one log is excluded."""
    folder = shared_folder(spark, "logs")
    # Spark writes an empty value of a partition under another name
    named = F.concat(F.lit("log-"), "log_path").alias("log_path")
    document_lines(spark, sf_dir).select(named, "raw").write.option("lineSep", "\n").partitionBy("log_path").text(folder)
    lines = files.read_log_lines(spark, [folder], exclude=["*/log_path=log-src7/*"])
    log = F.regexp_extract("log_path", "log_path=log-([^/]*)", 1)
    place = F.struct("log_path", "line_seq")
    return lines.select(log.alias("log"), "raw_len", "raw", place.alias("place")).groupBy(F.col("log").alias("log_path")).agg(F.count("*").alias("lines"), F.sum("raw_len").alias("bytes"), F.count_distinct("place").alias("places"), _digest("raw"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def write_events(spark, sf_dir):
    folder = shared_folder(spark, "events")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    sinks.write_events(e, folder)
    back = spark.read.parquet(folder)
    return back.groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("SELECT event_type AS metric, count(*) AS lines, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def write_metric_lines(spark, sf_dir):
    folder = shared_folder(spark, "metric-lines")
    sinks.write_metric_lines(samples(spark, sf_dir), folder)
    part = lambda n: F.regexp_extract("value", r'^\S+ \S+ \[app\] (\S+) \S+ user="(\d+)"$', n)
    return spark.read.text(folder).groupBy(part(1).alias("metric")).agg(F.count("*").alias("lines"), F.count_distinct(part(2)).alias("users"))


@query("""WITH L AS (SELECT l_suppkey, count(*)::DOUBLE AS n, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS q FROM lineitem GROUP BY 1)
 SELECT CAST(l_suppkey AS VARCHAR) AS container, unnest(['docker.mem.usage', 'docker.net.rx_bytes']) AS metric, unnest([q, n]) AS value FROM L""")
def read_container_stats(spark, sf_dir):
    folder = shared_folder(spark, "stats")
    s = _stats(spark, sf_dir)
    s.select(F.concat(F.lit('{"container":"'), F.col("l_suppkey").cast("string"), F.lit('","ts":"2024-01-01T00:00:00Z","stats":'), "stats", F.lit("}"))).write.text(folder)
    out = inventory.unpivot_container_stats(files.read_container_stats(spark, folder), ["container"])
    return out.where(F.col("metric").isin("docker.mem.usage", "docker.net.rx_bytes")).select("container", "metric", "value")


@query("SELECT 'udp|host' || user_id || '|514' AS conn_id, count(*) AS frames FROM events GROUP BY 1")
def read_syslog_capture(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    packets = e.select(F.lit("udp").alias("proto"), F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("srcip"), F.lit(514).alias("destport"), "ts", F.concat("event_type", F.lit("\n")).alias("payload"))
    return parse.split_syslog_frames(files.read_syslog_capture(packets)).groupBy("conn_id").agg(F.count("*").alias("frames"))


@query("SELECT o_orderstatus AS status, count(*) AS rows FROM orders GROUP BY 1")
def read_db_status(spark, sf_dir):
    return files.read_db_status(spark, f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("rows"))


@query("SELECT o_orderstatus AS status, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def read_db_ranges(spark, sf_dir):
    """Orders in a database in this process, read in ranges of their keys. Where executors are other processes they can't reach it, so there the table is read as a snapshot."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    if spark.sparkContext.master.startswith("local["):
        url, driver = f"jdbc:derby:memory:db{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
        o.write.option("createTableColumnTypes", "o_orderstatus VARCHAR(64), o_orderpriority VARCHAR(64)").jdbc(url, "orders", properties={"driver": driver})
        o = files.read_db_status(spark, url=url, table="orders", column="o_orderkey", rows_of_a_task=2000, driver=driver)
    return o.where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query(f"WITH {LINES} SELECT count(*) AS lines, CAST(sum(strlen(raw)) AS BIGINT) AS bytes, {_DIGEST_SQL.format('raw')} AS digest FROM L")
def stream_log_lines(spark, sf_dir):
    folder = shared_folder(spark, "landed")
    document_lines(spark, sf_dir).select("raw").write.option("lineSep", "\n").text(folder)
    out = run_to_end(files.stream_log_lines(spark, folder, per_trigger=3), "lines")
    return out.agg(F.count("*").alias("lines"), F.sum(F.octet_length("raw")).alias("bytes"), _digest("raw"))


_TAILED_SQL = f"WITH {LINES} SELECT log_path, count(*) AS lines, CAST(sum(raw_len) AS BIGINT) AS bytes, {_DIGEST_SQL.format('raw')} AS digest FROM L GROUP BY 1"


def _tailed(lines):
    log = F.regexp_extract("log_path", "log_path=log-([^/]*)", 1)
    return lines.groupBy(log.alias("log_path")).agg(F.count("*").alias("lines"), F.sum("raw_len").cast("long").alias("bytes"), _digest("raw"))


def _written_logs(spark, sf_dir) -> str:
    folder = shared_folder(spark, "tailed")
    named = F.concat(F.lit("log-"), "log_path").alias("log_path")
    document_lines(spark, sf_dir).select(named, "raw").write.option("lineSep", "\n").partitionBy("log_path").text(folder)
    return folder


@query(_TAILED_SQL)
def tail_log_lines(spark, sf_dir):
    """Files of lines through the registered source, in ranges of 64 KB."""
    spark.dataSource.register(LogTail)
    return _tailed(spark.read.format("log_tail").options(path=_written_logs(spark, sf_dir), rangeBytes=str(1 << 16)).load())


@query(_TAILED_SQL)
def tail_log_stream(spark, sf_dir):
    """The same as a stream, which is started twice from one checkpoint and reads nothing twice."""
    spark.dataSource.register(LogTail)
    source, folder = _written_logs(spark, sf_dir), shared_folder(spark, "tail")
    for _ in range(2):
        lines = spark.readStream.format("log_tail").option("path", source).load()
        lines.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _tailed(spark.read.schema(lines.schema).parquet(f"{folder}/out"))


class LogSizes(Monitor):
    """Bytes of each of the folders below a path, as a plugin: an instance is a folder."""

    @classmethod
    def name(cls) -> str:
        return "log_sizes"

    def instances(self) -> list[str]:
        system, path = fs.FileSystem.from_uri(self.options["path"])
        return [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory]

    def gather(self, instance: str):
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        sizes = [f.size for f in system.get_file_info(fs.FileSelector(instance, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        yield "log.bytes", sum(sizes), None, None


@query(f"WITH {LINES} SELECT log_path, 'log.bytes' AS metric, CAST(sum(raw_len) AS DOUBLE) AS value FROM L GROUP BY 1")
def plugin_metrics(spark, sf_dir):
    """Metrics that a plugin gathers, a task for each log."""
    spark.dataSource.register(LogSizes)
    m = spark.read.format("log_sizes").option("path", _written_logs(spark, sf_dir)).load()
    return m.select(F.regexp_extract("instance", "log_path=log-([^/]*)", 1).alias("log_path"), "metric", "value")


@query(f"""WITH {LINES}, B AS (SELECT log_path, raw, row_number() OVER (PARTITION BY log_path ORDER BY line_seq) AS rn FROM L)
 SELECT log_path, count(*) AS lines, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes, CAST(sum(rn * CAST('0x' || substr(md5(raw), 1, 8) AS BIGINT) % 1000003) AS BIGINT) AS digest FROM B GROUP BY 1""")
def read_rotated_lines(spark, sf_dir):
    """Each log in three files, x.log.2, x.log.1 and x.log, written apart and read as one log, oldest file first. The digest has each line's place in its log."""
    folder = shared_folder(spark, "rotated")
    df = running(document_lines(spark, sf_dir).withColumn("_b", line_block()), ["log_path"], ["line_seq"], F.lit(1).cast("long"), "rn", block="_b")
    n = df.groupBy("log_path").agg(F.max("rn").alias("n"))
    third = F.when(F.col("rn") * 3 > F.col("n") * 2, "").when(F.col("rn") * 3 > F.col("n"), ".1").otherwise(".2")
    named = df.join(n, "log_path").select(F.concat(F.lit("log-"), "log_path", F.lit(".log"), third).alias("file"), "line_seq", "raw")
    # a file is one task's, line by line
    named.repartition("file").sortWithinPartitions("file", "line_seq").foreachPartition(_files_in(folder))
    lines = files.read_log_lines(spark, [f"{folder}/*"], rotations=True)
    # a part of a file is a block: these never fall along the order
    lines = running(lines.withColumn("_b", F.shiftright("line_seq", 29)), ["log_path"], ["line_seq"], F.lit(1).cast("long"), "rn", block="_b")
    digest = F.sum(F.col("rn") * F.conv(F.substring(F.md5(F.col("raw").cast("binary")), 1, 8), 16, 10).cast("long") % 1000003)
    return lines.groupBy(F.regexp_extract("log_path", r"log-([^/]*)\.log$", 1).alias("log_path")).agg(F.count("*").alias("lines"), F.sum("raw_len").cast("long").alias("bytes"), digest.alias("digest"))


def _files_in(folder: str):
    """Writes rows of file and raw, which come in order, as lines of those files."""

    def run(rows):
        system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        system.create_dir(path, recursive=True)
        for file, own in itertools.groupby(rows, key=lambda r: r.file):
            with system.open_output_stream(f"{path}/{file}", compression=None) as out:
                for r in own:
                    out.write(r.raw.encode() + b"\n")

    return run
