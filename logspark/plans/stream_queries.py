"""Queries that run as streams over files that have landed, to the end of what is there, and read what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.model import Grouper
from logspark.operators import lines as L
from logspark.operators.ordered import shared_top
from logspark.operators.reports import mark_stale, session_expiry
from logspark.plans.metric_queries import _LIMIT_SQL, _RATE_SQL
from logspark.plans.registry import query, table
from logspark.sources import delivery, sinks
from logspark.streaming import reports, stateful

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can read and write."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a pattern: the table may be one file, which a stream doesn't take as a folder
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into Parquet, and reads it. mode complete: what the last batch gave."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    provider, last = spark.conf.get(PROVIDER), [0]
    spark.conf.set(PROVIDER, stateful.ROCKSDB)
    try:
        writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
        if mode == "append":
            q = writer.format("parquet").option("path", f"{folder}/out").start()
        else:

            def put(batch: DataFrame, n: int) -> None:
                batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={n}")
                last[0] = n

            q = writer.outputMode(mode).foreachBatch(put).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, provider)
    return spark.read.schema(df.schema).parquet(f"{folder}/out" if mode == "append" else f"{folder}/out/batch_id={last[0]}")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS window_start, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_interval_report(spark, sf_dir):
    report = stateful.interval_report(stream_of(spark, sf_dir, "events"), "ts", ["event_type"], "1 day")
    out = run_to_end(report, "interval", "complete")
    return out.select("event_type", F.unix_micros("window_start").alias("window_start"), "rows", F.round("total", 4).alias("total"))


@query(_RATE_SQL.format(gap=86_400_000 * 3, digits=7, more=""))
def stream_rate(spark, sf_dir):
    e = stream_of(spark, sf_dir, "events")
    m = e.select(F.lit("app").alias("monitor"), F.col("user_id").cast("string").alias("instance"), F.col("event_type").alias("metric"), "value", F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("extra"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    out = run_to_end(stateful.stream_rate(m, gap_seconds=86_400 * 3, digits=7, ttl_ms=None), "rate")
    return out.select(F.get_json_object("series", "$.instance").alias("instance"), F.get_json_object("series", "$.metric").alias("metric"), "ts_ms", "rate")


@query("""WITH RECURSIVE E AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
 R AS (SELECT user_id, rn, t, t AS last FROM E WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, e.t, CASE WHEN e.t - R.last >= 100000 THEN e.t ELSE R.last END FROM R JOIN E e ON e.user_id = R.user_id AND e.rn = R.rn + 1)
 SELECT CAST(user_id AS VARCHAR) AS key, t FROM R WHERE t = last""")
def stream_once_per(spark, sf_dir):
    e = stream_of(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return run_to_end(stateful.stream_once_per(e, 100_000), "once")


@query(_LIMIT_SQL)
def stream_rate_limit(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = stream_of(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), t.alias("t"), (F.col("event_id") % 5 + 1).cast("double").alias("cost"))
    return run_to_end(stateful.stream_rate_limit(e, 6, 0.00005), "limit")


@query("""WITH S AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '12 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 G AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM S)
 SELECT user_id, epoch_us(min(ts)) AS opened, epoch_us(max(ts)) AS last_seen, count(*) AS lines FROM G GROUP BY user_id, g""")
def session_periods(spark, sf_dir):
    out = session_expiry(table(spark, sf_dir, "events"), "user_id", "ts", "12 hours")
    return out.select("user_id", F.unix_micros("opened").alias("opened"), F.unix_micros("last_seen").alias("last_seen"), "lines")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS window_start, count(*) AS rows FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL")
def stream_stale_rows(spark, sf_dir):
    """Rows too old to be copied, counted by interval."""
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    _, stale = stateful.skip_stale(stream_of(spark, sf_dir, "events"), "ts", "5 days", now)
    out = run_to_end(stateful.interval_report(stale, "ts", ["event_type"], "1 day"), "stale", "complete")
    return out.select("event_type", F.unix_micros("window_start").alias("window_start"), "rows")


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_events(spark, sf_dir):
    folder = shared_folder(spark, "stream-events")
    e = stream_of(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    sinks.stream_events(e, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    back = spark.read.parquet(f"{folder}/out")
    return back.groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("SELECT count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids, count(DISTINCT event_id) AS different FROM events")
def write_batches(spark, sf_dir):
    """Batches under their numbers; the stream runs twice, and the second time finds nothing new."""
    folder = shared_folder(spark, "batches")
    for _ in range(2):
        sinks.write_batches(stream_of(spark, sf_dir, "events").select("event_id"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"), F.count_distinct("event_id").alias("different"))


@query("""WITH E AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
 M AS (SELECT *, max(CASE WHEN event_type <> 'click' THEN rn END) OVER (PARTITION BY user_id ORDER BY rn) AS head FROM E),
 K AS (SELECT M.user_id, M.event_id, CASE WHEN M.event_type = 'click' AND h.event_type = 'view' THEN M.head ELSE M.rn END AS k FROM M LEFT JOIN E h ON h.user_id = M.user_id AND h.rn = M.head),
 R AS (SELECT user_id, min(event_id) AS line_seq, count(*) AS n_lines FROM K GROUP BY user_id, k)
 SELECT CAST(R.user_id AS VARCHAR) AS log_path, line_seq, n_lines FROM R JOIN events e ON e.event_id = R.line_seq QUALIFY row_number() OVER (PARTITION BY R.user_id ORDER BY line_seq DESC) > 1 OR event_type <> 'view'""")
def stream_groups(spark, sf_dir):
    """A view and the clicks after it are a group; the last group of each log, if a view began it, is still open and not among the rows."""
    e = stream_of(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("log_path"), F.col("event_id").alias("line_seq"), F.col("event_type").alias("raw"))
    out = run_to_end(stateful.stream_groups(e, [Grouper("continueThrough", "^view$", "^click$")], wait_ms=None), "groups")
    return out.select("log_path", "line_seq", "n_lines")


@query("""WITH C AS (SELECT user_id, event_id, event_id % 4 = 3 AS whole FROM events),
 G AS (SELECT *, coalesce(sum(whole::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM C)
 SELECT CAST(user_id AS VARCHAR) AS log_path, min(event_id) AS line_seq, count(*) AS n_pieces, string_agg(CAST(event_id AS VARCHAR), '' ORDER BY event_id) AS message FROM G GROUP BY user_id, g HAVING bool_or(whole)""")
def stream_pieces(spark, sf_dir):
    """Pieces up to a full one; those of a message that isn't whole yet are held."""
    e = stream_of(spark, sf_dir, "events")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" stdout "), F.when(F.col("event_id") % 4 == 3, "F").otherwise("P"), F.lit(" "), F.col("event_id").cast("string"))
    parsed = L.parse_cri(e.select(F.col("user_id").cast("string").alias("log_path"), F.col("event_id").alias("line_seq"), raw.alias("raw")))
    return run_to_end(stateful.stream_pieces(parsed, wait_ms=None), "pieces").select("log_path", "line_seq", "n_pieces", "message")


@query("SELECT CAST(user_id AS VARCHAR) AS conn_id, count(*) AS frames, CAST(sum(strlen(event_type || ' ' || event_id)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def stream_frames(spark, sf_dir):
    """Frames by line of each user's connection, of chunks that end in the middle of a frame."""
    e = stream_of(spark, sf_dir, "events").withColumn("m", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit("\n")))
    half = F.floor(F.length("m") / 2).cast("int")
    chunks = e.select(F.col("user_id").cast("string").alias("conn_id"), F.posexplode(F.array(F.substring("m", F.lit(1), half), F.substring("m", half + 1, F.length("m")))).alias("k", "part"), "event_id")
    chunks = chunks.select("conn_id", (F.col("event_id") * 2 + F.col("k")).alias("chunk_seq"), F.col("part").cast("binary").alias("payload"))
    out = run_to_end(stateful.stream_frames(chunks, wait_ms=None), "frames")
    return out.where("complete").groupBy("conn_id").agg(F.count("*").alias("frames"), F.sum(F.octet_length("frame")).alias("bytes"))


@query("""SELECT count(*) AS lines_read, CAST(sum(event_id) AS BIGINT) AS bytes_read, count(*) FILTER (c) AS lines_copied, CAST(coalesce(sum(event_id) FILTER (c), 0) AS BIGINT) AS bytes_copied,
 count(*) FILTER (NOT k) AS lines_dropped, CAST(coalesce(sum(event_id) FILTER (NOT k), 0) AS BIGINT) AS bytes_dropped, count(*) FILTER (c AND event_type = 'view') AS lines_redacted,
 count(*) FILTER (f) AS lines_failed, CAST(coalesce(sum(event_id) FILTER (f), 0) AS BIGINT) AS bytes_failed, count(*) FILTER (s) AS lines_skipped, CAST(coalesce(sum(event_id) FILTER (s), 0) AS BIGINT) AS bytes_skipped
 FROM (SELECT *, k AND NOT f AND NOT s AS c FROM (SELECT *, event_id % 3 <> 0 AS k, event_id % 11 = 1 AS f, user_id % 10 = 1 AS s FROM events))""")
def stream_observed_report(spark, sf_dir):
    """What a stream's batches observed as they passed, all batches together."""
    e = stream_of(spark, sf_dir, "events")
    flags = (F.col("event_id") % 3 != 0, F.col("event_type") == "view", F.col("event_id") % 11 == 1, F.col("user_id") % 10 == 1)
    name = f"lines-{uuid.uuid4().hex}"
    listener = reports.BatchReports(name)
    spark.streams.addListener(listener)
    try:
        run_to_end(reports.observed(e, name, *flags, size="event_id").select("event_id"), "observed")
        reports.settled(spark)
    finally:
        spark.streams.removeListener(listener)
    return listener.table(spark).agg(*(F.sum(c).alias(c) for c in reports.COUNTS))


@query("""WITH S AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '12 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 G AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM S)
 SELECT user_id, epoch_us(min(ts)) AS opened, epoch_us(max(ts)) AS last_seen, count(*) AS lines FROM G GROUP BY user_id, g HAVING max(ts) + INTERVAL '12 hours' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '1 hour' FROM events)""")
def stream_session_periods(spark, sf_dir):
    """Sessions that are over when the stream ends; the others are held."""
    out = run_to_end(reports.stream_sessions(stream_of(spark, sf_dir, "events"), "user_id", "ts", "12 hours", "1 hour"), "sessions")
    return out.select("user_id", F.unix_micros("opened").alias("opened"), F.unix_micros("last_seen").alias("last_seen"), "lines")


@query("""SELECT unnest(['done', 'retried']) AS state, unnest([1, 1]) AS batches, unnest([1, 2]) AS attempts, unnest([count(*), 2 * count(*)]) AS rows, CAST(unnest([sum(event_id), 2 * sum(event_id)]) AS BIGINT) AS bytes,
 unnest([count(*), 0]) AS seen FROM events""")
def deliver_batches(spark, sf_dir):
    """A receiver that fails twice after it wrote: readers see each row once, the ledger has all attempts."""
    folder = shared_folder(spark, "delivery")
    failures = [2]

    def send(batch: DataFrame, part: str) -> None:
        batch.write.parquet(part)
        if failures[0]:
            failures[0] -= 1
            raise OSError("no answer")

    e = stream_of(spark, sf_dir, "events").select("event_id")
    delivery.deliver(e, send, f"{folder}/out", f"{folder}/checkpoint", size="event_id").awaitTermination()
    report = delivery.delivery_report(delivery.read_ledger(spark, f"{folder}/out"))
    seen = delivery.delivered(spark, f"{folder}/out", "event_id bigint").agg(F.count("*").alias("n"))
    # one row
    return report.join(F.broadcast(seen)).withColumn("seen", F.when(F.col("state") == "done", F.col("n")).otherwise(0)).drop("n")


_STALE_SQL = """WITH S AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '2 days', false) AS s FROM (SELECT DISTINCT user_id, date_trunc('milliseconds', ts) AS ts FROM events))
 SELECT CAST(user_id AS VARCHAR) AS log_path, count(*) FILTER (NOT s) AS copied, count(*) FILTER (s) AS skipped, CAST(coalesce(sum(event_id) FILTER (s), 0) AS BIGINT) AS skipped_bytes
 FROM events e JOIN S USING (user_id) WHERE S.ts = date_trunc('milliseconds', e.ts) GROUP BY 1"""


def _scanned(e):
    """Users as logs, whose events are lines that are seen when they happen."""
    return e.select(F.col("user_id").cast("string").alias("log_path"), F.col("event_id").alias("line_seq"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("scan"), F.col("event_id").alias("raw_len"))


def _stale_counts(df):
    n = F.count_if
    return df.groupBy("log_path").agg(n(~F.col("skipped")).alias("copied"), n("skipped").alias("skipped"), F.coalesce(F.sum(F.when(F.col("skipped"), F.col("raw_len"))), F.lit(0)).alias("skipped_bytes"))


@query(_STALE_SQL)
def stale_logs(spark, sf_dir):
    return _stale_counts(mark_stale(_scanned(table(spark, sf_dir, "events")), "2 days"))


@query(_STALE_SQL)
def stream_stale_logs(spark, sf_dir):
    """Logs that were left alone for two days skip to their ends."""
    out = run_to_end(stateful.skip_stale_logs(_scanned(stream_of(spark, sf_dir, "events")), "2 days"), "stale-logs")
    return _stale_counts(out.where("skipped is not null"))


@query("SELECT count(DISTINCT (user_id, event_type)) AS series, CAST(sum(t) AS BIGINT) AS latest FROM (SELECT user_id, event_type, 1 AS t FROM events GROUP BY ALL)")
def stream_series_state(spark, sf_dir):
    """The series that a stream of rates holds, counted in its state."""
    e = stream_of(spark, sf_dir, "events")
    m = e.select(F.lit("app").alias("monitor"), F.col("user_id").cast("string").alias("instance"), F.col("event_type").alias("metric"), "value", F.lit(None).cast("map<string,string>").alias("extra"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    folder = shared_folder(spark, "series")
    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, stateful.ROCKSDB)
    try:
        out = stateful.stream_rate(m, gap_seconds=86_400 * 3, ttl_ms=None)
        out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        # the state is read while the session still names its store
        held = stateful.state_of(spark, f"{folder}/checkpoint")
        return spark.createDataFrame(held.agg(F.count("*").alias("series"), F.count("value.time").alias("latest")).collect(), "series bigint, latest bigint")
    finally:
        spark.conf.set(PROVIDER, provider)
