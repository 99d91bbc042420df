"""Queries over metrics: events are samples of a metric (event_type) of an instance (user_id)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from logspark.functions import text, values
from logspark.functions.dates import epoch_seconds
from logspark.operators import parse, reports
from logspark.operators import metrics as M
from logspark.plans import pipelines
from logspark.plans.registry import query, table


def samples(spark, sf_dir):
    """Events as metrics: monitor app, instance user_id, extra k and user."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", F.lit("app").alias("monitor"), F.col("user_id").cast("string").alias("instance"), F.col("event_type").alias("metric"), "value", F.lit(None).cast("string").alias("value_str"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("extra"), F.unix_millis(ts).alias("ts_ms"), ts.alias("ts"))


_RATE_SQL = """WITH RECURSIVE E AS (SELECT user_id, event_type, (epoch_us(ts) // 1000) AS t, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (epoch_us(ts) // 1000), value) AS rn FROM events WHERE value IS NOT NULL),
 R AS (SELECT user_id, event_type, rn, t AS t0, value AS v0, NULL::DOUBLE AS rate, t FROM E WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.event_type, e.rn, CASE WHEN e.t - R.t0 >= {gap} OR (e.t > R.t0 AND e.value >= R.v0) THEN e.t ELSE R.t0 END, CASE WHEN e.t - R.t0 >= {gap} OR (e.t > R.t0 AND e.value >= R.v0) THEN e.value ELSE R.v0 END,
   CASE WHEN e.t - R.t0 < {gap} AND e.t > R.t0 AND e.value >= R.v0 THEN (e.value - R.v0) / ((e.t - R.t0) / 1000.0) END, e.t FROM R JOIN E e ON e.user_id = R.user_id AND e.event_type = R.event_type AND e.rn = R.rn + 1)
 SELECT CAST(user_id AS VARCHAR) AS instance, event_type AS metric, t AS ts_ms, round(rate, {digits}) AS rate FROM R WHERE rate IS NOT NULL {more}"""


def _of_series(df):
    return df.select(F.get_json_object("series", "$.instance").alias("instance"), F.get_json_object("series", "$.metric").alias("metric"), "ts_ms", "rate")


@query(_RATE_SQL.format(gap=86_400_000 * 3, digits=7, more=""))
def rate_per_series(spark, sf_dir):
    return _of_series(M.rate(samples(spark, sf_dir), gap_seconds=86_400 * 3, digits=7))


@query(_RATE_SQL.format(gap=86_400_000 * 3, digits=7, more="AND (event_type = 'click' OR (event_type = 'view' AND user_id = 7))"))
def rate_by_specs(spark, sf_dir):
    return _of_series(M.rate(samples(spark, sf_dir), ["app:click", "app:view:user=7"], gap_seconds=86_400 * 3, digits=7))


@query("""WITH E AS (SELECT user_id, event_type, (epoch_us(ts) // 1000) AS t, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS v FROM events),
 D AS (SELECT user_id, event_type, t, min(v) AS v FROM E GROUP BY ALL),
 P AS (SELECT *, (t - lag(t) OVER w) / 1000.0 AS s, v - lag(v) OVER w AS d FROM D WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t))
 SELECT CAST(user_id AS VARCHAR) AS instance, event_type AS metric, t AS ts_ms, round(d / s, 5) AS rate FROM P WHERE s < 600000""")
def rate_of_growing(spark, sf_dir):
    """Counters that only grow: windows, no fold."""
    w = Window.partitionBy("instance", "metric").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    m = samples(spark, sf_dir).withColumn("value", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).cast("double"))
    return _of_series(M.rate(m, gap_seconds=600_000, never_decreases=True))


@query("""SELECT CAST(user_id AS VARCHAR) AS instance, event_type || '_max' AS metric, max(value) AS value FROM events GROUP BY ALL""")
def registered_function(spark, sf_dir):
    """A function of a user's own: the greatest value of each series."""
    M.register_series_function("greatest", "_max", _Greatest)
    d = M.derive(samples(spark, sf_dir), "greatest")
    return d.select(F.get_json_object("series", "$.instance").alias("instance"), "metric", "value")


class _Greatest(M.Fold):
    def __init__(self):
        self.best = None

    def add(self, row):
        self.best = row if self.best is None or row.value > self.best.value else self.best
        return ()

    def end(self):
        return [(self.best.series, self.best.ts_ms, self.best.value)] if self.best else []


@query("SELECT event_id, coalesce(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id), 0) AS delta FROM events")
def cumulative_delta(spark, sf_dir):
    return M.delta(samples(spark, sf_dir), ["instance", "metric"], ["event_id"]).select("event_id", F.coalesce("delta", F.lit(0.0)).alias("delta"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) <= 2")
def last_two(spark, sf_dir):
    return M.last_n(samples(spark, sf_dir), ["instance", "metric"], "event_id", 2).select("event_id")


@query("""WITH S AS (SELECT user_id % 10 AS app, day(ts) AS epoch, user_id AS pid, CASE event_type WHEN 'view' THEN 'cpu' ELSE 'mem' END AS metric, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS value FROM (SELECT * REPLACE (ts + CASE WHEN day(ts) IN (9, 20) THEN INTERVAL '1 day' ELSE INTERVAL '0 days' END AS ts) FROM events) GROUP BY ALL),
 D AS (SELECT *, CASE WHEN lag(epoch) OVER w = epoch - 1 THEN value - lag(value) OVER w ELSE 0 END AS grown FROM S WINDOW w AS (PARTITION BY app, pid, metric ORDER BY epoch)),
 T AS (SELECT app, epoch, metric, sum(value) AS v, sum(grown) AS g FROM D GROUP BY ALL),
 B AS (SELECT *, CASE WHEN lag(epoch) OVER w = epoch - 1 THEN 0 ELSE 1 END AS b FROM T WINDOW w AS (PARTITION BY app, metric ORDER BY epoch)),
 N AS (SELECT *, sum(b) OVER (PARTITION BY app, metric ORDER BY epoch) AS r FROM B)
 SELECT app, epoch, metric, CASE WHEN metric = 'cpu' THEN sum(g) OVER (PARTITION BY app, metric, r ORDER BY epoch) ELSE v END AS total FROM N""")
def process_totals(spark, sf_dir):
    """Users as processes of ten applications, days as epochs; what two of the days had is put on the next, so that they have none."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.expr("ts + CASE WHEN day(ts) IN (9, 20) THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END"))
    s = e.groupBy((F.col("user_id") % 10).alias("app"), F.dayofmonth("ts").cast("long").alias("epoch"), F.col("user_id").alias("pid"), F.when(F.col("event_type") == "view", "cpu").otherwise("mem").alias("metric")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("value"))
    return M.process_totals(s, ["cpu"])


_HISTOGRAM = """H AS (SELECT event_type, CASE WHEN value < 10 THEN 0 WHEN value < 30 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS bucket, value FROM events WHERE value IS NOT NULL),
 B AS (SELECT event_type, bucket, count(*) AS count FROM H GROUP BY ALL), S AS (SELECT event_type, count(*) AS total, min(value) AS least, max(value) AS greatest, avg(value) AS mean FROM H GROUP BY ALL),
 U AS (SELECT event_type, CAST(bucket AS INT) AS bucket, count, CASE bucket WHEN 0 THEN least WHEN 1 THEN 10.0 WHEN 2 THEN 30.0 ELSE 100.0 END::DOUBLE AS lower, CASE bucket WHEN 0 THEN 10.0 WHEN 1 THEN 30.0 WHEN 2 THEN 100.0 ELSE greatest + 0.01 END::DOUBLE AS upper, total, least, greatest, mean FROM B JOIN S USING (event_type)),
 C AS (SELECT *, sum(count) OVER (PARTITION BY event_type ORDER BY bucket) AS reached FROM U)"""


def _histogram(spark, sf_dir):
    return M.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [10, 30, 100])


@query(f"WITH {_HISTOGRAM} SELECT event_type, bucket, count, lower, upper, total, least, greatest FROM U")
def histogram_buckets(spark, sf_dir):
    return _histogram(spark, sf_dir).drop("sum")


@query(f"WITH {_HISTOGRAM} SELECT event_type, arg_min((lower + upper) / 2, bucket) AS estimate FROM C WHERE reached >= total * 0.95 GROUP BY 1")
def histogram_p95(spark, sf_dir):
    return M.estimate_percentile(_histogram(spark, sf_dir), ["event_type"], 0.95)


@query(f"WITH {_HISTOGRAM} SELECT event_type, printf('count=%d,avg=%.2f,min=%.2f,max=%.2f,median=%.2f', any_value(total), any_value(mean), any_value(least), any_value(greatest), arg_min((lower + upper) / 2, bucket)) AS summary FROM C WHERE reached >= total * 0.5 GROUP BY 1")
def histogram_summary(spark, sf_dir):
    return M.summarise_histogram(_histogram(spark, sf_dir), ["event_type"])


def _scrapes(spark, sf_dir):
    """A scrape of each user and day: a text with types and samples of that user's events."""
    e = table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    sample = F.concat(F.lit("App-"), "event_type", F.lit('{id="'), F.col("event_id").cast("string"), F.lit('", kind="a=b"} '), F.when(F.col("event_id") % 5 == 0, F.lit("NaN")).when(F.col("event_id") % 5 == 1, F.lit("1e+03")).when(F.col("event_id") % 5 == 2, F.col("event_id").cast("string")).when(F.col("event_id") % 5 == 3, F.lit("+Inf")).otherwise(F.format_string("%.2f", "value")), F.lit(" 1700000000"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", sample.alias("s")))), lambda x: x["s"]), "\n")
    types = '# HELP nothing\n# TYPE app_click counter\n# TYPE app_view histogram\n\n'
    return e.groupBy("user_id", "day").agg(body.alias("b"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts_ms")).select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("scrape_id"), F.col("user_id").cast("string").alias("instance"), "ts_ms", F.concat(F.lit(types), "b").alias("text"))


_SCRAPED = """X AS (SELECT user_id || '/' || day(ts) AS scrape_id, user_id, event_id, 'app_' || event_type AS metric, event_id % 5 AS k, printf('%.2f', value)::DOUBLE AS v FROM events WHERE event_type <> 'view' AND event_id % 5 <> 0),
 Y AS (SELECT *, CASE k WHEN 1 THEN 1000.0 WHEN 2 THEN event_id WHEN 3 THEN -1 ELSE v END::DOUBLE AS value FROM X)"""


@query(f"WITH {_SCRAPED} SELECT scrape_id, metric, value, CASE WHEN k = 3 THEN '+Inf' ELSE '' END AS value_str, CAST(event_id AS VARCHAR) AS id, 'a=b' AS kind, 1700000000::BIGINT AS sample_ts FROM Y")
def parse_exposition(spark, sf_dir):
    m = M.parse_exposition(_scrapes(spark, sf_dir))
    return m.select("scrape_id", "metric", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("value_str", F.lit("")).alias("value_str"), F.col("extra")["id"].alias("id"), F.col("extra")["kind"].alias("kind"), "sample_ts")


@query(f"WITH {_SCRAPED} SELECT scrape_id, count(*) AS total, count(*) FILTER (WHERE metric = 'app_click') AS included, count(*) FILTER (WHERE metric <> 'app_click') AS ignored, false AS too_many, count(*) FILTER (WHERE metric = 'app_click') = 0 AS none_included FROM Y GROUP BY 1")
def scrape_report(spark, sf_dir):
    return M.scrape_report(M.parse_exposition(_scrapes(spark, sf_dir)), "scrape_id", F.col("metric") == "app_click")


@query(f"WITH {_SCRAPED} SELECT CAST(user_id AS VARCHAR) AS instance, metric, count(*) AS n FROM Y WHERE metric NOT LIKE '%err%' AND (metric LIKE '%chase' OR event_id::VARCHAR LIKE '1%') GROUP BY ALL")
def scrape_metrics(spark, sf_dir):
    m = pipelines.scrape_metrics(_scrapes(spark, sf_dir), "app", ["*chase"], ["*err*"], {"*": {"id": ["1*"]}})
    return m.groupBy("instance", "metric").agg(F.count("*").alias("n"))


@query("""SELECT event_id, event_type AS metric FROM events WHERE event_type <> 'error' AND (event_type LIKE 'v%' OR (event_type = 'click' AND CAST(user_id AS VARCHAR) LIKE '1?') OR CAST(user_id AS VARCHAR) SIMILAR TO '[2-4]5')""")
def filter_metrics_globs(spark, sf_dir):
    m = M.filter_metrics(samples(spark, sf_dir), ["v*"], ["err*"], {"click": {"user": ["1\\?"]}, "*": {"user": ["[2-4]5"]}})
    return m.select("event_id", "metric")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')")
def drop_listed_metrics(spark, sf_dir):
    return M.drop_listed(samples(spark, sf_dir), ["error", "view"]).select("event_id")


@query("SELECT event_id, 'app.' || event_type AS metric, round(value, 2) AS value, floor(epoch(ts)) AS time FROM events WHERE event_id % 4 > 1")
def parse_graphite(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    good = F.concat_ws(" ", F.concat(F.lit("app."), "event_type"), F.format_string("%.2f", "value"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    lines = e.select("event_id", F.when(k == 0, F.lit("app.x 5")).when(k == 1, F.lit("app.x five 7")).otherwise(good).alias("raw"))
    return M.parse_graphite(lines).select("event_id", "metric", "value", "time")


@query("SELECT event_id, event_type || ' ' || event_id || ' user=\"' || user_id || '\" host=\"a\"' AS line FROM events")
def rewrite_tsdb(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat("event_type", F.lit(" 170000 "), F.col("event_id").cast("string"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" host=a"))
    return e.select("event_id", M.rewrite_tsdb(line).alias("line"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.') || printf('%03d', ((epoch_us(ts) // 1000) % 1000)) || ' [app] ' || event_type || ' ' || event_id || ' user=\"' || user_id || '\"' AS value FROM events")
def format_metric_lines(spark, sf_dir):
    m = samples(spark, sf_dir)
    return M.format_metric_lines(m.withColumns({"value": F.lit(None).cast("double"), "value_str": F.col("event_id").cast("string")})).select(F.regexp_replace("value", r'^(\S+ \S+ \S+ \S+) "(\d+)"', "$1 $2").alias("value"))


@query("""WITH N AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a b!' WHEN 1 THEN '9x' WHEN 2 THEN 'value' WHEN 3 THEN 'ok.name-1' ELSE '_x' END AS n FROM events)
 SELECT event_id, CASE n WHEN 'a b!' THEN 'a_b_' WHEN '9x' THEN 'sa_9x' WHEN 'value' THEN 'value_' ELSE n END AS name FROM N""")
def valid_metric_names(spark, sf_dir):
    k = F.col("event_id") % 5
    n = F.when(k == 0, "a b!").when(k == 1, "9x").when(k == 2, "value").when(k == 3, "ok.name-1").otherwise("_x")
    return table(spark, sf_dir, "events").select("event_id", values.valid_metric_name(n).alias("name"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id / 1000 WHEN 1 THEN event_id WHEN 2 THEN event_id * 1000 WHEN 3 THEN -1 ELSE event_id * 1000000 END::DOUBLE AS mb, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id * 1000 ELSE -1 END::DOUBLE AS ms, event_id % 4 > 2 OR event_id % 4 = 0 AS flag, event_id % 2 = 1 AS odd FROM events""")
def units(spark, sf_dir):
    n = F.col("event_id").cast("string")
    k, t, b = F.col("event_id") % 5, F.col("event_id") % 3, F.col("event_id") % 4
    size = F.concat(n, F.when(k == 0, " KB").when(k == 1, " mb").when(k == 2, " GB").when(k == 3, " pb").otherwise(" tb"))
    time = F.concat(n, F.when(t == 0, " ms").when(t == 1, " s").otherwise(""))
    flag = F.when(b == 0, "yes").when(b == 1, "False").when(b == 2, "f").otherwise("true")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.round(values.to_megabytes(size), 6), F.lit(-1.0)).alias("mb"), F.coalesce(values.to_milliseconds(time), F.lit(-1.0)).alias("ms"), values.to_bool(flag).alias("flag"), values.number_to_bool(F.col("event_id") % 2).alias("odd"))


_LIMIT_SQL = """WITH RECURSIVE E AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id % 5 + 1 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id % 5 + 1) AS rn FROM events),
 R AS (SELECT user_id, rn, t, cost, cost <= 6 AS ok, CASE WHEN cost <= 6 THEN 6.0 - cost ELSE 6.0 END::DOUBLE AS level, CASE WHEN cost <= 6 THEN 0 ELSE 1 END AS d, 0 AS before FROM E WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, e.t, e.cost, e.cost <= least(6.0, R.level + (e.t - R.t) * 0.00005), least(6.0, R.level + (e.t - R.t) * 0.00005) - CASE WHEN e.cost <= least(6.0, R.level + (e.t - R.t) * 0.00005) THEN e.cost ELSE 0 END,
   CASE WHEN e.cost <= least(6.0, R.level + (e.t - R.t) * 0.00005) THEN 0 ELSE R.d + 1 END, CASE WHEN e.cost <= least(6.0, R.level + (e.t - R.t) * 0.00005) THEN R.d ELSE 0 END FROM R JOIN E e ON e.user_id = R.user_id AND e.rn = R.rn + 1)
 SELECT CAST(user_id AS VARCHAR) AS key, t, CAST(cost AS DOUBLE) AS cost, ok AS admitted, CAST(before AS BIGINT) AS dropped_before FROM R"""


@query(_LIMIT_SQL)
def rate_limit(spark, sf_dir):
    return M.rate_limit(table(spark, sf_dir, "events"), F.col("user_id"), epoch_seconds(F.col("ts")), F.col("event_id") % 5 + 1, 6, 0.00005)


@query("""WITH RECURSIVE E AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
 R AS (SELECT user_id, rn, t, t AS last FROM E WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, e.t, CASE WHEN e.t - R.last >= 100000 THEN e.t ELSE R.last END FROM R JOIN E e ON e.user_id = R.user_id AND e.rn = R.rn + 1)
 SELECT CAST(user_id AS VARCHAR) AS key, t FROM R WHERE t = last""")
def once_per_key(spark, sf_dir):
    return M.once_per(table(spark, sf_dir, "events"), F.col("user_id"), epoch_seconds(F.col("ts")), 100_000)


def _status_text(spark, sf_dir):
    """Status pages of several kinds, line by line, with numbers of customers' orders."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice").cast("long")).alias("total"))
    n, t = F.col("n").cast("string"), F.col("total").cast("string")
    lines = [F.concat(F.lit("Total Accesses: "), n), F.concat(F.lit("Total kBytes: "), t), F.lit("Scoreboard: ___"), F.concat(F.lit("ReqPerSec: "), n, F.lit(".5")), F.concat(F.lit("Active connections: "), n), F.lit("server accepts handled requests"), F.concat(F.lit(" "), n, F.lit(" "), n, F.lit(" "), t), F.concat(F.lit("Reading: "), n, F.lit(" Writing: 1 Waiting: "), t), F.concat(F.lit("Mutex spin waits "), n, F.lit(", rounds "), t, F.lit(", OS waits 3")), F.concat(F.lit("VmRSS:   "), n, F.lit(" kB")), F.concat(F.lit("rchar: "), t), F.concat(F.lit("TCP: inuse "), n, F.lit(" orphan 0")), F.concat(F.lit("Free memory: "), n, F.lit(" MB Total memory: "), n, F.lit(" GB Max memory: 1.5 GB"))]
    return o.select("o_custkey", F.explode(F.array(*lines)).alias("raw"))


@query("""WITH O AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY 1),
 F AS (SELECT o_custkey, unnest([{'m': 'total_accesses', 't': '', 'v': n::DOUBLE}, {'m': 'total_kbytes_sent', 't': '', 'v': total::DOUBLE}, {'m': 'request_per_sec', 't': '', 'v': n + 0.5}, {'m': 'active_connections', 't': '', 'v': n::DOUBLE}, {'m': 'server_accepts', 't': '', 'v': n::DOUBLE}, {'m': 'server_handled', 't': '', 'v': n::DOUBLE}, {'m': 'server_requests', 't': '', 'v': total::DOUBLE},
 {'m': 'reading', 't': '', 'v': n::DOUBLE}, {'m': 'writing', 't': '', 'v': 1.0::DOUBLE}, {'m': 'waiting', 't': '', 'v': total::DOUBLE}, {'m': 'innodb.locks.spin_waits', 't': 'mutex', 'v': n::DOUBLE}, {'m': 'innodb.locks.rounds', 't': 'mutex', 'v': total::DOUBLE}, {'m': 'innodb.locks.os_waits', 't': 'mutex', 'v': 3.0::DOUBLE}, {'m': 'app.mem.bytes', 't': 'resident', 'v': n * 1024.0::DOUBLE},
 {'m': 'app.disk.bytes', 't': 'read', 'v': total::DOUBLE}, {'m': 'app.net.sockets_in_use', 't': 'tcp', 'v': n::DOUBLE}, {'m': 'memory_bytes', 't': 'free', 'v': n::DOUBLE}, {'m': 'memory_bytes', 't': 'total', 'v': n * 1000.0::DOUBLE}, {'m': 'memory_bytes', 't': 'max', 'v': 1500.0::DOUBLE}]) AS f FROM O)
 SELECT o_custkey, f.m AS metric, f.t AS type, f.v AS value FROM F""")
def extract_status_fields(spark, sf_dir):
    rules = parse.APACHE_STATUS + parse.NGINX_STATUS + parse.ENGINE_STATUS + parse.PROC_STATUS + parse.PROC_IO + parse.SOCKET_STATUS + parse.JVM_STATUS
    out = parse.extract_fields(_status_text(spark, sf_dir), rules)
    return out.select("o_custkey", "metric", F.coalesce(F.try_element_at("extra", F.lit("type")), F.lit("")).alias("type"), "value")


@query("""WITH O AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY 1)
 SELECT o_custkey, 'TcpExt' AS protocol, unnest(['TCPRenoRecovery', 'TCPSackRecovery', 'Other']) AS name, unnest([n, total, 7]) AS value FROM O UNION ALL SELECT o_custkey, 'IpExt', unnest(['InOctets', 'OutOctets']), unnest([total, n]) FROM O""")
def pair_header_values(spark, sf_dir):
    return parse.pair_header_values(_netstat(spark, sf_dir), ["o_custkey"], ["line"])


def _netstat(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice").cast("long")).alias("total"))
    n, t = F.col("n").cast("string"), F.col("total").cast("string")
    lines = F.array(F.lit("TcpExt: TCPRenoRecovery TCPSackRecovery Other"), F.concat(F.lit("TcpExt: "), n, F.lit(" "), t, F.lit(" 7")), F.lit("IpExt: InOctets OutOctets"), F.concat(F.lit("IpExt: "), t, F.lit(" "), n))
    return o.select("o_custkey", F.posexplode(lines).alias("line", "raw"))


@query("SELECT o_custkey, CAST(count(*) + sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS value FROM orders GROUP BY 1")
def retransmits(spark, sf_dir):
    return parse.sum_retransmits(parse.pair_header_values(_netstat(spark, sf_dir), ["o_custkey"], ["line"]), ["o_custkey"])


@query("""SELECT l_orderkey, l_linenumber, unnest(['app.cpu', 'app.cpu', 'app.nice', 'app.threads', 'app.mem.majflt', 'app.io.wait', 'app.start']) AS metric, unnest(['user', 'system', '', '', '', '', '']) AS type, unnest([l_partkey, l_suppkey, 16, l_linenumber, 9, 390, 190])::DOUBLE AS value FROM lineitem""")
def parse_proc_stat(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    place = {11: F.col("l_partkey").cast("string"), 12: F.col("l_suppkey").cast("string"), 17: F.col("l_linenumber").cast("string")}
    raw = F.concat(F.lit("77 (a b) "), F.concat_ws(" ", *(place.get(i, F.lit("S" if i == 0 else str(i))) for i in range(45))))
    return parse.parse_proc_stat(li.select("l_orderkey", "l_linenumber", raw.alias("raw"))).select("l_orderkey", "l_linenumber", "metric", F.coalesce("type", F.lit("")).alias("type"), "value")


@query("SELECT event_type AS state, count(*) AS count FROM events GROUP BY 1")
def count_by_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("command", F.initcap("event_type"))
    return reports.count_by_state(e, "command")


@query("SELECT event_type, min(value) AS least, round(avg(value), 6) AS average, max(value) AS greatest FROM events GROUP BY 1")
def timing_stats(spark, sf_dir):
    return reports.timing_stats(table(spark, sf_dir, "events"), "event_type", "value").withColumn("average", F.round("average", 6))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, l_returnflag FROM lineitem GROUP BY l_returnflag")
def total_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("long"))
    return reports.total_stats(li, ["l_linenumber", "quantity"], ["l_returnflag"])


@query("SELECT o_custkey, epoch_us(max(o_orderdate)) AS t, arg_min(o_orderkey, (-epoch_us(o_orderdate), o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_checkpoint(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("t", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return reports.latest_state(o, "o_custkey", "t", ["o_orderkey"])


@query("""WITH C AS (SELECT ts, event_id AS copied, event_id // 100 AS skipped, event_id % 50 AS pending FROM events),
 L AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS w, arg_max(copied, ts) AS c, arg_max(skipped, ts) AS s, arg_max(copied + skipped + pending, ts) AS p FROM C GROUP BY 1),
 D AS (SELECT w, (c - lag(c) OVER o) / epoch(w - lag(w) OVER o) AS a, (p - lag(p) OVER o) / epoch(w - lag(w) OVER o) AS b, s > lag(s) OVER o AS k FROM L WINDOW o AS (ORDER BY w))
 SELECT epoch_us(w) AS window_start, a AS copied_per_second, b AS produced_per_second, k AS skipping FROM D WHERE a IS NOT NULL""")
def throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("copied"), F.floor(F.col("event_id") / 100).alias("skipped"), (F.col("event_id") % 50).alias("pending"))
    return reports.throughput(e, "ts", "6 hours").withColumn("window_start", F.unix_micros("window_start"))


@query("""WITH K AS (SELECT doc_id, {'lang': coalesce(lang, ''), 'source': coalesce(source, ''), 'x': '1'} AS m FROM documents)
 SELECT doc_id, 'lang=' || m.lang || ',x=1' AS csv, 'l_lang' AS prefixed, CASE WHEN m.lang = 'en' THEN 'x' ELSE 'lang,x' END AS changed, m.source || '!' AS merged, md5('{"c0":[{"key":"lang","value":"' || m.lang || '"},{"key":"x","value":"1"}]}') AS digest FROM K""")
def label_maps(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")), F.lit("x"), F.lit("1")).alias("m"))
    m = F.col("m")
    parent = F.create_map(F.lit("lang"), F.lit("en"), F.lit("source"), m["source"])
    own = F.create_map(F.lit("source"), F.concat(m["source"], F.lit("!")))
    digest = text.row_digest(text.sorted_map(F.map_filter(m, lambda k, _: k != "source")))
    return d.select("doc_id", text.labels_csv(m, ["*"], ["s*"]).alias("csv"), F.array_join(F.map_keys(text.label_filter(m, ["l*"], [], "l_")), ",").alias("prefixed"), F.array_join(F.array_sort(F.map_keys(text.diff_attrs(m, parent))), ",").alias("changed"), text.merge_attrs(m, own)["source"].alias("merged"), digest.alias("digest"))


@query("SELECT event_id, event_type || '-' || user_id || '/${nope}/' || event_type AS a, 'p=' || event_type AS b, user_id::VARCHAR AS picked FROM events")
def substituted(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("m", F.create_map(F.lit("type"), F.col("event_type"), F.lit("user.id"), F.col("user_id").cast("string")))
    return e.select("event_id", text.substitute("${type}-${user.id}/${nope}/$type", F.col("m")).alias("a"), text.substitute_column(F.lit("p=${type}"), F.col("m")).alias("b"), text.pick_fields(F.col("m"), {"user.id": "uid", "gone": "x"}, {"monitor_id": "j"})["uid"].alias("picked"))


@query("""SELECT event_id, 'details "it""s ' || event_type || '" user="' || user_id || '"' AS a, event_type || ' q="x"' AS b FROM events""".replace('it""s', "it is"))
def format_details(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    quoted = F.create_map(F.lit("q"), F.lit('"x"'))
    return e.select("event_id", text.format_details(F.concat(F.lit("it is "), "event_type"), user).alias("a"), text.format_details(F.col("event_type"), quoted, raw=True, detect_escaped=True).alias("b"))


@query("""WITH K AS (SELECT doc_id, text, (SELECT max(k) FROM (SELECT unnest(range(101)) AS k) WHERE strlen(left(text, k)) <= 100) AS k FROM documents),
 C AS (SELECT doc_id, left(text, k) AS whole, CASE WHEN strlen(text) > 100 AND strlen(left(text, k)) < 100 THEN chr(65533) ELSE '' END AS half FROM K)
 SELECT doc_id, whole || half AS lenient, whole || '... (3 more bytes)' AS cut FROM C WHERE whole IS NOT NULL""")
def lenient_bytes(spark, sf_dir):
    """The first hundred bytes of documents, which may end in half a character."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    first = F.substring(F.col("text").cast("binary"), F.lit(1), F.lit(100))
    marked = F.unhex(F.concat(F.hex(first), F.hex(F.lit("... (3 more bytes)"))))
    return d.select("doc_id", text.decode_lenient(first).alias("lenient"), text.clean_truncated(marked).alias("cut"))


@query("""SELECT event_id, (3 << 16) | user_id AS instance_id, event_type || ',b' AS keywords, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, 'u' || user_id AS user, 'v' AS named, event_type AS placed, '2nd' AS doubled FROM events""")
def event_log_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    data = F.array(F.struct(F.lit("@Name").alias("name"), F.lit("v").alias("text")), F.struct(F.lit(None).cast("string").alias("name"), F.col("event_type").alias("text")), F.struct(F.lit("@Name").alias("name"), F.lit("2nd").alias("text")))
    rows = e.select("event_id", F.lit(3).alias("qualifiers"), F.col("user_id"), F.array("event_type", F.lit("b")).alias("keywords"), "ts", F.concat(F.lit("PySID:u"), F.col("user_id").cast("string")).alias("user"), parse.event_data_map(data).alias("d"))
    out = parse.event_log_fields(rows.withColumn("_id", F.col("event_id")).withColumn("event_id", F.col("user_id")))
    return out.select(F.col("_id").alias("event_id"), "instance_id", "keywords", "time", "user", F.col("d")["Name"].alias("named"), F.col("d")["1"].alias("placed"), F.col("d")["Name2"].alias("doubled"))


@query("""SELECT event_id AS record_id, 'P&' || user_id AS provider, (2 << 16) | (event_id % 100) AS instance_id, 'Security' AS channel, epoch_us(date_trunc('seconds', ts)) AS at, 'S-1-' || user_id AS user, event_type || ',x' AS keywords,
 CASE WHEN event_id % 4 = 0 THEN '' ELSE '<' || event_type || '> & "' END AS named, event_type AS placed, CAST(event_id AS VARCHAR) AS doubled, event_id % 7 = 0 AS error FROM events WHERE event_id % 7 <> 0
 UNION ALL SELECT -1, '', -1, '', -1, '', '', '', '', '', true FROM events WHERE event_id % 7 = 0""")
def event_xml_rows(spark, sf_dir):
    """Events as XML text, with names, marks, empty data and doubled names; every seventh text is cut off."""
    e = table(spark, sf_dir, "events")
    c, n = (lambda x: F.col(x).cast("string")), F.col("event_id")
    lit = F.lit
    at = F.date_format(F.date_trunc("second", F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    xml = F.concat(
        lit('<Event xmlns="http://schemas.example/event"><System><Provider Name="P&amp;'), c("user_id"), lit('" Guid="{0}"/><EventID Qualifiers="2">'), (n % 100).cast("string"), lit("</EventID><Level>4</Level><TimeCreated SystemTime=\""), at,
        lit('"/><EventRecordID>'), c("event_id"), lit('</EventRecordID><Channel>Security</Channel><Computer>host</Computer><Security UserID="S-1-'), c("user_id"), lit('"/></System><EventData><Data Name="first">'),
        F.when(n % 4 == 0, "").otherwise(F.concat(lit("&lt;"), c("event_type"), lit('&gt; &amp; "'))), lit("</Data><Data>"), c("event_type"), lit('</Data><Data Name="first">'), c("event_id"), lit("</Data></EventData><RenderingInfo><Message>m</Message><Keywords><Keyword>"),
        c("event_type"), lit("</Keyword><Keyword>x</Keyword></Keywords></RenderingInfo></Event>"),
    )
    rows = parse.parse_event_xml(e.select(F.when(n % 7 == 0, F.substring(xml, 1, 120)).otherwise(xml).alias("xml")))
    out = parse.event_log_fields(rows.withColumn("d", parse.event_data_map(F.col("data"))))
    some = lambda x, v: F.coalesce(x, F.lit(v))
    key = lambda k: some(F.try_element_at("d", F.lit(k)), "")
    return out.select(some(F.col("record_id"), -1).alias("record_id"), some(F.col("provider"), "").alias("provider"), some(F.col("instance_id"), -1).alias("instance_id"), some(F.col("channel"), "").alias("channel"), some(F.unix_micros("ts"), -1).alias("at"), some(F.col("user"), "").alias("user"), some(F.col("keywords"), "").alias("keywords"), key("first").alias("named"), key("1").alias("placed"), key("first2").alias("doubled"), "error")


@query("""SELECT event_id, event_type AS metric, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN CAST(event_id || '.25' AS DOUBLE) ELSE -1 END::DOUBLE AS value, CASE WHEN event_id % 3 = 2 THEN 'n' || event_id ELSE '' END AS value_str FROM events""")
def typed_values(spark, sf_dir):
    """Whole numbers, fractions and texts."""
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    v = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".25"))).otherwise(F.concat(F.lit("n"), n))
    t = M.typed_metrics(table(spark, sf_dir, "events").select("event_id", "event_type", v.alias("v")), "event_type", "v")
    return t.select("event_id", "metric", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("value_str", F.lit("")).alias("value_str"))

