"""Queries over inventories: customers are containers, nations pods, regions namespaces, orders states and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from logspark.functions import text
from logspark.model import LogConfig
from logspark.operators import inventory as I  # noqa: E741
from logspark.operators import joins as J
from logspark.operators import parse
from logspark.plans import pipelines
from logspark.plans.registry import query, table


def _containers(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    df = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return df.select(F.col("c_custkey").alias("cid"), F.col("c_name").alias("name"), F.col("n_name").alias("pod"), F.col("r_name").alias("namespace"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("attributes"), F.col("c_acctbal").alias("digest"))


def _pods(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).where("n_nationkey % 5 <> 0").select(F.col("r_name").alias("namespace"), F.col("n_name").alias("pod"), F.concat(F.lit("uid"), F.col("n_nationkey").cast("string")).alias("uid"), F.lit("node1").alias("node"), F.create_map(F.lit("app"), F.col("n_name")).alias("labels"), F.lit("Deployment/x").alias("controller"))


@query("""SELECT c_custkey AS cid, CASE WHEN n_nationkey % 5 <> 0 THEN 'uid' || n_nationkey ELSE 'none' END AS pod_uid, CASE WHEN n_nationkey % 5 <> 0 THEN n_name ELSE '' END AS app, CASE WHEN n_nationkey % 5 <> 0 THEN 'Deployment/x' ELSE 'none' END AS controller
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def attach_pod(spark, sf_dir):
    out = J.attach_pod(_containers(spark, sf_dir), _pods(spark, sf_dir))
    return out.select("cid", "pod_uid", F.coalesce(F.try_element_at("pod_labels", F.lit("app")), F.lit("")).alias("app"), "controller")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE coalesce(c_mktsegment, '') END AS segment, o_orderpriority AS prio FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def attach_attributes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("segment"), F.lit("own"), F.lit("prio"), F.col("o_orderpriority"))).otherwise(F.create_map(F.lit("prio"), F.col("o_orderpriority")))
    lines = o.select("o_orderkey", F.col("o_custkey").alias("log_path"), own.alias("attrs"))
    logs = _containers(spark, sf_dir).select(F.col("cid").alias("log_path"), "attributes")
    out = J.attach_attributes(lines, logs)
    return out.select("o_orderkey", F.coalesce(F.try_element_at("attrs", F.lit("segment")), F.lit("")).alias("segment"), F.col("attrs")["prio"].alias("prio"))


_CONFIGS = [LogConfig("special", namespace="A*", pod="NATION_1*", attributes={"k": "1"}), LogConfig("seven", container="*[!0-6]7", parser="json"), LogConfig("europe", namespace="EUROPE")]


@query("""SELECT c_custkey AS cid, CASE WHEN r_name LIKE 'A%' AND n_name LIKE 'NATION_1%' THEN 'special' WHEN regexp_matches(c_name, '[^0-6]7$') THEN 'seven' WHEN r_name = 'EUROPE' THEN 'europe' ELSE '' END AS config,
 CASE WHEN NOT (r_name LIKE 'A%' AND n_name LIKE 'NATION_1%') AND regexp_matches(c_name, '[^0-6]7$') THEN 'json' ELSE '' END AS parser FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""".replace("LIKE 'NATION_1%'", "LIKE 'NATION#_1%' ESCAPE '#'"))
def first_matching_config(spark, sf_dir):
    out = J.first_matching(_containers(spark, sf_dir), _CONFIGS, {"namespace": "namespace", "pod": "pod", "container": "name"})
    return out.select("cid", F.coalesce("config", F.lit("")).alias("config"), F.coalesce("config_parser", F.lit("")).alias("parser"))


@query("""SELECT c_custkey AS cid, coalesce((SELECT arg_min('r' || r_regionkey, r_regionkey) FROM region WHERE c_nationkey % 5 >= r_regionkey AND r_regionkey > 1), '') AS config FROM customer""")
def first_matching_table(spark, sf_dir):
    """Configs from a table: a pattern for each region, of which the first that is found counts."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cid"), F.rpad(F.lit(""), F.col("c_nationkey") % 5, F.lit("x")).alias("path"))
    r = table(spark, sf_dir, "region").where("r_regionkey > 1").select(F.col("r_regionkey").alias("position"), F.concat(F.lit("^x{"), F.col("r_regionkey").cast("string"), F.lit(",}$")).alias("pattern"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("config"))
    return J.first_matching_table(c, r, "path").select("cid", F.coalesce("config", F.lit("")).alias("config"))


@query("""SELECT event_id, CASE WHEN regexp_matches(event_type, '^(?:cl)') THEN 'unit' WHEN CAST(user_id AS VARCHAR) LIKE '1%' AND event_type LIKE '%e%' THEN 'globs' ELSE 'default' END AS config FROM events""")
def match_journal(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("unit"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("fields"))
    return J.match_journal(e, [{"name": "unit", "unit": "cl"}, {"name": "missing", "globs": {"none": "*"}}, {"name": "globs", "globs": {"user": "1*", "unit": "*e*"}}]).select("event_id", "config")


_TREE = """T AS (SELECT o_orderkey AS pid, CASE WHEN o_orderkey = 0 THEN 0 ELSE o_orderkey - 1 - o_orderkey % 7 END AS ppid, o_orderpriority AS cmd FROM orders)"""


def _processes(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("pid"), F.when(k == 0, F.lit(0).cast("long")).otherwise(k - 1 - k % 7).alias("ppid"), F.col("o_orderpriority").alias("cmd"), k)


@query(f"""WITH RECURSIVE {_TREE}, D AS (SELECT pid FROM T WHERE pid % 97 = 5 AND regexp_matches(cmd, 'URGENT|HIGH') UNION SELECT T.pid FROM T JOIN D ON T.ppid = D.pid AND T.pid <> T.ppid) SELECT pid FROM D""")
def descendants(spark, sf_dir):
    p = _processes(spark, sf_dir)
    return J.descendants(p, (F.col("pid") % 97 == 5) & F.col("cmd").rlike("URGENT|HIGH"))


@query(f"""WITH RECURSIVE {_TREE}, K AS (SELECT pid, ppid, CASE WHEN pid % 31 = 0 THEN 'Odd' ELSE 'Job' END AS kind FROM T),
 W AS (SELECT pid, pid AS top FROM K UNION ALL SELECT W.pid, p.pid FROM W JOIN K k ON k.pid = W.top JOIN K p ON p.pid = k.ppid AND p.pid <> k.pid AND p.kind = 'Job')
 SELECT pid AS name, min(top) AS root FROM W GROUP BY pid""")
def root_owner(spark, sf_dir):
    o = _processes(spark, sf_dir).select(F.col("pid").alias("name"), F.when(F.col("pid") % 31 == 0, "Odd").otherwise("Job").alias("kind"), F.col("ppid").alias("parent"))
    return J.root_owner(o, ["Job"]).select("name", "root")


@query("SELECT DISTINCT o_orderkey AS pid FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 1")
def dead_processes(spark, sf_dir):
    p = _processes(spark, sf_dir)
    return J.dead_processes(p.where("pid % 3 = 0"), p.where("pid % 2 = 0"))


@query("SELECT o_orderkey AS pid FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-')")
def match_processes(spark, sf_dir):
    return J.match_processes(_processes(spark, sf_dir), "^[12]-").select("pid")


@query("SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '^[\\p{L}\\p{N}_]+[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0][\\p{L}\\p{N}_]*[^\\x00-\\x7F][\\p{L}\\p{N}_]*([^\\p{L}\\p{N}_]|$)')")
def match_unicode_processes(spark, sf_dir):
    """Commands (texts of documents) whose second word has a letter that isn't ASCII; the pattern's group has a name that Java lacks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("cmd"))
    return J.match_processes(d, r"^\w+\s(?P<second_word>\w*[^\x00-\x7f]\w*)(?:\W|$)").select("doc_id")


@query("""SELECT c_custkey AS cid, unnest(CASE WHEN c_custkey % 4 = 0 THEN ['own'] WHEN c_nationkey % 3 = 0 THEN ['pod', 'pod' || c_nationkey] WHEN r_regionkey = 1 THEN ['ns'] ELSE [''] END) AS destination FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def fan_out(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    none = F.array().cast("array<string>")
    df = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("cid"), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("own"))).otherwise(none).alias("a"), F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("pod"), F.concat(F.lit("pod"), F.col("c_nationkey").cast("string")))).alias("b"), F.when(F.col("n_regionkey") == 1, F.array(F.lit("ns"))).alias("c"))
    return J.fan_out(df, "a", "b", "c").select("cid", F.coalesce("destination", F.lit("")).alias("destination"))


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def known_pods_only(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("uid", F.col("o_custkey"))
    return J.known_only(o, table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("uid"))).select("o_orderkey")


@query("""SELECT o_orderkey, coalesce(n_name, '%%' || (o_custkey % 40)) AS a, 'plain' AS b FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40 AND (CASE WHEN o_orderkey % 2 = 0 THEN n_nationkey % 2 = 0 ELSE true END)""")
def resolve_placeholders(spark, sf_dir):
    """Even orders are in the Security channel, which has messages of even numbers only."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "Security").otherwise("System").alias("channel"), F.lit("p").alias("provider"), F.create_map(F.lit("a"), F.concat(F.lit("%%"), (F.col("o_custkey") % 40).cast("string")), F.lit("b"), F.lit("plain")).alias("data"))
    n = table(spark, sf_dir, "nation")
    m = n.select(F.lit("System").alias("channel"), F.lit("p").alias("provider"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("message"))
    m = m.unionByName(n.where("n_nationkey % 2 = 0").select(F.lit("Security").alias("channel"), F.lit("Microsoft-Windows-Security-Auditing").alias("provider"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("message")))
    out = J.resolve_placeholders(o, m, ["o_orderkey"])
    return out.select("o_orderkey", F.col("data")["a"].alias("a"), F.col("data")["b"].alias("b"))


@query("SELECT o_orderkey, coalesce(c_name, '') AS container_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def resolve_container(spark, sf_dir):
    """Ids of 64 digits; every third line has the short form of 12."""
    digest = lambda c: F.sha2(F.col(c).cast("string"), 256)
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(digest("c_custkey").alias("cid"), F.col("c_name").alias("name"), F.create_map(F.lit("s"), F.col("c_mktsegment")).alias("labels"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.substring(digest("o_custkey"), 1, 12)).otherwise(digest("o_custkey")).alias("cid"))
    return J.resolve_container(o, c).select("o_orderkey", F.coalesce("container_name", F.lit("")).alias("container_name"))


@query("SELECT o_orderkey, coalesce(regexp_extract(o_orderpriority, '^(\\d)-', 1), '') AS cid, substr(o_orderpriority, 3) AS rest FROM orders")
def extract_container(spark, sf_dir):
    x = parse.extract_container(F.col("o_orderpriority"), r"^(\d)-", None)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(x["cid"], F.lit("")).alias("cid"), x["rest"].alias("rest"))


@query("""WITH A AS (SELECT user_id, sum(event_id) AS d FROM events WHERE day(ts) = 3 GROUP BY 1), B AS (SELECT user_id, sum(event_id) AS d FROM events WHERE day(ts) = 4 GROUP BY 1)
 SELECT coalesce(B.user_id, A.user_id) AS user_id, CASE WHEN A.user_id IS NULL THEN 'started' WHEN B.user_id IS NULL THEN 'stopped' ELSE 'changed' END AS status FROM A FULL JOIN B USING (user_id) WHERE A.d IS DISTINCT FROM B.d""")
def snapshot_diff(spark, sf_dir):
    """Users of two days as snapshots."""
    e = table(spark, sf_dir, "events")
    day = lambda d: e.where(F.dayofmonth("ts") == d).groupBy("user_id").agg(F.sum("event_id").alias("d"))
    return I.diff_snapshots(day(3), day(4), "user_id", F.col("d"))


@query("""WITH S AS (SELECT day(ts) AS n, user_id, count(*) AS d FROM events WHERE day(ts) NOT IN (7, 15) GROUP BY ALL), N AS (SELECT n, lag(n) OVER (ORDER BY n) AS b FROM (SELECT DISTINCT n FROM S)),
 P AS (SELECT N.n, S.user_id, S.d FROM N JOIN S ON S.n = N.b), C AS (SELECT N.n, S.user_id, S.d FROM N JOIN S ON S.n = N.n WHERE N.b IS NOT NULL)
 SELECT coalesce(C.user_id, P.user_id) AS user_id, coalesce(C.n, P.n) AS snapshot, CASE WHEN P.user_id IS NULL THEN 'started' WHEN C.user_id IS NULL THEN 'stopped' ELSE 'changed' END AS status FROM P FULL JOIN C ON P.n = C.n AND P.user_id = C.user_id WHERE P.d IS DISTINCT FROM C.d""")
def follow_snapshots(spark, sf_dir):
    """Days as snapshots; two of them failed."""
    e = table(spark, sf_dir, "events").withColumn("n", F.dayofmonth("ts").cast("long"))
    s = e.groupBy("n", "user_id").agg(F.count("*").alias("d"))
    return I.follow_snapshots(s, "user_id", "n", "d", e.where(F.col("n").isin(7, 15)).select("n").distinct())


def _stats(spark, sf_dir):
    """A statistics object of each supplier: the sums of its items."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("q"))
    net = F.create_map(F.lit("rx_bytes"), F.col("n"), F.lit("tx_bytes"), F.col("q"), F.lit("other"), F.lit(1.0))
    memory = F.struct(F.create_map(F.lit("cache"), F.lit(3.0), F.lit("rss"), F.col("n")).alias("stats"), F.col("q").alias("usage"), F.lit(100.0).alias("limit"))
    cpu = F.struct(F.struct(F.array("n", "q").alias("percpu_usage"), F.col("q").alias("total_usage")).alias("cpu_usage"), F.lit(5.0).alias("system_cpu_usage"), F.create_map(F.lit("periods"), F.col("n")).alias("throttling_data"))
    return li.select("l_suppkey", F.to_json(F.struct(F.create_map(F.lit("eth0"), net).alias("networks"), memory.alias("memory_stats"), cpu.alias("cpu_stats"))).alias("stats"))


@query("""WITH L AS (SELECT l_suppkey, count(*)::DOUBLE AS n, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS q FROM lineitem GROUP BY 1)
 SELECT l_suppkey, unnest(['docker.net.rx_bytes', 'docker.net.tx_bytes', 'docker.mem.stat.cache', 'docker.mem.stat.rss', 'docker.mem.usage', 'docker.mem.limit', 'docker.cpu.total_usage', 'docker.cpu.system_cpu_usage', 'docker.cpu.throttling.periods', 'docker.cpu.usage', 'docker.cpu.usage']) AS metric,
 unnest(['eth0', 'eth0', '', '', '', '', '', '', '', '1', '2']) AS label, unnest([n, q, 3.0, n, q - 3, 100.0, q, 5.0, n, n, q]) AS value FROM L""")
def unpivot_container_stats(spark, sf_dir):
    out = I.unpivot_container_stats(_stats(spark, sf_dir), ["l_suppkey"], subtract_cache=True)
    return out.select("l_suppkey", "metric", F.coalesce(F.try_element_at("extra", F.lit("interface")), F.try_element_at("extra", F.lit("cpu")), F.lit("")).alias("label"), "value")


@query("""WITH L AS (SELECT l_suppkey, count(*)::DOUBLE AS n, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS q FROM lineitem GROUP BY 1)
 SELECT l_suppkey, unnest(['k8s.pod.network.rx_bytes', 'k8s.pod.network.tx_errors', 'docker.mem.usage', 'docker.mem.stat.total_rss', 'docker.cpu.total_usage']) AS metric, unnest([n, 0.0, q, n, q]) AS value FROM L""")
def unpivot_kubelet_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("q"))
    df = li.select("l_suppkey", F.create_map(F.lit("rxBytes"), F.col("n"), F.lit("txErrors"), F.lit(0.0)).alias("network"), F.create_map(F.lit("usageBytes"), F.col("q"), F.lit("rssBytes"), F.col("n")).alias("memory"), F.create_map(F.lit("usageCoreNanoSeconds"), F.col("q")).alias("cpu"))
    return I.unpivot_kubelet_stats(df, ["l_suppkey"], "network", "memory", "cpu")


@query("""SELECT o_orderkey, unnest(['slave.bytes_executed', 'slave.bytes_relayed', 'slave.io_running', 'slave.sql_running']) AS metric, unnest([o_custkey, o_orderkey, 1, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END])::DOUBLE AS value FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_orderkey, 'slave.seconds_behind_master', o_orderkey::DOUBLE FROM orders WHERE o_orderkey % 4 = 0""")
def unpivot_replica(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, F.when(k % 2 == 0, "m1").otherwise("").alias("master_host"), F.when(k % 4 == 0, k.cast("string")).otherwise("NULL").alias("seconds_behind_master"), F.col("o_custkey").alias("exec_master_log_pos"), k.alias("read_master_log_pos"), F.lit("Yes").alias("slave_io_running"), F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("slave_sql_running"))
    return I.unpivot_replica(o, ["o_orderkey"])


_COUNTERS = ("questions", "slow_queries", "max_used_connections", "connections", "aborted_clients", "aborted_connects", "com_select", "com_delete", "com_insert", "com_update", "com_replace", "qcache_hits", "select_range_check", "select_full_join", "opened_tables", "open_tables", "open_files", "table_locks_waited", "table_locks_immediate", "threads_created", "created_tmp_tables", "created_tmp_disk_tables")


def _status_rows(spark, sf_dir):
    """Counters of each customer as a database host: the i-th is (orders + i) * (i + 1) % 11."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit("status").alias("kind"), F.lit(c).alias("name"), ((F.col("n") + i) * (i + 1) % 11).cast("double").alias("value")) for i, c in enumerate(_COUNTERS)]
    rows += [F.struct(F.lit("variable").alias("kind"), F.lit(c).alias("name"), v.cast("double").alias("value")) for c, v in (("max_connections", F.col("n") % 5 + 1), ("open_files_limit", F.col("n") % 3), ("unrelated", F.lit(1)))]
    rows.append(F.struct(F.lit("status").alias("kind"), F.lit("com_begin").alias("name"), F.lit(1.0).alias("value")))
    return o.select("o_custkey", F.explode(F.array(*rows)).alias("r")).select("o_custkey", "r.*")


_C = "WITH O AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), C AS (SELECT o_custkey, n, " + ", ".join(f"((n + {i}) * {i + 1} % 11)::DOUBLE AS {c}" for i, c in enumerate(_COUNTERS)) + ", (n % 5 + 1)::DOUBLE AS max_connections, (n % 3)::DOUBLE AS open_files_limit FROM O)"


@query(f"""{_C}, W AS (SELECT *, com_delete + com_insert + com_update + com_replace AS w FROM C)
 SELECT o_custkey, 'derived.' || unnest(['slow_query_percentage', 'connections_used_percentage', 'aborted_connections_percentage', 'aborted_clients_percentage', 'read_percentage', 'write_percentage', 'query_cache_efficiency', 'joins_without_indexes', 'table_cache_hit_rate', 'open_file_percentage', 'immediate_table_lock_percentage', 'thread_cache_hit_rate', 'tmp_disk_table_percentage']) AS metric,
 round(unnest([CASE WHEN questions > 0 THEN 100 * slow_queries / questions ELSE 0 END, least(100, 100 * max_used_connections / max_connections), CASE WHEN connections > 0 THEN 100 * aborted_connects / connections ELSE 0 END, CASE WHEN connections > 0 THEN 100 * aborted_clients / connections ELSE 0 END,
 CASE WHEN com_select + w > 0 THEN 100 * com_select / (com_select + w) ELSE 0 END, CASE WHEN com_select + w > 0 THEN 100 * w / (com_select + w) ELSE 0 END, CASE WHEN com_select + qcache_hits > 0 THEN 100 * qcache_hits / (com_select + qcache_hits) ELSE 0 END, select_range_check + select_full_join,
 CASE WHEN opened_tables > 0 THEN 100 * open_tables / opened_tables ELSE 100 END, CASE WHEN open_files_limit > 0 THEN 100 * open_files / open_files_limit ELSE 0 END, CASE WHEN table_locks_waited > 0 THEN 100 * table_locks_immediate / (table_locks_waited + table_locks_immediate) ELSE 100 END,
 CASE WHEN connections > 0 THEN 100 - threads_created / connections ELSE 100 END, CASE WHEN created_tmp_tables > 0 THEN 100 * created_tmp_disk_tables / created_tmp_tables ELSE 0 END]), 6) AS value FROM W""")
def derived_ratios(spark, sf_dir):
    return I.derived_ratios(_status_rows(spark, sf_dir), ["o_custkey"]).withColumn("value", F.round("value", 6))


@query(f"""{_C} SELECT o_custkey, unnest([{', '.join(f"'{c}'" for c in _COUNTERS)}, 'max_connections', 'open_files_limit']) AS name FROM C""")
def report_status_rows(spark, sf_dir):
    return I.report_status_rows(_status_rows(spark, sf_dir)).select("o_custkey", "name")


@query("""WITH I AS (SELECT user_id AS host, ts, event_id * 100 AS m, event_id * 99 AS r FROM events), P AS (SELECT host, ts, m - r AS d, CAST(trunc((m - lag(m) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6) * 100) AS BIGINT) AS c FROM (SELECT host, ts, max(m) * 10 AS m, max(r) * 10 AS r FROM I WHERE m > 0 GROUP BY ALL) WINDOW w AS (PARTITION BY host ORDER BY ts))
 SELECT host, epoch_us(ts) AS ts, d AS offset_diff, coalesce(c, -1) AS master_change, coalesce(CASE WHEN c <> 0 THEN CAST(trunc(d / c) AS BIGINT) END, -1) AS lag_seconds FROM P""".replace(" * 100) AS BIGINT) AS c", ") AS BIGINT) AS c"))
def replication_lag(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    info = e.select(F.col("user_id").alias("host"), "ts", (F.col("event_id") * 1000).alias("master_offset"), F.explode(F.array(F.col("event_id") * 990, F.col("event_id") * 5)).alias("replica_offset"))
    out = I.replication_lag(info)
    return out.select("host", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "offset_diff", F.coalesce("master_change", F.lit(-1)).alias("master_change"), F.coalesce("lag_seconds", F.lit(-1)).alias("lag_seconds"))


@query("""SELECT c_custkey AS cid, r_name IN ('ASIA', 'AFRICA', 'EUROPE') AND r_name <> 'AFRICA' AS passes, r_name <> 'EUROPE' AS all_but, CASE WHEN c_custkey % 5 = 0 THEN false WHEN c_custkey % 5 = 1 THEN true WHEN c_nationkey % 2 = 0 THEN false ELSE true END AS included
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def container_filters(spark, sf_dir):
    df = _containers(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cid"), "c_nationkey"), "cid")
    own = F.when(F.col("cid") % 5 == 0, F.create_map(F.lit("exclude"), F.lit("true"))).when(F.col("cid") % 5 == 1, F.create_map(F.lit("include"), F.lit("yes"), F.lit("exclude"), F.lit("true")))
    pod = F.when(F.col("c_nationkey") % 2 == 0, F.create_map(F.lit("exclude"), F.lit("1")))
    n = F.col("namespace")
    return df.select("cid", J.namespace_passes(n, ["ASIA", "AFRICA", "EUROPE"], ["AFRICA"]).alias("passes"), J.namespace_passes(n, ["*"], ["kube-system"], ["EUROPE"]).alias("all_but"), J.included(own, pod).alias("included"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus <> 'F' OR o_orderdate >= TIMESTAMP '1997-01-01') AND o_orderkey % 10 <> 3")
def drop_old_dead(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") != "F").alias("running"), F.col("o_orderdate").alias("created"), (F.col("o_orderkey") % 10 == 3).alias("sandbox"))
    return J.drop_old_dead(o, F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id % 3 <> 0 AND event_id % 6 <> 0")
def relevant_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("event_type")).alias("kind"), F.concat(F.lit("ns"), (F.col("user_id") % 3).cast("string")).alias("namespace"))
    return J.relevant_events(e, ["click", "view"], J.namespace_passes(F.col("namespace"), [], ["ns0"])).select("event_id")


@query("""WITH S AS (SELECT user_id AS host, max(event_id) FILTER (WHERE event_id < 5000) + CASE WHEN user_id % 4 = 0 THEN 1000000 ELSE 0 END AS last_id, TIMESTAMP '2024-01-20' AS last_time, user_id % 4 = 0 AS reset FROM events GROUP BY 1)
 SELECT event_id AS id, NOT (user_id % 4 <> 0 AND last_id IS NOT NULL) AS gap FROM events JOIN S ON host = user_id WHERE CASE WHEN reset THEN ts > last_time ELSE event_id > last_id END OR last_id IS NULL""")
def new_rows_since(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("host"), F.col("event_id").alias("id"), F.col("ts").alias("time"))
    state = e.groupBy(F.col("user_id").alias("host")).agg((F.max(F.when(F.col("event_id") < 5000, F.col("event_id"))) + F.when(F.col("user_id") % 4 == 0, 1_000_000).otherwise(0)).alias("last_id")).withColumns({"last_time": F.lit("2024-01-20").cast("timestamp_ntz"), "reset": F.col("host") % 4 == 0})
    return J.new_rows_since(rows, state).select("id", "gap")


@query("""WITH K AS (SELECT c_custkey, c_custkey % 3 = 0 AS mixed FROM customer) SELECT c_custkey, unnest(['rules.000000000.match', 'rules.000000001.match', 'parser_name']) AS sort_key, unnest(['a' || c_custkey, 'b', 'p']) AS value FROM K WHERE NOT mixed""")
def annotation_rules(spark, sf_dir):
    pre = "log.config/"
    key = lambda k: F.lit(pre + k)
    own = F.create_map(key("rules.1.match"), F.lit("b"), key("rules.0.match"), F.concat(F.lit("a"), F.col("c_custkey").cast("string")), key("parser-name"), F.lit("p"), F.lit("other"), F.lit("x"))
    mixed = F.create_map(key("rules.0"), F.lit("a"), key("rules.name"), F.lit("b"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, mixed).otherwise(own).alias("annotations"))
    return parse.annotation_rules(c, ["c_custkey"], pre).select("c_custkey", "sort_key", "value")


@query("""WITH A AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 7 <> 0), B AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 5 <> 0),
 D AS (SELECT coalesce(B.c_custkey, A.c_custkey) AS cid, CASE WHEN A.c_custkey IS NULL THEN 'started' WHEN B.c_custkey IS NULL THEN 'stopped' END AS status FROM A FULL JOIN B USING (c_custkey))
 SELECT cid, status, CASE WHEN r_name LIKE 'A%' AND n_name LIKE 'NATION#_1%' ESCAPE '#' THEN 'special' WHEN regexp_matches(c_name, '[^0-6]7$') THEN 'seven' WHEN r_name = 'EUROPE' THEN 'europe' ELSE '' END AS config FROM D JOIN customer ON c_custkey = cid JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE status IS NOT NULL""")
def container_configs(spark, sf_dir):
    c = _containers(spark, sf_dir)
    out = pipelines.container_configs(c.where("cid % 7 <> 0"), c.where("cid % 5 <> 0"), _pods(spark, sf_dir), _CONFIGS)
    return out.select("cid", "status", F.coalesce("config", F.lit("")).alias("config"))


@query("SELECT c_custkey, c_mktsegment || '/' || n_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def template_paths(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("pod"), F.col("n_name"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", text.substitute("${segment}/$pod", m).alias("path"))
