"""Snapshots of inventories, and statistics of containers and databases as metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_snapshots(previous: DataFrame, current: DataFrame, key: str, digest: Column | None = None) -> DataFrame:
    """key, status: started, stopped or changed. Without a digest nothing counts as changed."""
    mark = (digest if digest is not None else F.lit(0)).alias("_d")
    a, b = previous.select(F.col(key).alias("_a"), mark), current.select(F.col(key).alias("_b"), mark.alias("_e"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    status = F.when(F.col("_a").isNull(), "started").when(F.col("_b").isNull(), "stopped").when(~F.col("_d").eqNullSafe(F.col("_e")), "changed")
    return both.select(F.coalesce("_b", "_a").alias(key), status.alias("status")).where("status is not null")


def follow_snapshots(snapshots: DataFrame, key: str, number: str, digest: str, failed: DataFrame | None = None) -> DataFrame:
    """key, snapshot, status over all snapshots in turn. snapshots: one row per key and snapshot; failed ones (by number) repeat the one before.

    numbers: the snapshots that took place, one row each; a key that is absent from the next one stopped in it.
    """
    numbers = snapshots.select(number).distinct()
    if failed is not None:
        numbers = numbers.join(failed.select(number), number, "left_anti")
    w = Window.orderBy(number)
    # one row per snapshot
    numbers = numbers.withColumns({"_before": F.lag(number).over(w), "_after": F.lead(number).over(w)})
    df = snapshots.join(numbers, number)
    k = Window.partitionBy(key).orderBy(number)
    df = df.withColumns({"_last": F.lag(number).over(k), "_digest": F.lag(digest).over(k), "_next": F.lead(number).over(k)})
    begun = F.when(~F.col("_last").eqNullSafe(F.col("_before")) & F.col("_before").isNotNull(), "started").when(F.col("_last").eqNullSafe(F.col("_before")) & F.col("_last").isNotNull() & ~F.col("_digest").eqNullSafe(F.col(digest)), "changed")
    ended = F.when(F.col("_after").isNotNull() & ~F.col("_next").eqNullSafe(F.col("_after")), "stopped")
    out = df.select(key, F.explode(F.array(F.struct(F.col(number).alias("snapshot"), begun.alias("status")), F.struct(F.col("_after").alias("snapshot"), ended.alias("status")))).alias("_e"))
    return out.select(key, "_e.snapshot", "_e.status").where("status is not null")


#: What container engines and the kubelet report, below the prefixes of their metrics.
NETWORK = ("rx_bytes", "rx_dropped", "rx_errors", "rx_packets", "tx_bytes", "tx_dropped", "tx_errors", "tx_packets")
MEMORY = ("max_usage", "usage", "fail_cnt", "limit")
MEMORY_STAT = (
    "total_pgmajfault", "cache", "mapped_file", "total_inactive_file", "pgpgout", "rss", "total_mapped_file", "writeback", "unevictable", "pgpgin",
    "total_unevictable", "pgmajfault", "total_rss", "total_rss_huge", "total_writeback", "total_inactive_anon", "rss_huge", "hierarchical_memory_limit",
    "total_pgfault", "total_active_file", "active_anon", "total_active_anon", "total_pgpgout", "total_cache", "inactive_anon", "active_file", "pgfault",
    "inactive_file", "total_pgpgin",
)
CPU_USAGE = ("usage_in_usermode", "total_usage", "usage_in_kernelmode")
THROTTLING = ("periods", "throttled_periods", "throttled_time")
KUBELET_NETWORK = {"rx_bytes": "rxBytes", "rx_errors": "rxErrors", "tx_bytes": "txBytes", "tx_errors": "txErrors"}
KUBELET_MEMORY = {"docker.mem.stat.total_pgfault": "pageFaults", "docker.mem.stat.total_pgmajfault": "majorPageFaults", "docker.mem.stat.total_rss": "rssBytes", "docker.mem.usage": "usageBytes", "docker.mem.workingSetBytes": "workingSetBytes", "docker.mem.availableBytes": "availableBytes"}
KUBELET_CPU = {"docker.cpu.total_usage": "usageCoreNanoSeconds", "docker.cpu.throttling.usageNanoCores": "usageNanoCores"}

STATS = (
    "networks map<string,map<string,double>>, network map<string,double>, "
    "memory_stats struct<stats:map<string,double>,max_usage:double,usage:double,fail_cnt:double,limit:double>, "
    "cpu_stats struct<cpu_usage:struct<percpu_usage:array<double>,usage_in_usermode:double,total_usage:double,usage_in_kernelmode:double>,system_cpu_usage:double,throttling_data:map<string,double>>"
)
METRICS = "array<struct<metric:string,value:double,extra:map<string,string>>>"


def _row(metric: Column, value: Column, *extra: Column | str) -> Column:
    fields = F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in extra)) if extra else F.from_json(F.lit("{}"), "map<string,string>")
    return F.struct(metric.alias("metric"), value.cast("double").alias("value"), fields.alias("extra"))


def _of_map(values: Column, names: tuple[str, ...], prefix: str, *extra: Column | str) -> Column:
    kept = F.filter(F.map_entries(values), lambda e: e["key"].isin(*names))
    return F.transform(kept, lambda e: _row(F.concat(F.lit(prefix), e["key"]), e["value"], *extra))


def unpivot_container_stats(df: DataFrame, keys: list[str], stats: str = "stats", subtract_cache: bool = False, per_cpu: bool = True) -> DataFrame:
    """keys, metric, value, extra of container statistics (JSON text). subtract_cache: memory in use is without the cache."""
    s = df.withColumn("_s", F.from_json(stats, STATS))
    memory, cpu = "_s.memory_stats", "_s.cpu_stats"
    usage = F.col(f"{memory}.usage") - F.coalesce(F.try_element_at(f"{memory}.stats", F.lit("cache")), F.lit(0.0)) if subtract_cache else F.col(f"{memory}.usage")
    own = {n: (usage if n == "usage" else F.col(f"{memory}.{n}")) for n in MEMORY}
    single = [_row(F.lit(f"docker.mem.{n}"), c) for n, c in own.items()]
    single += [_row(F.lit(f"docker.cpu.{n}"), F.col(f"{cpu}.cpu_usage.{n}")) for n in CPU_USAGE] + [_row(F.lit("docker.cpu.system_cpu_usage"), F.col(f"{cpu}.system_cpu_usage"))]
    parts = [
        F.flatten(F.transform(F.map_entries("_s.networks"), lambda e: _of_map(e["value"], NETWORK, "docker.net.", "interface", e["key"]))),
        _of_map(F.col("_s.network"), NETWORK, "docker.net."),
        _of_map(F.col(f"{memory}.stats"), MEMORY_STAT, "docker.mem.stat."),
        _of_map(F.col(f"{cpu}.throttling_data"), THROTTLING, "docker.cpu.throttling."),
        F.array(*single),
    ]
    if per_cpu:
        parts.append(F.transform(F.col(f"{cpu}.cpu_usage.percpu_usage"), lambda v, i: _row(F.lit("docker.cpu.usage"), v, "cpu", (i + 1).cast("string"))))
    rows = F.concat(*(F.coalesce(p.cast(METRICS), F.array().cast(METRICS)) for p in parts))
    out = s.select(*keys, F.explode(rows).alias("_m"))
    return out.select(*keys, "_m.metric", "_m.value", "_m.extra").where("value is not null")


def unpivot_kubelet_stats(df: DataFrame, keys: list[str], network: str, memory: str, cpu: str, level: str = "pod") -> DataFrame:
    """keys, metric, value of a kubelet summary (maps of numbers), under the names that container engines use."""
    rows = [(f"k8s.{level}.network.{n}", F.try_element_at(network, F.lit(k))) for n, k in KUBELET_NETWORK.items()]
    rows += [(n, F.try_element_at(memory, F.lit(k))) for n, k in KUBELET_MEMORY.items()] + [(n, F.try_element_at(cpu, F.lit(k))) for n, k in KUBELET_CPU.items()]
    return unpivot_columns(df, keys, dict(rows))


def unpivot_columns(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """keys, metric, value of named columns that aren't null."""
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in columns.items()))
    return df.select(*keys, F.explode(rows).alias("_m")).select(*keys, "_m.metric", "_m.value").where("value is not null")


def unpivot_replica(df: DataFrame, keys: list[str]) -> DataFrame:
    """A replica row: seconds behind (whole numbers only), bytes executed and relayed, and two running flags; nothing without a master host."""
    running = lambda c: F.when(F.col(c) == "Yes", 1).otherwise(0)
    behind = F.when(F.col("seconds_behind_master").cast("string").rlike(r"^\d+$"), F.col("seconds_behind_master").cast("string").try_cast("double"))
    columns = {"slave.seconds_behind_master": behind, "slave.bytes_executed": F.col("exec_master_log_pos"), "slave.bytes_relayed": F.col("read_master_log_pos"), "slave.io_running": running("slave_io_running"), "slave.sql_running": running("slave_sql_running")}
    return unpivot_columns(df.where("coalesce(master_host, '') <> ''"), keys, columns)


#: The command counters that are reported, and the variables.
COMMANDS = ("com_insert", "com_replace", "com_select", "com_update", "com_delete")
VARIABLES = ("max_connections", "open_files_limit")


def report_status_rows(rows: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """Counters that aren't commands, five that are, and two variables."""
    n = F.lower(name)
    return rows.where(((F.col(kind) == "status") & (~n.startswith("com_") | n.isin(*COMMANDS))) | ((F.col(kind) == "variable") & n.isin(*VARIABLES)))


def derived_ratios(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, value: 13 ratios of a database's counters. rows: keys, kind (status or variable), name, value. A zero divisor gives 0 or 100, as the ratio says."""
    g = lambda n, kind="status": F.max(F.when((F.col("kind") == kind) & (F.col("name") == n), F.col("value"))).alias(n)
    names = ("questions", "slow_queries", "max_used_connections", "connections", "aborted_clients", "aborted_connects", "com_select", "com_delete", "com_insert", "com_update", "com_replace", "qcache_hits", "select_range_check", "select_full_join", "opened_tables", "open_tables", "open_files", "table_locks_waited", "table_locks_immediate", "threads_created", "created_tmp_tables", "created_tmp_disk_tables")
    wide = rows.groupBy(*keys).agg(*map(g, names), *(g(n, "variable") for n in VARIABLES))
    c = F.col

    def percent(top: Column, bottom: Column, otherwise: float) -> Column:
        return F.when(bottom > 0, 100.0 * top / bottom).otherwise(otherwise)

    writes = c("com_delete") + c("com_insert") + c("com_update") + c("com_replace")
    ratios = {
        "slow_query_percentage": percent(c("slow_queries"), c("questions"), 0.0),
        "connections_used_percentage": F.least(F.lit(100.0), F.when(c("max_connections") != 0, 100.0 * c("max_used_connections") / c("max_connections"))),
        "aborted_connections_percentage": percent(c("aborted_connects"), c("connections"), 0.0),
        "aborted_clients_percentage": percent(c("aborted_clients"), c("connections"), 0.0),
        "read_percentage": percent(c("com_select"), c("com_select") + writes, 0.0),
        "write_percentage": percent(writes, c("com_select") + writes, 0.0),
        "query_cache_efficiency": percent(c("qcache_hits"), c("com_select") + c("qcache_hits"), 0.0),
        "joins_without_indexes": c("select_range_check") + c("select_full_join"),
        "table_cache_hit_rate": percent(c("open_tables"), c("opened_tables"), 100.0),
        "open_file_percentage": percent(c("open_files"), c("open_files_limit"), 0.0),
        "immediate_table_lock_percentage": F.when(c("table_locks_waited") > 0, 100.0 * c("table_locks_immediate") / (c("table_locks_waited") + c("table_locks_immediate"))).otherwise(100.0),
        # one part in a hundred, not a percentage: the definition that dashboards expect
        "thread_cache_hit_rate": F.when(c("connections") > 0, 100.0 - c("threads_created") / c("connections")).otherwise(100.0),
        "tmp_disk_table_percentage": percent(c("created_tmp_disk_tables"), c("created_tmp_tables"), 0.0),
    }
    return unpivot_columns(wide, keys, {f"derived.{k}": v for k, v in ratios.items()})


def replication_lag(info: DataFrame, host: str = "host", ts: str = "ts") -> DataFrame:
    """host, ts, offset_diff, master_change (per second) and lag_seconds, whole numbers. info: a row per replica: host, ts, master_offset, replica_offset. Where the master stood still the lag is null."""
    one = info.groupBy(host, ts).agg(F.max("master_offset").alias("m"), F.max("replica_offset").alias("r")).where("m <> 0")
    w = Window.partitionBy(host).orderBy(ts)
    # whole microseconds are subtracted: of times close together, seconds as doubles keep too few digits
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    change = ((F.col("m") - F.lag("m").over(w)) / ((micros - F.lag(micros).over(w)) / 1e6)).cast("long")
    df = one.withColumn("master_change", change).withColumn("offset_diff", (F.col("m") - F.coalesce("r", F.lit(0))).cast("long"))
    return df.select(host, ts, "offset_diff", "master_change", F.when(F.col("master_change") != 0, (F.col("offset_diff") / F.col("master_change")).cast("long")).alias("lag_seconds"))
