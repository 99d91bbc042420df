"""Lookups: containers, pods, owners, configs, destinations, messages.

A dimension is broadcast when Spark's statistics say that it is small; otherwise the same join is a shuffled one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.patterns import found, glob_regex
from logspark.functions.text import empty_map, merge_attrs
from logspark.functions.values import to_bool
from logspark.model import LogConfig
from logspark.operators.ordered import saved


def attach_pod(containers: DataFrame, pods: DataFrame, placeholder: str = "none") -> DataFrame:
    """Adds pod_uid, node, pod_labels, controller of (namespace, pod). A container whose pod isn't known stays, with placeholders."""
    dim = pods.select("namespace", "pod", F.col("uid").alias("pod_uid"), "node", F.col("labels").alias("pod_labels"), "controller")
    out = containers.join(dim, ["namespace", "pod"], "left")
    return out.withColumns({"pod_uid": F.coalesce("pod_uid", F.lit(placeholder)), "node": F.coalesce("node", F.lit(placeholder)), "controller": F.coalesce("controller", F.lit(placeholder)), "pod_labels": F.coalesce("pod_labels", empty_map())})


def attach_attributes(lines: DataFrame, containers: DataFrame, on: str = "log_path") -> DataFrame:
    """Adds the attributes of each line's log to its own, of which the line's win."""
    dim = containers.select(on, F.col("attributes").alias("_container"))
    own = F.col("attrs") if "attrs" in lines.columns else F.lit(None).cast("map<string,string>")
    return lines.join(dim, on, "left").withColumn("attrs", merge_attrs(F.col("_container"), own)).drop("_container")


def _rounds(df: DataFrame):
    """Doubling rounds: enough for every acyclic graph, and an end for one with cycles."""
    return range(df.count().bit_length() + 1)


def root_owner(owners: DataFrame, standard: list[str]) -> DataFrame:
    """name, root, root_kind of each owner: up while the parent is known and its kind is standard. owners: name, kind, parent.

    Every round doubles the steps up, so a chain of any depth takes the logarithm of it in joins. What leads into a cycle has no root: null.
    """
    known = owners.select(F.col("name").alias("_p"), F.col("kind").alias("_pk"))
    df = owners.join(known, (F.col("parent") == F.col("_p")) & F.col("_pk").isin(*standard) & (F.col("parent") != F.col("name")), "left")
    df = saved(df.select("name", "kind", F.coalesce("_p", "name").alias("up")))
    roots = df.where("up = name").select(F.col("name").alias("root")).distinct()
    for _ in _rounds(df):
        step = df.select(F.col("name").alias("_n"), F.col("up").alias("_u"))
        after = saved(df.join(step, df["up"] == step["_n"], "left").select("name", "kind", F.coalesce("_u", "up").alias("up"), (F.coalesce("_u", "up") != F.col("up")).alias("_moved")))
        moved = after.agg(F.count_if("_moved")).first()[0]
        df = after.drop("_moved")
        if not moved:
            break
    kinds = owners.select(F.col("name").alias("root"), F.col("kind").alias("root_kind"))
    return df.join(roots, F.col("up") == F.col("root"), "left").join(kinds, "root", "left").select("name", "root", "root_kind")


def descendants(processes: DataFrame, matched: Column, pid: str = "pid", ppid: str = "ppid") -> DataFrame:
    """pid of the matched processes and of all below them. A process that is its own parent has none.

    Whether one of the ancestors up to twice as far away is matched is known from two halves of the way.
    """
    parent = F.when(F.col(ppid) != F.col(pid), F.col(ppid))
    df = saved(processes.select(F.col(pid).alias("pid"), parent.alias("up"), F.coalesce(matched, F.lit(False)).alias("hit")))
    # hits, and what has no unknown ancestor left, stay as they are; only open rows are joined and saved again
    open_, hits = df.where("up is not null and not hit"), df.where("hit").select("pid")
    step = df.select(F.col("pid").alias("_n"), F.when(~F.col("hit"), F.col("up")).alias("_u"), F.col("hit").alias("_h"))
    for _ in _rounds(df):
        after = saved(open_.join(step, F.col("up") == F.col("_n"), "left").select("pid", F.col("_u").alias("up"), F.coalesce("_h", F.lit(False)).alias("hit")))
        hits = hits.unionByName(after.where("hit").select("pid"))
        open_ = after.where("up is not null and not hit")
        if not open_.limit(1).count():
            break
        # an open row asks its ancestor, which was open itself, or knew already
        new = after.select(F.col("pid").alias("_n"), F.when(~F.col("hit"), F.col("up")).alias("_u"), F.col("hit").alias("_h"))
        step = step.where("_h or _u is null").unionByName(new)
    return hits


def first_matching(df: DataFrame, configs: list[LogConfig], columns: dict[str, str] | None = None) -> DataFrame:
    """Adds config, config_parser and config_attributes of the first config all of whose globs match; nulls where none does.

    columns: which column is matched by path, namespace, pod and container (those not named match any).
    Configs are a driver-side list, so this is one expression and no join. For containers by namespace, pod and name; for
    lines of captured logs by their templated path.
    """
    columns = columns or {"path": "log_path"}
    kind = "struct<name:string,parser:string,attributes:map<string,string>>"
    chosen = F.lit(None).cast(kind)
    for c in reversed(configs):
        hits = [F.coalesce(F.col(col).rlike(glob_regex(getattr(c, part))), F.lit(False)) for part, col in columns.items() if getattr(c, part) != "*"]
        attrs = F.create_map(*[F.lit(x) for kv in c.attributes.items() for x in kv]) if c.attributes else empty_map()
        row = F.struct(F.lit(c.name).alias("name"), F.lit(c.parser).cast("string").alias("parser"), attrs.alias("attributes"))
        chosen = F.when(reduce(lambda a, b: a & b, hits, F.lit(True)), row).otherwise(chosen)
    return df.withColumn("_c", chosen).withColumns({"config": F.col("_c.name"), "config_parser": F.col("_c.parser"), "config_attributes": F.col("_c.attributes")}).drop("_c")


def first_matching_table(df: DataFrame, configs: DataFrame, column: str) -> DataFrame:
    """The same with configs in a table of position, pattern (Java) and config: every row with the matching config of the least position.

    The configs, which people write, come as one row with a sorted array, so lines are neither multiplied nor shuffled.
    """
    all_ = configs.where("pattern is not null").agg(F.array_sort(F.collect_list(F.struct("position", "pattern", "config"))).alias("_configs"))
    hit = F.get(F.filter("_configs", lambda c: F.regexp_like(F.col(column), c["pattern"])), F.lit(0))
    # one row
    return df.join(F.broadcast(all_)).withColumn("config", hit["config"]).drop("_configs")


def match_journal(rows: DataFrame, configs: list[dict], fields: str = "fields") -> DataFrame:
    """Adds config: the first of which the unit pattern (from the start) or all field globs match; a missing field doesn't. {name, unit | globs}."""
    chosen = F.lit("default")
    for c in reversed(configs):
        value = lambda k: F.try_element_at(fields, F.lit(k))
        if "unit" in c:
            hit = found(value("unit"), c["unit"], at_start=True)
        else:
            hit = reduce(lambda a, b: a & b, [F.coalesce(value(k).rlike(glob_regex(g)), F.lit(False)) for k, g in c.get("globs", {}).items()], F.lit(True))
        chosen = F.when(hit, c["name"]).otherwise(chosen)
    return rows.withColumn("config", chosen)


def fan_out(logs: DataFrame, container: str, pod: str, namespace: str) -> DataFrame:
    """A row for each destination of a log: the container's list, else the pod's, else the namespace's; no list: destination null."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return logs.withColumn("destination", F.explode_outer(F.coalesce(some(container), some(pod), some(namespace))))


def known_only(stats: DataFrame, wanted: DataFrame, on: str = "uid") -> DataFrame:
    return stats.join(wanted.select(on), on, "left_semi")


def resolve_placeholders(events: DataFrame, messages: DataFrame, key: list[str], provider: str = "provider", channel: str = "channel", data: str = "data") -> DataFrame:
    """Replaces %%N in the values of a map by the message of (channel, provider, N); unknown ones stay. The Security channel has one provider."""
    df = events.withColumn("_provider", F.when(F.col(channel) == "Security", "Microsoft-Windows-Security-Auditing").otherwise(F.col(provider)))
    long = df.select(*key, F.col(channel).alias("_channel"), "_provider", F.explode(data).alias("k", "v"))
    number = F.regexp_extract("v", r"^%%(\d+)$", 1)
    dim = messages.select(F.col("channel").alias("_channel"), F.col("provider").alias("_provider"), F.col("id").cast("string").alias("_id"), "message")
    found = long.withColumn("_id", number).join(dim, ["_channel", "_provider", "_id"], "left").withColumn("v", F.coalesce("message", "v"))
    maps = found.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("_data"))
    return df.drop("_provider").join(maps, key, "left").withColumn(data, F.coalesce("_data", data)).drop("_data")


def resolve_container(lines: DataFrame, containers: DataFrame, short: int = 12) -> DataFrame:
    """Adds container_name and container_labels by id: in full, or by its first characters (`short` or more), where just one container's id begins so; else null. Lines are never doubled."""
    named = F.struct(F.col("name").alias("container_name"), F.col("labels").alias("container_labels"))
    # of rows with one id the one with the least name
    whole = containers.groupBy("cid").agg(F.min_by(named, F.coalesce("name", F.lit(""))).alias("_named"))
    begun = whole.groupBy(F.substring("cid", 1, short).alias("_short")).agg(F.collect_list(F.struct("cid", "_named")).alias("_all"))
    df = lines.withColumn("_short", F.substring("cid", 1, short)).join(begun, "_short", "left")
    exact = F.get(F.filter("_all", lambda x: x["cid"] == F.col("cid")), F.lit(0))["_named"]
    fits = F.filter("_all", lambda x: x["cid"].startswith(F.col("cid")))
    only = F.when((F.size(fits) == 1) & (F.length("cid") >= short), F.get(fits, F.lit(0))["_named"])
    out = df.withColumn("_named", F.coalesce(exact, only))
    return out.withColumns({c: F.col("_named")[c] for c in ("container_name", "container_labels")}).drop("_short", "_all", "_named")


def namespace_passes(c: Column, include: list[str], ignore: list[str], local_ignore: list[str] | None = None, default_ignore: tuple[str, ...] = ("kube-system",)) -> Column:
    """In the include list (empty or *: all) and not ignored. A local ignore list counts only where the global one is the default."""
    ignored = local_ignore if local_ignore is not None and tuple(ignore) == default_ignore else ignore
    wanted = F.lit(True) if not include or "*" in include else c.isin(*include)
    return wanted & ~c.isin(*ignored) if ignored else wanted


def included(container: Column, pod: Column, default: bool = True) -> Column:
    """By annotations `include` and `exclude` (maps), the container's before the pod's, include before exclude."""
    def value(m: Column, k: str) -> Column:
        v = F.try_element_at(m, F.lit(k))
        return F.when(v.isNotNull(), to_bool(v))

    by = lambda m: F.coalesce(value(m, "include"), ~value(m, "exclude"))
    return F.coalesce(by(container), by(pod), F.lit(default))


def drop_old_dead(containers: DataFrame, created_before: Column) -> DataFrame:
    """Without stopped containers created before a time, and without pod sandboxes."""
    return containers.where((F.col("running") | (F.col("created") >= created_before)) & ~F.col("sandbox"))


def relevant_events(events: DataFrame, kinds: list[str], namespace: Column) -> DataFrame:
    """Events with an involved object of one of the kinds (none given: any) whose namespace passes."""
    has = F.col("kind").isNotNull()
    return events.where((has & F.col("kind").isin(*kinds) if kinds else has) & namespace)


def new_rows_since(rows: DataFrame, state: DataFrame, key: str = "host") -> DataFrame:
    """Rows after the last one seen, and gap: whether the last one seen is missing. state: key, last_id, last_time, reset (the server began anew: times decide)."""
    df = rows.join(state, key, "left")
    fresh = F.when(F.coalesce("reset", F.lit(False)), F.col("time") > F.col("last_time")).otherwise(F.col("id") > F.col("last_id"))
    missing = state.join(rows.select(F.col(key).alias("_k"), F.col("id").alias("_i")), (F.col(key) == F.col("_k")) & (F.col("last_id") == F.col("_i")), "left_anti").select(key, F.lit(True).alias("gap"))
    return df.where(fresh | F.col("last_id").isNull()).join(missing, key, "left").withColumn("gap", F.coalesce("gap", F.lit(False))).select(*rows.columns, "gap")


def match_processes(processes: DataFrame, pattern: str, column: str = "cmd") -> DataFrame:
    """Processes in whose command the pattern is found, as by Python's re."""
    return processes.where(found(F.col(column), pattern))


def dead_processes(history: DataFrame, running: DataFrame, pid: str = "pid") -> DataFrame:
    """pids of the history that run no more."""
    return history.select(pid).distinct().join(running.select(pid), pid, "left_anti")
