"""Lines of other formats: syslog, status pages, process files, journal and event-log rows, annotations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions.patterns import extracted, found, java_regex, replaced
from logspark.functions.values import to_megabytes, to_milliseconds, typed_value
from logspark.operators.ordered import Fold, ordered_fold

_SYSLOG = r"^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) (\S+) (?s)(.*)$"
_APP = r"^(.+?)(\[[0-9]+\])?:? "


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def parse_syslog(lines: DataFrame, column: str = "raw") -> DataFrame:
    """Adds priority, hostname, appname and message; nulls where a line isn't of the form <PRI>TIME HOST MESSAGE."""
    c = F.col(column)
    message = F.when(c.rlike(_SYSLOG), F.regexp_extract(c, _SYSLOG, 4))
    return lines.withColumns({"priority": F.regexp_extract(c, _SYSLOG, 1).try_cast("int"), "hostname": _some(F.regexp_extract(c, _SYSLOG, 3)), "appname": _some(F.regexp_extract(message, _APP, 1)), "message": message})


def extract_container(c: Column, id_pattern: str | None, full_pattern: str | None) -> Column:
    """struct(cid, name, rest): an id (its name is then looked up), or else a name and id, and the rest of the line."""
    null = F.lit(None).cast("string")
    by_id = F.when(found(c, id_pattern), F.struct(extracted(c, id_pattern).alias("cid"), null.alias("name"), replaced(c, id_pattern, "").alias("rest"))) if id_pattern else None
    by_name = F.when(found(c, full_pattern), F.struct(extracted(c, full_pattern, 2).alias("cid"), extracted(c, full_pattern).alias("name"), replaced(c, full_pattern, "").alias("rest"))) if full_pattern else None
    none = F.struct(null.alias("cid"), null.alias("name"), c.alias("rest"))
    return F.coalesce(*(x for x in (by_id, by_name) if x is not None), none)


class _Frames(Fold):
    """Splits a connection's bytes: octet-counted frames, lines, or frames with a 4-byte length. The state is bounded by max_frame and a chunk."""

    state = "conn string, n bigint, held binary"

    def saved(self):
        return self.conn, int(self.n), bytes(self.held)

    def restore(self, values):
        self.conn, self.n, held = values
        self.held = bytes(held)

    def __init__(self, prefixed: bool, max_frame: int):
        self.prefixed, self.max_frame, self.held, self.n, self.conn = prefixed, max_frame, b"", 0, None

    def _emit(self, frame: bytes, complete: bool = True, error: str | None = None):
        self.n += 1
        return self.conn, self.n - 1, frame, complete, error

    def _next(self) -> tuple[int, int, str | None] | None:
        """Begin and end of the frame that comes first, and what is wrong with it; None if it isn't whole."""
        if self.prefixed:
            if len(self.held) < 4:
                return None
            size = int.from_bytes(self.held[:4], "big")
            return (4, 4 + size, "too long" if size > self.max_frame else None) if size > self.max_frame or len(self.held) >= 4 + size else None
        if self.held[:1].isdigit():
            space = self.held.find(b" ", 0, 12)
            if space > 0 and self.held[:space].isdigit():
                size = int(self.held[:space])
                if size > self.max_frame:
                    return space + 1, space + 1 + size, "too long"
                return (space + 1, space + 1 + size, None) if len(self.held) > space + size else None
            if space < 0 and len(self.held) < 12 and self.held.isdigit():
                return None
        end = self.held.find(b"\n")
        if end >= 0:
            return 0, end + 1, "too long" if end > self.max_frame else None
        return (0, len(self.held), "too long") if len(self.held) > self.max_frame else None

    def add(self, row):
        self.conn = row.conn_id
        self.held += row.payload or b""
        while self.held and (found := self._next()):
            begin, end, error = found
            yield self._emit(self.held[begin:end].rstrip(b"\r\n") if not self.prefixed else self.held[begin:end], error=error)
            self.held = self.held[end:]

    def end(self):
        if self.held:
            yield self._emit(self.held, complete=False)


def split_syslog_frames(chunks: DataFrame, prefixed: bool = False, max_frame: int = 65_536) -> DataFrame:
    """conn_id, frame_seq, frame (binary), complete, error. chunks: conn_id, chunk_seq, payload. What a connection leaves unfinished is not complete."""
    df = chunks.select(F.col("conn_id").cast("string").alias("conn_id"), "chunk_seq", "payload")
    return ordered_fold(df, ["conn_id"], ["chunk_seq"], lambda: _Frames(prefixed, max_frame), "conn_id string, frame_seq bigint, frame binary, complete boolean, error string")


@dataclass(frozen=True)
class FieldRule:
    """A pattern and, for its groups in order, metric names (None: none) and fixed fields."""

    pattern: str
    metrics: tuple[str | None, ...]
    extra: tuple[dict[str, str], ...] = field(default=())
    unit: str = ""


#: Lines of known status texts and the metrics in them.
ENGINE_STATUS = (
    FieldRule(r"^OS WAIT ARRAY INFO: reservation count (\d+), signal count (\d+)", ("innodb.oswait_array.reservation_count", "innodb.oswait_array.signal_count")),
    FieldRule(r"^Mutex spin waits (\d+), rounds (\d+), OS waits (\d+)", ("innodb.locks.spin_waits", "innodb.locks.rounds", "innodb.locks.os_waits"), ({"type": "mutex"},) * 3),
    FieldRule(r"^RW-shared spins (\d+), OS waits (\d+); RW-excl spins (\d+), OS waits (\d+)", ("innodb.locks.spin_waits", "innodb.locks.os_waits") * 2, ({"type": "rw-shared"},) * 2 + ({"type": "rw-exclusive"},) * 2),
    FieldRule(r"^Ibuf: size (\d+), free list len (\d+), seg size (\d+),", ("innodb.ibuf.size", "innodb.ibuf.free_list_len", "innodb.ibuf.seg_size")),
    FieldRule(r"^(\d+) inserts, (\d+) merged recs, (\d+) merges", ("innodb.ibuf.inserts", "innodb.ibuf.merged_recs", "innodb.ibuf.merges")),
    FieldRule(r"^\d+ queries inside InnoDB, (\d+) queries in queue", ("innodb.queries_queued",)),
    FieldRule(r"^(\d+) read views open inside InnoDB", ("innodb.opened_read_views",)),
    FieldRule(r"^History list length (\d+)", ("innodb.history_list_length",)),
)
APACHE_STATUS = tuple(
    FieldRule(rf"^{prefix}: *(\S+)", (name,))
    for prefix, name in (
        ("Total Accesses", "total_accesses"),
        ("Total kBytes", "total_kbytes_sent"),
        ("Uptime", "uptime"),
        ("ReqPerSec", "request_per_sec"),
        ("BytesPerSec", "bytes_per_sec"),
        ("BytesPerReq", "bytes_per_req"),
        ("BusyWorkers", "busy_workers"),
        ("IdleWorkers", "idle_workers"),
        ("ConnsTotal", "connections_total"),
        ("ConnsAsyncWriting", "async_connections_writing"),
        ("ConnsAsyncKeepAlive", "async_connections_keep_alive"),
        ("ConnsAsyncClosing", "async_connections_closing"),
    )
)
NGINX_STATUS = (
    FieldRule(r"^Active connections: *(\d+)", ("active_connections",)),
    FieldRule(r"^\s+(\d+) (\d+) (\d+)\s*$", ("server_accepts", "server_handled", "server_requests")),
    FieldRule(r"^Reading: (\d+) Writing: (\d+) Waiting: (\d+)", ("reading", "writing", "waiting")),
)
JVM_STATUS = (
    FieldRule(r"Free memory: ([\d.]+ \w+) Total memory: ([\d.]+ \w+) Max memory: ([\d.]+ \w+)", ("memory_bytes",) * 3, ({"type": "free"}, {"type": "total"}, {"type": "max"}), "megabytes"),
    FieldRule(r"Max threads: (\d+) Current thread count: (\d+) Current thread busy: (\d+)", ("threads",) * 3, ({"type": "max"}, {"type": "active"}, {"type": "busy"})),
    FieldRule(r"Max processing time: (\d+ m?s) Processing time: ([\d.]+ m?s)", ("processing_time_max", "processing_time"), (), "milliseconds"),
    FieldRule(r"Request count: (\d+) Error count: (\d+)", ("request_count", "error_count")),
    FieldRule(r"Bytes received: ([\d.]+ \w+) Bytes sent: ([\d.]+ \w+)", ("network_bytes",) * 2, ({"type": "received"}, {"type": "sent"}), "megabytes"),
)
_KB = {"VmSize": "vmsize", "VmPeak": "peak_vmsize", "VmRSS": "resident", "VmHWM": "peak_resident"}
PROC_STATUS = tuple(FieldRule(rf"^{k}:\s*(\d+)", ("app.mem.bytes",), ({"type": v},), "kib") for k, v in _KB.items())
PROC_IO = tuple(FieldRule(rf"^{k}:\s*(\d+)", (m,), ({"type": t},)) for k, m, t in (("rchar", "app.disk.bytes", "read"), ("syscr", "app.disk.requests", "read"), ("wchar", "app.disk.bytes", "write"), ("syscw", "app.disk.requests", "write")))
SOCKET_STATUS = tuple(FieldRule(rf"^{p}: inuse (\d+)", ("app.net.sockets_in_use",), ({"type": p.lower()},)) for p in ("TCP", "UDP", "RAW"))


def extract_fields(lines: DataFrame, rules: tuple[FieldRule, ...], column: str = "raw") -> DataFrame:
    """A row for each group of each rule that a line matches: the line's columns, metric, value, value_str, extra."""
    c = F.col(column)
    found = []
    for r in rules:
        java = java_regex(r.pattern)
        for g, metric in enumerate(r.metrics, 1):
            if metric is None:
                continue
            fields = r.extra[g - 1] if r.extra else {}
            extra = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]) if fields else F.lit(None).cast("map<string,string>")
            found.append(F.when(c.rlike(java), F.struct(F.lit(metric).alias("metric"), F.regexp_extract(c, java, g).alias("text"), extra.alias("extra"), F.lit(r.unit).alias("unit"))))
    # one pass over the lines: each line makes the rows it matches
    df = lines.withColumn("_f", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    text, unit = F.col("_f.text"), F.col("_f.unit")
    typed = typed_value(text)
    value = F.when(unit == "megabytes", to_megabytes(text)).when(unit == "milliseconds", to_milliseconds(text)).when(unit == "kib", text.try_cast("double") * 1024).otherwise(typed["value"])
    return df.withColumns({"metric": F.col("_f.metric"), "value": value, "value_str": F.when(value.isNull(), text), "extra": F.col("_f.extra")}).drop("_f")


def pair_header_values(lines: DataFrame, keys: list[str], order: list[str], column: str = "raw") -> DataFrame:
    """protocol, name, value of two lines in a row with the same first word and as many words: names, then values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = lines.withColumn("_n", F.split(F.trim(F.col(column)), r"\s+")).withColumn("_v", F.lead("_n").over(w))
    df = df.where((F.col("_n")[0] == F.col("_v")[0]) & (F.size("_n") == F.size("_v")) & F.get("_n", F.lit(1)).try_cast("long").isNull())
    df = df.select(*keys, F.col("_n")[0].alias("protocol"), F.explode(F.slice(F.arrays_zip(F.col("_n").alias("n"), F.col("_v").alias("v")), 2, 1_000_000)).alias("_p"))
    return df.select(*keys, F.regexp_replace("protocol", ":$", "").alias("protocol"), F.col("_p.n").alias("name"), F.col("_p.v").try_cast("long").alias("value"))


def sum_retransmits(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """value: the sum of the two counters of recoveries by retransmission, if either is there."""
    hit = F.col("name").isin("TCPRenoRecovery", "TCPSackRecovery")
    return pairs.groupBy(*keys).agg(F.sum(F.when(hit, F.col("value"))).alias("value")).where("value is not null")


#: Places of fields after the command of a process's stat line, and the clock's ticks a second.
_STAT = {"majflt": 9, "user": 11, "system": 12, "nice": 16, "threads": 17, "start": 19, "io_wait": 39}
TICKS = 100


def parse_proc_stat(lines: DataFrame, column: str = "raw") -> DataFrame:
    """metric, type, value of a process's stat line: times in hundredths of a second, io wait in milliseconds."""
    # a column of its own: what explode makes rows of is computed for each mention of a line's fields
    df = lines.withColumn("_p", F.split(F.regexp_replace(F.col(column), r"^.*?\) ", ""), r"\s+"))
    number = lambda k: F.get("_p", F.lit(_STAT[k])).try_cast("double")
    rows = [("app.cpu", "user", number("user") * 100 / TICKS), ("app.cpu", "system", number("system") * 100 / TICKS), ("app.nice", None, number("nice")), ("app.threads", None, number("threads")), ("app.mem.majflt", None, number("majflt")), ("app.io.wait", None, number("io_wait") * 1000 / TICKS), ("app.start", None, number("start") * 1000 / TICKS)]
    df = df.withColumn("_m", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(t).cast("string").alias("type"), v.alias("value")) for m, t, v in rows))))
    return df.select(*lines.columns, "_m.metric", "_m.type", "_m.value").where("value is not null")


def event_data_map(data: Column) -> Column:
    """A map of an array of struct(name, text): by name, or by place without one; a name seen before gets its place appended; a leading @ or # goes."""
    bare = lambda n: F.regexp_replace(n, "^[@#]", "")
    names = F.transform(data, lambda x: x["name"])

    def entry(x: Column, i: Column) -> Column:
        place = i.cast("string")
        key = F.when(x["name"].isNull(), place).when(F.array_position(names, x["name"]) - 1 < i, F.concat(x["name"], place)).otherwise(x["name"])
        clash = F.array_contains(names, bare(key)) & (bare(key) != key)
        return F.struct(F.when(clash, key).otherwise(bare(key)).alias("key"), x["text"].alias("value"))

    return F.map_from_entries(F.transform(data, entry))


#: The elements of an event's XML. Data of unknown depth stays text.
EVENT_XML = (
    "System struct<Provider:struct<_Name:string>, EventID:struct<_Qualifiers:string,_VALUE:string>, Version:string, Level:string, Task:string, Opcode:string, Keywords:string, TimeCreated:struct<_SystemTime:string>, "
    "EventRecordID:string, Execution:struct<_ProcessID:string,_ThreadID:string>, Channel:string, Computer:string, Security:struct<_UserID:string>>, "
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>, RenderingInfo struct<Message:string, Level:string, Keywords:struct<Keyword:array<string>>>"
)


def parse_event_xml(rows: DataFrame, column: str = "xml") -> DataFrame:
    """Adds the fields of events in XML: provider, qualifiers, event_id, level, task, opcode, record_id, channel, computer, user, ts, keywords (array), message, data (array of name and text, see event_data_map) and error.

    error: whether the text isn't such XML, or has no number of the event; what it lacks is null. Namespaces don't matter. Numbers that are none are null.
    """
    x = F.from_xml(column, EVENT_XML, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})
    df = rows.withColumn("_event", x)
    s = F.col("_event.System")
    # read as text: one that is none would take its whole element with it
    whole = lambda c, kind="int": F.trim(c).try_cast(kind)
    data = F.transform(F.coalesce(F.col("_event.EventData.Data"), F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda d: F.struct(d["_Name"].alias("name"), d["_VALUE"].alias("text")))
    fields = {
        "provider": s["Provider"]["_Name"], "qualifiers": whole(s["EventID"]["_Qualifiers"]), "event_id": whole(s["EventID"]["_VALUE"]), "level": whole(s["Level"]), "task": whole(s["Task"]), "opcode": whole(s["Opcode"]), "record_id": whole(s["EventRecordID"], "bigint"),
        "channel": s["Channel"], "computer": s["Computer"], "user": s["Security"]["_UserID"], "ts": s["TimeCreated"]["_SystemTime"].try_cast("timestamp"),
        "keywords": F.col("_event.RenderingInfo.Keywords.Keyword"), "message": F.col("_event.RenderingInfo.Message"), "data": F.when(s.isNotNull(), data), "error": F.col(column).isNotNull() & whole(s["EventID"]["_VALUE"]).isNull(),
    }
    return df.withColumns(fields).drop("_event")


def event_log_fields(rows: DataFrame) -> DataFrame:
    """Adds instance_id (qualifiers in the upper half), keywords as text, a formatted time, and the user without its prefix."""
    return rows.withColumns({
        "instance_id": F.shiftleft(F.col("qualifiers").cast("long"), 16).bitwiseOR(F.col("event_id").cast("long")),
        "keywords": F.array_join("keywords", ","),
        "time": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "user": F.regexp_replace("user", "^PySID:", ""),
    })


def annotation_rules(pods: DataFrame, keys: list[str], prefix: str, column: str = "annotations", dashes: bool = True) -> DataFrame:
    """keys, path (array), value of annotations below a prefix, array positions as numbers; keys whose annotations mix names and numbers at one place have none."""
    df = pods.select(*keys, F.explode(column).alias("k", "value")).where(F.col("k").startswith(prefix))
    name = F.substring(F.col("k"), F.lit(len(prefix) + 1), F.length("k"))
    df = df.withColumn("path", F.split(F.translate(name, "-", "_") if dashes else name, r"\."))
    levels = df.select(*keys, F.posexplode("path").alias("pos", "part"), "path").withColumn("parent", F.array_join(F.slice("path", F.lit(1), F.col("pos")), "."))
    number = F.col("part").rlike(r"^\d+$")
    mixed = levels.groupBy(*keys, "parent").agg(F.count_if(number).alias("numbers"), F.count_if(~number).alias("names")).where("numbers > 0 and names > 0").select(*keys).distinct()
    ordered = F.array_join(F.transform("path", lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 9, "0")).otherwise(p)), ".")
    return df.join(mixed, keys, "left_anti").select(*keys, "path", ordered.alias("sort_key"), "value")
