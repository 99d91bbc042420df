"""Line assembly: groups of lines, container formats, pieces and fragments. Lines are rows of log_path, line_seq, raw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.dates import rfc3339_nanos
from logspark.functions.patterns import found
from logspark.model import MAX_LINE_BYTES, Grouper
from logspark.operators.chains import Groups, Pieces, chained
from logspark.operators.ordered import Fold, automaton, in_blocks, running

KEY, ORDER = ["log_path"], ["line_seq"]


def number_groups(lines: DataFrame, grouper: Grouper, block: Column | None = None) -> DataFrame:
    """Adds group_id, from 0 in each log: lines of one group share it; a line outside groups has its own.

    What a line leaves behind is one bit: whether a next line may be absorbed. So grouping is a one-bit automaton.
    With blocks, _block and edge (whether the group may go on in another block) stay as columns.
    """
    df, by = in_blocks(lines, block)
    pattern = found(F.col("raw"), grouper.pattern)
    df = df.withColumns({"_start": found(F.col("raw"), grouper.start), "_go": pattern if grouper.kind.startswith("continue") else ~pattern})
    if grouper.kind in ("continueThrough", "haltBefore"):
        # open after a start, or after a line that was absorbed; a line is absorbed if it goes on in an open group
        step = F.when(F.col("_start"), "1").when(F.col("_go"), "i").otherwise("0")
        outside = lambda open_: ~(open_ & F.col("_go"))
    else:
        # every line is absorbed by an open group, which stays open by what the line says; outside a group a start opens one
        step = F.when(F.col("_start"), F.when(F.col("_go"), "1").otherwise("f")).when(F.col("_go"), "i").otherwise("0")
        outside = lambda open_: ~open_
    df = automaton(df, KEY, ORDER, step, outside, "_open", "group_id", by)
    return df.withColumn("group_id", F.col("group_id") - 1).drop("_go", "_start", "_open")


def group_lines(lines: DataFrame, grouper: Grouper, separator: str = "\n", max_bytes: int | None = None, block: Column | None = None) -> DataFrame:
    """One row per group: log_path, line_seq (of its first line), n_lines, message.

    Groups within a block are put together where their lines are; only those at a block's edges are shuffled once more.
    Logs in which a group would exceed max_bytes are grouped by the fold that cuts groups at that size; all others stay native.
    """
    numbered = number_groups(lines, grouper, block)
    columns = ["log_path", "line_seq", "n_lines", "message", "_bytes"]
    size = F.sum(F.octet_length("raw") + len(separator)).alias("_bytes")
    if block is None:
        grouped = numbered.groupBy("log_path", "group_id").agg(F.min("line_seq").alias("line_seq"), F.count("*").alias("n_lines"), size, _joined(separator, "line_seq", "raw").alias("message"))
    else:
        parts = numbered.groupBy("log_path", "_block", "group_id", "edge").agg(F.min("line_seq").alias("line_seq"), F.count("*").alias("n_lines"), size, _joined(separator, "line_seq", "raw").alias("message"))
        edges = parts.where("edge").groupBy("log_path", "group_id").agg(_joined(separator, "line_seq", "message").alias("message"), F.min("line_seq").alias("line_seq"), F.sum("n_lines").alias("n_lines"), F.sum("_bytes").alias("_bytes"))
        grouped = parts.where("not edge").select(*columns).unionByName(edges.select(*columns))
    if max_bytes is None:
        return grouped.select("log_path", "line_seq", "n_lines", "message")
    large = grouped.where(F.col("_bytes") > max_bytes).select("log_path").distinct()
    native = grouped.join(large, "log_path", "left_anti").select("log_path", "line_seq", "n_lines", "message")
    return native.unionByName(group_lines_by(lines.join(large, "log_path", "left_semi"), [grouper], separator, max_bytes))


def _joined(separator: str, order: str, text: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(rows, lambda r: r[text]), separator)


class _Groupers(Fold):
    """The first grouper whose start matches opens a group; groups end by rule or at max_bytes, which bounds the state."""

    state = "lines array<string>, path string, seq bigint, kind int, size bigint, open boolean"

    def saved(self):
        return self.lines, self.path, None if self.seq is None else int(self.seq), int(self.kind), int(self.size), bool(self.open)

    def restore(self, values):
        lines, self.path, self.seq, self.kind, self.size, self.open = values
        self.lines = list(lines)

    def __init__(self, groupers: list[Grouper], separator: str, max_bytes: int):
        self.groupers, self.separator, self.max_bytes = groupers, separator, max_bytes
        self.lines: list[str] = []
        self.path, self.seq, self.kind, self.size, self.open = None, None, -1, 0, False

    def _close(self):
        if self.lines:
            yield self.path, self.seq, len(self.lines), self.separator.join(self.lines)
        self.lines, self.kind, self.size = [], -1, 0

    def add(self, row):
        out = []
        if self.lines:
            g = self.groupers[self.kind]
            hit = row.flags[2 * self.kind + 1]
            takes = {"continueThrough": hit, "haltBefore": not hit}.get(g.kind, self.open)
            if not takes or self.size + len(row.raw.encode()) + len(self.separator) > self.max_bytes:
                out += self._close()
        if not self.lines:
            self.path, self.seq = row.log_path, row.line_seq
            self.kind = next((i for i in range(len(self.groupers)) if row.flags[2 * i]), -1)
            self.lines, self.size = [row.raw], len(row.raw.encode()) + len(self.separator)
            if self.kind < 0:
                out += self._close()
            self.open = True
            return out
        self.lines.append(row.raw)
        self.size += len(row.raw.encode()) + len(self.separator)
        hit = row.flags[2 * self.kind + 1]
        self.open = {"continuePast": hit, "haltWith": not hit}.get(self.groupers[self.kind].kind, True)
        return out

    def end(self):
        return self._close()


def group_lines_by(lines: DataFrame, groupers: list[Grouper], separator: str = "\n", max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Several groupers: at each line outside a group the first that matches opens one. Patterns are matched by Spark; a log may be many tasks' (see chains)."""
    flags = F.array(*(x for g in groupers for x in (found(F.col("raw"), g.start), found(F.col("raw"), g.pattern))))
    df = lines.select("log_path", "line_seq", "raw", flags.alias("flags"), (F.octet_length("raw") + len(separator)).alias("size"))
    chained_ = chained(df, KEY, ORDER, Groups([g.kind for g in groupers], max_bytes))
    out = chained_.groupBy("log_path", "nth").agg(F.min("line_seq").alias("line_seq"), F.count("*").alias("n_lines"), _joined(separator, "line_seq", "raw").alias("message"))
    return out.drop("nth")


def parse_json_lines(lines: DataFrame, message_field: str = "log", time_field: str = "time", keep_raw_time: bool = False) -> DataFrame:
    """Adds message, ts_nanos and attrs of JSON lines. Without a text message, or without JSON, the message is the whole line and attrs is null."""
    obj = F.from_json("raw", "map<string,string>", {"mode": "PERMISSIVE"})
    df = lines.withColumn("_o", obj)
    body = F.try_element_at("_o", F.lit(message_field))
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json("raw"), f"$.{message_field}", "variant"))
    is_text = F.coalesce(kind == "STRING", F.lit(False))
    ok = F.coalesce(body.isNotNull() & is_text, F.lit(False))
    time = F.try_element_at("_o", F.lit(time_field))
    attrs = F.map_filter("_o", lambda k, _: ~k.isin(message_field, time_field))
    if keep_raw_time:
        attrs = F.when(time.isNotNull() & ~F.map_contains_key(attrs, "raw_timestamp"), F.map_concat(attrs, F.create_map(F.lit("raw_timestamp"), time))).otherwise(attrs)
    return df.withColumns({"message": F.when(ok, body).otherwise(F.col("raw")), "ts_nanos": F.when(ok, rfc3339_nanos(time)), "attrs": F.when(ok, attrs)}).drop("_o")


def merge_pieces(lines: DataFrame, block: Column | None = None) -> DataFrame:
    """Joins consecutive messages until one ends with a line end: log_path, line_seq, n_pieces, message, and ts_nanos and attrs of the first piece."""
    ended = F.when(F.col("message").endswith("\n"), 1).otherwise(0)
    df, by = in_blocks(lines, block)
    df = running(df, KEY, ORDER, ended, "_group", before=True, block=by).withColumn("_group", F.coalesce("_group", F.lit(0)))
    first = lambda c: F.min_by(c, "line_seq").alias(c)
    rows = F.array_sort(F.collect_list(F.struct("line_seq", "message")))
    out = df.groupBy("log_path", "_group").agg(F.min("line_seq").alias("line_seq"), F.count("*").alias("n_pieces"), F.array_join(F.transform(rows, lambda r: r["message"]), "").alias("message"), first("ts_nanos"), first("attrs"))
    return out.drop("_group")


def parse_cri(lines: DataFrame) -> DataFrame:
    """Adds ts_nanos, stream, tags, message and error of container runtime lines: TIME stdout|stderr TAGS [MESSAGE]. error: why a line isn't one."""
    # as a row made of the line its fields are split once: a filter on them isn't pushed below it, to split anew for each mention
    df, p = lines.withColumn("_p", F.explode(F.array(F.split("raw", " ", 4)))), F.col("_p")
    time, stream, tags = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.split(F.get(p, F.lit(2)), ":")
    nanos = rfc3339_nanos(time)
    full = F.coalesce(F.array_contains(tags, "P") | F.array_contains(tags, "F"), F.lit(False))
    error = F.when(F.size(p) < 3, "fields").when(~stream.isin("stdout", "stderr"), "stream").when(~full, "tags").when(nanos.isNull(), "time")
    return df.withColumns({"ts_nanos": nanos, "stream": stream, "tags": tags, "message": F.coalesce(F.get(p, F.lit(3)), F.lit("")), "error": error}).drop("_p")


class _Pieces(Fold):
    state = "path string, stream string, seq bigint, nanos bigint, parts array<string>, size bigint"

    def saved(self):
        path, stream, seq, nanos = self.first or (None, None, None, None)
        return path, stream, None if seq is None else int(seq), None if nanos is None else int(nanos), self.parts, int(self.size)

    def restore(self, values):
        *first, parts, self.size = values
        self.parts = list(parts)
        self.first = tuple(first) if self.parts else None

    def __init__(self, max_bytes: int):
        self.max_bytes, self.first, self.parts, self.size = max_bytes, None, [], 0

    def _close(self, partial: bool):
        if self.parts:
            yield *self.first, len(self.parts), "".join(self.parts), partial
        self.first, self.parts, self.size = None, [], 0

    def add(self, row):
        # plain values: a stream keeps the fold between batches
        self.first = self.first or (row.log_path, row.stream, row.line_seq, row.ts_nanos)
        self.parts.append(row.piece)
        self.size += len(row.piece.encode())
        return self._close(False) if row.full or self.size >= self.max_bytes else ()

    def end(self):
        return self._close(True)


_CRI = "log_path string, stream string, line_seq bigint, ts_nanos bigint, n_pieces bigint, message string, partial boolean"


def reassemble_cri(parsed: DataFrame, max_bytes: int | None = None, block: Column | None = None) -> DataFrame:
    """Joins the pieces of each (log_path, stream) up to a full one: the first piece's time, one line end off each piece. partial: no full piece came.

    max_bytes: a message is also complete when it reaches that size.
    """
    ok = parsed.where("error is null").select("log_path", "stream", "line_seq", "ts_nanos", F.regexp_replace("message", r"\r?\n$", "").alias("piece"), F.array_contains("tags", "F").alias("full"))
    if max_bytes is not None:
        sized = ok.withColumn("size", F.octet_length("piece"))
        # a log may be many tasks' (see chains)
        df = chained(sized, ["log_path", "stream"], ORDER, Pieces(max_bytes)).withColumnRenamed("nth", "_group")
        return _put_together(df, F.sum("size") < max_bytes)
    df, by = in_blocks(ok, block)
    df = running(df, ["log_path", "stream"], ORDER, F.when(F.col("full"), 1).otherwise(0), "_group", before=True, block=by).withColumn("_group", F.coalesce("_group", F.lit(0)))
    return _put_together(df, F.lit(True))


def _put_together(df: DataFrame, small: Column) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("line_seq", "piece")))
    out = df.groupBy("log_path", "stream", "_group").agg(F.min("line_seq").alias("line_seq"), F.min_by("ts_nanos", "line_seq").alias("ts_nanos"), F.count("*").alias("n_pieces"), F.array_join(F.transform(rows, lambda r: r["piece"]), "").alias("message"), (~F.bool_or("full") & small).alias("partial"))
    return out.drop("_group")


def fragment_lines(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Cuts messages of over max_bytes bytes: rows with fragment (from 0), fragment_offset (bytes), the piece's bytes, which put together are the message's, and message, the piece as text (half a character becomes U+FFFD)."""
    size = F.octet_length("message")
    df = lines.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / max_bytes).cast("int") - 1))))
    piece = F.substring(F.col("message").cast("binary"), F.col("fragment") * max_bytes + 1, F.lit(max_bytes))
    df = df.withColumns({"fragment_offset": (F.col("fragment") * max_bytes).cast("long"), "piece": piece})
    return df.withColumn("message", F.when(size > max_bytes, F.make_valid_utf8(F.col("piece").cast("string"))).otherwise(F.col("message")))
