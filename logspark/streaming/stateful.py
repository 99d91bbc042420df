"""Stateful streams: the folds of the batch operators, with their state kept between batches.

State has columns of its own, an entry for each key or (a few numbers a key) for each chunk of keys, in the state store that the session names (RocksDB is advised);
so what a checkpoint holds can be read as a table (see state_of). Rows of a bucket of keys that arrive in one batch are put in order first. What a fold would emit at the end
of its input is emitted by a timer.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logspark.operators.metrics import _Bucket, _Once, _Rate, with_series
from logspark.operators.ordered import Fold, _fields
from logspark.operators.parse import _Frames
from logspark.operators.lines import _Groupers, _Pieces
from logspark.functions.patterns import found
from logspark.model import MAX_LINE_BYTES, RATE_GAP_SECONDS, Grouper

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: The name of the state.
STATE = "fold"


#: Keys are dealt by their hash into so many buckets, each a group of the stream with a map of its keys' states. A checkpoint keeps the number.
BUCKETS = 4096
#: Keys of a bucket are dealt into so many chunks, if their states are kept by chunks (see _Chunked). A checkpoint keeps the number.
CHUNKS = 16
#: The name of a chunk's number.
CHUNK = "_chunk"
#: Rows of a frame that leaves.
OUT_ROWS = 10_000


class _Processor(StatefulProcessor):
    """The folds of a bucket's keys: what a call costs is a bucket's and not each key's."""

    def __init__(self, new: Callable[[], Fold], keys: dict[str, str], order: list[str], names: list[str], wait_ms: int | None, ttl_ms: int | None):
        self.new, self.keys, self.order, self.names, self.wait_ms, self.ttl_ms = new, keys, order, names, wait_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a fold that names no columns is kept as a whole; due: when a key that gets no row until then ends
        columns = (self.new().state or "body binary") + ("" if self.wait_ms is None else ", due bigint")
        self.states = handle.getMapState(STATE, ", ".join(f"`{k}` {kind}" for k, kind in self.keys.items()), columns, self.ttl_ms)

    def _fold(self, values: tuple | None) -> Fold:
        fold = self.new()
        if values is None:
            return fold
        if not fold.state:
            return pickle.loads(bytes(values[0]))
        fold.restore(tuple(values if self.wait_ms is None else values[:-1]))
        return fold

    def _frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        for k in range(0, len(out), OUT_ROWS):
            yield pd.DataFrame(out[k : k + OUT_ROWS], columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        own: dict[tuple, list] = {}
        for k, row in zip(zip(*(df[c].astype(object).where(df[c].notna(), None) for c in self.keys)), df.itertuples(index=False)):
            own.setdefault(k, []).append(row)
        due = () if self.wait_ms is None else (timerValues.getCurrentProcessingTimeInMs() + self.wait_ms,)
        out, known = [], self.states.exists()
        for k, its in own.items():
            fold = self._fold(self.states.getValue(k) if known else None)
            for row in its:
                out += fold.add(row)
            self.states.updateValue(k, (*(fold.saved() if fold.state else (pickle.dumps(fold),)), *due))
        # a timer that is set is earlier, and sets the next one
        if due and not list(self.handle.listTimers()):
            self.handle.registerTimer(due[0])
        yield from self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, over, later = timerValues.getCurrentProcessingTimeInMs(), [], [], []
        for k, values in self.states.iterator():
            if values[-1] <= now:
                out += self._fold(values).end()
                over.append(tuple(k))
            else:
                later = [min([values[-1], *later])]
        for k in over:
            self.states.removeKey(k)
        if later:
            self.handle.registerTimer(later[0])
        yield from self._frames(out)

    def close(self) -> None:
        pass


class _Chunked(_Processor):
    """Folds whose state is a few numbers and that take lists. A chunk of a bucket's keys is one entry of the state, with a list for each column: a batch reads and writes the chunks
    that it has keys of, so that calls are bounded by the chunks and don't grow with the keys."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = [(f"key_{k}", kind) for k, kind in self.keys.items()] + [(f"value_{n}", kind) for n, kind in (f.split(None, 1) for f in _fields(self.new().state))]
        self.states = handle.getMapState(STATE, f"{CHUNK} int", ", ".join(f"`{n}` array<{kind}>" for n, kind in columns), None)

    def _read(self, chunk: int) -> dict[tuple, tuple]:
        columns = self.states.getValue((chunk,))
        return {} if columns is None else dict(zip(zip(*columns[: len(self.keys)]), zip(*columns[len(self.keys) :])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        codes = df.groupby(list(self.keys), sort=False, dropna=False).ngroup().to_numpy()
        at = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[at], prepend=-1))
        heads = zip(*([None if pd.isna(x) else x for x in df[c].to_numpy(object)[at[starts]]] for c in self.keys))
        lists = [df[c].iloc[at].tolist() for c in self.new().takes]
        chunks: dict[int, dict[tuple, tuple]] = {}
        out, known = [], self.states.exists()
        for k, a, b in zip(heads, starts.tolist(), [*starts[1:].tolist(), len(at)]):
            n = zlib.crc32(ascii(k).encode()) % CHUNKS
            if n not in chunks:
                chunks[n] = self._read(n) if known else {}
            fold = self._fold(chunks[n].get(k))
            out += fold.add_lists(*(x[a:b] for x in lists))
            chunks[n][k] = fold.saved()
        for n, held in chunks.items():
            self.states.updateValue((n,), (*map(list, zip(*held)), *map(list, zip(*held.values()))))
        yield from self._frames(out)


def _processor(new: Callable[[], Fold], keys: dict[str, str], order: list[str], names: list[str], wait_ms: int | None, ttl_ms: int | None) -> _Processor:
    # a timer or a time to live is each key's own
    kind = _Chunked if new().takes and wait_ms is None and ttl_ms is None else _Processor
    return kind(new, keys, order, names, wait_ms, ttl_ms)


def stream_fold(df: DataFrame, keys: list[str], order: list[str], new: Callable[[], Fold], schema: str, wait_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """A fold over a stream. wait_ms: a key that gets no row for so long emits its end and is forgotten. ttl_ms: state unused for so long is dropped."""
    names = [f.split()[0].strip("`") for f in _fields(schema)]
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).groupBy("_bucket")
    return dealt.transformWithStateInPandas(_processor(new, kinds, order, names, wait_ms, ttl_ms), outputStructType=schema, outputMode="append", timeMode="processingTime" if wait_ms is not None or ttl_ms is not None else "none")


def stream_groups(lines: DataFrame, groupers: list[Grouper], wait_ms: int | None = 5_000, separator: str = "\n", max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """group_lines_by on a stream: an open group is held until a line closes it, or for wait_ms."""
    flags = F.array(*(x for g in groupers for x in (found(F.col("raw"), g.start), found(F.col("raw"), g.pattern))))
    df = lines.select("log_path", "line_seq", "raw", flags.alias("flags"))
    return stream_fold(df, ["log_path"], ["line_seq"], lambda: _Groupers(groupers, separator, max_bytes), "log_path string, line_seq bigint, n_lines bigint, message string", wait_ms)


def stream_pieces(parsed: DataFrame, wait_ms: int | None = 5_000, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """reassemble_cri on a stream: pieces are held until a full one, the size, or wait_ms."""
    ok = parsed.where("error is null").select("log_path", "stream", "line_seq", "ts_nanos", F.regexp_replace("message", r"\r?\n$", "").alias("piece"), F.array_contains("tags", "F").alias("full"))
    return stream_fold(ok, ["log_path", "stream"], ["line_seq"], lambda: _Pieces(max_bytes), "log_path string, stream string, line_seq bigint, ts_nanos bigint, n_pieces bigint, message string, partial boolean", wait_ms)


def stream_rate(metrics: DataFrame, gap_seconds: float = RATE_GAP_SECONDS, ttl_ms: int | None = 30 * 60_000, digits: int = 5) -> DataFrame:
    """rate on a stream; a series without samples for ttl_ms begins anew. With a ttl the stream runs on processing time and so never ends by itself."""
    m = with_series(metrics).select("series", "ts_ms", "value")
    out = stream_fold(m, ["series"], ["ts_ms", "value"], lambda: _Rate(gap_seconds), "series string, ts_ms bigint, rate double", ttl_ms=ttl_ms)
    return out.withColumn("rate", F.round("rate", digits))


def stream_once_per(rows: DataFrame, seconds: float) -> DataFrame:
    """once_per on a stream of key, t."""
    return stream_fold(rows.select("key", "t"), ["key"], ["t"], lambda: _Once(seconds), "key string, t double")


def stream_rate_limit(rows: DataFrame, burst: float, per_second: float) -> DataFrame:
    """rate_limit on a stream of key, t, cost."""
    schema = "key string, t double, cost double, admitted boolean, dropped_before bigint"
    return stream_fold(rows.select("key", "t", "cost"), ["key"], ["t", "cost"], lambda: _Bucket(burst, per_second), schema)


def stream_frames(chunks: DataFrame, wait_ms: int | None = 5_000, prefixed: bool = False, max_frame: int = 65_536) -> DataFrame:
    """split_syslog_frames on a stream: an unfinished frame is emitted as it is after wait_ms."""
    return stream_fold(chunks, ["conn_id"], ["chunk_seq"], lambda: _Frames(prefixed, max_frame), "conn_id string, frame_seq bigint, frame binary, complete boolean, error string", wait_ms)


def interval_report(stream: DataFrame, ts: str, keys: list[str], every: str, late: str = "1 hour") -> DataFrame:
    """keys, window_start, rows, total of every interval; rows later than `late` no longer count. ts must be a timestamp, value is summed."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return s.groupBy(*keys, F.window("_ts", every).alias("w")).agg(F.count("*").alias("rows"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("window_start"), "rows", "total")


def skip_stale(stream: DataFrame, ts: str, newest_allowed_age: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that may still be copied, and those that are older than that against the stream's clock (or `now`): count the latter by interval_report."""
    old = F.coalesce(F.col(ts).cast("timestamp") < (F.current_timestamp() if now is None else now) - F.expr(f"interval {newest_allowed_age}"), F.lit(False))
    return stream.where(~old), stream.where(old)


def series_count(metrics: DataFrame, ts: str, every: str, late: str = "1 hour", precision: float = 0.02) -> DataFrame:
    """window_start and series, the number of series (about) that had a sample in each interval: what a limit on series is compared with."""
    m = with_series(metrics).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return m.groupBy(F.window("_ts", every).alias("w")).agg(F.approx_count_distinct("series", precision).alias("series")).select(F.col("w.start").alias("window_start"), "series")


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key and value (columns) of what a stopped stream of this module holds, from its checkpoint: a row for each key, for rates each series, that isn't forgotten."""
    held = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint).select(F.col("user_map_key").alias("key"), F.col("user_map_value").alias("value"))
    if held.schema["key"].dataType.names != [CHUNK]:
        return held
    lists = held.select("value.*")
    rows = lists.select(F.explode(F.arrays_zip(*lists.columns)).alias("row"))
    part = lambda prefix: F.struct(*(F.col(f"row.{c}").alias(c.removeprefix(prefix)) for c in lists.columns if c.startswith(prefix)))
    return rows.select(part("key_").alias("key"), part("value_").alias("value"))


class _Stale(StatefulProcessor):
    def __init__(self, threshold_ms: int, names: list[str]):
        self.threshold_ms, self.names = threshold_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "scan_ms bigint, stale boolean, skipped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values(["scan_ms", "line_seq"], kind="stable")
        last, stale, skipping = self.last.get() if self.last.exists() else (None, False, False)
        scans = df["scan_ms"].unique()
        skips = set()
        for scan in map(int, scans):
            # a scan may go on in a later batch
            if last is None or scan != last:
                skipping = bool(stale) or (last is not None and scan - last > self.threshold_ms)
            if skipping:
                skips.add(scan)
            last, stale = max(scan, last or scan), False
        self.last.update((last, False, skipping))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.handle.registerTimer(last + self.threshold_ms + 1)
        df["skipped"], df["stale_since_ms"] = df["scan_ms"].isin(skips), None
        yield df[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, skipped = self.last.get()
        self.last.update((last, True, skipped))
        notice = {"log_path": key[0], "stale_since_ms": last}
        yield pd.DataFrame([[notice.get(n) for n in self.names]], columns=self.names)

    def close(self) -> None:
        pass


def skip_stale_logs(lines: DataFrame, threshold: str, late: str = "10 minutes") -> DataFrame:
    """Lines of logs: log_path, line_seq, scan (when they were seen) and raw_len, with skipped: whether the log had been left alone for longer than `threshold` when the scan found them.

    Then all that it found is passed over, as the log skips to its end; count it by processing_report or reports.observed. Time is the scans', a timer for each log tells when it
    has become stale: a row with stale_since alone. Scans that are later than `late` no longer count. See reports.mark_stale for the same on tables.
    """
    ms = F.unix_millis(F.col("scan").cast("timestamp"))
    df = lines.withColumn("_at", F.col("scan").cast("timestamp")).withWatermark("_at", late).select(F.col("log_path").cast("string").alias("log_path"), F.col("line_seq").cast("long").alias("line_seq"), F.col("raw_len").cast("long").alias("raw_len"), ms.alias("scan_ms"), "_at")
    names = ["log_path", "line_seq", "raw_len", "scan_ms", "skipped", "stale_since_ms"]
    schema = "log_path string, line_seq bigint, raw_len bigint, scan_ms bigint, skipped boolean, stale_since_ms bigint"
    out = df.groupBy("log_path").transformWithStateInPandas(_Stale(_milliseconds(threshold), names), outputStructType=schema, outputMode="append", timeMode="eventTime")
    return out.select("log_path", "line_seq", "raw_len", F.timestamp_millis("scan_ms").alias("scan"), "skipped", F.timestamp_millis("stale_since_ms").alias("stale_since"))


_UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _milliseconds(text: str) -> int:
    """`5 minutes` and the like."""
    n, unit = text.split()
    return int(n) * _UNITS[unit.rstrip("s")]
