"""Metric rows: exposition text, other line formats, filters, rates, histograms and totals."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions.patterns import matches_any
from logspark.functions.text import empty_map, json_text, sorted_map
from logspark.functions.values import typed_value, valid_metric_name
from logspark.model import RATE_GAP_SECONDS
from logspark.operators.chains import Accepted, Spaced, chained
from logspark.operators.ordered import Fold, ordered_fold

_SAMPLE = r"^([^{\s]+)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"


def _whole(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def parse_exposition(texts: DataFrame, key: str = "scrape_id", text: str = "text") -> DataFrame:
    """Samples of exposition texts: key, line, metric, value, value_str, extra, sample_ts, type.

    Names are lower-cased, without quotes, spaces and dashes as _. A value with a point is a fraction, one with e+ or e-
    a whole number (cut towards zero), +Inf stays text; NaN and what else isn't a whole number is dropped. Only counters, gauges, untyped and
    undeclared metrics are kept; the type is the last declared before the sample in its scrape.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    declared = F.regexp_extract("raw", r"^#\s*TYPE\s+(\S+)\s+(\S+)", 1)
    name = F.translate(F.lower(F.regexp_replace(F.regexp_extract("raw", _SAMPLE, 1), "[\"']", "")), " -", "__")
    df = lines.withColumns({"_declared": F.when(declared != "", declared), "_name": F.when(~F.col("raw").startswith("#") & F.col("raw").rlike(_SAMPLE), name)})
    df = df.where("_declared is not null or _name is not null").withColumn("_key", F.coalesce("_declared", "_name"))
    kind = F.when(F.col("_declared").isNotNull(), F.regexp_extract("raw", r"^#\s*TYPE\s+(\S+)\s+(\S+)", 2))
    w = Window.partitionBy(key, "_key").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("type", F.last(kind, ignorenulls=True).over(w)).where("_name is not null")
    df = df.where(F.col("type").isNull() | F.col("type").isin("counter", "gauge", "untyped"))
    raw = F.regexp_extract("raw", _SAMPLE, 3)
    number = F.when(raw.contains("."), raw.try_cast("double")).when(raw.rlike("e[+-]"), _whole(raw.try_cast("double"))).otherwise(raw.try_cast("long").cast("double"))
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    pairs = F.split(F.regexp_extract("raw", _SAMPLE, 2), r'"\s*,\s*')
    entries = F.filter(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.regexp_replace(F.regexp_replace(p, r"(?s)^[^=]*=", ""), r'^"|"\s*,?\s*$', "").alias("value"))), lambda e: e["key"] != "")
    # a label given twice has its last value; labels are few, and parsed once
    extra = F.aggregate(entries, empty_map(), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    out = df.select(key, "line", F.col("_name").alias("metric"), number.alias("value"), F.when(raw == "+Inf", raw).alias("value_str"), extra.alias("extra"), F.regexp_extract("raw", _SAMPLE, 4).try_cast("long").alias("sample_ts"), "type")
    return out.where("value is not null or value_str is not null")


def parse_graphite(lines: DataFrame, column: str = "raw") -> DataFrame:
    """metric, value, time of lines that are exactly a name and two numbers; others are dropped."""
    p = F.split(F.trim(F.col(column)), r"\s+")
    return lines.withColumns({"metric": F.get(p, F.lit(0)), "value": F.get(p, F.lit(1)).try_cast("double"), "time": F.get(p, F.lit(2)).try_cast("double")}).where((F.size(p) == 3) & F.col("value").isNotNull() & F.col("time").isNotNull())


def rewrite_tsdb(c: Column) -> Column:
    """Without the second token (a time), k=v as k="v"."""
    return F.regexp_replace(F.regexp_replace(c, r"^(\S+)\s+\S+\s*", "$1 "), r"(\S+?)=(\S+)", '$1="$2"')


def format_metric_lines(metrics: DataFrame) -> DataFrame:
    """One text line for each metric: time [monitor] metric value k=json .., keys sorted."""
    value = F.when(F.col("value").isNotNull(), F.to_json(F.struct(F.col("value").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("value").alias("v")))) - 6)).otherwise(json_text(F.col("value_str")))
    fields = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("extra", empty_map()))), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), json_text(e["value"]))), "")
    return metrics.select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ["), "monitor", F.lit("] "), "metric", F.lit(" "), value, fields).alias("value"))


def as_metrics(df: DataFrame, dropped: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """A monitor's rows in the library's schema: valid names, columns that are missing as nulls, listed names dropped."""
    kinds = {"monitor": "string", "instance": "string", "metric": "string", "value": "double", "value_str": "string", "extra": "map<string,string>", "ts_ms": "bigint", "ts": "timestamp"}
    out = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    out = out.withColumn("metric", valid_metric_name(F.col("metric")))
    out = out.withColumn("ts", F.coalesce("ts", F.timestamp_millis("ts_ms"))).withColumn("ts_ms", F.coalesce("ts_ms", F.unix_millis("ts")))
    return drop_listed(out, dropped)


def drop_listed(metrics: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    return metrics.where(~F.col("metric").isin(*names)) if names else metrics


def filter_metrics(metrics: DataFrame, include: list[str] = ("*",), exclude: list[str] = (), components: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """Names that exclude matches go; a metric with a field that a component glob matches (by metric name, or * for all) stays; else include decides."""
    name = F.col("metric")
    out = metrics.where(~matches_any(name, exclude)) if exclude else metrics
    if "*" in include:
        return out
    kept = matches_any(name, include)
    for metric, fields in (components or {}).items():
        for field, globs in fields.items():
            hit = matches_any(F.coalesce(F.try_element_at("extra", F.lit(field)), F.lit("")), globs)
            kept = kept | (hit if metric == "*" else (name == metric) & hit)
    return out.where(kept)


def scrape_report(metrics: DataFrame, key: str, kept: Column, many: int = 2000) -> DataFrame:
    """total, included, ignored, and flags for too many and none included, of each scrape."""
    n = F.count_if(kept)
    return metrics.groupBy(key).agg(F.count("*").alias("total"), n.alias("included"), (F.count("*") - n).alias("ignored"), (n > many).alias("too_many"), (n == 0).alias("none_included"))


def rate_spec(spec: str) -> Column:
    """Whether a row fits monitor:metric or monitor:metric:field=value."""
    monitor, metric, *rest = spec.split(":", 2)
    fits = (F.col("monitor") == monitor) & (F.col("metric") == metric)
    if rest:
        field, _, value = rest[0].partition("=")
        fits = fits & F.coalesce(F.try_element_at("extra", F.lit(field)) == value, F.lit(False))
    return fits


def match_rate_specs(metrics: DataFrame, specs: list[str]) -> DataFrame:
    return metrics.where(reduce(lambda a, b: a | b, map(rate_spec, specs), F.lit(False)))


class _Rate(Fold):
    """The last accepted sample. A sample not later, or less, is skipped and changes nothing; after a long gap the next one begins anew."""

    state = "time double, value double"
    takes = ("series", "ts_ms", "value")

    def __init__(self, gap: float):
        self.gap, self.time, self.value = gap, None, None

    def saved(self):
        return _float(self.time), _float(self.value)

    def restore(self, values):
        self.time, self.value = values

    def add(self, row):
        return self.add_lists((row.series,), (row.ts_ms,), (row.value,))

    def add_lists(self, series, times, values):
        for s, ms, value in zip(series, times, values):
            if value is None or math.isnan(value):
                continue
            t = ms / 1000
            if self.time is None or t - self.time >= self.gap:
                self.time, self.value = t, value
                continue
            if t <= self.time or value < self.value:
                continue
            rate = (value - self.value) / (t - self.time)
            self.time, self.value = t, value
            yield s, ms, rate


def with_series(metrics: DataFrame, parts: tuple[str, ...] = ("monitor", "instance", "metric")) -> DataFrame:
    """Adds series: the text that rows of one series share, of columns and of extra fields but timestamp."""
    fields = F.to_json(sorted_map(F.map_filter(F.coalesce("extra", empty_map()), lambda k, _: k != "timestamp")))
    return metrics.withColumn("series", F.to_json(F.struct(*parts, fields.alias("extra")), {"ignoreNullFields": "false"}))


def rate(metrics: DataFrame, specs: list[str] | None = None, gap_seconds: float = RATE_GAP_SECONDS, digits: int = 5, never_decreases: bool = False) -> DataFrame:
    """series, ts_ms, rate (per second, rounded) of each series: see _Rate for the rules.

    never_decreases: the caller knows that series only grow; then the sample before is the last accepted one and windows do.
    """
    m = with_series(match_rate_specs(metrics, specs) if specs is not None else metrics).select("series", "ts_ms", "value")
    if never_decreases:
        w = Window.partitionBy("series").orderBy("ts_ms")
        m = m.where("value is not null").groupBy("series", "ts_ms").agg(F.min("value").alias("value"))
        seconds = (F.col("ts_ms") - F.lag("ts_ms").over(w)) / 1000
        m = m.withColumn("_s", seconds).withColumn("_d", F.col("value") - F.lag("value").over(w))
        out = m.where(F.col("_s") < gap_seconds).select("series", "ts_ms", (F.col("_d") / F.col("_s")).alias("rate"))
    else:
        # samples that count are a chain, so a series may be many tasks'
        m = chained(m.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("ts_ms").isNotNull()), ["series"], ["ts_ms", "value"], Accepted(gap_seconds), apart=1)
        seconds = F.col("ts_ms") / 1000 - F.col("since") / 1000
        out = m.where(F.col("since").isNotNull()).select("series", "ts_ms", ((F.col("value") - F.col("base")) / seconds).alias("rate"))
    return out.withColumn("rate", F.round("rate", digits))


SERIES_FUNCTIONS: dict[str, tuple[str, Callable[[], Fold]]] = {"rate": ("_rate", lambda: _Rate(RATE_GAP_SECONDS))}


def register_series_function(name: str, suffix: str, new: Callable[[], Fold]) -> None:
    """A function over sorted series: a fold whose add() yields (series, ts_ms, value); its results are metrics with the suffix."""
    SERIES_FUNCTIONS[name] = (suffix, new)


def derive(metrics: DataFrame, name: str, specs: list[str] | None = None) -> DataFrame:
    """series, metric (with the function's suffix), ts_ms, value of a registered function."""
    suffix, new = SERIES_FUNCTIONS[name]
    m = with_series(match_rate_specs(metrics, specs) if specs is not None else metrics).select("series", "ts_ms", "value")
    out = ordered_fold(m, ["series"], ["ts_ms", "value"], new, "series string, ts_ms bigint, value double")
    return out.withColumn("metric", F.concat(F.get_json_object("series", "$.metric"), F.lit(suffix)))


def delta(metrics: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Adds delta: the value less the one before in its series."""
    return metrics.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def last_n(metrics: DataFrame, keys: list[str], order: str, n: int = 2) -> DataFrame:
    """The last n samples of each series."""
    return metrics.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def process_totals(samples: DataFrame, cumulative: list[str], app: str = "app", epoch: str = "epoch", pid: str = "pid") -> DataFrame:
    """app, epoch, metric, total over the running processes of an application.

    Absolute metrics: the sum of their values. Cumulative ones: a running total of what each process added since the
    epoch before, if it was seen then; the total starts again after an epoch without any process. samples: one row per app,
    epoch (dense numbers), pid and metric, value.
    """
    w = Window.partitionBy(app, pid, "metric").orderBy(epoch)
    grown = F.when(F.lag(epoch).over(w) == F.col(epoch) - 1, F.col("value") - F.lag("value").over(w))
    df = samples.withColumn("_grown", F.coalesce(grown, F.lit(0.0)))
    sums = df.groupBy(app, epoch, "metric").agg(F.sum("value").alias("_value"), F.sum("_grown").alias("_grown"))
    by_metric = Window.partitionBy(app, "metric").orderBy(epoch)
    broken = F.when(F.coalesce(F.lag(epoch).over(by_metric) == F.col(epoch) - 1, F.lit(False)), 0).otherwise(1)
    sums = sums.withColumn("_broken", broken).withColumn("_run", F.sum("_broken").over(by_metric.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("_grown").over(Window.partitionBy(app, "metric", "_run").orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("total", F.when(F.col("metric").isin(*cumulative), total).otherwise(F.col("_value"))).select(app, epoch, "metric", "total")


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Non-empty buckets [lower, upper) of each key: bucket, count, lower, upper, total, least, greatest.

    The first bucket begins at the least value, the overflow bucket ends 0.01 over the greatest."""
    bucket = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col(value) < bounds[i], i).otherwise(bucket)
    df = df.where(F.col(value).isNotNull()).withColumn("bucket", bucket)
    counted = df.groupBy(*keys, "bucket").agg(F.count("*").alias("count"), F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys)
    edges = F.array(*(F.lit(float(b)) for b in bounds))
    out = counted.withColumns({"least": F.min("_low").over(w), "greatest": F.max("_high").over(w), "total": F.sum("count").over(w), "sum": F.sum("_sum").over(w)})
    lower = F.when(F.col("bucket") == 0, F.col("least")).otherwise(F.get(edges, F.col("bucket") - 1))
    upper = F.when(F.col("bucket") == len(bounds), F.col("greatest") + 0.01).otherwise(F.get(edges, F.col("bucket")))
    return out.select(*keys, "bucket", "count", lower.alias("lower"), upper.alias("upper"), "total", "least", "greatest", "sum")


def estimate_percentile(buckets: DataFrame, keys: list[str], p: float) -> DataFrame:
    """estimate: the middle of the first bucket at which p of the values are reached."""
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    df = buckets.withColumn("_reached", F.sum("count").over(w)).where(F.col("_reached") >= F.col("total") * p)
    return df.groupBy(*keys).agg(F.min_by((F.col("lower") + F.col("upper")) / 2, "bucket").alias("estimate"))


def summarise_histogram(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """summary: count, average, least, greatest and estimated median as text with two decimals."""
    stats = buckets.groupBy(*keys).agg(F.first("total").alias("n"), F.first("sum").alias("s"), F.first("least").alias("a"), F.first("greatest").alias("b"))
    both = stats.join(estimate_percentile(buckets, keys, 0.5), keys)
    return both.select(*keys, F.format_string("count=%d,avg=%.2f,min=%.2f,max=%.2f,median=%.2f", F.col("n"), F.col("s") / F.col("n"), F.col("a"), F.col("b"), F.col("estimate")).alias("summary"))


def typed_metrics(rows: DataFrame, metric: str, text: str) -> DataFrame:
    """Adds value and value_str of a text value."""
    return rows.withColumn("_v", typed_value(F.col(text))).withColumns({"metric": F.col(metric), "value": F.col("_v.value"), "value_str": F.col("_v.value_str")}).drop("_v")


def _float(x) -> float | None:
    return None if x is None else float(x)


class _Bucket(Fold):
    state = "level double, time double, dropped bigint"
    takes = ("key", "t", "cost")

    def saved(self):
        return float(self.level), _float(self.time), int(self.dropped)

    def restore(self, values):
        self.level, self.time, self.dropped = values

    def __init__(self, burst: float, per_second: float):
        self.burst, self.rate, self.level, self.time, self.dropped = burst, per_second, burst, None, 0

    def add(self, row):
        return self.add_lists((row.key,), (row.t,), (row.cost,))

    def add_lists(self, keys, times, costs):
        for key, t, cost in zip(keys, times, costs):
            if self.time is not None:
                self.level = min(self.burst, self.level + (t - self.time) * self.rate)
            self.time = t
            if cost <= self.level:
                self.level -= cost
                yield key, t, cost, True, self.dropped
                self.dropped = 0
            else:
                self.dropped += 1
                yield key, t, cost, False, 0


def rate_limit(rows: DataFrame, key: Column, t: Column, cost: Column, burst: float, per_second: float) -> DataFrame:
    """key, t, cost, admitted, dropped_before: a leaky bucket for each key. A refused row costs nothing; the next admitted one carries how many were."""
    df = rows.select(key.cast("string").alias("key"), t.cast("double").alias("t"), cost.cast("double").alias("cost"))
    return ordered_fold(df, ["key"], ["t", "cost"], lambda: _Bucket(burst, per_second), "key string, t double, cost double, admitted boolean, dropped_before bigint")


class _Once(Fold):
    state = "last double"
    takes = ("key", "t")

    def saved(self):
        return (_float(self.last),)

    def restore(self, values):
        (self.last,) = values

    def __init__(self, seconds: float):
        self.seconds, self.last = seconds, None

    def add(self, row):
        return self.add_lists((row.key,), (row.t,))

    def add_lists(self, keys, times):
        for key, t in zip(keys, times):
            if self.last is None or t - self.last >= self.seconds:
                self.last = t
                yield key, t


def once_per(rows: DataFrame, key: Column, t: Column, seconds: float) -> DataFrame:
    """key, t of the first row of each key and of each that is `seconds` after the last one kept. Rows without a time are left out. A key may be many tasks' (see chains)."""
    df = rows.select(key.cast("string").alias("key"), t.cast("double").alias("t")).where("t is not null and not isnan(t)")
    return chained(df, ["key"], ["t"], Spaced("t", seconds)).where("start").select("key", "t")
