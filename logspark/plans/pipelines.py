"""Operators put together: lines to events, scrapes to metrics, containers to log configs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.model import REQUEST_BYTES, Grouper, RedactionRule, SamplingRule
from logspark.operators import lines as line_ops
from logspark.operators.inventory import diff_snapshots
from logspark.operators.joins import attach_attributes, attach_pod, first_matching
from logspark.operators.metrics import as_metrics, filter_metrics, parse_exposition
from logspark.operators.reports import processing_report
from logspark.operators.rules import kept, redact, sample, sample_rate
from logspark.operators.sequence import sequence


def log_events(lines: DataFrame, grouper: Grouper | None, sampling: tuple[SamplingRule, ...] = (), redaction: tuple[RedactionRule, ...] = (), containers: DataFrame | None = None, seed: int = 42, block: Column | None = None) -> DataFrame:
    """Assemble, sample, redact, add attributes, number: in this order, since sampling sees unredacted lines and numbers count what is left."""
    df = line_ops.group_lines(lines, grouper, block=block) if grouper else lines.select("log_path", "line_seq", F.lit(1).cast("long").alias("n_lines"), F.col("raw").alias("message"))
    df = redact(sample(df, sampling, ["log_path", "line_seq"], seed=seed), redaction)
    if containers is not None:
        df = attach_attributes(df, containers)
    return sequence(df.withColumn("raw_len", F.octet_length("message") + 1), block=block)


def log_report(lines: DataFrame, grouper: Grouper, sampling: tuple[SamplingRule, ...], redaction: tuple[RedactionRule, ...], block: Column | None = None, max_bytes: int = REQUEST_BYTES, skipped: Column | None = None) -> DataFrame:
    """What log_events did with each log. Events over max_bytes fail; skipped: of which logs the backlog isn't read."""
    df = line_ops.group_lines(lines, grouper, block=block).withColumn("raw_len", F.octet_length("message") + 1)
    # flags instead of filters, so that one pass counts what stays and what goes
    df = df.withColumn("_kept", kept(sample_rate(F.col("message"), sampling), ["log_path", "line_seq"]))
    df = df.withColumns({"_failed": F.col("raw_len") > max_bytes, "_skipped": F.lit(False) if skipped is None else F.coalesce(skipped, F.lit(False))})
    return processing_report(redact(df, redaction), ["log_path"], F.col("_kept"), F.col("redacted"), F.col("_failed"), F.col("_skipped"))


def scrape_metrics(scrapes: DataFrame, monitor: str, include: list[str], exclude: list[str], components: dict | None = None, dropped: tuple[str, ...] = ()) -> DataFrame:
    """Exposition texts (scrape_id, instance, ts_ms, text) as metrics that pass the filters."""
    m = filter_metrics(parse_exposition(scrapes), include, exclude, components)
    m = m.join(scrapes.select("scrape_id", "instance", "ts_ms"), "scrape_id")
    return as_metrics(m.withColumn("monitor", F.lit(monitor)), dropped)


def container_configs(previous: DataFrame, current: DataFrame, pods: DataFrame, configs: list) -> DataFrame:
    """cid, status and config of containers that started, stopped or changed between two snapshots; rules.apply_configs treats their lines by the config."""
    changes = diff_snapshots(previous, current, "cid", F.col("digest"))
    known = current.unionByName(previous.join(current.select("cid"), "cid", "left_anti"))
    rows = attach_pod(changes.join(known, "cid"), pods)
    return first_matching(rows, configs, {"namespace": "namespace", "pod": "pod", "container": "name"})
