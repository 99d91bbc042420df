"""Schemas of the library's tables, and the rules that users write."""

from __future__ import annotations

from dataclasses import dataclass, field

LINE = "log_path string, line_seq bigint, byte_offset bigint, raw string, raw_len int"
EVENT = "log_path string, seq_id string, seq_num bigint, ts_nanos bigint, ts timestamp, message string, attrs map<string,string>, sample_rate double, redactions int"
METRIC = "monitor string, instance string, metric string, value double, value_str string, extra map<string,string>, ts_ms bigint, ts timestamp"

#: Design limits of the line and metric model.
MAX_LINE_BYTES = 49_900
SEQUENCE_LIMIT = 1 << 40
RATE_GAP_SECONDS = 660
REQUEST_BYTES = 1_000_000
NEW_BACKLOG_BYTES, KNOWN_BACKLOG_BYTES = 5_000_000, 100_000_000


@dataclass(frozen=True)
class SamplingRule:
    """Lines in which `match` is found are kept with probability `rate`."""

    match: str
    rate: float

    def __post_init__(self):
        if not 0 <= self.rate <= 1:
            raise ValueError("a sampling rate is from 0 to 1")


@dataclass(frozen=True)
class RedactionRule:
    """Every match becomes `replacement`, in which \\1 is a group and \\H1 the salted hash of a group."""

    match: str
    replacement: str = ""
    hash_salt: str = ""


@dataclass(frozen=True)
class LogConfig:
    """How the logs that the globs match are treated; None: the default's."""

    name: str
    path: str = "*"
    namespace: str = "*"
    pod: str = "*"
    container: str = "*"
    parser: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    sampling: tuple[SamplingRule, ...] = ()
    redaction: tuple[RedactionRule, ...] = ()


GROUPERS = ("continueThrough", "continuePast", "haltBefore", "haltWith")


@dataclass(frozen=True)
class Grouper:
    """Groups lines from one that `start` matches; `kind` says what `pattern` does."""

    kind: str
    start: str
    pattern: str

    def __post_init__(self):
        if self.kind not in GROUPERS:
            raise ValueError(f"unknown kind of line grouper: {self.kind}")


def grouper_from_dict(rule: dict[str, str]) -> Grouper:
    """A rule with `start` and exactly one of the four kinds."""
    kinds = [k for k in GROUPERS if k in rule]
    if "start" not in rule or len(kinds) != 1 or set(rule) - {"start", *GROUPERS}:
        raise ValueError("a line grouper has start and one of " + ", ".join(GROUPERS))
    return Grouper(kinds[0], rule["start"], rule[kinds[0]])
