"""Chat formatting of typed content parts, with a reversible template and a loss mask.

A turn's parts go through a visitor: text is escaped and kept, every image, audio or document becomes
an ordered placeholder, its reference is recorded, and its expanded token count is added up. Formatting
is a map over turns, so a conversation of any length is never held as a whole. Reading back is a fold
over the formatted turns in order, which holds one batch.

Template: <|im_start|>ROLE, a newline, the content, <|im_end|>, a newline. In roles and texts a control
string is broken by one backslash: <, any backslashes, | gets one more backslash before the |. Undoing
this takes one away. Roles also have their newlines as \\n and backslashes doubled.

Null texts, parts and roles are empty. Turns are ordered by turn (null last), then role, then text (placeholders
in their places), both as they were before escaping, so that equal turn numbers have one order; repeated rows stay
repeated. An empty table gives an empty one. Turns with a null conversation id form one conversation with a null id.
A text of any length is one value of one row; columns besides those named do not pass, so none can clash.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import lean, partitions

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class TokenCosts:
    """What an attachment expands to."""

    patch: int = 14
    per_second: float = 25.0
    per_page: int = 256
    unknown: int = 1


@dataclass
class Flattened:
    content: str = ""
    #: (start, end) in content of the escaped texts
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0


class Flattener:
    """Visits the parts of one turn. A part of a type without a method is a document of unknown length."""

    def __init__(self, costs: TokenCosts):
        self.costs, self.out, self.counts, self.pending = costs, Flattened(), {}, ""

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pending += part.get("text") or ""

    def flush(self) -> None:
        """Neighbouring texts are escaped as one, or a control string could form across their border."""
        if self.pending:
            text, at = escape(self.pending), len(self.out.content)
            self.out.content += text
            self.out.texts.append((at, at + len(text)))
            self.pending = ""

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.flush()
        n = self.counts[kind] = self.counts.get(kind, -1) + 1
        self.out.content += f"<|{kind}:{n}|>"
        self.out.attachments.append({"kind": kind, "index": n, "ref": part.get("ref"), "tokens": tokens})
        self.out.tokens += tokens

    def visit_image(self, part: dict) -> None:
        w, h, p = part.get("width") or 0, part.get("height") or 0, self.costs.patch
        self._attach("image", part, max(1, -(-w // p) * -(-h // p)))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, int(-(-(part.get("seconds") or 0) * self.costs.per_second // 1))))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, (part.get("pages") or 1) * self.costs.per_page))

    def visit_other(self, part: dict) -> None:
        self._attach("document", part, self.costs.unknown)


def flatten(parts: list[dict] | None, costs: TokenCosts = TokenCosts()) -> Flattened:
    v = Flattener(costs)
    for p in parts or []:
        if p is not None:
            v.visit(p)
    v.flush()
    return v.out


def text_part(text: Column) -> Column:
    """One text part as a typed parts column."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("index", pa.int32()), ("ref", pa.string()), ("tokens", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", costs: TokenCosts = TokenCosts(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted row per turn: conv, turn, formatted, loss_spans (code points of formatted whose loss counts), attachments, attachment_tokens."""
    src = df.select(F.col(conv), F.col(turn), F.col(role).alias("_role"), F.col(parts).cast(f"array<{PART}>").alias("_parts"))

    def run(batches):
        for b in batches:
            formatted, spans, attached, tokens = [], [], [], []
            for r, p in zip(b["_role"].to_pylist(), b["_parts"].to_pylist()):
                r = r or ""
                head = f"{START}{escape_role(r)}\n"
                f = flatten(p, costs)
                formatted.append(f"{head}{f.content}{END}\n")
                spans.append([{"start": len(head) + s, "end": len(head) + e} for s, e in f.texts] if r in learn else [])
                attached.append(f.attachments)
                tokens.append(f.tokens)
            yield pa.RecordBatch.from_arrays([b[conv], b[turn], pa.array(formatted, pa.string()), pa.array(spans, _SPANS), pa.array(attached, _ATTACHED), pa.array(tokens, pa.int64())], [conv, turn, "formatted", "loss_spans", "attachments", "attachment_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:2]), "formatted string, loss_spans array<struct<start:int,end:int>>, attachments array<struct<kind:string,index:int,ref:string,tokens:long>>, attachment_tokens long"])
    return src.mapInArrow(lean(run), schema)


def role_and_text(formatted: Column) -> tuple[Column, Column]:
    """What parse_turn and unescape give, as columns: by these equal turn numbers are ordered."""
    plain = lambda c: F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")
    head = F.substring_index(formatted, "\n", 1)
    role = F.split(plain(F.substring(head, F.lit(len(START) + 1), F.length(head))), r"\\\\")
    content = F.substring(formatted, F.length(head) + 2, F.length(formatted) - F.length(head) - len(END) - 2)
    return F.array_join(F.transform(role, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"), plain(content)


def parse_turn(formatted: str) -> tuple[str, str]:
    """The role and the escaped content of a formatted turn."""
    if not formatted.startswith(START) or not formatted.endswith(f"{END}\n"):
        raise ValueError("not a formatted turn")
    role, _, rest = formatted[len(START) :].partition("\n")
    return unescape_role(role), rest[: -len(END) - 1]


class _Fold:
    def __init__(self, conv):
        self.conv, self.n, self.turns = conv, 0, hashlib.sha256()
        self.loss, self.loss_chars, self.chars = hashlib.sha256(), 0, 0

    def add(self, formatted: str, spans: list[dict]) -> None:
        role, content = parse_turn(formatted)
        self.turns.update(f"{role}\n{unescape(content)}\n".encode())
        for s in spans:
            text = unescape(formatted[s["start"] : s["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.n += 1
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """What formatted turns say, one row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a conversation is a chain over its turns, so a conversation is one task's; it streams through that task in order.
    """
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now = None
        for b in batches:
            done = []
            for c, f, s in zip(b[conv].to_pylist(), b["formatted"].to_pylist(), b["loss_spans"].to_pylist()):
                if now is None or now.conv != c:
                    if now is not None:
                        done.append(now.row())
                    now = _Fold(c)
                now.add(f, s or [])
            if done:
                yield _rows(done, b.schema.field(conv).type)
            kind = b.schema.field(conv).type
        if now is not None:
            yield _rows([now.row()], kind)

    def _rows(rows, kind):
        cols = list(zip(*rows))
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    df = formatted.select(conv, turn, "formatted", "loss_spans").repartition(partitions(formatted.sparkSession), conv)
    role, text = role_and_text(F.col("formatted"))
    # after the shuffle, so that only the sort carries the text twice
    df = df.withColumns({"_role": role, "_said": text}).sortWithinPartitions(F.col(conv), F.col(turn).asc_nulls_last(), "_role", "_said").drop("_role", "_said")
    return df.mapInArrow(lean(run), f"`{conv}` {df.schema[conv].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
