"""Media columns as MPEG transport streams: writing payloads into packets, and reading streams back.

A stream has a program association table, a program map table, and one private elementary stream.
The payload is cut into units; each becomes one elementary packet with a presentation timestamp,
whose first transport packet carries the random-access flag and a clock reference. The reader trusts
nothing but the bytes: it checks sync bytes and table checksums, finds the stream by the two tables,
checks continuity counters, puts elementary packets together, checks their lengths, and keeps the
timestamp and byte offset of every random-access point.

Packets without payload (an adaptation field alone) are passed over, as is one repeat of a packet; both are legal.

A null payload is an empty one. An empty payload makes a stream of tables alone. Rows are independent,
so repeated rows, ties and empty tables need no care; a payload of any length is one row's stream. In writing, other
columns pass unchanged and one named like the stream's column is replaced; in reading, only those named pass.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import lean, utf8

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, PRIVATE_DATA, PRIVATE_STREAM, CLOCK = 188, 0x47, 0, 0x06, 0xBD, 90_000
#: Choices of this writer.
PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x100, 1


class BadStream(ValueError):
    """A stream that breaks a rule of the format."""


@lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg(data: bytes) -> int:
    c, table = 0xFFFFFFFF, _crc_table()
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ x]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


@lru_cache(1)
def tables() -> bytes:
    pat = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, PRIVATE_DATA, 0xE000 | MEDIA_PID, 0xF000))
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _timestamp(t: int) -> bytes:
    t &= (1 << 33) - 1
    return struct.pack(">BHH", 0x21 | (t >> 29) & 0x0E, (t >> 14) & 0xFFFE | 1, (t << 1) & 0xFFFE | 1)


def write_stream(payload: bytes, unit: int = 192 * 170, ticks: int = CLOCK // 25) -> bytes:
    """The stream of a payload; `unit` bytes, 65000 at most, to an elementary packet, `ticks` from one to the next."""
    if not 0 < unit <= 65_000:
        raise ValueError("unit must be from 1 to 65000 bytes")
    out, counter = [tables()], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        chunk = payload[at : at + unit]
        body = struct.pack(">3xBHBBB", PRIVATE_STREAM, len(chunk) + 8, 0x84, 0x80, 5).replace(b"\0\0\0", b"\0\0\1", 1) + _timestamp(k * ticks) + chunk
        clock = k * ticks
        first = bytes([0x50]) + struct.pack(">IH", (clock >> 1) & 0xFFFFFFFF, (clock & 1) << 15 | 0x7E00)
        room = PACKET - 4 - 8
        # the first packet has flags and the clock; if all fits in it, stuffing follows the clock
        fill = max(0, room - len(body))
        head = struct.pack(">BHB", SYNC, 0x4000 | MEDIA_PID, 0x30 | counter) + bytes([7 + fill]) + first + b"\xff" * fill
        out.append(head + body[: room - fill])
        counter = (counter + 1) & 15
        rest = np.frombuffer(body, np.uint8)[room:]
        whole, last = divmod(len(rest), PACKET - 4)
        if whole:
            m = np.empty((whole, PACKET), np.uint8)
            m[:, :3] = np.frombuffer(struct.pack(">BH", SYNC, MEDIA_PID), np.uint8)
            m[:, 3] = 0x10 | ((counter + np.arange(whole)) & 15)
            m[:, 4:] = rest[: whole * (PACKET - 4)].reshape(whole, -1)
            out.append(m.tobytes())
            counter = (counter + whole) & 15
        if last:
            fill = PACKET - 4 - last
            pad = bytes([fill - 1]) + (b"\0" + b"\xff" * (fill - 2) if fill > 1 else b"")
            out.append(struct.pack(">BHB", SYNC, MEDIA_PID, 0x30 | counter) + pad + rest[len(rest) - last :].tobytes())
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    units: int = 0
    timestamps: list[int] = field(default_factory=list)
    #: (timestamp, byte offset in the stream) of each random-access point
    access: list[tuple[int, int]] = field(default_factory=list)


def _read_section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    at = 5 + (raw[4] + 1 if raw[3] & 0x20 else 0)
    at = at + raw[at - 1]
    size = struct.unpack_from(">H", raw, at + 1)[0] & 0xFFF
    section = raw[at : at + 3 + size]
    if raw[at] != table_id or size < 9 or crc32_mpeg(section) != 0:
        raise BadStream("a program table is damaged")
    return section[8:-4]


def continued(p: np.ndarray) -> np.ndarray:
    """Which of a stream's packets hold new payload: counters grow by one from payload to payload; a packet may come twice."""
    control = p[:, 3]
    if ((control & 0x30) == 0).any():
        raise BadStream("a packet has neither payload nor adaptation field")
    full = np.flatnonzero(control & 0x10)
    # a packet with an adaptation field alone has the counter of the last payload
    before = np.maximum.accumulate(np.where(control & 0x10, np.arange(len(p)), -1))
    bare = np.flatnonzero(((control & 0x10) == 0) & (before >= 0))
    step = (control[full[1:]] - control[full[:-1]]) & 15
    again = step == 0
    # what may differ in a repeat is its clock: the six bytes after the flags
    twice = np.flatnonzero(again)
    now, last = p[full[twice + 1]], p[full[twice]]
    same = now == last
    same[:, 6:12] |= ((now[:, 3] & 0x20 != 0) & (now[:, 4] >= 7) & (now[:, 5] & 0x10 != 0))[:, None]
    if (step > 1).any() or not same.all() or (again[1:] & again[:-1]).any() or ((control[bare] ^ control[before[bare]]) & 15).any():
        raise BadStream("continuity counters don't follow one another")
    return full[np.r_[True, ~again]] if len(full) else full


def read_stream(data: bytes) -> Stream:
    if len(data) % PACKET:
        raise BadStream("the length isn't a multiple of 188")
    m = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (m[:, 0] != SYNC).any() or (m[:, 1] & 0x80).any():
        raise BadStream("a packet has no sync byte or is marked as broken")
    pid = (m[:, 1].astype(np.int32) & 0x1F) << 8 | m[:, 2]
    starts = (m[:, 1] & 0x40) != 0
    found = np.flatnonzero((pid == PAT_PID) & starts)
    if not len(found):
        raise BadStream("there is no program association table")
    programs = [struct.unpack_from(">HH", b, i) for b in [_read_section(m[found[0]], 0)] for i in range(0, len(b), 4)]
    pmt_pid = next((p & 0x1FFF for n, p in programs if n), None)
    found = np.flatnonzero((pid == pmt_pid) & starts)
    if not len(found):
        raise BadStream("there is no program map table")
    body = _read_section(m[found[0]], 2)
    at, media_pid = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF), None
    while at < len(body) and media_pid is None:
        kind, es, info = struct.unpack_from(">BHH", body, at)
        media_pid = es & 0x1FFF if kind == PRIVATE_DATA else None
        at += 5 + (info & 0xFFF)
    if media_pid is None:
        raise BadStream("there is no private elementary stream")
    own = np.flatnonzero(pid == media_pid)
    out = Stream(packets=len(m))
    if not len(own):
        return out
    own = own[continued(m[own])]
    if not len(own):
        return out
    p = m[own]
    adapted = (p[:, 3] & 0x20) != 0
    begin = np.where(adapted, 5 + p[:, 4].astype(np.int64), 4)
    if (begin > PACKET).any() or not starts[own[0]]:
        raise BadStream("an adaptation field is too long, or the first unit has no start")
    access = adapted & (begin > 5) & ((p[:, 5] & 0x40) != 0)
    flat = p[np.arange(PACKET) >= begin[:, None]]
    ends = np.cumsum(PACKET - begin)
    units = np.flatnonzero(starts[own])
    cuts = np.r_[ends[units] - (PACKET - begin[units]), len(flat)]
    parts = []
    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
        head = flat[s : s + 14].tobytes()
        if len(head) < 9 or head[:4] != b"\0\0\1\xbd" or struct.unpack_from(">H", head, 4)[0] != e - s - 6:
            raise BadStream("an elementary packet's start code or length is wrong")
        if head[7] & 0x80:
            a, b, c = struct.unpack_from(">BHH", head, 9)
            t = (a >> 1 & 7) << 30 | (b >> 1) << 15 | c >> 1
            out.timestamps.append(t)
            if access[units[k]]:
                out.access.append((t, int(own[units[k]]) * PACKET))
        parts.append(flat[s + 9 + head[8] : e].tobytes())
    out.units, out.payload = len(parts), b"".join(parts)
    return out


def pack_media(df: DataFrame, payload: str = "payload", media: str = "media", unit: int = 192 * 170) -> DataFrame:
    """Adds the binary column `media` with each payload's stream."""

    def run(batches):
        for b in batches:
            rows = [write_stream(x.as_py() or b"", unit) for x in b[payload]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.binary())], [*b.schema.names, media])

    df = df.drop(media)
    return df.mapInArrow(lean(run), df.withColumn(media, F.lit(None).cast("binary")).schema)


def padded_texts(df: DataFrame, key: str, text: str, multiple: int = 192) -> DataFrame:
    """The key, n_bytes, and the payload: each text's bytes, with spaces up to a positive multiple."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    size = F.greatest(F.lit(multiple), F.ceil(n / multiple).cast("int") * multiple)
    return df.select(F.col(key), n.cast("long").alias("n_bytes"), F.rpad(raw, size, F.lit(b" ")).alias("payload"))


def read_media(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """Reads each stream back. Columns: those of `keep`, then

    payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256, packets,
    timestamps (array), access_points (array of timestamp and offset), and feature: a short text of the
    stream's shape and the payload's bytes. A null stream is read as an empty one, which is an error."""
    schema = df.select(*keep).schema
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, timestamps array<long>, access_points array<struct<timestamp:long,offset:long>>, feature string"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("timestamp", pa.int64()), ("offset", pa.int64())])), pa.string()]

    def run(batches):
        for b in batches:
            data, off = utf8(b[media])
            rows = []
            for i in range(len(off) - 1):
                raw = data[off[i] : off[i + 1]].tobytes()
                s = read_stream(raw)
                counts = np.bincount(np.frombuffer(s.payload, np.uint8), minlength=256)
                mean = int((counts * np.arange(256)).sum()) * 1000 // max(1, len(s.payload))
                feature = f"units={s.units};access={len(s.access)};last_pts={s.timestamps[-1] if s.timestamps else -1};distinct={int((counts > 0).sum())};spaces={int(counts[32])};mean_milli={mean}"
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), s.packets, s.timestamps, [{"timestamp": t, "offset": o} for t, o in s.access], feature))
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*keep, *(x.split()[0] for x in fields.split(", "))])

    df = df.select(*keep, media)
    return df.mapInArrow(lean(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), fields]))
