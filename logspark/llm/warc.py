"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

`write_archives` writes tables of pages as archives; `read_archives` reads archives (also others', with
a raw or a compressed dictionary, or none). The reader loads the dictionary, walks the frames by their
block headers, decodes one frame per record, and checks the version line, the named fields, the lengths,
the closing line ends and both digests; what breaks a rule raises BadArchive.

Of pages with equal payloads of at least `min_revisit` bytes, the one with the largest id is a response
and the others are revisits that name it. Rows that share the largest id are all responses; a null id is
smaller than any other. A null payload is empty, a null URL leaves the field out. Empty tables leave an empty folder,
which reads as an empty table. A payload of any length is one record of an archive that ends with it. Other columns do not pass.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import checkpoint, lean
from logspark.llm.files import make_folder, writing

#: Fixed values of the formats.
DICTIONARY_FRAME, ZSTD_FRAME, ZSTD_DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary of an archive is trained on at most so many of its first records and so many bytes of each.
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 32 << 10, 64, 16 << 10
#: Rows up to which a table of repeated payloads is broadcast (about 100 bytes a row), and rows of one payload from which on they aren't shuffled by it.
BROADCAST_ROWS, HOT_ROWS = 200_000, 100_000


class BadArchive(ValueError):
    """An archive that breaks a rule of the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> dict[str, str]:
        head, _, _ = self.block.partition(b"\r\n\r\n")
        return dict(_field(x) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def _field(line: str) -> tuple[str, str]:
    name, colon, value = line.partition(":")
    if not colon or not name or name != name.strip():
        raise BadArchive(f"not a named field: {line[:80]!r}")
    return name.lower(), value.strip()


def _quoted(uri: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{'null' if page_id is None else page_id}>"), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", _quoted(url))] if url else []
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        return record_bytes([*headers, ("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)], http)
    return record_bytes(headers, http + payload)


def train(samples: list[bytes]) -> bytes | None:
    """A dictionary for the samples; None where there are too few."""
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s[:SAMPLE_BYTES] for s in samples]).as_bytes()
    except zstandard.ZstdError:
        return None


def frames(records: Iterator[bytes], first: list[bytes], level: int = 6) -> Iterator[bytes]:
    """The frames of an archive: the dictionary's, then one for each record. first: the records to train on, which are not written."""
    dictionary = train(first)
    if dictionary:
        squeezed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        yield struct.pack("<II", DICTIONARY_FRAME, len(squeezed)) + squeezed
    c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    for r in records:
        yield c.compress(r)


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, by its header and its blocks' headers."""
    try:
        flags = data[at + 4]
        single, size_flag = flags >> 5 & 1, flags >> 6
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[size_flag]
        while True:
            b = data[at] | data[at + 1] << 8 | data[at + 2] << 16
            at += 3 + (1 if b >> 1 & 3 == 1 else b >> 3)
            if b & 1:
                break
    except IndexError:
        raise BadArchive("a frame is cut off") from None
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise BadArchive("a frame is cut off")
    return at


def parse_record(raw: bytes) -> Record:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive("a record has no version line or no end of its header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, value = _field(line)
        headers[name] = value
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadArchive(f"a record has no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("a record's length differs from its frame's")
    r = Record(headers, rest[:-4])
    for name, data in (("warc-block-digest", r.block), ("warc-payload-digest", r.payload if headers["warc-type"] == "response" else None)):
        if data is not None and name in headers and headers[name] != f"sha1:{base32_sha1(data)}":
            raise BadArchive(f"a record's {name} is wrong")
    return r


def parse_archive(data: bytes) -> Iterator[Record]:
    at, d = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 > len(data) or (end := at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")) > len(data):
                raise BadArchive("a skippable frame is cut off")
            if magic == DICTIONARY_FRAME and at == 0:
                body = data[8:end]
                if int.from_bytes(body[:4], "little") == ZSTD_FRAME:
                    body = d.decompress(body)
                if int.from_bytes(body[:4], "little") != ZSTD_DICTIONARY:
                    raise BadArchive("the dictionary has a wrong magic number")
                d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at = end
            continue
        if magic != ZSTD_FRAME:
            raise BadArchive("not a Zstandard frame")
        end = frame_end(data, at)
        try:
            raw = d.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise BadArchive(str(e)) from None
        yield parse_record(raw)
        at = end


def with_revisits(rows: DataFrame, min_revisit: int) -> DataFrame:
    """Adds _last, the largest id among the rows of an equal payload of at least min_revisit bytes that occurs more than once; else null. rows: id, url, payload.

    Where such payloads are too many to be broadcast, digests and ids are joined by themselves; rows with a payload are then joined by id, so
    that those of a hot payload are many tasks' (and those without an id by their URL).
    """
    rows = rows.withColumn("_sha", F.concat(F.sha1("payload"), F.lit(":"), F.octet_length("payload")))
    large = rows.where(F.octet_length("payload") >= min_revisit)
    last = checkpoint(large.groupBy("_sha").agg(F.max("id").alias("_last"), F.count("*").alias("_n")).where("_n > 1"))
    n, total = last.agg(F.count("*"), F.sum("_n")).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(last.select("_sha", "_last")), "_sha", "left")
    rows = rows.withColumn("_spot", F.pmod(F.xxhash64("id", "url"), F.lit(64)))
    ids = checkpoint(large.select("_sha", "id", F.pmod(F.xxhash64("id", "url"), F.lit(64)).alias("_spot")).distinct())
    # payloads of over total / BROADCAST_ROWS rows are fewer than BROADCAST_ROWS
    hot = F.col("_n") > max(HOT_ROWS, total // max(1, BROADCAST_ROWS))
    often, seldom = (F.broadcast(last.where(hot).select("_sha", "_last")), last.where(~hot).select("_sha", "_last"))
    marks = ids.join(often, "_sha").unionByName(ids.join(often, "_sha", "left_anti").join(seldom, "_sha"))
    marks = checkpoint(marks.select(F.col("_sha").alias("_s"), F.col("id").alias("_i"), F.col("_spot").alias("_p"), "_last"))
    return rows.join(marks, (F.col("_sha") == F.col("_s")) & F.col("id").eqNullSafe(F.col("_i")) & (F.col("_spot") == F.col("_p")), "left")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 8 << 20) -> DataFrame:
    """Writes the pages and returns the archives written: path, records, bytes. An archive ends when its payloads reach `archive_bytes`."""
    df = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    df = with_revisits(df, min_revisit).select("id", "url", "payload", F.when(F.col("_last").isNotNull() & ~F.col("id").eqNullSafe(F.col("_last")), F.col("_last")).alias("refers_to"))
    df = df.sortWithinPartitions("id", "url")
    make_folder(folder)

    def run(batches):
        task = TaskContext.get()
        held, size, number = [], 0, 0

        def flush():
            nonlocal held, size, number
            uri, n, total = f"{folder}/part-{task.partitionId():05d}-{number:05d}.warc.zst", len(held), 0
            info = record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{task.partitionId()}-{number}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            with writing(uri, task.taskAttemptId()) as out:
                for f in frames(iter([info, *held]), held[:SAMPLES]):
                    total += out.write(f)
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_pydict({"path": [uri], "records": [n], "bytes": [total]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for i, u, p, r in zip(*(b[c] for c in ("id", "url", "payload", "refers_to"))):
                body = p.as_py()
                held.append(page_record(i.as_py(), u.as_py(), body, r.as_py(), date))
                size += len(body)
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return checkpoint(df.mapInArrow(lean(run), "path string, records long, bytes long"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record: page_id, record_type, refers_to, url, payload_digest and payload_bytes (of the full payload), payload (null for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    names = ["page_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str | None) -> int | None:
        x = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(x) if x.lstrip("-").isdigit() else None

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for data in b["content"]:
                rows, size = [], 0
                for r in parse_archive(data.as_py()):
                    h = r.headers
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    length = r.http.get("content-length", "")
                    if not length.isdigit() or h["warc-type"] == "response" and int(length) != len(r.payload):
                        raise BadArchive("a payload's length differs from its header's")
                    rows.append((number(h["warc-record-id"]), h["warc-type"], number(h.get("warc-refers-to")), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), int(length), r.payload if h["warc-type"] == "response" else None))
                    size += len(r.block)
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return files.mapInArrow(lean(run), "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, payload binary")
