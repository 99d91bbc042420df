"""What the operators of this subpackage share: the shared folder, text buffers, packed shuffles, stable streams of random numbers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step holds at once; its temporaries are about 60 times as large.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir).

    Only where the session names none and runs on one machine, as in tests, a temporary folder is set.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        top = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared_dir(spark, "set")
    return df.checkpoint(eager=True)


#: Rows in an Arrow batch: a row is a whole text.
BATCH_ROWS = 2000


def lean(run: Callable) -> Callable:
    """A function for mapInArrow whose worker gives its memory back at the end of a task: workers live on, and what they keep adds up.

    Also bounds the rows of the session's Arrow batches, which Spark's default sets for small rows.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    @functools.wraps(run)
    def whole_task(batches):
        yield from run(batches)
        give_back()

    return whole_task


def lean_groups(run: Callable) -> Callable:
    """The same for a function of two groups."""

    @functools.wraps(run)
    def one_group(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return one_group


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free(name: str, taken: list[str]) -> str:
    """The name, with as many underscores behind it as it takes not to be one of those taken (Spark ignores case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Reduce tasks of a packed shuffle at most. A task takes its buckets one after another, so this is no bound on what is held.
MOST_TASKS = 32_768


def tasks(spark: SparkSession, n_buckets: int) -> int:
    return max(partitions(spark), min(n_buckets, MOST_TASKS))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) with about `limit` bytes each, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows, so that what is packed by bucket isn't packed in crumbs."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


PACKED = "bucket int, body binary"


def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket that holds the columns' values of its rows, so that millions of small rows pass a shuffle as a few large ones."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(bucket)]
    squeeze = zstandard.ZstdCompressor(level=1)
    rows = [squeeze.compress(np.int64(e - s).tobytes() + b"".join(np.ascontiguousarray(c[s:e]).tobytes() for c in columns)) for s, e in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "body"])


def unpack(body: bytes, dtypes: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for d in map(np.dtype, dtypes):
        out.append(np.frombuffer(raw, d, n, at))
        at += n * d.itemsize
    return out


def delta(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def packed_groups(batches: Iterator[pa.RecordBatch], dtypes: list) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The buckets of a partition that is sorted by bucket, each with its whole columns; one bucket is held at a time."""
    at, parts = None, []
    for b in batches:
        for bucket, body in zip(b["bucket"].to_pylist(), b["body"]):
            if bucket != at and parts:
                yield at, [np.concatenate(c) for c in zip(*parts)]
                parts = []
            at = bucket
            parts.append(unpack(body.as_py(), dtypes))
    if parts:
        yield at, [np.concatenate(c) for c in zip(*parts)]


#: Bits of a map of wanted ids, 32 MB.
BITMAP_BITS = 1 << 28


def membership(wanted: DataFrame, column: str, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Says of ids whether they may be among the n wanted ones: a bitmap of 16 bits an id and at most `BITMAP_BITS`.

    What it hasn't isn't wanted. With more ids than it has room for it only leaves out less, so callers still join."""
    bits = min(BITMAP_BITS, 1 << max(12, (16 * n - 1).bit_length()))
    spot = F.pmod(column, F.lit(bits))
    # a row for each word of the bitmap, so never more than BITMAP_BITS / 64
    words = wanted.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))).alias("v")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)

    def has(ids: np.ndarray) -> np.ndarray:
        at = ids % bits
        return ((bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) == 1

    return has


def deal(df: DataFrame, n: int) -> DataFrame:
    """Packed rows to n tasks by bucket, sorted by bucket."""
    return df.repartition(n, "bucket").sortWithinPartitions("bucket")
