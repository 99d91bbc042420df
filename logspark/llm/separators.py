"""Token counts from flat, unindexed token files by a scan for end-of-document ids.

A file is nothing but ids of 2 or 4 bytes, a separator after each document. Files are cut into byte
blocks wherever they fall; each block is searched in one vectorised comparison and gives the lengths
between its separators. The number of separators before a block is a prefix scan over the blocks of
its file (one small row per block); what a block holds before its first and after its last separator
is added to the same document's part in the neighbouring blocks. A document may span any number of blocks.

A file's end ends its last document; after a closing separator there is no further one. Empty documents
count 0 tokens. Empty files and an empty folder give no rows. Null texts are empty documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.bpe import encoded, load
from logspark.llm.common import checkpoint, lean
from logspark.llm.files import read_range, writing

SUFFIX = ".tokens"


def write_token_files(df: DataFrame, folder: str, vocabulary: bytes, pattern: str, eod: int, key: str = "doc_id", text: str = "text", dtype: str = "<u2") -> DataFrame:
    """Encodes texts into one flat file per task. Returns file, ordinal (from 0) and key of each document: what the files themselves don't hold."""
    src = df.select(F.col(key), F.col(text))

    def run(batches):
        task, bpe, n = TaskContext.get(), load(vocabulary, pattern), 0
        if eod > np.iinfo(dtype).max or len(bpe.bytes_of) - 1 > np.iinfo(dtype).max:
            raise ValueError("the ids don't fit the type")
        name = f"part-{task.partitionId():06d}{SUFFIX}"
        with writing(f"{folder}/{name}", task.taskAttemptId()) as out:
            for b in batches:
                for _, _, ids, off in encoded(b, text, bpe):
                    out.write(np.insert(ids, off[1:], eod).astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(np.arange(n, n + len(b)), pa.int64()), b[key]], ["file", "ordinal", key])
                n += len(b)

    return checkpoint(src.mapInArrow(lean(run), f"file string, ordinal long, `{key}` {src.schema[key].dataType.simpleString()}"))


def count_tokens(spark: SparkSession, folder: str, eod: int, dtype: str = "<u2", block: int = 4 << 20) -> DataFrame:
    """file, ordinal, start_token, n_tokens of every document in the folder's token files."""
    item = np.dtype(dtype).itemsize
    block -= block % item
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "length").where("length > 0")
    blocks = files.select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {block})")).alias("block"))
    blocks = blocks.repartition("path", "block")

    def run(batches):
        for b in batches:
            for path, length, k in zip(*(b[c].to_pylist() for c in ("path", "length", "block"))):
                if length % item:
                    raise ValueError(f"{path}: not whole ids")
                ids = np.frombuffer(read_range(path, k * block, min(block, length - k * block)), dtype)
                cuts = np.flatnonzero(ids == eod)
                starts = np.r_[0, cuts + 1]
                counts = np.r_[cuts, len(ids)] - starts
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([k], pa.int64()), pa.array([counts], pa.list_(pa.int64())), pa.array([starts + k * block // item], pa.list_(pa.int64()))], ["file", "block", "counts", "starts"])

    found = checkpoint(blocks.mapInArrow(lean(run), "file string, block long, counts array<long>, starts array<long>"))
    before = F.sum(F.size("counts") - 1).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("before", F.coalesce(before, F.lit(0)))
    parts = found.select("file", "before", F.size("counts").alias("n"), F.posexplode(F.arrays_zip("counts", "starts")).alias("pos", "x"))
    parts = parts.select("file", (F.col("before") + F.col("pos")).alias("ordinal"), F.col("x.starts").alias("start_token"), F.col("x.counts").alias("n_tokens"), ((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)).alias("edge"))
    inner = parts.where("not edge").drop("edge")
    edges = parts.where("edge").groupBy("file", "ordinal").agg(F.min("start_token").alias("start_token"), F.sum("n_tokens").alias("n_tokens"))
    # what follows the last separator is a document only if it has a token
    ends = found.groupBy("file").agg(F.sum(F.size("counts") - 1).alias("ordinal")).withColumn("after_last", F.lit(True))
    edges = edges.join(ends, ["file", "ordinal"], "left").where("n_tokens > 0 or after_last is null").drop("after_last")
    return inner.unionByName(edges)
