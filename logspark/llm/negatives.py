"""Hard negatives of anchors among vectors of whole numbers, by exact scores in a residue number system.

A score is the inner product of two vectors of whole numbers. It is computed modulo several small primes: residues of both
sides, centred about zero, are multiplied as float32 matrices whose sums stay below 2**24 and so are exact; the
Chinese remainder theorem (in mixed radix) puts the residues together to the exact signed score. There are as many primes
as the longest vectors need (Cauchy and Schwarz bound every score).

Rows are dealt to blocks by their key, and every block meets the anchors in blocks, so that neither side is held whole
anywhere: a task holds one block of rows, and one block of anchors after another passes by. Each such meeting keeps the first few
rows of an anchor; ranks over those of all blocks give the first of all. A first round finds the positives, a
second one the negatives within the windows that the positives' scores give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import checkpoint, gathered, lean, partitions, tasks

#: Rows of a block (64 components of two bytes: 38 MB), anchors of a block, and rows that are scored at once.
ROWS, ANCHORS, TILE = 1 << 18, 1 << 10, 1 << 11
#: Scores must stay below this, so that a hundred times a score is a long.
MOST_SCORE = 1 << 53
#: Terms of a sum of products of residues of primes below 256: 1024 * 125 * 125 is less than 2**24.
TERMS = 1 << 10


def primes_below(n: int) -> Iterator[int]:
    """Primes below n, the largest first."""
    yield from (p for p in range(n - 1, 1, -1) if all(p % q for q in range(2, math.isqrt(p) + 1)))


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, from -(p // 2) to p // 2, in place. x: float32 of whole numbers below 2**24."""
    for _ in range(2):  # the first quotient may be rounded to the wrong side
        x -= np.float32(p) * np.rint(x * np.float32(1 / p))
    return x


class Residues:
    """Exact inner products of whole numbers, in size below `bound`."""

    def __init__(self, bound: int):
        self.primes: list[int] = []
        of = primes_below(256)
        while math.prod(self.primes) <= 2 * bound + 1:
            self.primes.append(next(of))

    def split(self, m: np.ndarray) -> list[np.ndarray]:
        """The matrix of whole numbers modulo each prime."""
        return [((m + p // 2) % p - p // 2).astype(np.float32) for p in self.primes]

    def product(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Scores of rows of a with rows of b, both as split."""
        digits: list[np.ndarray] = []
        for p, x, y in zip(self.primes, a, b):
            r = np.zeros((len(x), len(y)), np.float32)
            for k in range(0, x.shape[1], TERMS):
                r += centred(x[:, k : k + TERMS] @ y[:, k : k + TERMS].T, p)
                if k:
                    centred(r, p)
            # mixed radix: what is left of the score above the digits so far, modulo p
            for q, d in zip(self.primes, digits):
                r = centred((r - d) * np.float32(pow(q, -1, p)), p)
            digits.append(r)
        out = digits[-1].astype(np.int64)
        for q, d in zip(self.primes[-2::-1], digits[-2::-1]):
            out = out * q + d.astype(np.int64)
        return out


class First:
    """The first k columns of each row by score (higher first), ties by place. Tiles of columns come in order."""

    def __init__(self, rows: int, k: int):
        self.k, self.least = k, np.full(rows, np.iinfo(np.int64).min)
        self.row, self.score, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, allowed: np.ndarray, base: int) -> None:
        # an equal score comes later in order than those that are held
        row, col = np.nonzero(allowed & (scores > self.least[:, None]))
        if not len(row):
            return
        row, score, at = np.r_[self.row, row], np.r_[self.score, scores[row, col]], np.r_[self.at, col + base]
        order = np.lexsort((at, -score, row))
        row, score, at = row[order], score[order], at[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        keep = rank < self.k
        self.row, self.score, self.at = row[keep], score[keep], at[keep]
        full = rank == self.k - 1
        self.least[row[full]] = score[full]


def finite(vector: Column) -> Column:
    """Whether a vector isn't null and has finite components only."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == math.inf))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, with zeros after shorter lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


_PACKED = "bucket int, kind int, block long, body binary"


def hard_negatives(df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first positives, its first negatives.

    A component x counts as floor(scale * x). A row's order is by score with the anchor, higher first, ties by smaller key. Positives are the first rows
    of the anchor's label with another key; negatives are rows of another label with low * positive <= 100 * negative <= high * positive.
    anchor: which rows are anchors. Rows with a null key, label or vector, or a component that is null or not finite, take no part. A
    vector shorter than others counts as followed by zeros, an empty one as zeros. Repeated rows are rows of their own and
    are repeated in the result. Labels and keys are whole numbers. Scores that may reach 2**53 are an error. Other columns don't pass, so none can clash.
    """
    spark = df.sparkSession
    floats = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & finite(F.col(vector)))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), floats.alias("v"))
    size, norm = F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, n_anchors, width, norm = rows.agg(F.count("*"), F.count_if("anchor"), size, norm).first()
    if not n or not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    bound = math.ceil(norm * (1 + 1e-9))
    if bound >= MOST_SCORE:
        raise ValueError(f"scores may reach {bound}, which is {MOST_SCORE} or more")
    n_blocks, n_asking = max(partitions(spark), -(-n // ROWS)), -(-n_anchors // ANCHORS)
    kind = next(k for k in ("i2", "i4", "i8") if math.isqrt(bound) + 1 < 1 << (8 * int(k[1]) - 1))
    record = np.dtype([("id", "i8"), ("label", "i8"), ("v", kind, (width,))])

    def records(x: pa.Table) -> np.ndarray:
        out = np.zeros(len(x), record)
        out["id"], out["label"], out["v"] = x["id"].to_numpy(), x["label"].to_numpy(), matrix(x["v"], width)
        return out

    def packed(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for x in gathered(batches, 1 << 16):
            bucket, all_ = x["bucket"].to_numpy(), records(x)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            parts = [squeeze.compress(all_[order[s:e]].tobytes()) for s, e in zip(cuts, np.r_[cuts[1:], len(order)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts]], pa.int32()), pa.array(parts, pa.binary())], ["bucket", "body"])

    dealt = lambda m: F.pmod(F.xxhash64("id", "v"), F.lit(m)).cast("int").alias("bucket")
    at = rows.select(dealt(n_blocks), "id", "label", "v").mapInArrow(lean(packed), "bucket int, body binary")
    homes = at.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "body")
    # a block of anchors has a number when it is written
    asking = rows.where("anchor").select(dealt(n_asking), "id", "label", "v").repartition(min(n_asking, tasks(spark, n_asking)), "bucket").mapInArrow(lean(packed), "bucket int, body binary")
    asking = checkpoint(asking.select(F.monotonically_increasing_id().alias("block"), "body"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))

    def meetings(asking: DataFrame, run, schema: str) -> DataFrame:
        """run(anchors, wanted, rows) for each block of rows and block of anchors; rows are in order of their ids."""
        visits = asking.select(everywhere.alias("bucket"), F.lit(1).alias("kind"), "block", "body", "wanted")
        both = homes.withColumn("wanted", F.lit(None).cast(asking.schema["wanted"].dataType)).unionByName(visits)
        both = both.repartition(tasks(spark, n_blocks), "bucket").sortWithinPartitions("bucket", "kind")

        def search(batches):
            squeeze = zstandard.ZstdDecompressor()
            now, parts, held = None, [], None
            for x in batches:
                for bucket, kind, block, body, wanted in zip(x["bucket"].to_pylist(), x["kind"].to_pylist(), x["block"].to_pylist(), x["body"], x["wanted"]):
                    if bucket != now:
                        now, parts, held = bucket, [], None
                    part = np.frombuffer(squeeze.decompress(body.as_py()), record)
                    if kind == 0:
                        parts.append(part)
                        continue
                    if held is None:
                        held = np.concatenate(parts) if parts else np.zeros(0, record)
                        held = held[np.argsort(held["id"], kind="stable")]
                    yield from run(block, part, wanted.as_py(), held)

        return both.mapInArrow(lean(search), schema)

    scores = Residues(bound)

    def tiles(anchors: np.ndarray, held: np.ndarray):
        a = scores.split(anchors["v"].astype(np.int64))
        for s in range(0, len(held), TILE):
            t = held[s : s + TILE]
            yield s, t, scores.product(a, scores.split(t["v"].astype(np.int64)))

    def find_positives(block, anchors, wanted, held):
        best = First(len(anchors), n_positives)
        for s, t, x in tiles(anchors, held):
            best.offer(x, (anchors["label"][:, None] == t["label"]) & (anchors["id"][:, None] != t["id"]), s)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.row), block)), pa.array(best.row), pa.array(held["id"][best.at]), pa.array(best.score)], ["block", "at", "id", "score"])

    order = [F.col("score").desc(), F.col("id")]
    found = meetings(asking.withColumn("wanted", F.lit(None).cast("boolean")), find_positives, "block long, at long, id long, score long")
    positives = found.withColumn("nth", F.row_number().over(Window.partitionBy("block", "at").orderBy(*order))).where(F.col("nth") <= n_positives)
    # at most n_positives * ANCHORS in a list
    wanted = checkpoint(positives.groupBy("block").agg(F.collect_list(F.struct("at", "nth", "id", "score")).alias("wanted")))

    def find_negatives(block, anchors, wanted, held):
        asked = np.array([(w["at"], w["nth"], w["id"], w["score"]) for w in wanted], np.int64).reshape(-1, 4)
        turns = [asked[asked[:, 1] == nth] for nth in range(1, n_positives + 1)]
        best = [First(len(t), n_negatives) for t in turns]
        for s, t, x in tiles(anchors, held):
            other = anchors["label"][:, None] != t["label"]
            for turn, b in zip(turns, best):
                own, p = x[turn[:, 0]], turn[:, 3][:, None]
                b.offer(own, other[turn[:, 0]] & (low * p <= 100 * own) & (100 * own <= high * p), s)
        for turn, b in zip(turns, best):
            asks = turn[b.row]
            columns = [np.full(len(asks), block), anchors["id"][asks[:, 0]], asks[:, 0], asks[:, 1], asks[:, 2], asks[:, 3], held["id"][b.at], b.score]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["block", "anchor_id", "at", "nth", "positive_id", "positive_score", "id", "score"])

    found = meetings(asking.join(wanted, "block"), find_negatives, "block long, anchor_id long, at long, nth long, positive_id long, positive_score long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "at", "nth").orderBy(*order))).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
