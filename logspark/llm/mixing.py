"""Mixing sources to target weights by pivotal dependent rounding.

Sources get targets in words by water filling: each has its weight's share of the budget, none more than
`cap` times its own words, and what is cut off goes to the others by weight. A document's expected copies
are its source's target over its words. The whole part is taken; the fraction, times the size, is a mass
that pairs of documents exchange at random, without bias and without changing its sum, until one of the
two is 0 or a whole copy. Each task does so along the documents of one bucket and leaves one open
document; the open ones of 64 buckets meet in a bucket of the next level, and so on up to one per source.
The last open document is rounded to the nearer side. What a source is then off, half a document at most,
is made good by adding or taking back a copy of the document whose size is nearest to it, twice.

Hot sources are many buckets, a bucket is a fold that holds one document. Random numbers depend on the
seed and the bucket only, and a bucket's order is total, so reruns agree. Null texts have size 0, documents
of size 0 take nothing. A null source is a source of its own, the last. Repeated rows are documents of their
own. An empty table gives an empty one. Other columns are not passed on; the key may have any name, and a
result that would have the key's name gets an underscore behind its own. A text of any length is counted whole,
in one task.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import checkpoint, free, lean, partitions, utf8

FAN_IN = 64
BUCKET_ROWS = 10_000
#: Rows up to which a table of sources is broadcast (about 100 bytes a row).
BROADCAST_ROWS = 50_000


def word_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+` in each text."""
    space = np.r_[(data == 32) | ((data >= 9) & (data <= 13))]
    before = np.r_[True, space[:-1]] if len(space) else space
    before[off[:-1][off[:-1] < len(space)]] = True
    return np.diff(np.r_[0, np.cumsum(~space & before)][off])


def sizes(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """key, _source (v and the name; w for null: code point order, null last), size."""
    src = df.select(F.col(key), F.when(F.col(source).isNull(), "w").otherwise(F.concat(F.lit("v"), F.col(source).cast("string"))).alias("_source"), F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[key], b["_source"], pa.array(word_counts(*utf8(b["_text"])), pa.int64())], [key, "_source", "size"])

    return src.mapInArrow(lean(run), src.select(key, "_source", F.lit(0).cast("long").alias("size")).schema)


def ranked(df: DataFrame, column: str, rank: str) -> DataFrame:
    """Adds the rank (from 0) of distinct values, without bringing them to one task."""
    id_ = F.monotonically_increasing_id()
    df = checkpoint(df.repartitionByRange(partitions(df.sparkSession), column).sortWithinPartitions(column).withColumn("_id", id_))
    # one row per partition
    counts = df.groupBy(F.shiftright("_id", 33).alias("_p")).count()
    first = counts.alias("a").join(F.broadcast(counts.select(F.col("_p").alias("_q"), F.col("count").alias("_n"))), F.col("_q") < F.col("_p"), "left").groupBy("_p").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_first"))
    return df.withColumn("_p", F.shiftright("_id", 33)).join(F.broadcast(first), "_p").withColumn(rank, F.col("_first") + (F.col("_id") % (1 << 33))).drop("_id", "_p", "_first")


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds the target of each source. totals: _source, source_size."""
    t = ranked(totals, "_source", "_rank")
    t = checkpoint(t.withColumn("_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_rank") % len(weights) + 1).cast("int"))))
    limit = F.col("source_size") * float(cap)
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = None, 0
    while True:
        is_capped = F.lit(False) if level is None else limit < F.col("_weight") * level
        mass, weight, n = t.agg(F.sum(F.when(is_capped, limit).otherwise(0.0)), F.sum(F.when(is_capped, 0.0).otherwise(F.col("_weight"))), F.count_if(is_capped)).first()
        if level is not None and n == stopped:
            break
        stopped, level = n, max(0.0, share * total - (mass or 0.0)) / weight if weight else 0.0
    return t.withColumn("target", F.least(limit, F.col("_weight") * level)).drop("_rank", "_weight")


class _Pivot:
    """Folds documents (size, mass) of one bucket; holds the open one."""

    def __init__(self, seed: str):
        self.random, self.open = random.Random(seed).random, None

    def add(self, row: int, size: float, mass: float) -> tuple[int, int] | None:
        """Takes a document; returns one that is decided, with its copies. A mass of 0 or of the size is decided at once."""
        if mass <= 0 or mass >= size:
            return row, int(mass > 0)
        if self.open is None:
            self.open = (row, size, mass)
            return None
        i, si, mi = self.open
        up, down = min(si - mi, mass), min(mi, size - mass)
        if self.random() * (up + down) < down:
            if si - mi <= mass:
                done, self.open = (i, 1), (row, size, mass - (si - mi))
            else:
                done, self.open = (row, 0), (i, si, mi + mass)
        elif mi <= size - mass:
            done, self.open = (i, 0), (row, size, mass + mi)
        else:
            done, self.open = (row, 1), (i, si, mi - (size - mass))
        return done


def _level(df: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """One level of the tree: every bucket's documents become decided (extra 0 or 1, mass null) but for one."""
    df = df.repartition(partitions(df.sparkSession), "_source", "_bucket").sortWithinPartitions("_source", "_bucket", F.desc("size"), "_order", "mass")

    def run(batches):
        pivot, at, held = None, None, None

        def closed():
            """The open document of the bucket that ends."""
            if pivot is None or pivot.open is None:
                return []
            _, size, mass = pivot.open
            row = dict(held)
            row |= {"extra": int(2 * mass >= size), "mass": None} if last else {"extra": None, "mass": mass}
            return [row]

        for b in batches:
            rows = b.to_pylist()
            out = []
            for k, r in enumerate(rows):
                if (r["_source"], r["_bucket"]) != at:
                    out += closed()
                    at = (r["_source"], r["_bucket"])
                    pivot = _Pivot(f"{seed}/{level}/{at}")
                done = pivot.add(k, float(r["size"]), r["mass"])
                if done is not None:
                    i, extra = done
                    out.append((rows[i] if i >= 0 else held) | {"extra": extra, "mass": None})
                if pivot.open is not None and pivot.open[0] >= 0:
                    # rows are numbered within a batch; -1 is the one kept aside
                    held = rows[pivot.open[0]]
                    pivot.open = (-1, *pivot.open[1:])
            if out:
                yield pa.RecordBatch.from_pylist(out, b.schema)
            schema = b.schema
        if out := closed():
            yield pa.RecordBatch.from_pylist(out, schema)

    return checkpoint(df.mapInArrow(lean(run), df.schema))


def _made_good(df: DataFrame, key: str, n_sources: int) -> DataFrame:
    """Changes one document's extra copy per source where that brings its words nearer to the target."""
    off = df.groupBy("_source").agg((F.first("target") - F.sum((F.col("_whole") + F.col("extra")) * F.col("size"))).alias("_off"))
    off = checkpoint(off)
    small = F.broadcast if n_sources <= BROADCAST_ROWS else (lambda x: x)
    left = F.abs(F.abs("_off") - F.col("size"))
    may = (F.col("extra") == F.when(F.col("_off") > 0, 0).otherwise(1)) & (F.col("target") > F.col("_whole") * F.col("source_size")) & (left < F.abs("_off"))
    picks = df.join(small(off), "_source").where(may).groupBy("_source").agg(F.min(F.struct(left.alias("d"), F.col(key), F.col("_row").alias("r"))).alias("_pick"))
    picks = checkpoint(picks.select("_source", F.col("_pick.r").alias("_picked")))
    df = df.join(small(picks), "_source", "left")
    return df.withColumn("extra", F.when(F.col("_row") == F.col("_picked"), 1 - F.col("extra")).otherwise(F.col("extra"))).drop("_picked")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """key, size, source_size, target, copies, taken (copies times size) of each document.

    weights: of the sources in order, repeating. share: the budget over all words. cap: the most copies of a source.
    """
    spark = df.sparkSession
    df = df.select(F.col(key).alias("_key"), F.col(source).alias("_of"), F.col(text).alias("_text"))
    own_name, key = key, "_key"
    docs = checkpoint(sizes(df, key, "_of", "_text").withColumn("_row", F.monotonically_increasing_id()))
    totals = docs.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    t = checkpoint(targets(totals, weights, share, cap).withColumn("_buckets", F.ceil(F.col("_n") / BUCKET_ROWS)).drop("_n"))
    n_sources, most = t.agg(F.count("*"), F.max("_buckets")).first()
    docs = docs.join(F.broadcast(t) if n_sources <= BROADCAST_ROWS else t, "_source")
    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    docs = docs.withColumn("_whole", F.floor(share_of)).withColumn("mass", (share_of - F.col("_whole")) * F.col("size")).withColumn("extra", F.lit(None).cast("int"))
    docs = docs.withColumn("_order", F.xxhash64(key)).withColumn("_bucket", F.pmod(F.col("_order"), "_buckets")).drop("_buckets")
    decided, open_, level, buckets = [], docs, 0, most or 1
    while True:
        done = _level(open_, seed, level, last=buckets <= 1)
        decided.append(done.where("mass is null"))
        if buckets <= 1:
            break
        open_ = done.where("mass is not null").withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN))
        level, buckets = level + 1, -(-buckets // FAN_IN)
    out = reduce(DataFrame.unionByName, decided)
    for _ in range(2):
        out = _made_good(checkpoint(out), key, n_sources)
    copies = F.col("_whole") + F.col("extra")
    results = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies.cast("int"), "taken": (copies * F.col("size")).cast("long")}
    return out.select(F.col(key).alias(own_name), *(c.alias(free(name, [own_name])) for name, c in results.items()))
