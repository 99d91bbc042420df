"""Embedding near-duplicates: an exact range join of unit vectors by pivots.

Two vectors have a cosine of c or more if and only if, brought to length one, they are within sqrt(2 - 2c) of each other, and that is a
metric. Pivots, fitted on a bounded sample, cut the vectors into parts. *Balls* are what lies within half the
range of a pivot where the sample is dense: there any two are in range by the triangle inequality, so a ball of copies,
however large, is counted and linked without being compared. The rest goes to *cells*, each vector to its nearest
pivot. A vector also visits every later part that it may have a partner in: a ball if it is within the range of it (by the
triangle inequality), a cell if it is within range of the plane between its own pivot and the cell's and of the
farthest member of the cell. Each pair in range meets in just one place, the later part of the two (balls come after cells).

Parts are joined independently; those with many members are dealt to tasks by blocks of members, which visitors pass by in
batches. A join returns counts of links and a forest of them, so no group gives more rows than it has members. Visits depend
on the data: vectors that are spread evenly over many dimensions have no boundary that a range of 0.9 doesn't cross, so they
visit about half of all cells; grouped ones visit few.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import checkpoint, gathered, lean, tasks
from logspark.llm.components import connected_components, join_components, union_find
from logspark.llm.negatives import finite, matrix

#: Vectors of the sample that pivots come from, at most, and the bytes it may have.
SAMPLE, SAMPLE_BYTES = 1 << 14, 64 << 20
#: Of these, so many are compared with each other to find dense places; a ball has that many neighbours among them.
DENSE_SAMPLE, DENSE = 1 << 12, 4
#: Vectors of a cell on average, cells at most, and members of a block of a part.
CELL, MOST_CELLS, BLOCK = 1 << 14, 1 << 12, 1 << 15
#: Rows that are scored at once.
TILE = 1 << 11
#: Allowance of bounds for rounding.
EPS = 1e-9


class Pivots:
    """Cells (by pivot) and balls, in this order: their numbers are the parts'."""

    def __init__(self, sample: np.ndarray, n: int, reach: float):
        self.reach = reach
        some = sample[:DENSE_SAMPLE]
        near = self.distance(some, some) <= reach / 2
        crowd, free, balls = near.sum(1) - 1, np.ones(len(some), bool), []
        for i in np.argsort(-crowd, kind="stable"):
            if crowd[i] < DENSE:
                break
            if free[i]:
                balls.append(i)
                # a centre in a ball or next to it would only add visits
                free &= self.distance(some, some[i : i + 1])[:, 0] > reach
        self.balls = some[balls]
        left = sample[(self.distance(sample, self.balls) > reach / 2).all(1)] if len(balls) else sample
        self.cells = left[: min(MOST_CELLS, -(-n // CELL))] if len(left) else sample[:1]
        self.apart = np.maximum(self.distance(self.cells, self.cells), EPS)

    @staticmethod
    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))

    def home(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each vector and its distance from the part's pivot."""
        d = self.distance(v, self.cells)
        part = d.argmin(1)
        far = d[np.arange(len(v)), part]
        if len(self.balls):
            b = self.distance(v, self.balls)
            ball = b.argmin(1)
            own = b[np.arange(len(v)), ball]
            part, far = np.where(own <= self.reach / 2, len(self.cells) + ball, part), np.where(own <= self.reach / 2, own, far)
        return part, far

    def visits(self, v: np.ndarray, home: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of the later parts in which a vector may have a partner. radius: of each part, -1 where it is empty."""
        reach, cells = self.reach + EPS, len(self.cells)
        d = self.distance(v, self.cells)
        own = d.argmin(1)
        # how far v is behind the plane between its own cell's pivot and the other's: |vq|^2 - |vp|^2 over twice |pq|
        behind = (d**2 - d[np.arange(len(v)), own][:, None] ** 2) / (2 * self.apart[own])
        may = (behind <= reach) & (d <= radius[:cells] + reach)
        if len(self.balls):
            may = np.hstack([may, self.distance(v, self.balls) <= radius[cells:] + reach])
        may &= (radius >= 0) & (np.arange(len(radius)) > home[:, None])
        return np.nonzero(may)


class Meeting:
    """The members of a block of a part, and the links found so far."""

    def __init__(self, v: np.ndarray, width: np.ndarray, ids: np.ndarray, least: float):
        self.v, self.width, self.ids, self.least = v, width, ids, least
        self.label = np.arange(len(ids))

    def links(self, v: np.ndarray, width: np.ndarray, ids: np.ndarray, own: int | None = None):
        """Counts and a forest of the links between members and visitors, as columns a, b, n. own: the visitors are members themselves, from this place on."""
        count, n = np.zeros(len(self.ids), np.int64), len(self.ids)
        for s in range(0, len(ids), TILE):
            t = slice(s, s + TILE)
            mine = np.zeros(len(ids[t]), np.int64)
            name = n + np.arange(len(ids[t]))
            if own is not None:
                name = np.arange(own + s, own + s + len(ids[t]))
            for m in range(0, n if own is None else own + s + len(ids[t]), TILE):
                u = slice(m, m + TILE)
                hit = (v[t] @ self.v[u].T >= self.least) & (width[t][:, None] == self.width[u])
                if own is not None:
                    hit &= name[:, None] > np.arange(m, m + hit.shape[1])
                if not hit.any():
                    continue
                mine += hit.sum(1)
                count[u] += hit.sum(0)
                row, col = np.nonzero(hit)
                # one link of each visitor with each piece of members
                both = np.unique(np.c_[name[row], self.label[m + col]], axis=0)
                yield from self._merged(both, ids[t], own)
            hits = np.flatnonzero(mine)
            yield ids[t][hits], None, mine[hits]
        hits = np.flatnonzero(count)
        yield self.ids[hits], None, count[hits]

    def _merged(self, both: np.ndarray, visitors: np.ndarray, own: int | None):
        n = len(self.ids)
        a, b = both[:, 0], both[:, 1]
        if own is not None:
            a = self.label[a]
        root = union_find(a, b, n if own is not None else n + len(visitors))
        name = np.r_[self.ids, visitors] if own is None else self.ids
        joined = np.flatnonzero(root != np.arange(len(root)))
        yield name[joined], name[root[joined]], None
        self.label = root[self.label]


def range_links(df: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n_links, component_id and kept of every row: how many other rows have a cosine of at least `least`, and the least key that such links reach.

    A row is a vector: rows that share a key or a vector are vectors of their own. Vectors that are null, empty or zero, or hold a null or
    non-finite component, and vectors of different lengths, link with nothing. kept: the key is its component's; of rows that share that key each is kept. A
    row whose key is null is linked like others, its own key isn't the least of any, and it is not kept; alone, its component is null. Keys are whole numbers. Other columns don't pass,
    so none can clash. An empty table gives an empty one. least: from 0 (exclusive, so that zero never links) to 1.
    """
    spark, reach = df.sparkSession, math.sqrt(2 - 2 * least)
    usable = finite(F.col(vector)) & F.exists(vector, lambda x: x != 0)
    # rows have a number when they are written
    rows = checkpoint(df.select(F.monotonically_increasing_id().alias("id"), F.col(key).cast("long").alias("key"), F.when(usable, F.col(vector)).alias("v")))
    good = rows.where("v is not null").select("id", "v")
    n, width = good.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.col("key").isNotNull().alias("kept"))
    sample = good.orderBy(F.xxhash64("v"), "id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).select("v").toArrow()
    pivots = Pivots(units(sample["v"], width), n, reach)
    cells, parts = len(pivots.cells), len(pivots.cells) + len(pivots.balls)

    def at_home(batches):
        for x in gathered(batches, 1 << 14):
            part, far = pivots.home(units(x["v"], width))
            w = lengths(x["v"])
            order = np.lexsort((w, part))
            part, far, w, ids = part[order], far[order], w[order], x["id"].to_numpy()[order]
            cut = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (w[1:] != w[:-1])])
            n = np.diff(np.r_[cut, len(part)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part[cut], w[cut].astype(np.int64), n, np.maximum.reduceat(far, cut), np.minimum.reduceat(ids, cut))], ["part", "width", "n", "far", "least"])

    # a row for each part and length of vectors: balls count and link theirs by length, cells need the sum
    sums = good.mapInArrow(lean(at_home), "part long, width long, n long, far double, least long").groupBy("part", "width").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.min("least").alias("least"))
    sums = checkpoint(sums)
    radius, members = np.full(parts, -1.0), np.zeros(parts, np.int64)
    # one row a part: at most MOST_CELLS and DENSE_SAMPLE // DENSE
    for r in sums.groupBy("part").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():
        radius[r["part"]], members[r["part"]] = r["far"], r["n"]
    blocks = np.maximum(1, -(-members // BLOCK))
    first = np.cumsum(blocks) - blocks
    n_blocks = int(blocks.sum())
    record = np.dtype([("id", "i8"), ("width", "i4"), ("block", "i4"), ("v", "f4" if dict(df.dtypes)[vector] == "array<float>" else "f8", (width,))])

    def dealt(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for x in gathered(batches, 1 << 14):
            raw = matrix(x["v"], width)
            v, rec = unit(raw), np.zeros(len(x), record)
            home, _ = pivots.home(v)
            rec["id"], rec["width"], rec["v"] = x["id"].to_numpy(), lengths(x["v"]), raw
            rec["block"] = first[home] + rec["id"] % blocks[home]
            row, part = pivots.visits(v, home, radius)
            take, to, kind = [np.arange(len(x))], [rec["block"]], [np.zeros(len(x), np.int64)]
            for k in range(int(blocks.max())):
                # all blocks of the parts visited, and the later blocks of the own cell
                more = blocks[part] > k
                later = np.flatnonzero((home < cells) & (first[home] + k > rec["block"]) & (blocks[home] > k))
                take += [row[more], later]
                to += [first[part[more]] + k, first[home[later]] + k]
                kind += [np.ones(int(more.sum()), np.int64), np.ones(len(later), np.int64)]
            take, to, kind = np.concatenate(take), np.concatenate(to), np.concatenate(kind)
            order = np.argsort(to * 2 + kind, kind="stable")
            take, code = take[order], (to * 2 + kind)[order]
            cut = np.flatnonzero(np.r_[True, np.diff(code) != 0])
            body = [squeeze.compress(rec[take[s:e]].tobytes()) for s, e in zip(cut, np.r_[cut[1:], len(code)])]
            yield pa.RecordBatch.from_arrays([pa.array((code[cut] // 2).astype(np.int32)), pa.array((code[cut] % 2).astype(np.int32)), pa.array(body, pa.binary())], ["bucket", "kind", "body"])

    ball = np.repeat(np.arange(parts) >= cells, blocks)

    def join(batches):
        squeeze = zstandard.ZstdDecompressor()
        now, members, met = None, [], None

        def begin():
            rec = np.concatenate(members)
            m = Meeting(unit(rec["v"].astype(np.float64)), rec["width"], rec["id"], least)
            return m, ([] if ball[now] else m.links(m.v, m.width, m.ids, 0))

        for x in batches:
            for bucket, kind, body in zip(x["bucket"].to_pylist(), x["kind"].to_pylist(), x["body"]):
                if bucket != now:
                    if members and met is None:
                        yield from map(_row, begin()[1])
                    now, members, met = bucket, [], None
                rec = np.frombuffer(squeeze.decompress(body.as_py()), record)
                if kind == 0:
                    members.append(rec)
                    continue
                if not members:
                    continue
                if met is None:
                    met, own = begin()
                    yield from map(_row, own)
                yield from map(_row, met.links(unit(rec["v"].astype(np.float64)), rec["width"], rec["id"]))
        if members and met is None:
            yield from map(_row, begin()[1])

    packed = good.mapInArrow(lean(dealt), "bucket int, kind int, body binary")
    met = packed.repartition(tasks(spark, n_blocks), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lean(join), "a long, b long, n long")
    # of balls: a row for each member, linked to the first of its length
    of_ball = spark.createDataFrame(sums.where(F.col("part") >= cells).toArrow()).select("part", "width", (F.col("n") - 1).alias("n"), F.col("least").alias("b")) if parts > cells else None
    if of_ball is not None:

        def parts_of(batches):
            for x in gathered(batches, 1 << 14):
                part, _ = pivots.home(units(x["v"], width))
                own = part >= cells
                yield pa.RecordBatch.from_arrays([pa.array(x["id"].to_numpy()[own]), pa.array(part[own]), pa.array(lengths(x["v"])[own].astype(np.int64))], ["a", "part", "width"])

        inside = good.mapInArrow(lean(parts_of), "a long, part long, width long").join(F.broadcast(of_ball), ["part", "width"])
        met = met.unionByName(inside.select("a", "b", "n"))
    met = checkpoint(met)
    counts = met.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    links = met.where("b is not null").select("a", "b")
    found = connected_components(links).withColumnRenamed("node", "id")
    linked = rows.select("id", "key").join(counts, "id").join(found, "id")
    least_key = linked.groupBy("component").agg(F.min("key").alias("_least"))
    reached = join_components(linked, least_key, "component").select("id", "n_links", "_least")
    out = rows.select("id", "key").join(reached, "id", "left").withColumn("component_id", F.coalesce("_least", "key"))
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.lit(False))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", kept.alias("kept"))


def _row(x) -> pa.RecordBatch:
    a, b, n = x
    empty = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), empty if b is None else pa.array(b, pa.int64()), empty if n is None else pa.array(n, pa.int64())], ["a", "b", "n"])


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).offsets.to_numpy())


def unit(m: np.ndarray) -> np.ndarray:
    # the largest component first, so that squares neither vanish nor overflow
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def units(column: pa.Array, width: int) -> np.ndarray:
    return unit(matrix(column, width))
