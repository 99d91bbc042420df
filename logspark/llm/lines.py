"""Fuzzy line dedup by MinHash: one line stays of every component of lines that resemble one another.

Lines of at least `min_chars` code points that have a word take part; equal lines are one by their 64-bit
hash. A line's signature is one permutation of its character shingles cut into bins: the least hash in each
bin, empty bins filled from others in an order that all lines share. Bands of bins become keys; lines that
share a key are candidates, if their sketches, 32 bits of their signatures, agree in 22 at least: without these, chance meetings in
keys would grow with the square of the lines. Keys and line ids travel packed; equal sets of candidates, which near copies give
for many keys, are one set. Every set is verified on the texts, by sketches and exact Jaccard resemblance: a line is compared
with those of the set that it isn't yet connected to, so the links are no more than the lines, and none that joins
two components is lost. Sets over `BLOCK` lines are cut into blocks, each of which is verified together with the set's first
lines; only the pieces in which this leaves a set are compared pairwise by blocks. Links become
components by distributed union-find. The first line of a component, by key and line number, stays.

The search is not exact: of pairs at a resemblance of just 0.8, 99 % share a key and agree (see the tests), of closer ones more.

Rows that share a key count as one document. Rows without a key, blank lines and short lines stay as they are and
remove nothing. Null texts have no lines. A line of any length is compared whole. Empty tables give empty ones. Of other
columns `drop_lines` keeps all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import PACKED, checkpoint, deal, free, lean, lean_groups, membership, mix64, pack, packed_groups, ragged, slices, tasks, unpack, utf8
from logspark.llm.components import connected_components, sets_between_pieces, union_find

BANDS, ROWS = 12, 5
SHINGLE, LEAST, MIN_CHARS = 5, 0.8, 16
#: Lines of a block of a larger set (its hashes take some 40 MB), and of its first lines, which are verified with each block.
BLOCK, HUB = 4000, 200
#: Of 32 sketch bits, so many must agree for two lines of a key to be candidates. Keys with more lines than SKETCHED aren't
#: split by sketches before they are verified: that only saves work.
AGREEING, SKETCHED = 22, 64
#: Sets of more lines don't share a bucket with the others of their home: their lines hardly profit from links found there.
APART = 256
#: Lines of sets of over MAPPED lines get a map of so many bits, one for each shingle.
MAPPED, MAP_BITS = 16, 4096
#: Bytes of lines that a bucket of sets should hold, a line being taken for 1000 bytes; their hashes take eight times as much.
SET_BYTES = 4 << 20
BUCKET_KEYS, BUCKET_BYTES = 400_000, 8 << 20
#: Line numbers up to which the table of removed lines is broadcast (16 bytes each).
BROADCAST_LINES = 1_000_000


def line_table(data: np.ndarray, off: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """row, line number, start and end (bytes), and whether the line takes part, of all lines of the texts."""
    n = len(off) - 1
    breaks = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(breaks, off)) + 1
    row = np.repeat(np.arange(n), count)
    first = np.r_[0, np.cumsum(count)]
    number = np.arange(len(row)) - first[row]
    start, end = off[row].copy(), off[row + 1].copy()
    start[number > 0] = breaks + 1
    end[number < count[row] - 1] = breaks
    space = (data == 32) | ((data >= 9) & (data <= 13))
    words = np.r_[0, np.cumsum(~space)]
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return row, number, start, end, (words[end] > words[start]) & (chars[end] - chars[start] >= min_chars)


def line_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist())), np.uint64, len(start)).view(np.int64)


def _characters(lines: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all lines, where a shingle of each line begins, and the number of each line's; a shorter line is one shingle."""
    text = np.frombuffer(b"\n".join(lines).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.r_[np.flatnonzero(text == 10), len(text)]
    starts = np.r_[0, ends[:-1] + 1]
    count = np.maximum(1, ends - starts - n + 1)
    # +1 where a line's shingles begin, -1 after its last
    mark = np.zeros(len(text) + 1, np.int8)
    mark[starts] += 1
    np.add.at(mark, starts + count, -1)
    return text, np.cumsum(mark[:-1], dtype=np.int8).view(bool), count


def _sums(text: np.ndarray, n: int, kind) -> np.ndarray:
    h = np.zeros(len(text), kind)
    wide = np.r_[text, np.zeros(n, np.uint32)].astype(kind, copy=False)
    for i, f in enumerate((mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)).astype(kind)):
        h += wide[i : i + len(text)] * f
    return h


def shingles(lines: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-character shingles of all lines, and the number of each line's."""
    text, begins, count = _characters(lines, n)
    return _sums(text, n, np.uint64)[begins], count


def signatures(lines: list[bytes], n: int, bins: int) -> np.ndarray:
    """The least 32-bit hash in each of the bins of each line's shingles."""
    text, begins, count = _characters(lines, n)
    h = _sums(text, n, np.uint32)[begins]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    wide = max(1, (bins - 1).bit_length())
    empty = np.uint32(0xFFFFFFFF)
    # as many bins as a power of two; those over `bins` aren't used
    s = np.full(len(count) << wide, empty, np.uint32)
    np.minimum.at(s, np.repeat(np.arange(len(count), dtype=np.int64) << wide, count) + (h >> np.uint32(32 - wide)), h << np.uint32(wide))
    s = s.reshape(-1, 1 << wide)
    gaps = np.flatnonzero((s == empty).any(1))
    own = s[gaps]
    filled, step = own.copy(), 0
    while len(gaps) and (filled == empty).any():
        step += 1
        source = (mix64(np.arange(1 << wide, dtype=np.uint64) + np.uint64(1000 * step)) & np.uint64((1 << wide) - 1)).astype(np.int64)
        other = own[:, source]
        filled = np.where((filled == empty) & (other != empty), other ^ np.uint32(step * 0x9E3779B1 & 0xFFFFFFFE), filled)
    s[gaps] = filled
    return s[:, :bins]


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each line and band."""
    s = s.reshape(len(s), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(s), 1))
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i].astype(np.uint64))
    return key


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]]


class Verifier:
    """Resemblance of lines by sketches and sorted distinct shingle hashes, with the components found so far: lines of one component aren't compared again.

    Bits of one map that another hasn't are shingles that the other line hasn't: where there are too many, the hashes needn't be compared.
    """

    def __init__(self, hashed: list[np.ndarray], sketch: np.ndarray, least: float):
        self.hashed, self.sketch, self.least, self.parent = hashed, sketch.tolist(), least, list(range(len(hashed)))
        self.maps: list[int | None] = [None] * len(hashed)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def alike(self, i: int, j: int) -> bool:
        if (self.sketch[i] ^ self.sketch[j]).bit_count() > 32 - AGREEING:
            return False
        s, t = self.hashed[i], self.hashed[j]
        if len(s) > len(t):
            s, t = t, s
        if len(s) < self.least * len(t):
            return False
        a, b = self.maps[i], self.maps[j]
        if a is not None and b is not None:
            if len(self.hashed[i]) > len(self.hashed[j]):
                a, b = b, a
            same = a & b
            most = min(len(s) - (a ^ same).bit_count(), len(t) - (b ^ same).bit_count())
            if most < self.least * (len(s) + len(t) - most):
                return False
        both = np.concatenate((s, t))
        both.sort()
        both = int((both[1:] == both[:-1]).sum())
        return both >= self.least * (len(s) + len(t) - both)

    def add_set(self, members: list[int]) -> None:
        """Links the components of the members as far as any two of them resemble each other."""
        groups: dict[int, list[int]] = {}
        if len(members) > MAPPED:
            for i in members:
                if self.maps[i] is None:
                    bits = np.zeros(MAP_BITS, bool)
                    bits[self.hashed[i] % MAP_BITS] = True
                    self.maps[i] = int.from_bytes(np.packbits(bits).tobytes())
        for i in members:
            mine = groups.setdefault(self.find(i), [])
            mine.append(i)
            for root in [r for r in groups if r != self.find(i)]:
                other = groups[root]
                j = next((j for j in reversed(other) if self.alike(i, j)), None)
                if j is not None:
                    self.links.append((i, j))
                    a, b = sorted((self.find(i), root))
                    self.parent[b] = a
                    groups[a] = groups.pop(a) + groups.pop(b)


def sketches(s: np.ndarray) -> np.ndarray:
    """A bit of each of the first 32 bins: lines that resemble each other to 0.8 agree in 29 of them on average, others in 16."""
    bits = (mix64(s[:, :32].astype(np.uint64)) & np.uint64(1)).astype(np.uint32)
    return (bits << np.arange(bits.shape[1], dtype=np.uint32)).sum(1, dtype=np.uint32)


def alike_groups(first: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A label for each row of the runs [first, first + size): rows of a run that agreeing sketches connect share one. Runs over SKETCHED rows stay whole, as sets that are verified by the same sketches."""
    label = np.repeat(first, size)
    small = np.flatnonzero(size <= SKETCHED)
    rows = ragged(first[small], size[small])
    later = np.repeat(first[small] + size[small], size[small]) - rows - 1
    i, j = np.repeat(rows, later), ragged(rows + 1, later)
    ok = 32 - np.bitwise_count(sketch[i] ^ sketch[j]) >= AGREEING
    own = union_find(i[ok], j[ok], len(label))
    label[rows] = own[rows]
    return label


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).where(F.col("_key").isNotNull())


def occurrences(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """line, doc, number of every line that takes part."""

    def run(batches):
        for b in batches:
            data, off = utf8(b["_text"])
            ids = b["_key"].to_numpy()
            for i, j in slices(off):
                own, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                row, number, start, end, part = line_table(own, at, min_chars)
                yield pa.RecordBatch.from_arrays([pa.array(line_ids(own, start[part], end[part])), pa.array(ids[i:j][row[part]]), pa.array(number[part].astype(np.int32))], ["line", "doc", "number"])

    return _keyed(df, key, text).mapInArrow(lean(run), "line long, doc long, number int")


def _unique_lines(batches, min_chars: int, size: int = 1 << 20, wanted=None):
    """Ids and bytes of the lines of a slice of about `size` bytes, each once. wanted: says of ids which may be left out."""
    for b in batches:
        data, off = utf8(b["_text"])
        for i, j in slices(off, size):
            own, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            _, _, start, end, part = line_table(own, at, min_chars)
            start, end = start[part], end[part]
            ids, first = np.unique(line_ids(own, start, end), return_index=True)
            if wanted is not None:
                keep = wanted(ids)
                ids, first = ids[keep], first[keep]
            if len(ids):
                raw = own.tobytes()
                yield ids, [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())]


def candidate_sets(df: DataFrame, total: int, key: str, text: str, min_chars: int, n: int, bands: int, rows: int) -> DataFrame:
    """set, line, home, part_of: lines that share a band's key; equal sets are one. home: the least line of the set, which near copies' sets have in common; of sets over APART lines the set.

    part_of: the larger set that this one is a block of; null for sets of up to BLOCK lines.
    """
    docs = _keyed(df, key, text)
    # a line has about 300 bytes; only the size of buckets depends on that
    n_buckets = int(min(1 << 24, 1 + total // 300 * bands // BUCKET_KEYS))

    def keys(batches):
        for ids, lines in _unique_lines(batches, min_chars):
            s = signatures(lines, n, bands * rows)
            k = band_keys(s, bands, rows).ravel()
            yield pack(((k & np.uint64(0xFFFFFF)) % np.uint64(n_buckets)).astype(np.int64), [(k >> np.uint64(32)).astype(np.uint32), np.repeat(sketches(s), bands), np.repeat(ids, bands)])

    def sets(batches):
        for _, (k, sketch, line) in packed_groups(batches, [np.uint32, np.uint32, np.int64]):
            order = np.lexsort((line, k))
            k, sketch, line = k[order], sketch[order], line[order]
            once = np.r_[True, (k[1:] != k[:-1]) | (line[1:] != line[:-1])]
            k, sketch, line = k[once], sketch[once], line[once]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            label = alike_groups(first, np.diff(np.r_[first, len(k)]), sketch)
            order = np.lexsort((line, label))
            line, label = line[order], label[order]
            first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            size = np.diff(np.r_[first, len(k)])
            name = np.add.reduceat(mix64(line.view(np.uint64)), first) + size.astype(np.uint64)
            keep = np.flatnonzero(size > 1)
            _, some = np.unique(name[keep], return_index=True)
            keep = keep[some]
            small, large = keep[size[keep] <= BLOCK], keep[size[keep] > BLOCK]
            set_of = np.repeat(np.arange(len(first)), size)
            chosen = np.zeros(len(first), bool)
            chosen[small] = True
            member = chosen[set_of]
            home = np.where(size > APART, name.view(np.int64), line[first])
            yield _set_rows(name[set_of[member]].view(np.int64), line[member], home[set_of[member]], None)
            for g in large.tolist():
                own = line[first[g] : first[g] + size[g]]
                # in an order that has nothing to do with the lines' order elsewhere
                own = own[np.argsort(mix64(own.view(np.uint64) + name[g]))]
                for i in range(HUB, len(own), BLOCK):
                    both = np.r_[own[:HUB], own[i : i + BLOCK]]
                    block = mix64(np.array([name[g]], np.uint64) + np.uint64(i)).view(np.int64)
                    yield _set_rows(np.full(len(both), block), both, np.full(len(both), block), name[g : g + 1].view(np.int64))

    packed = docs.mapInArrow(lean(keys), PACKED)
    return deal(packed, tasks(df.sparkSession, n_buckets)).mapInArrow(lean(sets), "set long, line long, home long, part_of long").distinct()


def _set_rows(name: np.ndarray, line: np.ndarray, home: np.ndarray, part_of: np.ndarray | None) -> pa.RecordBatch:
    parts = pa.nulls(len(line), pa.int64()) if part_of is None else pa.array(np.repeat(part_of, len(line)))
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(line), pa.array(home), parts], ["set", "line", "home", "part_of"])


def line_texts(df: DataFrame, wanted: DataFrame, n: int, total: int, key: str, text: str, min_chars: int) -> DataFrame:
    """line, body of the n wanted lines, out of `total` bytes of text. The lines that may be wanted travel compressed."""
    docs = _keyed(df, key, text)
    n_buckets = int(min(1 << 20, 1 + total // BUCKET_BYTES))
    may_be_wanted = membership(wanted, "line", n)
    bucket = lambda ids: (mix64(ids.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)

    def squeezed(batches):
        c = zstandard.ZstdCompressor(level=3)
        for ids, lines in _unique_lines(batches, min_chars, 8 << 20, may_be_wanted):
            to = bucket(ids)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]])
            bodies = []
            for s, e in zip(cuts, np.r_[cuts[1:], len(order)]):
                own = order[s:e]
                bodies.append(c.compress(np.int64(len(own)).tobytes() + ids[own].tobytes() + np.array([len(lines[i]) for i in own], np.int64).tobytes() + b"".join(lines[i] for i in own)))
            yield pa.RecordBatch.from_arrays([pa.array(to[order][cuts].astype(np.int32)), pa.array(bodies, pa.binary())], ["bucket", "body"])

    def asked(batches):
        for b in batches:
            ids = b["line"].to_numpy()
            yield pack(bucket(ids), [ids])

    def found(have: pa.Table, want: pa.Table) -> pa.Table:
        d, left = zstandard.ZstdDecompressor(), set()
        for x in want["body"]:
            raw = d.decompress(x.as_py())
            left.update(np.frombuffer(raw, np.int64, -1, 8).tolist())
        ids, bodies = [], []
        for x in have["body"] if left else []:
            raw = d.decompress(x.as_py())
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            own, size = np.frombuffer(raw, np.int64, n, 8).tolist(), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
            ends = (8 + 16 * n + np.cumsum(size)).tolist()
            for i, s, e in zip(own, size.tolist(), ends):
                if i in left:
                    left.discard(i)
                    ids.append(i)
                    bodies.append(raw[e - s : e])
        return pa.table([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], ["line", "body"])

    have, want = docs.mapInArrow(lean(squeezed), PACKED), wanted.mapInArrow(lean(asked), PACKED)
    return have.groupBy("bucket").cogroup(want.groupBy("bucket")).applyInArrow(lean_groups(found), "line long, body binary")


def resembling_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, n: int = SHINGLE, min_chars: int = MIN_CHARS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """line and component (the least id) of lines that resemble another line."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    sets = checkpoint(candidate_sets(df, total, key, text, min_chars, n, bands, rows))

    def texts_of(sets: DataFrame) -> DataFrame:
        wanted = checkpoint(sets.select("line").distinct())
        return line_texts(df, wanted, wanted.count(), total, key, text, min_chars)

    found = verified_links(sets, texts_of(sets), least, n, bands * rows)
    parts = sets.where("part_of is not null").select(F.col("part_of").alias("_group"), "line").distinct()
    if parts.limit(1).count():
        found = checkpoint(found)
        pieces = connected_components(found, thin=False).select(F.col("node").alias("line"), F.col("component").alias("_piece"))
        nodes = parts.join(pieces, "line", "left").withColumn("_piece", F.coalesce("_piece", "line"))
        apart = checkpoint(sets_between_pieces(nodes, "line").select("set", "line", F.col("set").alias("home")))
        found = found.unionByName(verified_links(apart, texts_of(apart), least, n, bands * rows))
    return connected_components(found, thin=False).select(F.col("node").alias("line"), "component")


def verified_links(sets: DataFrame, texts: DataFrame, least: float, n: int, bins: int) -> DataFrame:
    """a, b: links of lines of a set that resemble each other, as far as they join what isn't yet connected. sets: set, line, home."""
    n_buckets = int(min(1 << 30, 1 + sets.count() * 1000 // SET_BYTES))
    sets = sets.withColumn("bucket", F.pmod(F.xxhash64("home"), F.lit(n_buckets)).cast("int"))
    # a line's text goes once to each bucket that has a set with it
    bodies_of = sets.select("bucket", "line").distinct().join(texts, "line").select("bucket", "line", "body")

    def packed_sets(batches):
        for b in batches:
            yield pack(b["bucket"].to_numpy(), [b["set"].to_numpy(), b["line"].to_numpy()])

    def packed_texts(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            to, ids = b["bucket"].to_numpy(), b["line"].to_numpy()
            data, off = utf8(b["body"])
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]])
            bodies = []
            for s, e in zip(cuts, np.r_[cuts[1:], len(order)]):
                own = order[s:e]
                bodies.append(c.compress(np.int64(e - s).tobytes() + ids[own].tobytes() + np.diff(off)[own].tobytes() + b"".join(data[off[i] : off[i + 1]].tobytes() for i in own)))
            yield pa.RecordBatch.from_arrays([pa.array(to[order][cuts].astype(np.int32)), pa.array(bodies, pa.binary())], ["bucket", "body"])

    def verified(have: pa.Table, members: pa.Table) -> pa.Table:
        d, ids, lines = zstandard.ZstdDecompressor(), [], []
        for x in have["body"]:
            raw = d.decompress(x.as_py())
            k = int(np.frombuffer(raw, np.int64, 1)[0])
            size = np.frombuffer(raw, np.int64, k, 8 + 8 * k)
            ends = (8 + 16 * k + np.cumsum(size)).tolist()
            ids += np.frombuffer(raw, np.int64, k, 8).tolist()
            lines += [raw[e - z : e] for z, e in zip(size.tolist(), ends)]
        hashed: list[np.ndarray] = []
        sketch = [np.zeros(0, np.uint32)]
        first, total = 0, 0
        for i in range(len(lines) + 1):
            if i == len(lines) or total > 1 << 20:
                if i > first:
                    h, count = shingles(lines[first:i], n)
                    hashed += [distinct(h[e - k : e]) for e, k in zip(np.cumsum(count).tolist(), count.tolist())]
                    sketch.append(sketches(signatures(lines[first:i], n, bins)))
                first, total = i, 0
            total += len(lines[i]) if i < len(lines) else 0
        at = {x: i for i, x in enumerate(ids)}
        v = Verifier(hashed, np.concatenate(sketch), least)
        parts = [unpack(x.as_py(), [np.int64, np.int64]) for x in members["body"]]
        names, line = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((line, names))
        names, line = names[order], line[order]
        cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else names
        for s, e in zip(cuts, np.r_[cuts[1:], len(names)]):
            v.add_set([at[x] for x in line[s:e].tolist()])
        return pa.table([pa.array([ids[i] for i, _ in v.links], pa.int64()), pa.array([ids[j] for _, j in v.links], pa.int64())], ["a", "b"])

    have, members = bodies_of.mapInArrow(lean(packed_texts), PACKED), sets.mapInArrow(lean(packed_sets), PACKED)
    return have.groupBy("bucket").cogroup(members.groupBy("bucket")).applyInArrow(lean_groups(verified), "a long, b long")


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, **how) -> DataFrame:
    """doc, n_lines (that take part), removed (sorted numbers, from 0, of lines that go) of documents with such lines."""
    found = resembling_lines(df, key, text, min_chars=min_chars, **how)
    lines = occurrences(df, key, text, min_chars)
    lines = checkpoint(lines.join(found, "line", "left").select(F.coalesce("component", "line").alias("root"), "doc", "number"))
    first = checkpoint(lines.groupBy("root").agg(F.min(F.struct("doc", "number")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = lines.join(first, "root", "left").select("doc", "number", F.coalesce(F.struct("doc", "number") > F.col("first"), F.lit(False)).alias("gone"))
    return marked.groupBy("doc").agg(F.count_distinct("number").alias("n_lines"), F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("number")))).alias("removed"))


def drop_lines(df: DataFrame, repeated: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their removed lines; those with no word left go. repeated: doc, removed."""
    schema, names = df.schema, df.columns
    doc, removed = free("_doc", names), free("_removed", names)
    gone = checkpoint(repeated.where(F.size("removed") > 0).select(F.col("doc").alias(doc), F.col("removed").alias(removed)))
    n = gone.agg(F.sum(F.size(removed) + 2)).first()[0] or 0
    df = df.join(F.broadcast(gone) if n <= BROADCAST_LINES else gone, F.col(key) == F.col(doc), "left").drop(doc)

    def run(batches):
        for b in batches:
            texts = []
            for t, out in zip(b[text], b[removed].to_pylist()):
                if out:
                    less = set(out)
                    texts.append("\n".join(x for i, x in enumerate(t.as_py().split("\n")) if i not in less))
                else:
                    texts.append(t.as_py())
            b = b.set_column(b.schema.get_field_index(text), b.schema.field(text), pa.array(texts, b.schema.field(text).type)).select(names)
            yield b.filter(pc.fill_null(pc.match_substring_regex(b[text], r"[^ \t-\r]"), False))

    return df.select(*names, removed).mapInArrow(lean(run), schema)
