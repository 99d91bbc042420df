"""Byte-level BPE encoding and decoding on length-bucketed, padded matrices.

A text is cut into pieces by the vocabulary's pattern. Pieces not seen lately go, by length, into
padded integer matrices. In every round each row merges its leftmost pair of the least rank: pair
ranks come from a hashed table, the row is compacted by one, and two of its ranks are renewed. A row
leaves when no pair of it is in the table. Pieces over `LONGEST` bytes would make the matrices
quadratic and are merged one by one with a heap, in the same order.

Nulls are empty texts; an empty text has no ids. Rows are independent: repeated rows, ties and empty
tables need no care, and other columns pass unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import SLICE_BYTES, lean, ragged, slices, utf8

NONE = np.int32(2**31 - 1)
LONGEST = 256
#: Pieces that a worker remembers.
REMEMBERED = 100_000


class PairTable:
    """Ranks of pairs of ids, by open addressing in two flat arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            self.ranks[slot[free]] = ranks[free]
            lost = self.keys[slot] != keys
            self.ranks[slot[~lost]] = ranks[~lost]
            keys, ranks, slot = keys[lost], ranks[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        shape = keys.shape
        keys = keys.ravel()
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        seen = self.keys[slot]
        hit = seen == keys
        out[hit] = self.ranks[slot[hit]]
        open_ = np.flatnonzero(~hit & (seen != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out.reshape(shape)


class Bpe:
    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [((ranks[t[:i]] << 32) | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.ranks = ranks
        self.table = PairTable(*(np.array(x, d) for x, d in zip(zip(*pairs), (np.int64, np.int32))))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_rows(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """m: a row of byte ids for each piece, padded with -1. Returns the flat ids of the rows and their counts."""
        rows, width = m.shape
        count = (m >= 0).sum(1)
        rank = self.table.find(m[:, :-1], m[:, 1:])
        rank[m[:, 1:] < 0] = NONE
        live, cols = np.arange(rows), np.arange(width)
        cur, cur_rank = m.copy(), rank
        while len(live):
            at = cur_rank.argmin(1)
            best = cur_rank[np.arange(len(live)), at]
            going = best != NONE
            if not going.all():
                m[live[~going]] = cur[~going]
                live, cur, cur_rank, at, best = live[going], cur[going], cur_rank[going], at[going], best[going]
                if not len(live):
                    break
            r = np.arange(len(live))
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            cur = np.take_along_axis(cur, take, 1)
            cur[:, -1] = -1
            cur[r, at] = best
            count[live] -= 1
            cur_rank = np.take_along_axis(cur_rank, np.minimum(take[:, :-1], width - 2), 1)
            cur_rank[:, -1] = NONE
            for left, ok in ((at - 1, at > 0), (at, at < width - 1)):
                i, j = r[ok], left[ok]
                new = self.table.find(cur[i, j], cur[i, j + 1])
                new[cur[i, j + 1] < 0] = NONE
                cur_rank[i, j] = new
        return m[cols < count[:, None]], count

    def merge_long(self, piece: bytes) -> list[int]:
        """The same order of merges for one long piece, in O(n log n)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda a, b: self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (q := rank(ids[left], ids[right])) is not None:
                    heapq.heappush(heap, (q, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces, by length, and remembers their ids."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, lengths = [], np.zeros(len(raw), np.int64)
        order = []
        width = 1
        while width <= LONGEST:
            low = width // 2 if width > 1 else 0
            these = np.flatnonzero((size > low) & (size <= width))
            for s in range(0, len(these), max(64, 400_000 // width)):
                part = these[s : s + max(64, 400_000 // width)]
                data = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                if width == 1:
                    ids, count = data, np.ones(len(part), np.int64)
                else:
                    m = np.full((len(part), width), -1, np.int32)
                    m[np.arange(width) < size[part][:, None]] = data
                    ids, count = self.merge_rows(m)
                flat.append(ids)
                lengths[part] = count
                order.append(part)
            width *= 2
        for i in np.flatnonzero(size > LONGEST):
            ids = self.merge_long(raw[i])
            flat.append(np.array(ids, np.int32))
            lengths[i] = len(ids)
            order.append(np.array([i]))
        if not order:
            return
        order = np.concatenate(order)
        ends = np.cumsum(lengths[order])
        base = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - lengths[order]])
        self.lengths = np.concatenate([self.lengths, lengths[order]])
        self.ids = np.concatenate([self.ids, *flat])
        for k, i in enumerate(order.tolist()):
            self.known[pieces[i]] = base + k

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The flat ids of all texts and the offsets of each text's."""
        if len(self.known) > REMEMBERED:
            self.known = {}
            self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pieces, counts = [], []
        for t in texts:
            found = self.split(t)
            counts.append(len(found))
            pieces += found
        self.learn([p for p in set(pieces) if p not in self.known])
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.lengths[which]
        ids = self.ids[ragged(self.starts[which], lengths)]
        ends = np.r_[0, np.cumsum(lengths)]
        return ids, ends[np.r_[0, np.cumsum(counts)].astype(np.int64)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def load(vocabulary: bytes, pattern: str) -> Bpe:
    """One tokenizer for each worker process."""
    return Bpe(vocabulary, pattern)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(batch: pa.RecordBatch, column: str, bpe: Bpe) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = utf8(batch[column])
    for i, j in slices(off):
        texts = [data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") for k in range(i, j)]
        yield i, j, *bpe.encode(texts)


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def encode(df: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the column `ids` (array of int) in place of any column of that name."""

    def run(batches):
        bpe = load(vocabulary, pattern)
        for b in batches:
            parts = [(x, o) for _, _, x, o in encoded(b, text, bpe)]
            flat = np.concatenate([x for x, _ in parts] or [np.zeros(0, np.int32)])
            counts = np.concatenate([np.diff(o) for _, o in parts] or [np.zeros(0, np.int64)])
            yield _with(b, **{ids: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))})

    df = df.drop(ids)
    return df.mapInArrow(lean(run), df.withColumn(ids, F.lit(None).cast("array<int>")).schema)


def decode(df: DataFrame, vocabulary: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded bytes of the column `ids` (null: no bytes) in place of any column named `out`."""

    def run(batches):
        bpe = load(vocabulary, pattern)
        for b in batches:
            yield _with(b, **{out: pa.array([bpe.decode(x or []) for x in b[ids].to_pylist()], pa.binary())})

    df = df.drop(out)
    return df.mapInArrow(lean(run), df.withColumn(out, F.lit(None).cast("binary")).schema)


def round_trip_digests(df: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, decodes its ids, and returns counts and digests of both instead of the ids themselves: one pass, nothing shuffled.

    Columns: the key, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256.
    """

    def run(batches):
        bpe = load(vocabulary, pattern)
        for b in batches:
            n, by_ids, by_bytes = [], [], []
            for i, j, ids, off in encoded(b, text, bpe):
                for k in range(j - i):
                    own = ids[off[k] : off[k + 1]].tolist()
                    n.append(len(own))
                    by_ids.append(hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, own)).encode()).hexdigest())
                    by_bytes.append(hashlib.sha256(bpe.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([b[key], pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    df = df.select(key, text)
    return df.mapInArrow(lean(run), df.select(key, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema)
