"""Exact substring dedup: bytes covered by a string of `length` bytes that also starts in a smaller document.

A suffix array over every suffix, in blocks with a difference cover, needs about ten bytes of shuffle for
each byte of text before any text is compared (see the README's figures), so the suffixes are thinned
first, without loss, and only contested ones are sorted, one bucket at a time:

1. Cover sample. In every window of `length` bytes the k-byte string with the least hash is sampled. Equal
   windows sample the same place, so, as with a difference cover, two equal windows share a sampled suffix at
   the same shift. One suffix in 18 is sampled. Each goes to the bucket of its first k bytes, with a rank (a
   hash) of the whole context that any window over it can see: length - k bytes on both sides.
2. Buckets. Suffixes of one bucket are sorted by first bytes, then by the precomputed rank. Where the rank also
   occurs in a smaller document, all windows over the suffix are covered. Where a suffix is the first of its
   rank, but others with the same first bytes differ in rank, it is contested: long ties must be cut at the right byte.
3. Contested suffixes get their contexts from their documents, and each bucket of them is sorted once for
   each shift of the window; those windows over one suffix that are covered form one span.
4. Spans meet their documents, are united, and the remaining bytes are put together.

Whatever the number of copies, a suffix is one row in one bucket. Rows travel packed, and a task holds one bucket: the
suffixes of one sampled string, however common, are in one, and take about 100 bytes each there.

Strings are compared by hashes: sampled strings by 64 bits at most (40 and the bucket), contexts by 48 more, windows of a contested
string by 64. Of 10^13 sampled suffixes (200 TB of text) two different ones would be taken for equal with a
probability of about 10^-8; in contested buckets, where only windows over one string meet, of 2^-64 a pair.

Null texts are empty. Rows without a key neither lose bytes nor make others lose any. Rows that share a key are
not smaller than one another; equal texts among them get the same spans. Empty tables give empty ones. Texts of any
length are sampled whole. Columns besides key and text don't pass, so none can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import PACKED, checkpoint, deal, delta, lean, lean_groups, mix64, pack, packed_groups, slices, tasks, unpack, utf8

#: Sampled suffixes and text bytes that a bucket should hold.
BUCKET_SUFFIXES, BUCKET_BYTES = 250_000, 8 << 20


class Windows:
    """The geometry of windows of `length` bytes and the sampled k-byte strings in them."""

    def __init__(self, length: int, k: int = 16):
        if not 16 <= k < length:
            raise ValueError("k is 16 at least and less than the length")
        self.length, self.k, self.side = length, k, length - k
        #: Bytes of context: `side` before the sampled string, itself, `side` after it.
        self.width = 2 * self.side + k


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x[:-step] |= x[step:] << np.uint64(8 * step)
    return x[: len(data)]


def _slide(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least (or greatest) of the n values from each position on, as far as there are any."""
    f, x, have = (np.minimum if least else np.maximum), x.copy(), 1
    while have < n:
        step = min(have, n - have)
        f(x[:-step], x[step:], out=x[:-step])
        have += step
    return x


def sample(texts: list[bytes], g: Windows) -> tuple[np.ndarray, ...]:
    """text number, position, hash of the sampled k bytes, rank of the context, bytes of context before and from the position on."""
    pad = b"\0" * g.length
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    begin = g.length + np.r_[0, np.cumsum(sizes[:-1] + g.length)] if len(texts) else np.zeros(0, np.int64)
    w = words8(data)
    h = w * np.uint64(0x9E3779B97F4A7C15)
    for at in range(8, g.k - 7, 8):
        h[:-at] = mix64(h[:-at] ^ (w[at:] * np.uint64(0xC2B2AE3D27D4EB4F)))
    if g.k % 8:
        h[: -(g.k - 8)] = mix64(h[: -(g.k - 8)] ^ (w[g.k - 8 :] * np.uint64(0x165667B19E3779F9)))
    h |= np.uint64(1)
    least = _slide(h, g.side + 1, True)
    valid = np.zeros(len(data) + 1, np.int8)
    long_ = sizes >= g.length
    np.add.at(valid, begin[long_], 1)
    np.add.at(valid, (begin + sizes - g.length + 1)[long_], -1)
    least[np.cumsum(valid[:-1]) == 0] = 0
    seen = np.zeros_like(least)
    seen[g.side :] = _slide(least, g.side + 1, False)[: len(least) - g.side]
    # before the first `side` positions there is only padding
    at = np.flatnonzero((seen == h) & (seen != 0))
    text = np.searchsorted(begin, at, "right") - 1
    pos = at - begin[text]
    before, after = np.minimum(g.side, pos), np.minimum(g.length, sizes[text] - pos)
    rank = mix64((before * 256 + after).astype(np.uint64) + np.uint64(1))
    for shift in sorted({*range(-g.side, -7, 8), -8, *range(g.k, g.length - 7, 8), g.length - 8}):
        rank = mix64(rank ^ w[at + shift])
    return text, pos, h[at], rank, before, after


def row_hash(text: bytes, matters: bool) -> int:
    """Tells rows of one key apart by their texts; 0, which costs nothing to move, where all keys are different."""
    return xxhash.xxh3_64_intdigest(text) if matters else 0


def keys_repeat(df: DataFrame, key: str) -> bool:
    return bool(df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count())


def _texts(batch: pa.RecordBatch, key: str, size: int = 1 << 20):
    data, off = utf8(batch["_text"])
    ids = pc.fill_null(batch[key], 0).to_numpy()
    none = batch[key].is_null().to_numpy(zero_copy_only=False)
    for i, j in slices(off, size):
        yield ids[i:j], none[i:j], [data[off[n] : off[n + 1]].tobytes() for n in range(i, j)]


_SUFFIX = [np.uint32, np.uint8, np.uint32, np.uint16, np.int64, np.uint64, np.int32, np.uint8, np.uint8]
_FOUND = [np.int64, np.uint64, np.uint64, np.int32, np.uint16]


def _pack_suffixes(bucket, h, rank, doc, row, pos, before, after):
    # 40 bits of the hash besides the bucket (false ties are contested and cut exactly), 48 of the rank
    order = np.argsort(bucket, kind="stable")
    edge = np.r_[True, bucket[order][1:] != bucket[order][:-1]]

    def differences(x):
        y = x[order]
        d = delta(y)
        d[edge] = y[edge]
        out = np.empty_like(d)
        out[order] = d
        return out

    return pack(bucket, [(h >> np.uint64(32)).astype(np.uint32), (h >> np.uint64(24)).astype(np.uint8), (rank >> np.uint64(32)).astype(np.uint32), (rank >> np.uint64(16)).astype(np.uint16), differences(doc), differences(row), differences(pos.astype(np.int32)), before.astype(np.uint8), after.astype(np.uint8)])


def _suffix_groups(batches):
    """Buckets with differences undone, blob by blob."""
    at, parts = None, []
    for b in batches:
        for bucket, body in zip(b["bucket"].to_pylist(), b["body"]):
            if bucket != at and parts:
                yield at, [np.concatenate(c) for c in zip(*parts)]
                parts = []
            at = bucket
            hi, lo, r1, r2, doc, row, pos, before, after = unpack(body.as_py(), _SUFFIX)
            parts.append(((hi.astype(np.uint64) << np.uint64(8)) | lo, (r1.astype(np.uint64) << np.uint64(16)) | r2, np.cumsum(doc), np.cumsum(row), np.cumsum(pos, dtype=np.int32), before, after))
    if parts:
        yield at, [np.concatenate(c) for c in zip(*parts)]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal rows in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix64(doc.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _found(doc, row, tie, pos, size, n):
    order = np.lexsort((pos, doc))
    return pack(_doc_bucket(doc[order], n), [x[order] for x in (doc, row, tie, pos.astype(np.int32), size.astype(np.uint16))])


def covered_spans(df: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, bool]:
    """Packed spans and packed documents by bucket of documents, and whether keys repeat."""
    g = Windows(length)
    docs = df.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text"))
    total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n_suffix = int(min(1 << 24, 1 + total * 2 // (g.side + 2) // BUCKET_SUFFIXES))
    n_docs = int(1 + total // BUCKET_BYTES)
    spark = df.sparkSession
    matters = keys_repeat(docs, key)

    def sampled(batches):
        for b in batches:
            for ids, _, texts in _texts(b, key):
                text, pos, h, rank, before, after = sample(texts, g)
                if len(pos):
                    yield _pack_suffixes(((h & np.uint64(0xFFFFFF)) % np.uint64(n_suffix)).astype(np.int64), h, rank, ids[text], np.array([row_hash(x, matters) for x in texts], np.uint64)[text], pos, before, after)

    def sorted_buckets(batches):
        """Spans (size over 0) and contested suffixes (size 0, with a tie of 40 bits of the hash and the bucket), by bucket of documents."""
        for bucket, (h, rank, doc, row, pos, before, after) in _suffix_groups(batches):
            order = np.lexsort((doc, rank, h))
            h, rank, doc, row, pos, before, after = (x[order] for x in (h, rank, doc, row, pos, before, after))
            tie, ranked = _runs(h), _runs(h, rank)
            first_of_rank = np.r_[True, ranked[1:] != ranked[:-1]]
            least = doc[np.flatnonzero(first_of_rank)][ranked]
            n_ties = tie[-1] + 1
            ranks_in_tie = np.bincount(tie[first_of_rank], minlength=n_ties)[tie]
            low, high = np.full(n_ties, np.iinfo(np.int64).max), np.full(n_ties, np.iinfo(np.int64).min)
            np.minimum.at(low, tie, doc)
            np.maximum.at(high, tie, doc)
            full = doc > least
            contested = ~full & (ranks_in_tie > 1) & (low[tie] < high[tie])
            take = np.flatnonzero(full | contested)
            if len(take):
                ties = np.where(full, np.uint64(0), (h << np.uint64(24)) | np.uint64(bucket))[take]
                start = np.where(full, pos - before, pos)[take]
                size = np.where(full, before.astype(np.int64) + after, 0)[take]
                yield _found(doc[take], row[take], ties, start, size, n_docs)

    suffixes = docs.where(F.col(key).isNotNull() & (F.octet_length("_text") >= length)).mapInArrow(lean(sampled), PACKED)
    found = checkpoint(deal(suffixes, tasks(spark, n_suffix)).mapInArrow(lean(sorted_buckets), PACKED))

    def squeezed(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for ids, none, texts in _texts(b, key, 8 << 20):
                to = _doc_bucket(ids, n_docs)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]])
                bodies = []
                for s, e in zip(cuts, np.r_[cuts[1:], len(order)]):
                    own = order[s:e]
                    head = np.int64(len(own)).tobytes() + ids[own].tobytes() + none[own].astype(np.uint8).tobytes() + np.array([len(texts[i]) for i in own], np.int64).tobytes()
                    bodies.append(c.compress(head + b"".join(texts[i] for i in own)))
                yield pa.RecordBatch.from_arrays([pa.array(to[order][cuts].astype(np.int32)), pa.array(bodies, pa.binary())], ["bucket", "body"])

    packed = docs.mapInArrow(lean(squeezed), PACKED)

    def contexts(dealt: pa.Table, ties: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), _FOUND) for x in ties["body"]]
        empty = pa.table({"bucket": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
        if not parts:
            return empty
        doc, row, tie, pos, size = (np.concatenate(c) for c in zip(*parts))
        keep = np.flatnonzero(size == 0)
        doc, row, tie, pos = doc[keep], row[keep], tie[keep], pos[keep]
        if not len(doc):
            return empty
        order = np.lexsort((row, doc))
        doc, row, tie, pos = doc[order], row[order], tie[order], pos[order]
        out = []
        done = set()
        for ids, none, texts in _open(dealt):
            for i, (d, raw) in enumerate(zip(ids.tolist(), texts)):
                if none[i] or len(raw) < length:
                    continue
                s, e = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
                if s == e:
                    continue
                r = row_hash(raw, matters)
                if (d, r) in done:
                    continue
                done.add((d, r))
                own = np.arange(s, e)[row[s:e] == np.uint64(r)]
                if len(own):
                    padded = np.frombuffer(b"\0" * g.side + raw + b"\0" * g.length, np.uint8)
                    c = np.lib.stride_tricks.sliding_window_view(padded, g.width)[pos[own]]
                    out.append((own, np.minimum(g.side, pos[own]), np.minimum(g.length, len(raw) - pos[own]), np.delete(c, np.s_[g.side : g.side + g.k], axis=1)))
        if not out:
            return empty
        own, before, after, near = (np.concatenate(x) for x in zip(*out))
        to = (tie[own] & np.uint64(0xFFFFFF)).astype(np.int64)
        near = np.ascontiguousarray(near).view(f"V{2 * g.side}").ravel()
        return pa.Table.from_batches([pack(to, [tie[own], doc[own], row[own], pos[own], before.astype(np.uint8), after.astype(np.uint8), near])])

    # a random number for each byte at each place of the context
    table = mix64(np.arange(2 * g.side * 256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)).reshape(2 * g.side, 256)
    tied = [np.uint64, np.int64, np.uint64, np.int32, np.uint8, np.uint8, f"V{2 * g.side}"]

    def cut(batches):
        """For each shift of the window, contested suffixes that see equal windows are sorted together; the least document keeps them."""
        for _, (tie, doc, row, pos, before, after, near) in packed_groups(batches, tied):
            order = np.argsort(tie, kind="stable")
            tie, doc, row, pos, near = tie[order], doc[order], row[order], pos[order], near[order]
            before, after = before[order].astype(np.int64), after[order].astype(np.int64)
            bytes_ = near.view(np.uint8).reshape(len(near), -1)
            left, right = bytes_[:, : g.side], bytes_[:, g.side :]
            # a window's hash: of the tie, and a random number for each byte at each place; a shift adds a byte on the left and takes one on the right
            window = mix64(tie)
            for n in range(g.side):
                window += table[g.side + n][right[:, n]]
            far, close = np.full(len(tie), -1, np.int64), np.full(len(tie), g.length, np.int64)
            for shift in range(g.side + 1):
                if shift:
                    window += table[g.side - shift][left[:, g.side - shift]] - table[2 * g.side - shift][right[:, g.side - shift]]
                rows = np.flatnonzero((before >= shift) & (after >= length - shift))
                if len(rows) < 2:
                    continue
                seen = window[rows]
                by = np.lexsort((doc[rows], seen))
                run = _runs(seen[by])
                least = doc[rows[by]][np.flatnonzero(np.r_[True, run[1:] != run[:-1]])][run]
                lost = rows[by][doc[rows[by]] > least]
                far[lost] = np.maximum(far[lost], shift)
                close[lost] = np.minimum(close[lost], shift)
            hit = np.flatnonzero(far >= 0)
            if len(hit):
                yield _found(doc[hit], row[hit], np.zeros(len(hit), np.uint64), pos[hit] - far[hit], far[hit] - close[hit] + length, n_docs)

    by_bucket = packed.groupBy("bucket")
    seen = by_bucket.cogroup(found.groupBy("bucket")).applyInArrow(lean_groups(contexts), PACKED)
    spans = deal(seen, tasks(spark, n_suffix)).mapInArrow(lean(cut), PACKED)
    return found.unionByName(spans), packed, matters


def _open(dealt: pa.Table):
    d = zstandard.ZstdDecompressor()
    for x in dealt["body"]:
        raw = d.decompress(x.as_py())
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, none, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint8, n, 8 + 8 * n), np.frombuffer(raw, np.int64, n, 8 + 9 * n)
        ends = 8 + 17 * n + np.cumsum(sizes)
        yield ids, none, [raw[e - s : e] for s, e in zip(sizes, ends)]


def unite(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans; spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:] - 1, len(start) - 1]]


def remove_repeats(df: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans (maximal removed runs), spans (array of start and end), kept (the remaining bytes)."""
    spans, packed, matters = covered_spans(df, length, key, text)

    def cleaned(dealt: pa.Table, found: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), _FOUND) for x in found["body"]]
        doc, row, _, pos, size = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, d) for d in _FOUND)
        keep = np.flatnonzero(size > 0)
        order = keep[np.argsort(doc[keep], kind="stable")]
        doc, row, pos, size = doc[order], row[order], pos[order].astype(np.int64), size[order].astype(np.int64)
        rows = []
        for ids, none, texts in _open(dealt):
            for i, (d, raw) in enumerate(zip(ids.tolist(), texts)):
                starts = ends = np.zeros(0, np.int64)
                s, e = (0, 0) if none[i] else (np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right"))
                if s < e:
                    own = row[s:e] == np.uint64(row_hash(raw, matters))
                    if own.any():
                        starts, ends = unite(pos[s:e][own], (pos + size)[s:e][own])
                at = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(at[::2], at[1::2]))
                rows.append((None if none[i] else d, len(raw), len(raw) - len(kept), len(starts), [{"start": x, "end": y} for x, y in zip(starts.tolist(), ends.tolist())], kept))
        cols = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], [key, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return packed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(lean_groups(cleaned), f"`{key}` long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
