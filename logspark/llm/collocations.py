"""Phrase collocations: counts of word n-grams in counting quotient filters, and how fast the words of a phrase stick together.

A first pass splits texts into pieces and words. Each chunk of texts is written once, as the run of its words' numbers in its own vocabulary,
and that vocabulary, packed by buckets of words; so texts are read once. A bucket's task adds up its words' counts, gives those that are frequent
enough for a phrase an id, and tells every chunk the ids of its words. A second pass puts ids into the runs (0 for other words) and writes those.
Then the ids of each pair are packed and permuted invertibly; the upper part of the result is the quotient, the lower part the remainder. A chunk's filter
keeps its n-grams in order of quotients, as the number of remainders of each quotient, the remainders in full, and counters of one byte with an
overflow: nothing is lost, and the permutation undone gives the ids back. Filters are cut into shards by quotient; sorted filters of a
shard are merged, a shard at a time, and n-grams that are frequent enough leave as rows. Triples are counted after pairs, in the same way: a triple can only be frequent if
both its pairs are, so a bitmap of the frequent pairs keeps most others from travelling; it lets some pass, and the counts decide.

The permutation spreads frequent words over the shards, and a chunk has one entry for an n-gram however often it occurs, so no word or phrase makes a
shard hot. Cuts, scores and ranks are joins and windows over the phrases that are left, with exact decimals.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import checkpoint, deal, lean, membership, mix64, partitions, tasks

#: Bytes of texts in a chunk (a longer text is a chunk of its own), and of those that wait for more.
CHUNK, WAITING = 8 << 20, 64 << 20
#: Entries that a shard should have, and from which on filters that wait are merged.
SHARD = 1 << 21
#: Entries of vocabularies in a bucket of words (about 12 bytes each), ids up to so many bits (three of them are packed).
WORDS, MOST_BITS = 1 << 20, 32
#: Buckets of words that chunks are packed by; where they hold too much, each is split further before it is dealt.
FINE = 1 << 8
#: Parts of a language that are ranked apart, one set of parts after another.
SALTS = (64, 8)
#: Rows up to which the dictionary is broadcast (about 60 bytes each); above it is joined by shuffles.
BROADCAST_WORDS = 200_000

#: A-Z to a-z, what ends a piece to a line end, tabs to spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


class Numbers(dict):
    """Numbers of words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The vocabulary of texts, the count of each of its words, and the run of words as numbers from 1; 0 is between pieces. Number 1 is the vocabulary's first."""
    own = Numbers({b"\n": 0, b"": 1})
    runs = []
    for t in texts:
        words = t.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        runs += [np.fromiter(map(own.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
    run = np.concatenate(runs)
    run = run[run != 1]
    run[run > 1] -= 1
    return list(own)[2:], np.bincount(run, minlength=len(own) - 1)[1:], run


class Permutation:
    """A bijection of three fields of `bits` bits each to a quotient of `bits` bits and a remainder of twice as many: four rounds, each undone by itself."""

    def __init__(self, bits: int):
        self.bits = bits
        self.high, self.low = np.uint64((1 << bits) - 1), np.uint64((1 << 2 * bits) - 1)

    def _rounds(self) -> list[np.uint64]:
        return [np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for k in range(1, 5)]

    def forth(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, r = a.astype(np.uint64), (b.astype(np.uint64) << np.uint64(self.bits)) | c.astype(np.uint64)
        for i, k in enumerate(self._rounds()):
            if i % 2 == 0:
                q = q ^ (mix64(r + k) & self.high)
            else:
                r = r ^ (mix64(q + k) & self.low)
        return q, r

    def back(self, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for i, k in reversed(list(enumerate(self._rounds()))):
            if i % 2 == 0:
                q = q ^ (mix64(r + k) & self.high)
            else:
                r = r ^ (mix64(q + k) & self.low)
        return q, r >> np.uint64(self.bits), r & self.high


class QuotientFilter:
    """Entries of distinct (quotient, remainder) with a count, in order. Counts are exact."""

    def __init__(self, quotient: np.ndarray, remainder: np.ndarray, count: np.ndarray):
        self.quotient, self.remainder, self.count = quotient, remainder, count

    @classmethod
    def of(cls, quotient: np.ndarray, remainder: np.ndarray, count: np.ndarray | None = None) -> QuotientFilter:
        """Entries in any order and repeated, whose counts add up."""
        order = np.lexsort((remainder, quotient))
        quotient, remainder = quotient[order], remainder[order]
        starts = np.flatnonzero(np.r_[True, (quotient[1:] != quotient[:-1]) | (remainder[1:] != remainder[:-1])]) if len(order) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[starts, len(order)]) if count is None else np.add.reduceat(count[order], starts) if len(order) else count
        return cls(quotient[starts], remainder[starts], counts)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        return filters[0] if len(filters) == 1 else cls.of(*(np.concatenate(c) for c in zip(*((f.quotient, f.remainder, f.count) for f in filters))))

    def __len__(self) -> int:
        return len(self.count)

    def encoded(self, first: int, slots: int, width: int) -> bytes:
        """The filter as bytes: remainders of each of the `slots` quotients from `first` on, remainders of `width` bytes, counters."""
        runs = np.bincount((self.quotient - np.uint64(first)).astype(np.int64), minlength=slots)
        remainders = np.ascontiguousarray(self.remainder).view(np.uint8).reshape(-1, 8)[:, :width]
        small = np.minimum(self.count, 255).astype(np.uint8)
        over = self.count[small == 255]
        # columns of bytes are alike, so they are stored by columns
        parts = [_varints(runs), np.ascontiguousarray(remainders.T).tobytes(), small.tobytes(), over.astype("<i8").tobytes()]
        head = np.array([len(self), len(parts[0])], "<i8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))

    @classmethod
    def decoded(cls, body: bytes, first: int, slots: int, width: int) -> QuotientFilter:
        raw = zstandard.ZstdDecompressor().decompress(body)
        n, size = np.frombuffer(raw, "<i8", 2).tolist()
        at = 16
        runs = _integers(np.frombuffer(raw, np.uint8, size, at))
        at += size
        remainder = np.zeros((n, 8), np.uint8)
        remainder[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        count = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        count[count == 255] = np.frombuffer(raw, "<i8", -1, at + n)
        return cls(np.repeat(np.arange(slots, dtype=np.uint64) + np.uint64(first), runs), remainder.view(np.uint64).ravel(), count)


def _varints(x: np.ndarray) -> bytes:
    """Bytes of whole numbers, seven bits a byte, the lowest first."""
    out = []
    k = np.arange(len(x))
    x = x.astype(np.uint64)
    while len(k):
        more = x >= 128
        out.append((k, (x & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)))
        k, x = k[more], x[more] >> np.uint64(7)
    if not out:
        return b""
    at = np.concatenate([k for k, _ in out])
    return np.concatenate([v for _, v in out])[np.argsort(at, kind="stable")].tobytes()


def _integers(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def chunks(df: DataFrame, text: str, lang: str) -> DataFrame:
    """chunk, lang, bucket, n, body, written in the shared folder: whole texts, one chunk after another.

    A chunk has a row with bucket -1, whose body is the run of its words (see numbered) and n their number, and a row for each bucket of its words:
    the words (as text with spaces), their numbers and counts.
    """
    src = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))

    def one(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        words, counts, run = numbered(texts)
        squeeze = zstandard.ZstdCompressor(level=3)
        # the chunk's own word numbers by frequency, so that small numbers are common
        order = np.argsort(-counts, kind="stable")
        place = np.zeros(len(words) + 1, np.int32)
        place[order + 1] = np.arange(1, len(words) + 1)
        run = place[run]
        name = uuid.uuid4().hex
        of = _hashes([words[i] for i in order]) % np.uint64(FINE)
        by = np.argsort(of, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(of[by]) != 0]) if len(by) else np.zeros(0, np.int64)
        buckets, bodies = [-1], [squeeze.compress(np.ascontiguousarray(run.view(np.uint8).reshape(-1, 4).T).tobytes())]
        for s, e in zip(cut, np.r_[cut[1:], len(by)]):
            own = by[s:e]
            numbers, n = np.sort(own).astype("<i4"), counts[order[np.sort(own)]].astype("<i8")
            buckets.append(int(of[own[0]]))
            bodies.append(_packed(numbers, n, [words[order[i]] for i in numbers]))
        size = [int(counts.sum()), *np.diff(np.r_[cut, len(by)]).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(buckets)), pa.array([lang] * len(buckets)), pa.array(buckets, pa.int32()), pa.array(size, pa.int64()), pa.array(bodies, pa.binary())], ["chunk", "lang", "bucket", "n", "body"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                raw = text.as_py()
                if not raw:
                    continue
                held.setdefault(lang, []).append(raw)
                size[lang] = size.get(lang, 0) + len(raw)
                if size[lang] >= CHUNK:
                    size.pop(lang)
                    yield one(lang, held.pop(lang))
                elif sum(size.values()) >= WAITING:
                    for k in list(held):
                        yield one(k, held.pop(k))
                    size.clear()
        for k in list(held):
            yield one(k, held.pop(k))

    # a chunk's name is its own; it is written once
    return checkpoint(src.mapInArrow(lean(run), "chunk string, lang string, bucket int, n bigint, body binary"))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _packed(numbers: np.ndarray, counts: np.ndarray, words: list[bytes]) -> bytes:
    """Words, which hold no spaces, with their numbers in rising order and their counts."""
    parts = [np.int64(len(words)).tobytes(), np.diff(numbers, prepend=0).astype("<i4").tobytes(), counts.astype("<i8").tobytes(), b" ".join(words)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _vocabulary(body: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.cumsum(np.frombuffer(raw, "<i4", n, 8)), np.frombuffer(raw, "<i8", n, 8 + 4 * n), raw[8 + 12 * n :].split(b" ")


def dictionary(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """id, lang, word, f of the words that occur `least` times; and chunk, known: for each bucket of a chunk's words the numbers and ids of those.

    Ids are from 1, each once: a bucket numbers its words, and the buckets' numbers interleave. A task holds one bucket's vocabularies, compressed.
    """
    spark = texts.sparkSession
    words = texts.where("bucket >= 0").select("bucket", "lang", "chunk", "body")
    entries = texts.where("bucket >= 0").agg(F.sum("n")).first()[0] or 0

    # with more vocabularies than the buckets should hold, a bucket is k
    k = max(1, -(-entries // (FINE * WORDS)))
    n_buckets = FINE * k

    def split(batches):
        for b in batches:
            for bucket, lang, chunk, body in zip(b["bucket"].to_pylist(), b["lang"].to_pylist(), b["chunk"].to_pylist(), b["body"]):
                numbers, counts, own = _vocabulary(body.as_py())
                of = _hashes(own) // np.uint64(FINE) % np.uint64(k)
                parts = np.unique(of)
                bodies = [_packed(numbers[of == p], counts[of == p], [own[i] for i in np.flatnonzero(of == p)]) for p in parts]
                columns = [pa.array((bucket + FINE * parts.astype(np.int64)).astype(np.int32)), pa.array([lang] * len(parts), pa.string()), pa.array([chunk] * len(parts), pa.string()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "lang", "chunk", "body"])

    if k > 1:
        words = words.mapInArrow(lean(split), "bucket int, lang string, chunk string, body binary")

    def one(bucket: int, held: list[tuple[str, str, bytes]]):
        total: dict[tuple[str, bytes], int] = {}
        for lang, _, body in held:
            _, counts, own = _vocabulary(body)
            for w, n in zip(own, counts.tolist()):
                total[lang, w] = total.get((lang, w), 0) + n
        frequent = sorted(w for w, n in total.items() if n >= least)
        ids = {w: i * n_buckets + bucket + 1 for i, w in enumerate(frequent)}
        # frequent words come back as rows, and to each chunk as its numbers and their ids
        n = len(frequent)
        yield pa.RecordBatch.from_arrays([pa.array(ids.values(), pa.int64()), pa.array([w[0] for w in frequent], pa.string()), pa.array([w[1] for w in frequent], pa.binary()), pa.array([total[w] for w in frequent], pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], names)
        for lang, chunk, body in held:
            numbers, _, own = _vocabulary(body)
            of = np.fromiter((ids.get((lang, w), 0) for w in own), np.int64, len(own))
            numbers, of = numbers[of > 0].astype("<i4"), of[of > 0].astype("<i8")
            packed = zstandard.ZstdCompressor(level=1).compress(np.int64(len(of)).tobytes() + numbers.tobytes() + of.tobytes())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([chunk]), pa.array([packed], pa.binary())], names)

    names = ["id", "lang", "word", "f", "chunk", "known"]

    def run(batches):
        rows = ((bucket, lang, chunk, body.as_py()) for b in batches for bucket, lang, chunk, body in zip(b["bucket"].to_pylist(), b["lang"].to_pylist(), b["chunk"].to_pylist(), b["body"]))
        for bucket, group in itertools.groupby(rows, key=lambda r: r[0]):
            yield from one(bucket, [r[1:] for r in group])

    dealt = deal(words, min(tasks(spark, n_buckets), max(partitions(spark), -(-entries // WORDS))))
    out = checkpoint(dealt.mapInArrow(lean(run), "id long, lang string, word binary, f long, chunk string, known binary"))
    return out.where("id is not null").select("id", "lang", "word", "f"), out.where("chunk is not null").select("chunk", "known")


def with_ids(texts: DataFrame, known: DataFrame) -> DataFrame:
    """n, run: the run of each chunk with ids in place of its own numbers, 0 for words that no phrase can hold, compressed; written in the shared folder."""
    # as many rows for a chunk as there are buckets at most
    of = known.groupBy("chunk").agg(F.collect_list("known").alias("known"))

    def run(batches):
        for b in batches:
            runs = []
            for body, known, n in zip(b["body"], b["known"].to_pylist(), b["n"].to_pylist()):
                ids, got = np.zeros(n + 1, np.int64), zstandard.ZstdDecompressor()
                for k in known or ():
                    raw = got.decompress(k)
                    m = int(np.frombuffer(raw, "<i8", 1)[0])
                    ids[np.frombuffer(raw, "<i4", m, 8) + 1] = np.frombuffer(raw, "<i8", m, 8 + 4 * m)
                flat = np.frombuffer(got.decompress(body.as_py()), np.uint8)
                own = np.ascontiguousarray(flat.reshape(4, -1).T).view(np.int32).ravel()
                of = ids[own]
                # a run of words outside phrases is one gap
                of = of[np.r_[True, (of[1:] != 0) | (of[:-1] != 0)]] if len(of) else of
                runs.append(zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(of.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.binary())], ["run"])

    both = texts.where("bucket = -1").select("chunk", "n", "body").join(of, "chunk", "left")
    return checkpoint(both.select("n", "body", "known").mapInArrow(lean(run), "run binary"))


def count_phrases(runs: DataFrame, bits: int, least: int, n_words: int, size: int, may_hold=None) -> DataFrame:
    """x, y, z, f: the ids of each pair (size 2, x is 0) or triple of words that occurs `least` times within pieces. runs: see with_ids.

    may_hold: whether a pair, by its hash, may be frequent; triples with another pair don't count.
    """
    spark = runs.sparkSession
    permute, width = Permutation(bits), -(-2 * bits // 8)
    n_shards = max(1, min(1 << bits, max(partitions(spark), -(-n_words // SHARD))))
    # shards are ranges of quotients
    bounds = np.array([-(-s * (1 << bits) // n_shards) for s in range(n_shards + 1)], np.int64)

    def ngrams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        two = (ids[:-1] != 0) & (ids[1:] != 0)
        if size == 2:
            return np.zeros(int(two.sum()), np.int64), ids[:-1][two], ids[1:][two]
        if may_hold is not None:
            two[two] = may_hold(pair_hash(ids[:-1][two], ids[1:][two], bits))
        three = two[:-1] & two[1:]
        return ids[:-2][three], ids[1:-1][three], ids[2:][three]

    def filtered(batches):
        for b in batches:
            for run in b["run"]:
                flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(run.as_py()), np.uint8)
                ids = np.ascontiguousarray(flat.reshape(8, -1).T).view(np.int64).ravel()
                f = QuotientFilter.of(*permute.forth(*ngrams(ids)))
                cut = np.searchsorted(f.quotient, bounds.astype(np.uint64))
                full = np.flatnonzero(np.diff(cut))
                body = [QuotientFilter(f.quotient[cut[s] : cut[s + 1]], f.remainder[cut[s] : cut[s + 1]], f.count[cut[s] : cut[s + 1]]).encoded(int(bounds[s]), int(bounds[s + 1] - bounds[s]), width) for s in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(body, pa.binary())], ["bucket", "body"])

    def merged(batches):
        rows = ((bucket, body.as_py()) for b in batches for bucket, body in zip(b["bucket"].to_pylist(), b["body"]))
        for s, group in itertools.groupby(rows, key=lambda r: r[0]):
            held: list[QuotientFilter] = []
            for _, body in group:
                held.append(QuotientFilter.decoded(body, int(bounds[s]), int(bounds[s + 1] - bounds[s]), width))
                if len(held) > 1 and sum(map(len, held[1:])) > max(SHARD, len(held[0])):
                    held = [QuotientFilter.merged(held)]
            f = QuotientFilter.merged(held)
            keep = f.count >= least
            ids = permute.back(f.quotient[keep], f.remainder[keep])
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in ids), pa.array(f.count[keep])], ["x", "y", "z", "f"])

    return deal(runs.mapInArrow(lean(filtered), "bucket int, body binary"), tasks(spark, n_shards)).mapInArrow(lean(merged), "x long, y long, z long, f long")


def pair_hash(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """A hash of pairs of ids, not negative."""
    return (mix64((a.astype(np.uint64) << np.uint64(bits)) | b.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _with_words(df: DataFrame, words: DataFrame, on: list[str] | str, n_words: int) -> DataFrame:
    return df.join(F.broadcast(words) if n_words <= BROADCAST_WORDS else words, on)


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    product = (wide(a) * wide(a)).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", product, (wide(l) * wide(r)).cast("decimal(38,0)"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two or three words.

    Words are what spaces and tabs separate in pieces, and pieces what . , ; : ! ? and line ends do; A-Z are lower-cased. n: words of the language; a: occurrences of
    the phrase, `least` or more. A phrase cut into two has l and r occurrences of its parts and the score floor(10**6 * a * a / (l * r)), which is at most 10**6; its lowest
    cut counts, the first of equal ones. A pair that is part of a triple with at least `inside` hundredths of its occurrences is left out. Order: score and a, higher first, then
    phrase by its bytes. Arithmetic is exact up to counts of 10**15. Null texts are empty, a null language is `und`. Repeated rows count again.
    Texts of any length are whole: a text longer than a chunk is a chunk of its own, one task's. Empty tables give empty ones. Other columns don't pass, so none can clash.
    """
    texts = chunks(df, text, lang)
    sizes = texts.where("bucket = -1").groupBy("lang").agg(F.sum("n").alias("n"))
    words, known = dictionary(texts, least)
    n_words, top_id = words.agg(F.count("*"), F.max("id")).first()
    bits = (top_id or 1).bit_length()
    if bits > MOST_BITS:
        raise ValueError(f"ids of {bits} bits")
    runs = with_ids(texts, known)
    n_all = sizes.agg(F.sum("n")).first()[0] or 0
    found = checkpoint(count_phrases(runs, bits, least, n_all, 2))

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(b["y"].to_numpy(), b["z"].to_numpy(), bits))], ["pair"])

    # a bitmap of the frequent pairs, of bounded size; more pairs than it has room for only let more triples travel
    may_hold = membership(found.mapInArrow(lean(hashed), "pair long"), "pair", found.count())
    found = found.unionByName(checkpoint(count_phrases(runs, bits, least, n_all, 3, may_hold)))
    single = words.select("id", F.col("f").alias("own"))
    pairs = found.where("x = 0").select(F.col("y").alias("x"), F.col("z").alias("y"), F.col("f").alias("a"))
    triples = found.where("x > 0").withColumnRenamed("f", "a")

    def with_count(df: DataFrame, id_: str, name: str) -> DataFrame:
        return _with_words(df, single.withColumnsRenamed({"id": id_, "own": name}), id_, n_words)

    # of pairs: the most frequent triple that holds it
    holds = triples.select("x", "y", "a").unionByName(triples.select(F.col("y").alias("x"), F.col("z").alias("y"), "a")).groupBy("x", "y").agg(F.max("a").alias("longer"))
    two = with_count(with_count(pairs, "x", "l"), "y", "r").join(holds, ["x", "y"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    two = two.select("x", "y", F.lit(0).cast("long").alias("z"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    three = with_count(with_count(triples, "x", "l1"), "z", "r2")
    three = three.join(pairs.select("x", "y", F.col("a").alias("l2")), ["x", "y"]).join(pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("r1")), ["y", "z"])
    three = three.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    low = lambda a, b: F.when(F.col("s1") <= F.col("s2"), F.col(a)).otherwise(F.col(b))
    three = three.select("x", "y", "z", "a", low("l1", "l2").alias("l"), low("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))
    best = _with_words(two.unionByName(three), words.select(F.col("id").alias("x"), "lang"), "x", n_words)
    # those that may be among the first by score and count, before they get their words: ties stay
    order = [F.col("score").desc(), F.col("a").desc()]
    for salts in SALTS:
        salt = F.pmod(F.xxhash64("x", "y", "z"), F.lit(salts))
        best = best.withColumn("rank", F.rank().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    for c in "xyz":
        of = words.select(F.col("id").alias(c), F.col("word").cast("string").alias(f"w{c}"))
        best = best.join(F.broadcast(of) if n_words <= BROADCAST_WORDS else of, c, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", "wx", "wy", "wz"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
