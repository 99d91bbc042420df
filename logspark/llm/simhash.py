"""SimHash near-duplicates by vantage-point trees over fingerprints.

Two fingerprints within `radius` bits of each other are, in at least one of any B disjoint blocks of their
bits, within radius // B bits (the differences of the blocks add up). So every block has a vantage-point
tree of its own, with the Hamming distance inside the block as its metric; the small radius keeps the
boundaries between branches thin. The upper levels of a tree are the shards: a fingerprint lives in the
branch that its distances to the vantage points give, and also visits each branch that the triangle bound
doesn't rule out, of which only those after its own are needed to meet every pair. Every level that is cut so
lets more branches through, so after `TREE_LEVELS` a level is a single bit of the block, and of the branches
only those are visited that a value within the block's radius lives in: at a radius of 1 at most 22 others,
however many fingerprints there are. A task goes on
splitting its shard by further vantage points, prunes by the same bound, and compares what is left
bit by bit over the whole fingerprint, so the pairs are exact for any radius.

Per shard only a minimum spanning forest of the near pairs is returned (shortest first): no group, however
large, gives more links than it has members, and no connection is lost. Hot shards are dealt to several
tasks by their visitors: blocks of residents against blocks of visitors, which is what comparing them takes.
Equal fingerprints are one. Texts of any length are hashed whole, and all their words. Columns besides key and
text don't pass; the key may have any name, and a result that would have the key's name gets an underscore behind
its own. Empty tables give empty ones.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import PACKED, checkpoint, deal, free, lean, membership, mix64, pack, packed_groups, partitions, slices, tasks, utf8
from logspark.llm.components import connected_components, join_components, sets_between_pieces, union_find

#: Fingerprints that a shard should hold (a few megabytes; every level above tasks costs visits, so shards are large), and from
#: which on it is dealt to several tasks.
SHARD, HOT_SHARD = 1 << 16, 1 << 17
#: Levels above tasks at most; shards that would need more are dealt to several tasks.
MOST_LEVELS = 24
#: Of these, so many by vantage points. The largest shard is at most 2 to this power times what the bits alone would give.
TREE_LEVELS = 3
#: Values within a block's radius that are tried at most; with more (a radius over 2) there are levels by vantage points only.
MOST_VALUES = 256
THIRDS = ((0, 21), (21, 42), (42, 64))


def shingle_hashes(raw: bytes, n: int, hash_=xxhash.xxh64_intdigest) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles of a text, A-Z lower-cased; with fewer words, of the whole sequence."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([hash_(b" ".join(words), 42)], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-n]].tolist()
    return np.fromiter((hash_(text[s:e], 42) for s, e in zip(starts, (ends[n - 1 :] - 1).tolist())), np.uint64, len(starts))


def norm_hash(raw: bytes) -> int:
    """XXH3 of a text's words, A-Z lower-cased: the name of all texts of these words."""
    return xxhash.xxh3_64_intdigest(b" ".join(raw.lower().split()))


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of counts[i] hashes: bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)
    first = np.r_[0, np.cumsum(counts[full])[:-1]]
    piece_of = np.repeat(np.arange(len(full)), pieces)
    at = np.r_[0, np.cumsum(pieces)[:-1]]
    starts = first[piece_of] + 255 * (np.arange(len(piece_of)) - at[piece_of])
    for j in range(8):
        # eight counters of at most 255 in the bytes of one sum
        sums = np.add.reduceat((hashes >> np.uint64(j)) & np.uint64(0x0101010101010101), starts)
        totals = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), at)
        over = 2 * totals > counts[full][:, None]
        out[full] |= (over.astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(j))).sum(1, dtype=np.uint64)
    return out


def fingerprints(df: DataFrame, n: int, words: int = 1, key: str = "doc_id", text: str = "text", distinct: bool = False) -> DataFrame:
    """key, norm (XXH64 of all words), n_words and the fingerprint f0.. of 64 * words bits. Null and blank texts: all zero. distinct: a repeated shingle counts once."""
    names = [f"f{i}" for i in range(words)]
    src = df.select(F.col(key), F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            data, off = utf8(b["_text"])
            out: list[list[np.ndarray]] = [[] for _ in range(words + 1)]
            for i, j in slices(off):
                raws = [data[off[k] : off[k + 1]].tobytes() for k in range(i, j)]
                found = [np.unique(shingle_hashes(r, n)) if distinct else shingle_hashes(r, n) for r in raws]
                counts = np.array([len(x) for x in found], np.int64)
                h = np.concatenate(found)
                out[0].append(np.fromiter(map(norm_hash, raws), np.uint64, len(raws)))
                for w in range(words):
                    out[w + 1].append(majority_bits(h if w == 0 else mix64(h + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), counts))
            cols = [np.concatenate(c).view(np.int64) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([b[key], *map(pa.array, cols)], [key, "norm", *names])

    return src.mapInArrow(lean(run), src.select(key, F.lit(0).cast("long").alias("norm"), *(F.lit(0).cast("long").alias(x) for x in names)).schema)


class Blocks:
    """The disjoint bit blocks of a fingerprint of several words, their vantage points, and their radius."""

    def __init__(self, words: int, radius: int, block_radius: int | None = None, compared: int | None = None):
        #: compared: so many words, the first, are within the radius together
        self.words, self.radius, self.compared = words, radius, words if compared is None else compared
        self.blocks = [(w, np.uint64(((1 << e) - (1 << s)) & 0xFFFFFFFFFFFFFFFF), e - s) for w in range(words) for s, e in THIRDS]
        self.block_radius = radius // len(self.blocks) if block_radius is None else block_radius
        self.most_levels = MOST_LEVELS if all(sum(math.comb(x, k) for k in range(self.block_radius + 1)) <= MOST_VALUES for _, _, x in self.blocks) else TREE_LEVELS

    def vantage(self, block: int, level: int) -> np.uint64:
        w, mask, _ = self.blocks[block]
        return mix64(np.array([1 + block * 1000 + level], np.uint64))[0] & mask

    def distance(self, f: list[np.ndarray], block: int, point: np.uint64) -> np.ndarray:
        w, mask, _ = self.blocks[block]
        return np.bitwise_count((f[w] ^ point) & mask).astype(np.int32)

    def route(self, f: list[np.ndarray], block: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home) of every shard that a fingerprint lives in or must visit."""
        if levels > TREE_LEVELS:
            return self.route_values(f, block, levels)
        row, code = np.arange(len(f[0])), np.zeros(len(f[0]), np.int64)
        home = np.zeros(len(row), np.int64)
        middle = self.blocks[block][2] // 2
        for level in range(levels):
            d = self.distance(f, block, self.vantage(block, level))
            home = home * 2 + (d > middle)
            x = d[row]
            left, right = x <= middle + self.block_radius, x > middle - self.block_radius
            row, code = np.r_[row[left], row[right]], np.r_[code[left] * 2, code[right] * 2 + 1]
        keep = code >= home[row]
        return row[keep], code[keep], code[keep] == home[row[keep]]

    def shard(self, value: np.ndarray, block: int, levels: int) -> np.ndarray:
        """Where a value of the block lives: sides of the vantage points, then bits."""
        _, _, width = self.blocks[block]
        first = THIRDS[block % len(THIRDS)][0]
        code = np.zeros(len(value), np.int64)
        for level in range(TREE_LEVELS):
            code = code * 2 + (np.bitwise_count(value ^ self.vantage(block, level)) > width // 2)
        for bit in range(levels - TREE_LEVELS):
            code = code * 2 + ((value >> np.uint64(first + bit)) & np.uint64(1)).astype(np.int64)
        return code

    def route_values(self, f: list[np.ndarray], block: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the values within the block's radius: two fingerprints meet where the later of their two shards is."""
        w, mask, width = self.blocks[block]
        first = THIRDS[block % len(THIRDS)][0]
        value = f[w] & mask
        home = self.shard(value, block, levels)
        away = [np.zeros(0, np.int64)]
        for k in range(1, self.block_radius + 1):
            for bits in itertools.combinations(range(first, first + width), k):
                code = self.shard(value ^ np.uint64(sum(1 << b for b in bits)), block, levels)
                later = np.flatnonzero(code > home)
                away.append((later << levels) + code[later])
        away = np.unique(np.concatenate(away))
        row = np.r_[np.arange(len(value)), away >> levels]
        return row, np.r_[home, away & ((1 << levels) - 1)], np.arange(len(row)) < len(value)


def light_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Links of a minimum spanning forest, by Boruvka's rounds."""
    order = np.lexsort((b, a, d))
    a, b = a[order], b[order]
    label, kept = np.arange(n), []
    alive = np.arange(len(a))
    while True:
        alive = alive[label[a[alive]] != label[b[alive]]]
        if not len(alive):
            break
        best = np.full(n, len(a), np.int64)
        np.minimum.at(best, label[a[alive]], alive)
        np.minimum.at(best, label[b[alive]], alive)
        chosen = np.unique(best[best < len(a)])
        kept.append(chosen)
        joined = union_find(label[a[chosen]], label[b[chosen]], n)
        label = joined[label]
    return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)


class Search:
    """Near pairs of a shard between those that live in it, and between them and its visitors."""

    LEAF = 1 << 16

    def __init__(self, blocks: Blocks, block: int, f: list[np.ndarray], home: np.ndarray):
        self.blocks, self.block, self.f, self.home = blocks, block, f, home
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def pairs(self, living: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.split(living, asking, 0)
        self.thin()
        return self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),)

    def split(self, living: np.ndarray, asking: np.ndarray, depth: int) -> None:
        if not len(living) or not len(asking):
            return
        if len(living) * len(asking) <= self.LEAF or depth > 24:
            return self.compare(living, asking)
        r = self.blocks.block_radius
        w, mask, _ = self.blocks.blocks[self.block]
        point = self.f[w][living[int(mix64(np.array([depth * 7919 + len(living)], np.uint64))[0] % np.uint64(len(living)))]] & mask
        d = np.bitwise_count((self.f[w][living] ^ point) & mask).astype(np.int32)
        q = np.bitwise_count((self.f[w][asking] ^ point) & mask).astype(np.int32)
        middle = int(np.median(d))
        inside = d <= middle
        if inside.all():
            middle -= 1
            inside = d <= middle
        if not inside.any():
            return self.compare(living, asking)
        self.split(living[inside], asking[q <= middle + r], depth + 1)
        self.split(living[~inside], asking[q > middle - r], depth + 1)

    def compare(self, living: np.ndarray, asking: np.ndarray) -> None:
        w, mask, _ = self.blocks.blocks[self.block]
        step = max(1, self.LEAF // len(living))
        for s in range(0, len(asking), step):
            some = asking[s : s + step]
            near = np.bitwise_count((self.f[w][some][:, None] ^ self.f[w][living][None, :]) & mask) <= self.blocks.block_radius
            i, j = np.nonzero(near)
            a, b = some[i], living[j]
            # a pair of two that live here is met twice
            keep = (a != b) & (~self.home[a] | (a < b))
            a, b = a[keep], b[keep]
            d = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int32) for x in self.f[: self.blocks.compared])
            keep = d <= self.blocks.radius
            if keep.any():
                self.parts.append((a[keep], b[keep], d[keep]))
                self.held += int(keep.sum())
                if self.held > 2_000_000:
                    self.thin()

    def thin(self) -> None:
        if self.parts:
            a, b, d = (np.concatenate(x) for x in zip(*self.parts))
            keep = light_forest(a, b, d, len(self.home))
            self.parts = [(a[keep], b[keep], d[keep])]
            self.held = len(keep)


def near_links(df: DataFrame, radius: int, words: int = 1, id_: str = "id", block_radius: int | None = None, compared: int | None = None) -> DataFrame:
    """a, b, distance: a spanning forest, in each shard, of the pairs of rows within `radius` bits. df: distinct fingerprints f0.. with an id (long).

    block_radius None: every pair is found. Else pairs are found that differ by at most so many bits in one of the blocks.
    compared: the radius holds for the first so many words; those after it only give further blocks, so a shard gets just the one that its block lies in.
    """
    spark = df.sparkSession
    blocks = Blocks(words, radius, block_radius, compared)
    compared = blocks.compared
    names = [f"f{i}" for i in range(words)]
    df = checkpoint(df.select(F.col(id_).cast("long").alias("id"), *names))
    levels = min(blocks.most_levels, max(0, math.ceil(math.log2(max(1, df.count()) / SHARD))))
    extra = int(words > compared)
    kinds = [np.int64, *[np.uint64] * (compared + extra), np.uint8]
    hot_of: dict[int, int] = {}

    def shards(batches):
        for x in batches:
            f = [x[c].to_numpy().view(np.uint64) for c in names]
            ids = x["id"].to_numpy()
            for block in range(len(blocks.blocks)):
                row, code, home = blocks.route(f, block, levels)
                w = blocks.blocks[block][0]
                own = [f[w] if w >= compared else np.zeros_like(f[w])] if extra else []
                yield row, (block << levels) + code, home, [*f[:compared], *own], ids

    def counted(batches):
        for _, shard, home, _, _ in shards(batches):
            full, n = np.unique(shard[home], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n)], ["bucket", "n"])

    # shards over HOT_SHARD only: their number is at most that of the fingerprints over HOT_SHARD
    for r in df.mapInArrow(lean(counted), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_SHARD).collect():
        hot_of[r["bucket"]] = -(-r["n"] // HOT_SHARD)
    n_shards = len(blocks.blocks) << levels
    base, at = {}, n_shards
    for s, n in sorted(hot_of.items()):
        base[s] = at
        at += n
    owner = {base[s] + k: s for s, n in hot_of.items() for k in range(n)}
    hot = np.array(sorted(hot_of), np.int64)

    def dealt(batches):
        for row, shard, home, f, ids in shards(batches):
            salt = (mix64(f[0][row]) >> np.uint64(40)).astype(np.uint32)
            bucket, asks = shard.copy(), np.full(len(row), 2, np.uint8)
            parts = []
            for s in np.intersect1d(shard, hot).tolist():
                own, n = np.flatnonzero(shard == s), hot_of[s]
                bucket[own] = -1
                for k in range(n):
                    # those that live here go to every part; each asks in one part only
                    take = own[home[own] | (salt[own] % n == k)]
                    parts.append((take, np.full(len(take), base[s] + k), (salt[take] % n == k).astype(np.uint8) * 2))
            plain = np.flatnonzero(bucket >= 0)
            parts.append((plain, bucket[plain], asks[plain]))
            take, to, asks = (np.concatenate(x) for x in zip(*parts))
            if len(take):
                yield pack(to, [ids[row[take]], *(x[row[take]] for x in f), (home[take] | asks).astype(np.uint8)])

    def search(batches):
        for bucket, (ids, *f, flags) in packed_groups(batches, kinds):
            home, asks = (flags & 1) == 1, (flags & 2) == 2
            order = np.argsort(ids, kind="stable")
            ids, home, asks, f = ids[order], home[order], asks[order], [x[order] for x in f]
            block = owner.get(bucket, bucket) >> levels
            f += [f[-1]] * (words - len(f))
            s = Search(blocks, block, f, home)
            a, b, d = s.pairs(np.flatnonzero(home), np.flatnonzero(asks))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(d.astype(np.int32))], ["a", "b", "distance"])

    packed = df.repartition(max(1, min(partitions(spark), 1 + n_shards // 2))).mapInArrow(lean(dealt), PACKED)
    return deal(packed, tasks(spark, n_shards)).mapInArrow(lean(search), "a long, b long, distance int")


def near_duplicates(df: DataFrame, n: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits), component_id: the least key among all reachable over fingerprints within `radius` bits.

    Null and blank texts have the fingerprint zero and are linked like others. Repeated rows stay; a null key is in its component, but its id is the least key that isn't null.
    """
    docs = checkpoint(fingerprints(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), n, 1, "_key", "_text").select("_key", "f0"))
    least = checkpoint(docs.groupBy("f0").agg(F.min("_key").alias("_least")))
    links = near_links(least.select(F.col("f0").alias("id"), "f0"), radius)
    found = checkpoint(connected_components(links, thin=False))
    members = found.join(least, F.col("node") == F.col("f0")).select("f0", "_least", "component")
    roots = members.groupBy("component").agg(F.min("_least").alias("_all"))
    linked = join_components(members, roots, "component").select("f0", "_all")
    by_print = least.join(linked, "f0", "left").select("f0", F.coalesce("_all", "_least").alias("component_id"))
    return docs.join(by_print, "f0").select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias(free("fingerprint", [key])), F.col("component_id").alias(free("component_id", [key])))


#: For copies by resemblance: links up to 36 differing bits of 128, with at most 1 in one of 36 blocks of 768 bits. At a
#: Jaccard resemblance of 0.8 a bit differs with probability 0.15, so 19 of 128 bits differ on average (deviation 4); of
#: unrelated texts 64 (deviation 6).
WIDE_WORDS, WIDE_COMPARED, WIDE_RADIUS, WIDE_BLOCK_RADIUS = 12, 2, 36, 1
#: Bytes of texts, one being taken for 1000, in a bucket of groups whose pieces are compared again.
PIECE_BYTES = 4 << 20


def resembling(df: DataFrame, n: int = 5, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and component_id (least key) of documents that have a link: a Jaccard resemblance of n-word shingles of at least `least`.

    Candidates are links of wide fingerprints of the distinct shingles, first of forests only; each is checked on the
    texts. Where checks fail and leave a forest in pieces, all pairs within the radius between the pieces are checked too, since
    a forest may lack a pair that would pass. The search is not
    exact: of pairs at a resemblance of just 0.8 it finds 99.5 % to 99.97 % (3,000 pairs of
    random sets each of 9, 18, 45, 90, 225, 450 and 900 shingles), of closer ones more.

    The nodes are texts, by a 64-bit hash of their words: texts of equal words, blank and null ones too, are one node.
    Rows that share a key are one document, which links what any of its texts resembles. One row for each such document;
    those without a link have none. Null keys are not linked. Texts of any length are hashed whole. Other columns don't pass.
    """
    own_name, key = key, "_key"
    df = df.where(F.col(own_name).isNotNull()).select(F.col(own_name).cast("long").alias(key), F.col(text).alias("_text"))
    text = "_text"
    docs = checkpoint(fingerprints(df, n, WIDE_WORDS, key, text, distinct=True))
    names = [f"f{i}" for i in range(WIDE_WORDS)]
    unique = checkpoint(docs.select("norm", *names).dropDuplicates(["norm"]))
    links = checkpoint(near_links(unique, WIDE_RADIUS, WIDE_WORDS, "norm", WIDE_BLOCK_RADIUS, WIDE_COMPARED).select("a", "b").distinct())
    ends = links.select(F.explode(F.array("a", "b")).alias("norm")).distinct()
    texts = checkpoint(texts_of(df, docs, ends, key, text))
    both = links.join(texts.select(F.col("norm").alias("a"), F.col("_z").alias("_za")), "a").join(texts.select(F.col("norm").alias("b"), F.col("_z").alias("_zb")), "b")

    def verified(batches):
        d = zstandard.ZstdDecompressor()
        for x in batches:
            keep = [alike(*(np.unique(shingle_hashes(d.decompress(z.as_py()), n)) for z in pair), least) for pair in zip(x["_za"], x["_zb"])]
            yield pa.RecordBatch.from_arrays([x["a"].filter(pa.array(keep, pa.bool_())), x["b"].filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    sure = checkpoint(both.select("a", "b", "_za", "_zb").mapInArrow(lean(verified), "a long, b long"))
    more = links_between_pieces(links, sure, texts.join(unique.select("norm", *names[:WIDE_COMPARED]), "norm"), n, least)
    # texts of one document belong together
    several = docs.groupBy(key).agg(F.min("norm").alias("_low"), F.max("norm").alias("_high")).where("_low < _high")
    same = docs.select(key, "norm").join(several, key).where("norm > _low").select(F.col("norm").alias("a"), F.col("_low").alias("b"))
    found = connected_components(sure.unionByName(more).unionByName(same), thin=False)
    rows = docs.select(key, "norm").join(found, F.col("norm") == F.col("node"), "left").select(key, F.coalesce("component", "norm").alias("component"))
    groups = rows.groupBy("component").agg(F.min(key).alias("component_id"), F.max(key).alias("_last")).where("component_id < _last").drop("_last")
    return join_components(rows.distinct(), groups, "component").select(F.col(key).alias(own_name), F.col("component_id").alias(free("component_id", [own_name])))


def texts_of(df: DataFrame, docs: DataFrame, ends: DataFrame, key: str, text: str) -> DataFrame:
    """norm and _z, the compressed text of one row of each of the wanted norms. Only rows whose key may be wanted travel."""
    keys = checkpoint(docs.select(key, "norm").join(ends, "norm").groupBy("norm").agg(F.min(key).alias(key)).select(key).distinct())
    may_be_wanted = membership(keys, key, keys.count())
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))

    def run(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            b = b.filter(pa.array(may_be_wanted(b["_key"].to_numpy())))
            data, off = utf8(b["_text"])
            raws = [data[s:e].tobytes() for s, e in zip(off, off[1:])]
            norm = np.fromiter((norm_hash(r) for r in raws), np.uint64, len(raws)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(norm), pa.array([c.compress(r) for r in raws], pa.binary())], ["_key", "norm", "_z"])

    found = src.mapInArrow(lean(run), "_key long, norm long, _z binary")
    return found.join(keys.withColumnRenamed(key, "_key"), "_key", "left_semi").join(ends, "norm", "left_semi").select("norm", "_z").dropDuplicates(["norm"])


def alike(s: np.ndarray, t: np.ndarray, least: float) -> bool:
    """Whether two sets of hashes, each sorted, have a Jaccard resemblance of at least `least`."""
    if min(len(s), len(t)) < least * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    union = len(s) + len(t) - both
    return union > 0 and both >= least * union


def links_between_pieces(links: DataFrame, sure: DataFrame, texts: DataFrame, n: int, least: float) -> DataFrame:
    """a, b: verified links, by texts, of members of a group of links that sure links leave in different pieces. texts: norm, _z, f0.."""
    groups = connected_components(links, thin=False).select(F.col("node").alias("norm"), F.col("component").alias("_group"))
    pieces = connected_components(sure, thin=False).select(F.col("node").alias("norm"), F.col("component").alias("_piece"))
    sets = checkpoint(sets_between_pieces(groups.join(pieces, "norm", "left").withColumn("_piece", F.coalesce("_piece", "norm")), "norm"))
    n_buckets = int(min(1 << 30, 1 + sets.count() * 1000 // PIECE_BYTES))
    rows = sets.withColumn("bucket", F.pmod(F.xxhash64("set"), F.lit(n_buckets)).cast("int")).join(texts, "norm")
    names = [f"f{i}" for i in range(WIDE_COMPARED)]

    def search(batches):
        for ids, piece, f, z in runs_of(batches, "set", "norm", names):
            a, b = links_of_set(ids, piece, f, z, n, least)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.select("bucket", "set", "norm", "_piece", "_z", *names).repartition(tasks(links.sparkSession, n_buckets), "bucket").sortWithinPartitions("bucket", "set", "norm")
    return rows.mapInArrow(lean(search), "a long, b long")


def runs_of(batches, set_: str, key: str, names: list[str]):
    """Ids, pieces, fingerprints and compressed texts of each run of equal sets; one is held at a time."""
    at, parts = None, []

    def whole():
        ids, piece, *f = (np.concatenate(c) for c in zip(*(p[:-1] for p in parts)))
        return ids, piece, f, [z for p in parts for z in p[-1]]

    for x in batches:
        own = x[set_].to_numpy()
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
        for s, e in zip(cuts, np.r_[cuts[1:], len(own)]):
            if own[s] != at and parts:
                yield whole()
                parts = []
            at = own[s]
            part = x.slice(s, e - s)
            parts.append((part[key].to_numpy(), part["_piece"].to_numpy(), *(part[c].to_numpy().view(np.uint64) for c in names), part["_z"].to_pylist()))
    if parts:
        yield whole()


def links_of_set(ids: np.ndarray, piece: np.ndarray, f: list[np.ndarray], z: list[bytes], n: int, least: float) -> tuple[list[int], list[int]]:
    """Links that join the pieces of a set as far as any two documents within the radius resemble each other."""
    _, label = np.unique(piece, return_inverse=True)
    d, hashed, a, b = zstandard.ZstdDecompressor(), {}, [], []

    def shingles(i: int) -> np.ndarray:
        if i not in hashed:
            hashed[i] = np.unique(shingle_hashes(d.decompress(z[i]), n))
        return hashed[i]

    for i in range(1, len(ids)):
        apart = sum(np.bitwise_count(x[:i] ^ x[i]).astype(np.int32) for x in f)
        near = np.flatnonzero((apart <= WIDE_RADIUS) & (label[:i] != label[i]))
        for j in near[np.argsort(apart[near], kind="stable")].tolist():
            if label[i] != label[j] and alike(shingles(i), shingles(j), least):
                a.append(int(ids[i]))
                b.append(int(ids[j]))
                label[label == label[j]] = label[i]
    return a, b
