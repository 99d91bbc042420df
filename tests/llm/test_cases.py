"""Cases of single operators: ties, empty tables, clashing columns, repeated keys, legal packets, recall, verdicts, against independent loops."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logspark.llm import chat, lines, mixing, mpegts, queries, repetition, simhash, warc
from logspark.llm.common import shared_dir
from logspark.llm.components import union_find


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_turns_that_tie_are_ordered_by_role_and_text(spark):
    rng = random.Random(1)
    said = [(1, 0, "user", "a!"), (1, 0, "user", "a"), (1, 0, "user", "<|a"), (1, 0, "user", "<a"), (1, 0, "u\\", "x"), (1, 0, "u\n", "x")]
    said += [(2 + k % 20, k % 3 if k % 7 else None, "".join(rng.choice("<|\\n\nu") for _ in range(rng.randint(0, 5))), "".join(rng.choice("<|\\a>né\n!~") for _ in range(rng.randint(0, 9)))) for k in range(600)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(5).withColumn("parts", chat.text_part(F.col("text")))
    got = {r.conv_id: r.turns_sha256 for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv in got:
        own = sorted(((t is None, t or 0, r.encode(), x.encode()) for c, t, r, x in said if c == conv))
        assert got[conv] == hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, _, r, x in own)).hexdigest()


def test_empty_archives(spark):
    folder = shared_dir(spark, "test-warc")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(none, folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0


def test_long_payloads_pass_archives(spark):
    folder = shared_dir(spark, "test-warc")
    rows = [(1, None, "é" * 3_000_000), (2, "u", None), (3, "u", "é" * 3_000_000)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, archive_bytes=1 << 20)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, folder).drop("payload").collect()}
    assert got == {1: ("revisit", 3, 6_000_000), 2: ("response", None, 0), 3: ("response", None, 6_000_000)}


def test_lines_of_a_table_with_clashing_columns(spark):
    rows = [(1, "one long line of words\nother line of this text", "x", 5), (2, "one long line of words\nsomething else, long enough", None, 6), (3, None, "y", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, line int")
    out = {r.doc_id: (r.text, r.removed, r.line) for r in lines.drop_lines(df, lines.repeated_lines(df)).collect()}
    assert out == {1: (rows[0][1], "x", 5), 2: ("something else, long enough", None, 6)}


def test_legal_packets():
    stream = mpegts.write_stream(b"x" * 9000)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    bare = bytes([0x47, 0x01, 0x00, 0x20 | packets[4][3] & 15, 183, 0]) + b"\xff" * 182
    clock = bytearray(packets[2])
    clock[7] ^= 1
    for good in (packets[:5] + [bare] + packets[5:], packets[:5] + packets[4:], packets[:3] + [bytes(clock)] + packets[3:], packets[:3] + [bytes(clock)] + packets[3:5] + [bare] * 3 + packets[5:]):
        got = mpegts.read_stream(b"".join(good))
        assert got.payload == b"x" * 9000 and got.access == [(0, 376)]
    wrong = bare[:3] + bytes([bare[3] ^ 1]) + bare[4:]
    for bad in (packets[:5] + [packets[4]] * 2 + packets[5:], packets[:5] + [wrong] + packets[5:], packets[:4] + packets[5:], packets[:4] + [packets[4][:100] + b"y" * 88] + packets[4:]):
        with pytest.raises(mpegts.BadStream):
            mpegts.read_stream(b"".join(bad))


def test_targets_are_water_filled(spark):
    """Targets against a loop that reshapes shares one source at a time."""
    rng = random.Random(6)
    rows = [(k, words(rng, rng.randint(0, 60)), rng.choice(["a", "b", "c", "d", "d", "d", "d", None])) for k in range(300)]
    rows += [(1000, words(rng, 5), "e"), (1001, "", "f"), (1002, None, "g"), (5, words(rng, 9), "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    source = {}
    for r in got:
        assert r.source_size in sizes.values() and 0 <= r.taken <= 2 * r["size"]
        source.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert set(source) == {(sizes[s], round(target[s], 6)) for s in sizes}


def test_fingerprints_by_a_plain_loop():
    rng = random.Random(7)
    for text in ["", "  ", "One", "a B c", "a b c d", "É é A", *(words(rng, rng.randint(4, 700), 50) for _ in range(20))]:
        w = text.translate({c: c + 32 for c in range(65, 91)}).split()
        grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        own = simhash.shingle_hashes(text.encode(), 4)
        assert int(simhash.majority_bits(own, np.array([len(own)]))[0]) == want


def test_rows_that_share_a_key_are_one_document(spark):
    rng = random.Random(9)
    a, b, c = (words(rng, 80, 10**6) for _ in range(3))
    for order in ([(1, a), (2, b), (2, a.replace(" w1", " v", 1)), (3, c), (3, c), (4, b)], [(2, a.replace(" w1", " v", 1)), (4, b), (3, c), (2, b), (1, a), (3, c)]):
        got = {r.doc_id: r.component_id for r in simhash.resembling(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert got == {1: 1, 2: 1, 4: 1}


def kept_by_loop(text):
    """The verdict from the definition: repeats by comparing all pairs of places."""
    w = (text or "").split()
    n, longest = len(w), [0] * len(w)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    window = {i + k for i in range(n) if longest[i] >= 3 for k in range(3)}
    covered = {i + k for i in range(n) if longest[i] >= 8 for k in range(longest[i])}
    most = max(longest, default=0)
    base = n < 50 or 100 * len(window) > 50 * n
    return base, not base and 100 * len(covered) <= 20 * n and not (most > 12 and 100 * most > 15 * n), len(covered), most


def test_verdicts_by_a_loop(spark):
    rng = random.Random(12)
    texts = [None, "", words(rng, 49)]
    for _ in range(60):
        t = words(rng, rng.randint(50, 110), 500).split()
        size = rng.randint(5, 25)
        at = rng.randrange(len(t) - size)
        texts.append(" ".join(t[: at + size] + t[at:] if rng.random() < 0.8 else t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept, r.covered_words, r.longest_repeat) for r in repetition.verdict(repetition.measure(df)).collect()}
    assert got == {k: kept_by_loop(t) for k, t in enumerate(texts)}
    assert {(b, k) for b, k, _, _ in got.values()} == {(True, False), (False, True), (False, False)}


def test_a_long_text_is_measured_whole(spark):
    rng = random.Random(13)
    t = words(rng, 300_000, 10**9)
    df = spark.createDataFrame([(1, t + " " + t[: len(t) // 2]), (2, t)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.kept) for r in repetition.verdict(repetition.measure(df)).collect()}
    assert got[1][0] >= 449_000 and got[1][1] is False and got[2] == (300_000, True)


def pairs_of_lines(rng, n):
    """Pairs of lines of 16 to 200 characters at a resemblance from 0.8 to 0.85."""
    letters = "abcdefghijklmnopqrstuvwxyz ,.éß"
    while n:
        a = "".join(rng.choice(letters) for _ in range(rng.randint(16, 200)))
        b = list(a)
        for _ in range(rng.randint(1, 5)):
            b[rng.randrange(len(b))] = rng.choice(letters)
        s, t = ({x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in (a, "".join(b)))
        if 0.8 <= len(s & t) / len(s | t) <= 0.85:
            n -= 1
            yield a, "".join(b)


def test_recall_of_line_candidates():
    """Of pairs near the least resemblance, those that share a key and whose sketches agree."""
    a, b = zip(*pairs_of_lines(random.Random(14), 3000))
    s, t = (lines.signatures([x.encode() for x in side], 5, lines.BANDS * lines.ROWS) for side in (a, b))
    meet = (lines.band_keys(s, lines.BANDS, lines.ROWS) == lines.band_keys(t, lines.BANDS, lines.ROWS)).any(1)
    agree = 32 - np.bitwise_count(lines.sketches(s) ^ lines.sketches(t)) >= lines.AGREEING
    assert (meet & agree).mean() >= 0.985
    assert agree.mean() >= 0.999


def test_one_key_with_many_lines(spark, monkeypatch):
    """Lines of one template and strangers that share a key with them: as all pairs one by one."""
    monkeypatch.setattr(lines, "BLOCK", 40)
    monkeypatch.setattr(lines, "HUB", 10)
    # one band of one bin: keys that hundreds of lines share
    rng = random.Random(15)
    own = [f"page {k} of the report that everyone has to read, with figures" for k in range(150)] + ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    got = {r.doc for r in lines.repeated_lines(df, bands=1, rows=1).where(F.size("removed") > 0).collect()}
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in own]
    s = lines.signatures([x.encode() for x in own], 5, 1)
    sketch = lines.sketches(s)
    links = [(a, b) for a in range(len(own)) for b in range(a) if s[a] == s[b] and (int(sketch[a]) ^ int(sketch[b])).bit_count() <= 10 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = union_find(np.array([a for a, _ in links]), np.array([b for _, b in links]), len(own))
    assert got == {k for k in range(len(own)) if root[k] != k}


def test_pipeline_with_nulls_ties_and_no_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = words(rng, 150, 100_000)
    rows = [(1, clean, "en", "a", 1), (1, clean, "en", "a", 1), (None, words(rng, 150, 100_000), None, None, None), (2, None, "en", "b", 0), (3, "", None, "b", 0), (4, words(rng, 150, 100_000), "en", None, 3), (5, clean, "en", "c", 1)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in out} <= {1, 4, None} and bool(out) == bool(data)


def test_token_counts_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    none.write.parquet(f"{(folder := shared_dir(spark, 'empty'))}/documents.parquet")
    assert queries.op10_separator_scan(spark, folder).count() == 0


@pytest.mark.parametrize("name", ["f0", "norm", "fingerprint", "component_id", "_text"])
def test_near_duplicates_by_keys_of_any_name(spark, name):
    rows = [(1, "a b c d e f"), (2, "x y z x y z"), (3, "A b c d e f")]
    df = spark.createDataFrame(rows, f"{name} long, words string")
    first = {r[0]: r[2] for r in simhash.near_duplicates(df, key=name, text="words").collect()}
    assert first == {1: 1, 2: 2, 3: 1}
    assert {r[0]: r[1] for r in simhash.resembling(df, key=name, text="words").collect()} == {1: 1, 3: 1}


@pytest.mark.parametrize("name", ["size", "taken", "mass", "_row"])
def test_mixing_by_keys_of_any_name(spark, name):
    rows = [(k, "one two three " * (1 + k % 5), "ab"[k % 2]) for k in range(40)]
    want = sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()))
    got = mixing.mix(spark.createDataFrame(rows, f"{name} long, text string, source string"), key=name)
    assert sorted(map(tuple, got.collect())) == want and len(set(got.columns)) == len(got.columns)


def test_dropped_lines_beside_columns_of_inner_names(spark):
    rows = [(1, "one long line of words\nother line of this text", "x", 5), (2, "one long line of words\nsomething else, long enough", None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _removed int")
    out = {r.doc_id: (r.text, r._doc, r._removed) for r in lines.drop_lines(df, lines.repeated_lines(df)).collect()}
    assert out == {1: (rows[0][1], "x", 5), 2: ("something else, long enough", None, 6)}


def test_no_temporary_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(), "x")


@pytest.mark.parametrize("levels", [0, 3, 5, 9, 17])
@pytest.mark.parametrize("radius", [1, 4, 7])
def test_shards_meet_all_near_pairs(levels, radius):
    """Every pair within the radius, of which a block differs by its radius at most, lives or visits in one shard, and few are visited."""
    rng = np.random.default_rng(levels * 10 + radius)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 400)].copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(0, radius + 2), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    f = np.unique(np.r_[base, near])
    want = set(zip(*np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius, 1))))
    blocks, got = simhash.Blocks(1, radius), set()
    for block in range(3):
        row, code, home = blocks.route([f], block, levels)
        assert len(set(zip(row.tolist(), code.tolist()))) == len(row) and code.max() < 1 << levels
        assert (np.sort(row[home]) == np.arange(len(f))).all()
        if levels > simhash.TREE_LEVELS and blocks.block_radius == 1:
            assert np.bincount(row).max() <= 23 and len(row) <= 11 * len(f)
        for s in np.unique(code):
            r, own = row[code == s], home[code == s]
            x, y, _ = simhash.Search(blocks, block, [f[r]], own).pairs(np.flatnonzero(own), np.arange(len(r)))
            got |= {(min(a, b), max(a, b)) for a, b in zip(r[x], r[y])}
    a, b = np.array(sorted(want)).T
    x, y = np.array(sorted(got)).T
    assert got <= want and (union_find(a, b, len(f)) == union_find(x, y, len(f))).all()


def test_near_duplicates_over_many_shards(spark, monkeypatch):
    """Small and hot shards, deep levels: the same components as in one shard."""
    rng = random.Random(21)
    bases = [words(rng, 60) for _ in range(40)]
    rows = []
    for k in range(900):
        t = rng.choice(bases).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            t[rng.randrange(len(t))] = f"e{rng.randrange(50)}"
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    monkeypatch.setattr(simhash, "SHARD", 4)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == want
    monkeypatch.setattr(simhash, "HOT_SHARD", 8)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert len({c for _, _, c in want}) < 0.9 * len(want)


def test_near_duplicates_of_queries_against_all(spark):
    """Ids divisible by 50 against every row of a table, by exact Jaccard."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.component_id for r in simhash.resembling(df).collect()}
    sets = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in df.collect()}
    pairs = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    missed = [(a, b) for a, b in pairs if a not in found or found[a] != found.get(b)]
    assert len(missed) <= 0.01 * len(pairs), missed


def test_very_long_texts(spark):
    """A text of 3 MB beside short ones: fingerprints, and turns of a conversation."""
    rng = random.Random(4)
    long = words(rng, 500_000, 10**6)
    df = spark.createDataFrame([(1, long), (2, "short"), (3, long + " end"), (4, None)], "doc_id long, text string")
    h = simhash.shingle_hashes(long.encode(), 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert got[1].fingerprint == f"{int(simhash.majority_bits(h, np.array([len(h)]))[0]):016x}" and got[3].component_id == 1
    turns = df.select(F.lit(7).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), chat.text_part(F.col("text")).alias("parts"))
    r = chat.read_back(chat.format_turns(turns)).first()
    texts = [long, "short", long + " end", ""]
    assert (r.n_turns, r.loss_chars) == (4, sum(map(len, texts)))
    assert r.loss_sha256 == hashlib.sha256("".join(texts).encode()).hexdigest()


@pytest.mark.parametrize("most, hot", [(200_000, 100_000), (0, 3), (0, 10**6)])
def test_repeated_payloads_by_broadcast_and_by_id(spark, monkeypatch, most, hot):
    """A hot payload, ids that tie or are null: the same records whichever join finds them."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(30)]), rng.choice(["u", "v", None]), rng.choice(["", None, "x", "hot", "hot", "hot", f"y{k % 20}"])) for k in range(300)]
    last = {}
    for i, _, p in rows:
        last[p or ""] = max(last.get(p or "", -1), -1 if i is None else i)
    n = {p: sum((q or "") == p for _, _, q in rows) for p in last}
    folder = shared_dir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), folder)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read_archives(spark, folder).collect())
    want = []
    for i, _, p in rows:
        own = last[p or ""]
        revisit = n[p or ""] > 1 and own >= 0 and own != (-1 if i is None else i)
        want.append((i is None, i or 0, len(p or ""), "revisit" if revisit else "response", own if revisit else 0))
    assert got == sorted(want)
