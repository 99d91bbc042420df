"""Operators on small tables with nulls, empty and long texts, repeated rows, and clashing columns, against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from logspark.llm import bpe, chat, components, lines, mixing, mpegts, queries, repetition, separators, simhash, substrings, warc
from logspark.llm.common import shared_dir
from logspark.llm.components import connected_components, union_find

SCHEMA = "doc_id long, text string, source string, n_words long, size int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(0, None, "b", 1, 1), (1, "", "a", 1, 1), (2, " \n\t ", None, 1, 1), (3, words(rng, 6000), "a", 1, 1)]
    bases = [words(rng, 120) for _ in range(6)]
    for k in range(60):
        t = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            t[rng.randrange(len(t))] = "edit%d" % rng.randrange(99)
        text = " ".join(t)
        out.append((10 + k, "\n".join(text[i : i + 90] for i in range(0, len(text), 90)), rng.choice(["a", "b", "c", None]), 1, 1))
    out += [(100 + k, words(rng, rng.randrange(1, 200)) + "\n" + "common line of everyone, long enough", "c", 1, 1) for k in range(30)]
    return out + [out[20], out[20]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(2)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3)] + [(1000, 1000 + k) for k in range(1, 50)] + [(2000 + k, 2001 + k) for k in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    ok = [(a, b) for a, b in e if a is not None and a != b]
    root = union_find(np.array([a for a, _ in ok]), np.array([b for _, b in ok]), 3000)
    assert got == {n: int(root[n]) for x in ok for n in x}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, docs, rows, none):
    out = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in out) == sorted((r[0], len((r[1] or "").split())) for r in rows)
    by = {}
    for r in out:
        by.setdefault((r.target, r.source_size), []).append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    for (target, size), own in by.items():
        assert target <= 2 * size + 1e-9
        assert abs(sum(r.taken for r in own) - target) <= 0.1 * size
    total = sum(r["size"] for r in out)
    assert abs(sum(t for t, _ in by) - 1.5 * total) < 1e-6 * total
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert mixing.mix(none).count() == 0


def test_simhash_components(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    prints = []
    for r in rows:
        h = simhash.shingle_hashes((r[1] or "").encode(), 4)
        prints.append(int(simhash.majority_bits(h, np.array([len(h)]))[0]))
    f = np.array(prints, np.uint64)
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    root = union_find(i, j, len(f))
    least = {}
    for k, r in enumerate(rows):
        least[root[k]] = min(least.get(root[k], r[0]), r[0])
    assert sorted(map(tuple, got)) == sorted((r[0], f"{f[k]:016x}", least[root[k]]) for k, r in enumerate(rows))
    assert simhash.near_duplicates(none).count() == 0


def test_resembling(docs, rows, none):
    got = {r.doc_id: r.component_id for r in simhash.resembling(docs).collect()}
    texts = {r[0]: set(simhash.shingle_hashes((r[1] or "").encode(), 5).tolist()) for r in rows}
    ids = sorted(texts)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if texts[ids[a]] and len(texts[ids[a]] & texts[ids[b]]) >= 0.8 * len(texts[ids[a]] | texts[ids[b]])]
    root = union_find(np.array([a for a, _ in links]), np.array([b for _, b in links]), len(ids))
    want = {ids[k]: ids[root[k]] for k in {x for p in links for x in p}}
    # blank texts have equal words, and repeated rows one id
    assert {k: v for k, v in got.items() if k > 3} == want
    assert simhash.resembling(none).count() == 0


def test_resembling_finds_pairs_at_the_least_resemblance(spark):
    """Pairs of 200 words with two changed words in each, a resemblance of 0.815 on average: nearly all share a block."""
    rng = random.Random(3)
    rows, want = [], 0
    for k in range(300):
        a = words(rng, 200, 10**9).split()
        b = list(a)
        for t in (a, b):
            for i in rng.sample(range(200), 2):
                t[i] = f"edit{rng.randrange(10**9)}"
        s, t = (set(simhash.shingle_hashes(" ".join(x).encode(), 5).tolist()) for x in (a, b))
        if len(s & t) >= 0.8 * len(s | t):
            rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
            want += 1
    got = simhash.resembling(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    found = got.where("doc_id > component_id").count()
    assert want > 200 and 0.985 * want <= found <= want, (found, want)


@pytest.mark.parametrize("block", [500, 4])
def test_resembling_looks_behind_failed_links(spark, monkeypatch, block):
    """Groups whose forests have links that fail the check, while pairs that they lack would pass: as all pairs one by one."""
    monkeypatch.setattr(components, "PIECE_BLOCK", block)
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = words(rng, 180, 10**9).split()
        for _ in range(20):
            t = list(base)
            for i in rng.sample(range(180), 2 if g % 2 else 3):
                t[i] = f"edit{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    prints = {r.doc_id: [r[f"f{w}"] & (1 << 64) - 1 for w in range(simhash.WIDE_COMPARED)] for r in simhash.fingerprints(df, 5, 4, distinct=True).collect()}
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b])) <= simhash.WIDE_RADIUS]
    root = union_find(np.array([a for a, _ in links]), np.array([b for _, b in links]), len(rows))
    want = {k: int(root[k]) for k in {x for p in links for x in p}}
    assert {r.doc_id: r.component_id for r in simhash.resembling(df).collect()} == want


def test_quality_rules(docs, rows, none):
    got = {r.doc_id: r for r in repetition.verdict(repetition.measure(docs)).collect()}
    for r in rows:
        w = (r[1] or "").split()
        grams = {}
        for i in range(len(w) - 2):
            grams.setdefault(tuple(w[i : i + 3]), []).append(i)
        hit = {i + k for v in grams.values() if len(v) > 1 for i in v for k in range(3)}
        own = [x for x in (r[1] or "").split("\n") if x.split()]
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(own) - len(set(own)), len(hit))
        assert g.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert repetition.measure(none).count() == 0


def test_archives(spark, docs, rows):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("http://h/\n"), F.col("source"))).alias("url"), F.col("text").alias("html"))
    for least in (0, 200):
        folder = shared_dir(spark, "test-warc")
        warc.write_archives(pages, folder, min_revisit=least, archive_bytes=20_000)
        got = sorted(tuple(r) for r in warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1))).collect())
        last = {}
        for r in rows:
            last[r[1] or ""] = max(last.get(r[1] or "", -1), r[0])
        want = []
        for r in rows:
            p = (r[1] or "").encode()
            revisit = len(p) >= least and last[r[1] or ""] != r[0]
            want.append((r[0], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", last[r[1] or ""] if revisit else -1))
        assert got == sorted(want)


def test_chat(spark):
    said = [(1, 1, "assistant", "a<|im_end|>\n"), (1, 0, "user", None), (1, 2, None, "x"), (2, 0, "assistant", ""), (None, 0, "assistant", "né"), (1, 2, None, "x")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    formatted = chat.format_turns(df)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, None):
        turns = sorted((t[1], t[2] or "", t[3] or "") for t in said if t[0] == conv)
        body = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv][:4] == (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_line_dedup(docs, rows, none):
    got = {r.doc: (r.n_lines, list(r.removed)) for r in lines.repeated_lines(docs).collect()}
    own = sorted({(r[0], i, x) for r in rows for i, x in enumerate((r[1] or "").split("\n")) if len(x) >= 16 and x.split()})
    unique = sorted({x for _, _, x in own})
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in unique]
    links = [(a, b) for a in range(len(unique)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = union_find(np.array([a for a, _ in links]), np.array([b for _, b in links]), len(unique))
    at = {x: root[k] for k, x in enumerate(unique)}
    first, want = {}, {}
    for d, i, x in own:
        n, gone = want.setdefault(d, [0, []])
        want[d][0] += 1
        if first.setdefault(at[x], (d, i)) != (d, i):
            gone.append(i)
    assert got == {d: (n, g) for d, (n, g) in want.items()}
    kept = lines.drop_lines(docs, lines.repeated_lines(docs))
    assert set(kept.columns) == set(docs.columns)
    assert all(r.text.split() for r in kept.collect())
    assert lines.drop_lines(none, lines.repeated_lines(none)).count() == 0


def test_short_lines_take_part(spark, tmp_path):
    """The query's lines have no least length: equal ones go, of those that have a word."""
    texts = ["ok\n好的，我明白了\n \n#1", None, "ok", "zz\nok", "好的，我明白了\n#2\n\t\n#1", "12345678\n123456789\nx"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, list(r.removed)) for r in queries.op6_fuzzy_lines(spark, str(tmp_path)).collect()}
    rest = got.pop(5)
    assert got == {0: (3, []), 2: (1, [0]), 3: (2, [1]), 4: (3, [0, 3])}
    # 4 of 5 shingles are common
    assert rest == (3, [1])


def test_line_dedup_in_blocks(docs, monkeypatch):
    whole = {r.doc: r.removed for r in lines.repeated_lines(docs).collect()}
    monkeypatch.setattr(lines, "BLOCK", 3)
    monkeypatch.setattr(lines, "HUB", 1)
    monkeypatch.setattr(components, "PIECE_BLOCK", 2)
    assert {r.doc: r.removed for r in lines.repeated_lines(docs).collect()} == whole


def test_media(docs, rows, none):
    stored = mpegts.pack_media(mpegts.padded_texts(docs, "doc_id", "text"))
    got = sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in mpegts.read_media(stored, ["doc_id", "n_bytes"]).collect())
    want = []
    for r in rows:
        p = (r[1] or "").encode()
        full = p.ljust(max(192, -(-len(p) // 192) * 192))
        want.append((r[0], len(p), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert got == sorted(want)
    assert mpegts.read_media(mpegts.pack_media(mpegts.padded_texts(none, "doc_id", "text")), ["doc_id"]).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_repeated_bytes(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(substrings, "BUCKET_SUFFIXES", 100)
        monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randint(20, 150))) for _ in range(8)]
    rows = [(None, pool[0] * 3), (0, None), (1, "")]
    for d in range(2, 70):
        t = "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("abcdef\0") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 5)))
        rows.append((d, " " * rng.randint(0, 150) if d % 11 == 0 else t))
    rows += [rows[10], (10, pool[3] + pool[4]), rows[20]]
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        want.append((-1 if d is None else d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(df).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def _tiktoken():
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(queries.VOCABULARY))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return vocabulary, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, none):
    vocabulary, other = _tiktoken()
    got = sorted(map(tuple, bpe.round_trip_digests(docs, vocabulary, public_tokenizers.PATTERN).collect()))
    want = []
    for r in rows:
        ids = other.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want)
    both = bpe.decode(bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary, public_tokenizers.PATTERN)
    assert both.where(F.col("decoded") != F.coalesce(F.col("text"), F.lit("")).cast("binary")).count() == 0
    assert bpe.encode(none, vocabulary, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("block", [64, 1000, 4 << 20])
def test_separators(spark, docs, rows, block):
    vocabulary, other = _tiktoken()
    folder = shared_dir(spark, "test-tokens")
    written = separators.write_token_files(docs, folder, vocabulary, public_tokenizers.PATTERN, queries.EOD)
    counts = separators.count_tokens(spark, folder, queries.EOD, block=block)
    got = sorted((r.doc_id, r.n_tokens) for r in written.join(counts, ["file", "ordinal"]).collect())
    assert got == sorted((r[0], len(other.encode_ordinary(r[1] or ""))) for r in rows)


def test_queries_are_registered():
    import corpus_pipeline

    assert [n for n in queries.QUERIES if n.startswith("op")] == sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark, tmp_path, rows):
    """Each stage on its own input; the copies of a document go, clean documents stay."""
    import corpus_pipeline

    rng = random.Random(8)
    clean = [(k, words(rng, 150, 100_000), "en", f"s{k % 3}", 0) for k in range(40)]
    bad = [(100, "spam spam " * 100, "en", "s0", 0), (101, "short", "en", "s0", 0)]
    copies = [(200 + k, clean[k][1], "en", "s1", 0) for k in range(5)]
    spark.createDataFrame(clean + bad + copies, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), *range(200, 205)]
    near = corpus_pipeline.near_dedup(spark, kept, str(tmp_path))
    assert sorted(r.doc_id for r in near.collect()) == [*range(40)]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(40)) and 45 <= len(out) <= 75
