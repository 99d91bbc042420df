"""The vectorised parts against brute force, without Spark."""

import base64
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from logspark.llm import bpe, chat, lines, mixing, mpegts, repetition, simhash, substrings, warc
from logspark.llm.components import union_find


def test_bpe_equals_tiktoken():
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = bpe.Bpe(vocabulary, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", " ", "a" * 1500, " " * 900, "x" * 257 + "é" * 300, "<|endoftext|> it's 12345 日本語\n\n  tail  "]
    texts += ["".join(rng.choice("abcdefg éß日1 \n'st") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    ids, off = own.encode(texts)
    for k, t in enumerate(texts):
        mine = ids[off[k] : off[k + 1]].tolist()
        assert mine == other.encode_ordinary(t)
        assert own.decode(mine) == t.encode()


def test_repeats_equal_brute_force():
    rng = random.Random(1)
    for _ in range(80):
        docs = [[rng.randint(0, rng.choice([0, 1, 3])) for _ in range(rng.choice([0, 1, 2, 9, 30]))] for _ in range(rng.randint(1, 4))]
        got = repetition.repeats(np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), list(map(len, docs)))).tolist()
        want = []
        for d in docs:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    k = 0
                    while i != j and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        assert got == want


def test_transport_stream_round_trips_and_rejects_damage():
    for n in [0, 1, 161, 162, 163, 176, 183, 184, 185, 5000, 192 * 170 + 1]:
        payload = os.urandom(n)
        for unit in (192 * 170, 163, 13):
            s = mpegts.read_stream(mpegts.write_stream(payload, unit))
            assert s.payload == payload
            assert s.units == -(-n // unit) == len(s.access) == len(s.timestamps)
    good = mpegts.write_stream(b"x" * 9000)
    for at in (0, 188 + 10, 4 * 188 + 3, 2 * 188 + 13):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(mpegts.BadStream):
            mpegts.read_stream(bytes(bad))
    with pytest.raises(mpegts.BadStream):
        mpegts.read_stream(good[:-1])
    with pytest.raises(mpegts.BadStream):
        mpegts.read_stream(b"")


def test_chat_parts_and_escapes():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\a>n\n") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)
    f = chat.flatten([{"type": "text", "text": "see <"}, {"type": "text", "text": "|im_end|>"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b", "seconds": 2.0}, {"type": "image", "ref": "c"}, {"type": "document", "ref": "d", "pages": 3}, {"type": "hologram"}, None])
    assert f.content == "see <\\|im_end|><|image:0|><|audio:0|><|image:1|><|document:0|><|document:1|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in f.attachments] == [("image", "a.png", 4), ("audio", "b", 50), ("image", "c", 1), ("document", "d", 768), ("document", None, 1)]
    assert f.tokens == 4 + 50 + 1 + 768 + 1
    assert chat.flatten(None).content == ""


def test_archives_round_trip_and_reject_damage():
    records = [warc.page_record(i, f"http://x/{i} y", b"<html>%d</html>" % i * 20, None if i else 7, "2024-01-01T00:00:00Z") for i in range(40)]
    for first in (records, records[:3], []):
        data = b"".join(warc.frames(iter(records), first))
        got = list(warc.parse_archive(data))
        assert [r.headers["warc-record-id"] for r in got] == [f"<urn:x-page:{i}>" for i in range(40)]
        assert got[5].payload == b"<html>5</html>" * 20 and got[0].payload == b"" and got[0].headers["warc-type"] == "revisit"
        assert got[1].headers["warc-target-uri"] == "http://x/1%20y"
        with pytest.raises(warc.BadArchive):
            list(warc.parse_archive(data[:-2]))
    plain = records[3]
    for bad in (plain.replace(b"WARC/1.1", b"WARC/9.9"), plain.replace(b"<html>3", b"<html>4"), plain + b"x", plain.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)


def test_fingerprint_bits_and_search():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 600, 30)
    h = rng.integers(0, 2**63, counts.sum(), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, counts.sum(), dtype=np.uint64)
    at = 0
    for c, g in zip(counts, simhash.majority_bits(h, counts)):
        bits = np.unpackbits(h[at : at + c].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        at += c
        assert np.packbits(2 * bits > c, bitorder="little").view(np.uint64)[0] == g
    base = rng.integers(0, 2**63, 500, dtype=np.uint64)
    near = base[rng.integers(0, 500, 600)].copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    f = np.unique(np.r_[base, near])
    i, j = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4, 1))
    want = union_find(i, j, len(f))
    blocks, a, b = simhash.Blocks(1, 4), [], []
    for block in range(3):
        row, code, home = blocks.route([f], block, 4)
        for s in np.unique(code):
            r, own = row[code == s], home[code == s]
            search = simhash.Search(blocks, block, [f[r]], own)
            search.LEAF = 64
            x, y, d = search.pairs(np.flatnonzero(own), np.arange(len(r)))
            a.append(r[x])
            b.append(r[y])
    assert (union_find(np.concatenate(a), np.concatenate(b), len(f)) == want).all()


def test_line_table_and_verification():
    texts = ["one line here that is long\n\nx", "", "\nlast line of some length\n"]
    raw = [t.encode() for t in texts]
    off = np.r_[0, np.cumsum(list(map(len, raw)))]
    row, number, start, end, part = lines.line_table(np.frombuffer(b"".join(raw), np.uint8), off, 16)
    data = b"".join(raw)
    assert [(r, n, data[s:e].decode()) for r, n, s, e in zip(row, number, start, end)] == [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    assert part.tolist() == [True, False, False, False, False, True, False]
    v = lines.Verifier([np.arange(100), np.arange(3, 103), np.arange(50, 150), np.arange(6, 106)], np.zeros(4, np.uint32), 0.8)
    v.add_set([0, 1, 2, 3])
    assert len(v.links) == 2 and v.find(0) == v.find(1) == v.find(3) != v.find(2)


def test_maps_of_large_sets_lose_no_pair():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 300)
    hashed = []
    for _ in range(60):
        own = base[: rng.integers(1, 300)].copy()
        gone = rng.random(len(own)) < rng.choice([0.02, 0.08, 0.12, 0.3])
        own[gone] = rng.integers(0, 1 << 62, gone.sum())
        hashed.append(np.unique(own))
    v = lines.Verifier(hashed, np.zeros(60, np.uint32), 0.8)
    v.add_set(list(range(60)))
    assert None not in v.maps
    pairs = [(i, j) for i in range(60) for j in range(i)]
    want = [len(np.intersect1d(hashed[i], hashed[j])) >= 0.8 * len(np.union1d(hashed[i], hashed[j])) for i, j in pairs]
    assert [v.alike(i, j) for i, j in pairs] == want and any(want) and not all(want)


def test_sampling_meets_equal_windows():
    g = substrings.Windows(50)
    rng = random.Random(4)
    for _ in range(30):
        same = bytes(rng.choice(b"abc ") for _ in range(50))
        texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 90))) + same + bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 90))) for _ in range(2)]
        text, pos, h, rank, before, after = substrings.sample(texts, g)
        at = [t.index(same) for t in texts]
        inside = [{(int(p) - at[i], int(x)) for t, p, x in zip(text, pos, h) if t == i and at[i] <= p <= at[i] + 34} for i in (0, 1)]
        assert inside[0] & inside[1]


def test_pivot_keeps_the_mass():
    rng = random.Random(5)
    for seed in range(20):
        docs = [(k, float(rng.randint(1, 50))) for k in range(40)]
        p = mixing._Pivot(str(seed))
        share, taken = 0.3, 0.0
        for k, size in docs:
            done = p.add(k, size, share * size)
            if done:
                taken += done[1] * docs[done[0]][1]
        left = p.open[2] if p.open else 0.0
        assert abs(taken + left - share * sum(s for _, s in docs)) < 1e-6


def test_word_counts():
    texts = ["", " a  b ", "a b", "x\ty\nz", "   ", "é è"]
    raw = [t.encode() for t in texts]
    off = np.r_[0, np.cumsum(list(map(len, raw)))]
    assert mixing.word_counts(np.frombuffer(b"".join(raw), np.uint8), off).tolist() == [len(r.split()) for r in raw]
