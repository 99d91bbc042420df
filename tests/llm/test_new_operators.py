"""Collocations, hard negatives and the range join on small tables with nulls, ties, repeats and clashing columns, against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest

from logspark.llm import collocations as C
from logspark.llm import negatives as N
from logspark.llm import ranges as R
from logspark.llm.components import union_find

# --- collocations


def collocations_by_loop(rows, least=10, inside=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        t = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(100 * b >= inside * a for (g, q), b in candidates.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    got = []
    for lang, rows_ in out.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            got.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(got)


def prose(rng, n):
    return "".join(rng.choice(["Alpha ", "beta ", "gamma  ", "\tdelta ", "É ", "é ", "new york city ", "new york ", "x, ", "y. ", "z\n", "\x1c\xa0q ", "u\x85v "]) for _ in range(n))


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    if small:  # many chunks, shards and buckets, joins that aren't broadcast
        for name, value in (("CHUNK", 400), ("SHARD", 20), ("WORDS", 3), ("BROADCAST_WORDS", 1), ("SALTS", (3, 2))):
            monkeypatch.setattr(C, name, value)
    rng = random.Random(1)
    rows = [(prose(rng, rng.randrange(40)), rng.choice(["en", "fr", None])) for _ in range(150)] + [(None, "en"), ("", "de"), (" \t", None), (prose(rng, 4000), "en")] + [("same words here. Same words here", "de")] * 30
    df = spark.createDataFrame([(t, g, 1, "w", 2) for t, g in rows], "text string, lang string, x int, word string, chunk int").repartition(3)
    got = sorted(map(tuple, C.collocations(df).collect()))
    assert got == collocations_by_loop(rows) and len(got) > 20
    assert sorted(map(tuple, C.collocations(df, least=3, inside=90, top=4).collect())) == collocations_by_loop(rows, 3, 90, 4)


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(none).count() == 0
    assert C.collocations(spark.createDataFrame([(None, "en"), ("a b", "en")], "text string, lang string")).count() == 0


def test_quotient_filters_lose_nothing():
    rng = np.random.default_rng(4)
    for bits in (1, 5, 17, 32):
        p = C.Permutation(bits)
        a, b, c = (rng.integers(0, 1 << bits, 3000).astype(np.int64) for _ in range(3))
        q, r = p.forth(a, b, c)
        assert all((x == y).all() for x, y in zip(p.back(q, r), (a, b, c)))
        assert (q < 1 << bits).all() and (bits == 32 or (r < 1 << 2 * bits).all())
    p, width = C.Permutation(6), 2
    count = rng.integers(1, 5, 3000) * rng.choice([1, 1, 1, 300], 3000)
    a, b, c = (rng.integers(0, 9, 3000) for _ in range(3))
    q, r = p.forth(a, b, c)
    parts = [C.QuotientFilter.of(q[i::3], r[i::3], count[i::3]) for i in range(3)]
    back = C.QuotientFilter.merged([C.QuotientFilter.decoded(f.encoded(0, 64, width), 0, 64, width) for f in parts])
    want = collections.Counter()
    for k, n in zip(zip(a.tolist(), b.tolist(), c.tolist()), count.tolist()):
        want[k] += n
    ids = p.back(back.quotient, back.remainder)
    assert dict(zip(zip(*(x.tolist() for x in ids)), back.count.tolist())) == want
    assert (np.diff(back.quotient.astype(np.int64)) >= 0).all()
    empty = C.QuotientFilter.of(q[:0], r[:0])
    assert len(C.QuotientFilter.decoded(empty.encoded(0, 64, width), 0, 64, width)) == 0


# --- hard negatives


def negatives_by_loop(rows, k=5, low=80, high=100):
    ok = [(i, g, [math.floor(256 * float(x)) for x in v]) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, g, v in ok:
        if i % 100:
            continue
        others = sorted((-score(v, w), j, h) for j, h, w in ok if j != i)
        for p, j, _ in [x for x in others if x[2] == g][:k]:
            near = [x for x in others if x[2] != g and low * -p <= 100 * -x[0] <= high * -p][:k]
            out += [(i, j, r, b, -p, -s) for r, (s, b, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(rng, n, width=12, spread=1.0):
    return [(i, [spread * rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(width)], rng.randrange(3)) for i in range(n)]


ODD = [(1000, None, 1), (1100, [], 1), (1101, [1.0], None), (None, [1.0] * 12, 1), (1200, [float("nan")] * 12, 1), (1300, [float("inf")] + [0.0] * 11, 0), (1400, [1.0, 2.0], 1), (1500, [None] * 12, 1), (1600, [0.0] * 12, 2)]
VECTOR = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("spread", [0.01, 1.0, 3000.0])
def test_hard_negatives(spark, monkeypatch, spread):
    """Ties, repeated rows, negative scores, and scores that need three to six primes."""
    monkeypatch.setattr(N, "ANCHORS", 3)
    monkeypatch.setattr(N, "TILE", 16)
    rng = random.Random(int(spread))
    rows = vectors(rng, 500, spread=spread) + ODD
    rows += [(700 + k, rows[0][1], k % 3) for k in range(30)] + [rows[7], rows[7]]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], VECTOR + ", id int, score string").repartition(4)
    from pyspark.sql import functions as F

    got = sorted(map(tuple, N.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == negatives_by_loop(rows) and len(got) > 50


def test_hard_negatives_of_nothing(spark):
    from pyspark.sql import functions as F

    columns = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    for rows in ([], [(1, [1.0], 1)], [(None, None, None)], [(100, [1.0], 1)]):
        out = N.hard_negatives(spark.createDataFrame(rows, VECTOR), F.col("vec_id") % 100 == 0)
        assert out.columns == columns and out.count() == 0
    with pytest.raises(ValueError):
        N.hard_negatives(spark.createDataFrame([(100, [1e9], 1)], VECTOR), F.lit(True))


def test_residue_products_are_exact():
    rng = np.random.default_rng(5)
    for size, width in ((3, 5), (300, 64), (10**5, 2500), (10**6, 3)):
        a, b = rng.integers(-size, size + 1, (7, width)), rng.integers(-size, size + 1, (9, width))
        a[0], b[0], b[1] = size, size, -size
        r = N.Residues(size * size * width)
        assert (r.product(r.split(a), r.split(b)) == a @ b.T).all()
    assert list(N.primes_below(12)) == [11, 7, 5, 3, 2]


# --- range join


def links_by_loop(rows, least=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    a, b = [], []
    for i, (_, v) in enumerate(rows):
        for j, (_, w) in enumerate(rows[:i]):
            if ok[i] and ok[j] and len(v) == len(w) and sum(x * y for x, y in zip(v, w)) / math.sqrt(sum(x * x for x in v)) / math.sqrt(sum(x * x for x in w)) >= least:
                a.append(i)
                b.append(j)
    n = collections.Counter(a + b)
    root = union_find(np.array(a, np.int64), np.array(b, np.int64), len(rows))
    key = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            key[root[i]] = min(k, key.get(root[i], k))
    return sorted(((k, n[i], key.get(root[i]), k is not None and k == key.get(root[i])) for i, (k, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"CELL": 20, "BLOCK": 7, "TILE": 5}, {"CELL": 3, "DENSE": 10**6, "BLOCK": 4, "SAMPLE": 60}, {"CELL": 40, "DENSE": 2, "BLOCK": 6, "TILE": 3}])
@pytest.mark.parametrize("width", [2, 6])
def test_range_join(spark, monkeypatch, sizes, width):
    """Groups of copies, scaled vectors, chains, vectors of other lengths and unusable ones; in few dimensions most cells are neighbours."""
    for k, v in sizes.items():
        monkeypatch.setattr(R, k, v)
    rng = random.Random(width)
    vector = lambda: [rng.gauss(0, 1) for _ in range(width)]
    base = [vector() for _ in range(5)]
    rows = [(i, vector()) for i in range(120 if width > 2 else 40)]
    rows += [(200 + i, [x + rng.gauss(0, 0.02 + 0.03 * (i % 5)) for x in base[min(4, i // 25)]]) for i in range(140)]
    rows += [(400 + i, [7.5 * x for x in rows[i][1]]) for i in range(10)] + [rows[3], rows[3], (3, vector()), (None, rows[3][1]), (None, [0.0] * width)]
    rows += [(500, None), (501, []), (502, [float("nan")] * width), (503, [None] * width), (504, [0.0] * width), (505, [1.0]), (506, [2.0]), (507, base[4] + [0.0]), (508, [x * 1e-200 for x in base[0]])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id int, component int").repartition(3)
    got = sorted(map(tuple, R.range_links(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    # squares of the last vector vanish in the loop
    want = links_by_loop([(k, [x * 1e200 for x in v] if k == 508 else v) for k, v in rows])
    assert got == want


def test_range_join_of_nothing(spark):
    for rows, n in (([], 0), ([(1, None), (None, [0.0])], 2)):
        out = R.range_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == n
