"""Chains over blocks give what a loop over each key gives."""

import random

import numpy as np
import pytest

from logspark.model import Grouper
from logspark.operators import chains
from logspark.operators import lines as L
from logspark.operators.chains import Accepted, SizeCuts, Spaced, chained
from logspark.operators.lines import _Groupers, _Pieces
from logspark.operators.metrics import _Once, _Rate
from logspark.operators.ordered import ordered_fold


def test_ends_of_chains():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 60)
        following = [rng.randint(i + 1, min(n, i + 9)) for i in range(n)]
        last, count = chains.ends_of_chains(np.array(following))
        for i in range(n):
            at, k = i, 1
            while following[at] < n:
                at, k = following[at], k + 1
            assert (last[i], count[i]) == (at, k)


def test_first_at_least():
    rng = random.Random(2)
    for _ in range(50):
        v = [rng.randint(0, 9) for _ in range(rng.randint(1, 70))]
        start = [rng.randint(0, len(v)) for _ in v]
        least = [rng.randint(0, 10) for _ in v]
        want = [next((j for j in range(s, len(v)) if v[j] >= x), len(v)) for s, x in zip(start, least)]
        assert chains.first_at_least(np.array(v), np.array(start), np.array(least)).tolist() == want


def some_keys(rng, n):
    """A key of most rows, which is several blocks, and a few small ones."""
    return [rng.choice(["a"] * 8 + ["b", "c", None]) for _ in range(n)]


@pytest.mark.parametrize("limit", [1, 30, 200, 10**6])
def test_batches_by_size(spark, limit):
    rng = random.Random(limit)
    rows = [(k, i, rng.choice([0, 0, 1, 5, 9, 300 if limit < 300 else 40])) for i, k in enumerate(some_keys(rng, 600))]
    df = spark.createDataFrame(rows, "k string, i long, size long").repartition(5)
    got = {r.i: (r.nth - 1, r.start) for r in chained(df, ["k"], ["i"], SizeCuts("size", limit), tasks=9).collect()}
    batch, size = {}, {}
    for k, i, s in rows:
        new = k not in batch or (size[k] and size[k] + s > limit)
        batch[k], size[k] = (batch.get(k, -1) + 1, s) if new else (batch[k], size[k] + s)
        assert got[i] == (batch[k], bool(new)), (k, i)


@pytest.mark.parametrize("seconds", [0.5, 7.0, 100.0, 10**6])
def test_spaced_rows(spark, seconds):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, rng.randrange(5000) / 10) for k in some_keys(rng, 500)], "key string, t double")
    got = chained(df, ["key"], ["t"], Spaced("t", seconds), tasks=8).where("start").select("key", "t")
    want = ordered_fold(df, ["key"], ["t"], lambda: _Once(seconds), "key string, t double")
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


@pytest.mark.parametrize("gap,spread", [(0.5, 4000), (3.0, 900), (3.0, 40_000), (10**6, 3000)])
def test_rates(spark, gap, spread):
    """Series with decreases, equal times and gaps."""
    rng = random.Random(spread)
    rows = [(k or "n", rng.randrange(spread), float(rng.choice([i // 5, rng.randrange(40)]))) for i, k in enumerate(some_keys(rng, 700))]
    df = spark.createDataFrame(rows, "series string, ts_ms long, value double")
    m = chained(df, ["series"], ["ts_ms", "value"], Accepted(gap), apart=1, tasks=8).where("since is not null")
    got = sorted((r.series, r.ts_ms, (r.value - r.base) / (r.ts_ms / 1000 - r.since / 1000)) for r in m.collect())
    want = ordered_fold(df, ["series"], ["ts_ms", "value"], lambda: _Rate(gap), "series string, ts_ms bigint, rate double")
    assert got == sorted(map(tuple, want.collect()))


GROUPERS = [Grouper("continueThrough", "^a", "^[bc]"), Grouper("haltWith", "^d", "x$"), Grouper("continuePast", "^e", "y$"), Grouper("haltBefore", "^f", "^[af]")]


@pytest.mark.parametrize("max_bytes", [1, 12, 25, 10**6])
@pytest.mark.parametrize("which", [[0], [1], [2], [3], [0, 1, 2, 3], [3, 2, 1, 0]])
def test_groups(spark, max_bytes, which):
    rng = random.Random(max_bytes)
    groupers = [GROUPERS[g] for g in which]
    rows = [(k or "n", i, rng.choice("aabbccdefg") + "z" * rng.randrange(4) + rng.choice(["", "", "x", "y", "é"])) for i, k in enumerate(some_keys(rng, 300))]
    df = spark.createDataFrame(rows, "log_path string, line_seq long, raw string").repartition(3)
    folds, want = {}, []
    flags = [(g.start, g.pattern) for g in groupers]

    class Row:
        def __init__(self, path, seq, raw):
            import re

            self.log_path, self.line_seq, self.raw = path, seq, raw
            self.flags = [re.search(p, raw) is not None for pair in flags for p in pair]

    for path, seq, raw in rows:
        fold = folds.setdefault(path, _Groupers(groupers, "\n", max_bytes))
        want += fold.add(Row(path, seq, raw))
    for fold in folds.values():
        want += fold.end()
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = [tuple(r) for r in L.group_lines_by(df, groupers, max_bytes=max_bytes).select("log_path", "line_seq", "n_lines", "message").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("max_bytes", [1, 10, 40, 10**6])
def test_pieces(spark, max_bytes):
    rng = random.Random(max_bytes)
    rows = [(k or "n", i, i, "x" * rng.randrange(6), rng.random() < 0.2) for i, k in enumerate(some_keys(rng, 400))]
    raw = [(p, i, f"2024-01-01T00:00:00.{i:03d}Z stdout {'F' if f else 'P'} {x}") for p, i, _, x, f in rows]
    parsed = L.parse_cri(spark.createDataFrame(raw, "log_path string, line_seq long, raw string"))
    folds, want = {}, []
    for r in parsed.select("log_path", "stream", "line_seq", "ts_nanos", "message", "tags").orderBy("line_seq").collect():
        row = type("R", (), {"log_path": r.log_path, "stream": r.stream, "line_seq": r.line_seq, "ts_nanos": r.ts_nanos, "piece": r.message, "full": "F" in r.tags})
        want += folds.setdefault(r.log_path, _Pieces(max_bytes)).add(row)
    for fold in folds.values():
        want += fold.end()
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        out = L.reassemble_cri(parsed, max_bytes).select("log_path", "stream", "line_seq", "ts_nanos", "n_pieces", "message", "partial")
        assert sorted(map(tuple, out.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, i long, size long")
    assert chained(df, ["k"], ["i"], SizeCuts("size", 5)).count() == 0
