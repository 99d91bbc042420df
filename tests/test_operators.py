"""Order-dependent operators against loops over random input, in one piece and in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from logspark.functions import text
from logspark.model import Grouper
from logspark.operators import lines as L
from logspark.operators import joins, parse, sequence
from logspark.operators import metrics as M
from logspark.operators.ordered import Fold, in_blocks, ordered_fold, running
from logspark.sources import files
from logspark.sources.files import read_log_lines
from logspark.sources.sinks import write_events


def logs(seed, n=6, letters="abcs"):
    rng = random.Random(seed)
    return {f"log{k}": [rng.choice(letters) * rng.randint(1, 2) for _ in range(rng.randint(0, 25))] for k in range(n)}


def frame(spark, data):
    rows = [(p, i, x, len(x) + 1) for p, xs in data.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "log_path string, line_seq long, raw string, raw_len int")


def looped(lines, kind, start, pattern):
    out, i = [], 0
    while i < len(lines):
        group, j = [lines[i]], i + 1
        if start in lines[i]:
            while j < len(lines):
                hit = pattern in lines[j]
                if kind == "continueThrough" and not hit or kind == "haltBefore" and hit:
                    break
                group.append(lines[j])
                j += 1
                if kind == "continuePast" and not hit or kind == "haltWith" and hit:
                    break
        out.append("\n".join(group))
        i = j
    return out


@pytest.mark.parametrize("kind", ["continueThrough", "continuePast", "haltBefore", "haltWith"])
@pytest.mark.parametrize("start, pattern", [("s", "a"), ("s", "s"), ("a", "b")])
def test_groups(spark, kind, start, pattern):
    data = logs(kind + start + pattern)
    df, g = frame(spark, data), Grouper(kind, start, pattern)
    want = sorted((p, m) for p, xs in data.items() for m in looped(xs, kind, start, pattern))
    for how in ({}, {"block": F.floor(F.col("line_seq") / 4)}, {"max_bytes": 10_000}):
        assert sorted((r.log_path, r.message) for r in L.group_lines(df, g, **how).collect()) == want
    assert sorted((r.log_path, r.message) for r in L.group_lines_by(df, [g]).collect()) == want


def test_groups_are_cut_at_a_size(spark):
    df = frame(spark, {"a": ["s"] + ["x" * 9] * 5, "b": ["s", "x"]})
    got = sorted((r.log_path, r.n_lines) for r in L.group_lines(df, Grouper("continueThrough", "s", "x"), max_bytes=25).collect())
    assert got == [("a", 2), ("a", 2), ("a", 2), ("b", 2)] or sum(n for p, n in got if p == "a") == 6


class _Last(Fold):
    def __init__(self):
        self.rows = []

    def add(self, row):
        self.rows.append(row.v)
        return ()

    def end(self):
        yield self.k(), str(self.rows)

    def k(self):
        return len(self.rows)


def test_fold_carries_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("k"), (100 - F.col("id")).alias("v"))
        got = {r.rows for r in ordered_fold(df, ["k"], ["v"], _Last, "n bigint, rows string").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == {str(sorted(100 - i for i in range(100) if i % 3 == k)) for k in range(3)}


def test_rate_rules(spark):
    rows = [(0, 1.0), (1000, 3.0), (1000, 9.0), (2000, 2.0), (3000, 5.0), (700_000, 1.0), (701_000, 2.0)]
    df = spark.createDataFrame([("m", "i", "c", t, v) for t, v in rows], "monitor string, instance string, metric string, ts_ms long, value double").withColumn("extra", F.lit(None).cast("map<string,string>"))
    assert [(r.ts_ms, r.rate) for r in M.rate(df).orderBy("ts_ms").collect()] == [(1000, 2.0), (3000, 1.0), (701_000, 1.0)]


def test_sequence_in_blocks(spark):
    df = frame(spark, logs(7))
    want = {tuple(r) for r in sequence.sequence(df, 20).collect()}
    assert {tuple(r) for r in sequence.sequence(df, 20, block=F.floor(F.col("line_seq") / 3)).collect()} == want


def test_monotonic_time(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(0, 20)) for k in range(3) for i in range(30)]
    got = {(r.k, r.i): r.t for r in sequence.monotonic_time(spark.createDataFrame(rows, "k int, i int, t long"), ["k"], ["i"], "t").collect()}
    last = {}
    for k, i, t in rows:
        last[k] = max(t, last.get(k, -1) + 1)
        assert got[k, i] == last[k]


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"".join(b"line %d\r\n" % i for i in range(5000)))
    (tmp_path / "b.log").write_bytes(b"x\ny")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = read_log_lines(spark, [str(tmp_path)], exclude=["*/b.log"]).orderBy("line_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.raw for r in got] == [f"line {i}\r" for i in range(5000)]


def test_events_are_written_by_date(spark, tmp_path):
    write_events(spark.sql("select timestamp'2024-01-02 03:00:00' ts, 'm' message union all select null, 'n'"), str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert sorted((str(r.date), r.message) for r in back.collect()) == [("2024-01-02", "m"), ("None", "n")]


def test_fragments_keep_all_bytes(spark):
    texts = ["aééb", "", "日本" * 9, "plain"]
    out = L.fragment_lines(spark.createDataFrame(list(enumerate(texts)), "i int, message string"), 2).orderBy("i", "fragment").collect()
    for i, t in enumerate(texts):
        own = [r for r in out if r.i == i]
        assert b"".join(bytes(r.piece) for r in own) == t.encode() and all(len(r.piece) <= 2 for r in own)


def test_owners_in_cycles_have_no_root(spark):
    rows = [("a", "Job", "b"), ("b", "Job", "a"), ("c", "Job", "a"), ("x", "Job", None), ("y", "Job", "x"), ("z", "Job", "y"), ("s", "Job", "s"), *((f"k{i}", "Job", f"k{(i + 1) % 3}") for i in range(3))]
    got = {r.name: r.root for r in joins.root_owner(spark.createDataFrame(rows, "name string, kind string, parent string"), ["Job"]).collect()}
    assert got == {"a": None, "b": None, "c": None, "x": "x", "y": "x", "z": "x", "s": "s", "k0": None, "k1": None, "k2": None}


def test_descendants_of_chains_and_cycles(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(max(1, k)) if k % 9 else None, k % 13 == 5) for k in range(200)] + [(1000 + k, 1000 + (k + 1) % 4, k == 2) for k in range(4)] + [(2000 + k, 2000 + k - 1 if k else 2000, k == 3) for k in range(60)] + [(3000, 3001, False), (3001, 3000, False)]
    up, hit = {p: q for p, q, _ in rows}, {p for p, _, h in rows if h}
    want = set()
    for p in up:
        q, seen = p, set()
        while q is not None and q not in seen:
            if q in hit:
                want.add(p)
                break
            seen.add(q)
            q = up.get(q)
    df = spark.createDataFrame(rows, "pid long, ppid long, h boolean")
    got = [r.pid for r in joins.descendants(df, F.col("h")).collect()]
    assert sorted(got) == sorted(want)


def test_null_keys_carry_over_blocks(spark):
    rows = [(k, i, 1) for k in ("a", None) for i in range(10)]
    df, by = in_blocks(spark.createDataFrame(rows, "k string, i int, v int"), F.floor(F.col("i") / 3))
    out = running(df, ["k"], ["i"], F.col("v"), "n", block=by)
    assert sorted((r.k or "", r.i, r.n) for r in out.collect()) == sorted((k or "", i, i + 1) for k, i, _ in rows)


def test_rotations_beyond_a_hundred(spark, tmp_path):
    """200 rotated files are one log in order; more than the numbers hold is an error."""
    for g in range(200):
        (tmp_path / ("x.log" if g == 0 else f"x.log.{g}")).write_text(f"line {g}\n")
    got = files.read_log_lines(spark, [str(tmp_path)], rotations=True).orderBy("line_seq").collect()
    assert [r.raw for r in got] == [f"line {g}" for g in reversed(range(200))] and min(r.line_seq for r in got) >= 0
    seq = lambda start, place, rank: spark.range(1).select(files._line_seq(spark, F.lit(start), F.lit(place), F.lit(rank)).alias("s")).first().s
    assert seq(1 << 42, 5, 8191) > seq(4 << 20, 9, 8191) > seq(1 << 42, 0, 8190) >= 0
    for start, place, rank in ((1 << 44, 0, 0), (0, 1 << 32, 0), (0, 0, 8192)):
        with pytest.raises(Exception, match="numbered|number them"):
            seq(start, place, rank)


def test_sizes_of_the_session():
    assert [files.byte_size(x) for x in ("8192", "128MB", "1tb", "3k", "134217728b")] == [8192, 128 << 20, 1 << 40, 3072, 134217728]
    with pytest.raises(ValueError):
        files.byte_size("some")


def test_containers_by_id(spark):
    """Ids that share their first characters, copies of a container, and ids that are too short."""
    own = [("a" * 12 + "1" * 4, "one", {"k": "1"}), ("a" * 12 + "2" * 4, "two", None), ("b" * 16, "bee", None), ("b" * 16, "ant", None), ("c" * 16, "sea", None)]
    c = spark.createDataFrame(own, "cid string, name string, labels map<string,string>")
    ids = ["a" * 12 + "1" * 4, "a" * 12 + "2" * 4, "a" * 12, "a" * 12 + "1", "b" * 16, "b" * 13, "c" * 12, "c" * 5, "d" * 16, None]
    lines = spark.createDataFrame(list(enumerate(ids)), "i int, cid string")
    got = joins.resolve_container(lines, c).orderBy("i").collect()
    assert [r.container_name for r in got] == ["one", "two", None, "one", "ant", "ant", "sea", None, None, None]
    assert got[0].container_labels == {"k": "1"} and len(got) == len(ids)


def test_patterns_of_callers_are_pythons(spark):
    df = spark.createDataFrame([("café au lait",), ("cafe",), (None,)], "cmd string")
    assert [r.cmd for r in joins.match_processes(df, r"^caf\w\s").collect()] == ["café au lait"]
    assert [r.cmd for r in joins.match_processes(df, r"(?P<a_b>f)?(?(a_b)e|x)$").collect()] == ["cafe"]
    x = parse.extract_container(F.col("cmd"), r"^(?P<id_x>\w+) ", None)
    assert [(r.x.cid, r.x.rest) for r in df.select(x.alias("x")).collect()] == [("café", "au lait"), (None, "cafe"), (None, None)]
    j = joins.match_journal(df.select(F.create_map(F.lit("unit"), F.coalesce("cmd", F.lit("none"))).alias("fields")), [{"name": "u", "unit": r"caf\w\b"}])
    assert [r.config for r in j.collect()] == ["u", "u", "default"]
    out = text.rename_log(df, match=r"(?P<w>\w+)$", replacement=r"<\g<w>>", path="cmd").collect()
    assert [r.logfile for r in out] == ["café au <lait>", "<cafe>", None]
    s = df.select(text.summarise_output(F.col("cmd"), r"(?i)(É)").alias("s")).collect()
    assert [r.s.output for r in s] == ["é", "cafe", None]


def test_numbers_of_expositions(spark):
    df = spark.createDataFrame([(1, "a -15e-1\nb 1E+2\nc 25e-1\nd 1e+2\ne -1.5E+1\nf 7")], "scrape_id int, text string")
    got = {r.metric: r.value for r in M.parse_exposition(df).collect()}
    assert got == {"a": -1.0, "c": 2.0, "d": 100.0, "e": -15.0, "f": 7.0}


def test_event_xml(spark):
    whole = '<Event xmlns="x"><System><Provider Name="p"/><EventID>7</EventID><TimeCreated SystemTime="2024-01-01T00:00:00Z"/></System><EventData><Data Name="a">1</Data></EventData></Event>'
    rows = [(0, whole), (1, whole.replace("<EventData>", "<UserData>").replace("</EventData>", "</UserData>")), (2, "no xml"), (3, None), (4, ""), (5, whole.replace("<EventID>7", "<EventID Qualifiers='9'>x")), (6, whole.replace('<Data Name="a">1</Data>', "<Data/><Data> b </Data>"))]
    got = parse.parse_event_xml(spark.createDataFrame(rows, "i int, xml string")).orderBy("i").collect()
    assert [(r.event_id, r.provider, r.error) for r in got] == [(7, "p", False), (7, "p", False), (None, None, True), (None, None, False), (None, None, True), (None, "p", True), (7, "p", False)]
    assert [tuple(x) for x in got[0].data] == [("a", "1")] and got[1].data == [] and got[2].data is None
    assert [(x.name, (x.text or "").strip()) for x in got[6].data] == [(None, ""), (None, "b")]


def test_tables_of_a_database_are_read_in_ranges(spark):
    """Uneven keys, keys without a value, and filters that the database applies."""
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    url = f"jdbc:derby:memory:t{random.randrange(10**9)};create=true"
    rows = [(k, f"v{(k or 0) % 3}") for k in [*range(900), *range(100_000, 100_100), 10**6, None, None]]
    df = spark.createDataFrame(rows, "id long, v string")
    df.write.option("createTableColumnTypes", "v VARCHAR(8)").jdbc(url, "status", properties={"driver": driver})
    read = files.read_db_status(spark, url=url, table="status", column="id", rows_of_a_task=50, driver=driver)
    sizes = [len(p) for p in read.rdd.glom().collect()]
    assert sorted(map(tuple, read.collect()), key=repr) == sorted(rows, key=repr) and len(sizes) > 2
    hit = read.where("v = 'v1' and id < 500").select("id")
    assert hit.count() == len([1 for k, v in rows if k is not None and v == "v1" and k < 500])
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(v,v1)" in plan.replace("*", "")
    assert files.read_db_status(spark, url=url, table="status", column="id", driver=driver).rdd.getNumPartitions() == 1
    df.limit(0).write.jdbc(url, "bare", properties={"driver": driver})
    assert files.read_db_status(spark, url=url, table="bare", column="id", driver=driver).count() == 0


def test_blocks_of_sequences_times_and_versions(spark):
    """In blocks of any size what comes out is what comes out in one piece."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, *range(9)]), rng.choice(["x", "x", "y", None]), rng.randrange(50), i * 3 + rng.randrange(-20, 20)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long, seq_id string, seq_num long, t long").repartition(3)
    for size in (1, 7, 100, 1000):
        block = F.floor(F.col("i") / size)
        for run in (
            lambda **o: sequence.encode_sequence(df, ["k"], ["i"], **o),
            lambda **o: sequence.monotonic_time(df, ["k"], ["i"], "t", **o),
            lambda **o: sequence.fresh_versions(df, ["k"], ["i"], "v", **o),
        ):
            assert sorted(map(tuple, run(block=block).collect()), key=repr) == sorted(map(tuple, run().collect()), key=repr)
