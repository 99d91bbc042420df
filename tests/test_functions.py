"""Scalar functions and rules on small inputs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logspark import model
from logspark.functions import dates, patterns, text, values
from logspark.model import RedactionRule, SamplingRule
from logspark.operators import parse
from logspark.operators.metrics import parse_exposition
from logspark.operators.parse import annotation_rules
from logspark.operators.rules import apply_rule_tables, redact, rule_tables, sample


def one(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column(F.col("x"))).collect()]


def test_rfc3339(spark):
    got = one(spark, dates.rfc3339_nanos, "2020-10-27T17:08:32Z", "2020-10-27T17:08:32.526666851Z", "2020-10-27T17:08:32.5266668519999Z", "2020-10-27T17:08:32.5", "2020-10-27T17:08:32+05:30", "2020-15-27T17:08:32Z", "x", None)
    base = 1603818512
    assert got == [base * 10**9, base * 10**9 + 526666851, base * 10**9 + 526666851, base * 10**9 + 500000000, (base - 19800) * 10**9, None, None, None]


def test_globs():
    for glob, yes, no in (("a*", "abc", "bac"), ("[!x]?", "ab", "xb"), ("a.b", "a.b", "axb"), ("*[0-9]", "a7", "a"), ("a[", "a[", "a"), ("x/*", "x/y/z", "y/x")):
        assert re.search(patterns.glob_regex(glob), yes) and not re.search(patterns.glob_regex(glob), no)


def test_java_patterns():
    assert patterns.java_regex(r"(?P<a_b>x)\Z") == r"(x)\z"
    assert patterns.java_regex(r"(a)?(?(1)b|c)") is None
    assert patterns.never_empty("a|b+") and not patterns.never_empty(r"a*|b") and not patterns.never_empty(r"\b")
    assert patterns.java_replacement(r"\2$\1") == r"$2\$$1"
    with pytest.raises(re.error):
        patterns.java_regex("(")


@pytest.mark.parametrize(
    "line, rules, expected, count",
    [
        ("auth=password, foo=password", [RedactionRule("password")], "auth=, foo=", 2),
        ("foo=bar&password=123&foo2", [RedactionRule(r"(password)=[^&]+", r"\1=***")], "foo=bar&password=***&foo2", 1),
        ("a b", [RedactionRule("a", "b"), RedactionRule("b", "c")], "c c", 3),
        ("né é", [RedactionRule("é", "e")], "ne e", 2),
        ("userid=123456", [RedactionRule(r"(userid)=(\d+)", r"\1=\H2", "s")], "userid=" + hashlib.md5(b"123456s").hexdigest(), 2),
        ("u=1 u=2", [RedactionRule(r"u=(\d)", r"\H1")], hashlib.md5(b"1").hexdigest() + " " + hashlib.md5(b"2").hexdigest(), 2),
        ("none", [RedactionRule(r"u=(\d)", r"\H1")], "none", 0),
        ("aXbX", [RedactionRule(r"(?P<q>X)b(?P=q)", "-")], "a-", 1),
        ("ab", [RedactionRule("x*", "-")], "-a-b-", 3),
    ],
)
def test_redaction(spark, line, rules, expected, count):
    row = redact(spark.createDataFrame([(line,)], "message string"), rules).first()
    assert (row.message, row.redactions, row.redacted) == (expected, count, count > 0)


PATTERNS = [r"user=\w+", r"tok=.*", r"\d+", r"\s+x", r"\bé\w", r"(?P<user_id>\w+)@", r"[[]a", r"[^\W\d]+", r"[\w.-]+@[^\s@]+", r"^a|z$", r"(?m)^\w", r"(?m)x$", r"(?i)É+", r"(?s)a.b", r"(?a:\w+)é", r"a(?=\d)", r"(?<!=)b", r"(a|b)\1", r"[a-c&&b]", r"\Bx", r"x{2,3}?", r"\$\{[^}]*\}", r"#\S", "(?x) a b # c"]


def test_patterns_match_as_in_python(spark):
    """Redaction by 24 patterns of random lines with all kinds of spaces, digits, letters and line ends, against Python's re."""
    rng = random.Random(5)
    letters = "ab xyz=@.-_[]&#${}0٣²éÉßñ日k\u212a\r\n\t\x0b\x1c\x85\xa0\u2003\u2028\u0301\U0001d7d9"
    lines = ["user=béa", "tok=a\rb", "tok=a\nb", "", "x\n"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(1200)] + ["user=" + "".join(rng.choice(letters) for _ in range(5)) for _ in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, message string").coalesce(2)
    for p in PATTERNS:
        for rule in (RedactionRule(p, "<X>"), RedactionRule(p, r"\H1", "s") if re.compile(p).groups else RedactionRule(p)):
            made = (lambda m: hashlib.md5((m.group(1) + "s").encode()).hexdigest()) if "H" in rule.replacement else rule.replacement
            weight = re.compile(p).groups if "H" in rule.replacement else 1
            # a group that takes no part fails the line where hashes are made
            lost = lambda t: "H" in rule.replacement and any(None in m.groups() for m in re.finditer(p, t))  # noqa: E731, B023
            want = [("", None) if lost(t) else (lambda x: (x[0], x[1] * weight))(re.subn(p, made, t)) for t in lines]  # noqa: B023
            got = [(r.message, r.redactions) for r in redact(df, [rule]).orderBy("id").collect()]
            got = [(m, n if w is not None else None) for (m, n), (_, w) in zip(got, want)]
            assert got == want, (p, rule.replacement, next((t, a, b) for t, a, b in zip(lines, got, want) if a != b))
        assert [r[0] for r in df.orderBy("id").select(patterns.found(F.col("message"), p)).collect()] == [re.search(p, t) is not None for t in lines], p


def test_redaction_of_many_groups_is_an_error(spark):
    with pytest.raises(ValueError):
        redact(spark.createDataFrame([("a",)], "message string"), [RedactionRule("(a)", r"\H12")]).collect()


HASHES = [
    ("u=1", r"u=(\d)", r"\H1\H1", "s", hashlib.md5(b"1s").hexdigest() + r"\H1", 1, False),
    ("u=1", r"u=(\d)", r"\1 \H1", "s", r"\1 " + hashlib.md5(b"1s").hexdigest(), 1, False),
    ("u=1", r"u=\d", r"\H1", "s", r"\H1", 0, False),
    ("u=1x", r"u=(\d)(x)", r"\H2", "", hashlib.md5(b"x").hexdigest(), 2, False),
    ("u=", r"u=(\d*)", r"\H1", "", "", 1, True),
    ("u=", r"u=(\d*)", r"\H1", "s", hashlib.md5(b"s").hexdigest(), 1, False),
    ("ab", r"a(x)?b", r"\H1", "s", "", 0, True),
    ("none", r"a(x)?b", r"\H1", "s", "none", 0, False),
    ("x", r"(?:(a)|x)", r"\H1", "s", "", 0, True),
]


@pytest.mark.parametrize("line, match, replacement, salt, expected, count, failed", HASHES)
def test_hashes_of_groups(spark, line, match, replacement, salt, expected, count, failed):
    """Each group's token once; counts are matches times groups; groups that take no part, and empty ones without salt, fail the line."""
    rules = [RedactionRule(match, replacement, salt), RedactionRule("z*$", "")]
    row = redact(spark.createDataFrame([(line, "k")], "message string, pieces string"), rules[:1]).first()
    assert (row.message, row.redaction_failed, row.redacted, row.pieces) == (expected, failed, failed or count > 0, "k")
    assert failed or row.redactions == count
    if failed:
        # no later rule is applied
        assert redact(spark.createDataFrame([(line,)], "message string"), [rules[0], RedactionRule("z*", "never")]).first().message == ""


def test_rules_that_are_none_are_errors(spark):
    df = spark.createDataFrame([("a",)], "message string")
    for rule in (RedactionRule("("), RedactionRule("a", r"\1"), RedactionRule("(a)", r"\g<b>")):
        with pytest.raises(ValueError):
            redact(df, [rule])


def test_rules_of_tables_equal_rules(spark):
    """Each rule as data does what it does as a rule; rules that can't be applied withhold the line."""
    own = [[RedactionRule(m, r, s)] for _, m, r, s, *_ in HASHES] + [[RedactionRule("a", "$1")], [RedactionRule(r"\d*", "#")], [RedactionRule("(a)?b(?(1)c|d)", "!")], [RedactionRule(r"u=(\w+)", r"u=\1\1"), RedactionRule("=", r"\\")], [RedactionRule("(?i)U", "v"), RedactionRule(r"(\d)", r"<\H1>", "p")]]
    lines = ["u=1", "u=1x", "ab", "u=", "", None, "abc bd é", "uU=12"]
    pods = [(p, {f"c/redaction_rules.{i}.{k}": v for i, r in enumerate(rules) for k, v in (("match_expression", r.match), ("replacement", r.replacement), ("hash_salt", r.hash_salt))}) for p, rules in enumerate(own)]
    bad = [{"c/redaction_rules.0.match_expression": "("}, {"c/redaction_rules.0.replacement": "x"}, {"c/redaction_rules.0.match_expression": "a", "c/redaction_rules.0.replacement": r"\3"}]
    pods += [(100 + i, b) for i, b in enumerate(bad)]
    df = spark.createDataFrame([(p, i, t) for p, _ in pods for i, t in enumerate(lines)], "pod long, i long, message string")
    rows = annotation_rules(spark.createDataFrame(pods, "pod long, annotations map<string,string>"), ["pod"], "c/")
    sampling, redaction, _ = rule_tables(rows, ["pod"])
    got = {(r.pod, r.i): (r.message, r.redactions, r.redacted, r.redaction_failed) for r in apply_rule_tables(df, sampling, redaction, ["pod"], ["pod", "i"]).collect()}
    for p, rules in enumerate(own):
        for r in redact(df.where(f"pod = {p}"), rules).collect():
            want = (r.message, r.redactions, r.redacted, r.redaction_failed)
            assert got[p, r.i] == want if not r.redaction_failed else (got[p, r.i][0], *got[p, r.i][2:]) == (want[0], *want[2:]), (p, r.i)
    for p in range(100, 103):
        assert all(got[p, i] == ("" if t is not None else None, 0, True, True) for i, t in enumerate(lines))


def test_sampling_rules_of_tables(spark):
    """Patterns that only Python has, rules without a pattern and rates that are none."""
    pods = [(0, {"c/sampling_rules.0.match_expression": "(e)?(?(1)n|t)", "c/sampling_rules.0.sampling_rate": "0"}), (1, {"c/sampling_rules.0.sampling_rate": "0", "c/sampling_rules.1.match_expression": "t", "c/sampling_rules.1.sampling_rate": "x"}), (2, {"c/attributes.a.b": "1"})]
    df = spark.createDataFrame([(p, i, t, {"a.b": "own"} if i == 0 else None) for p in range(3) for i, t in enumerate(["en", "t", "e", None])], "pod long, i long, message string, attrs map<string,string>")
    sampling, redaction, attributes = rule_tables(annotation_rules(spark.createDataFrame(pods, "pod long, annotations map<string,string>"), ["pod"], "c/"), ["pod"])
    got = apply_rule_tables(df, sampling, redaction, ["pod"], ["pod", "i"], attributes=attributes).collect()
    assert sorted((r.pod, r.i) for r in got) == [(0, 2), (0, 3), *((p, i) for p in (1, 2) for i in range(4))]
    assert {r.rule_error for r in got if r.pod == 1} == {"no pattern"} and {r.rule_error for r in got if r.pod != 1} == {None}
    assert [r.attrs for r in got if r.pod == 2 and r.i < 2] == [{"a.b": "own"}, {"a.b": "1"}]


def test_sampling(spark):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "INFO x").otherwise("other").alias("message"))
    rules = [SamplingRule("INFO", 0.2), SamplingRule("I", 1.0)]
    kept = sample(df, rules, ["id"])
    n = kept.where("message = 'INFO x'").count()
    assert abs(n - 2000) < 3 * (10_000 * 0.2 * 0.8) ** 0.5
    assert kept.where("message = 'other' and sample_rate = 1.0").count() == 10_000
    assert sorted(r.id for r in sample(df.repartition(7), rules, ["id"]).collect()) == sorted(r.id for r in kept.collect())
    with pytest.raises(ValueError):
        SamplingRule("x", 2)


def test_values(spark):
    assert one(spark, values.to_megabytes, "6.5 MB", "1 gb", "x", None) == [6.5, 1000.0, None, None]
    assert one(spark, values.to_bool, "", "f", "FALSE", "0", None) == [False, False, False, True, False]
    assert one(spark, values.valid_metric_name, "ok.x", "a b", "1a", "metric", "é") == ["ok.x", "a_b", "sa_1a", "metric_", "_"]
    assert one(spark, lambda c: text.one_line(c, 4), "a\nb\rcd") == ["a b "]
    assert [tuple(x) for x in one(spark, values.typed_value, "1.5", "7", "x")] == [(1.5, None), (7.0, None), (None, "x")]


def test_exposition(spark):
    body = "# TYPE jvm_x gauge\njvm_x{area=\"heap\",id=\"a b, c\"} 1.5\n# TYPE Req histogram\nreq 3\nplain 1e+05 170\nplain 1e5\nnan NaN\ninf +Inf\nneg -4\n\n"
    got = {(r.metric, r.value, r.value_str, tuple(sorted(r.extra.items())), r.sample_ts) for r in parse_exposition(spark.createDataFrame([("s", body)], "scrape_id string, text string")).collect()}
    assert got == {("jvm_x", 1.5, None, (("area", "heap"), ("id", "a b, c")), None), ("req", 3.0, None, (), None), ("plain", 100000.0, None, (), 170), ("inf", None, "+Inf", (), None), ("neg", -4.0, None, (), None)}


def test_frames(spark):
    def frames(parts, **how):
        df = spark.createDataFrame([("c", i, p) for i, p in enumerate(parts)], "conn_id string, chunk_seq int, payload binary")
        return [(bytes(r.frame), r.complete) for r in parse.split_syslog_frames(df, **how).orderBy("frame_seq").collect()]

    assert frames([b"3 a\nb5 he", b"llo", b"line\nta", b"il"]) == [(b"a\nb", True), (b"hello", True), (b"line", True), (b"tail", False)]
    assert frames([b"\0\0\0\2hi\0\0", b"\0\1x"], prefixed=True) == [(b"hi", True), (b"x", True)]


def test_groupers_from_dict():
    assert model.grouper_from_dict({"start": "a", "haltWith": "b"}) == model.Grouper("haltWith", "a", "b")
    for bad in ({"start": "a"}, {"start": "a", "haltWith": "b", "haltBefore": "c"}, {"haltWith": "b"}):
        with pytest.raises(ValueError):
            model.grouper_from_dict(bad)
