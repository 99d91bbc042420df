"""Sampling and redaction by ordered rules."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.patterns import found, groups_take_part, java_regex, java_replacement, never_empty, parse_template
from logspark.functions.text import merge_attrs
from logspark.model import LogConfig, RedactionRule, SamplingRule


def sample_rate(c: Column, rules: list[SamplingRule] | tuple[SamplingRule, ...]) -> Column:
    """The rate of the first rule whose pattern is found; 1 if none is."""
    out = F.lit(1.0)
    for r in reversed(rules):
        out = F.when(found(c, r.match), float(r.rate)).otherwise(out)
    return out


def kept(rate: Column, key: list[str], seed: int = 42) -> Column:
    """Whether a line of this rate stays: it depends on its key and the seed only, so repeated tasks agree."""
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return (rate >= 1) | (draw < rate)


def sample(lines: DataFrame, rules: list[SamplingRule] | tuple[SamplingRule, ...], key: list[str], column: str = "message", seed: int = 42) -> DataFrame:
    """Keeps lines by their rule's rate and adds sample_rate."""
    if not rules:
        return lines.withColumn("sample_rate", F.lit(1.0))
    return lines.withColumn("sample_rate", sample_rate(F.col(column), rules)).where(kept(F.col("sample_rate"), key, seed))


_HASH = "\\H"
_PARTS = "array<struct<text:string,grp:int,hashed:boolean>>"
_PROGRAM = f"struct<java:string,plain:string,hashes:boolean,groups:int,parts:{_PARTS},error:string>"


@dataclass(frozen=True)
class Program:
    """What a redaction rule does, for expressions to interpret. java: the pattern for Spark, None where only Python's own will do.

    plain: the replacement in Java's syntax, of rules without hashes. parts: of rules with hashes, what a match becomes: literals, and groups as
    they are or hashed. Each group's token counts once, the hashed one if it has both; other tokens are literal. error: why the rule can't be applied.
    """

    java: str | None = None
    plain: str | None = None
    hashes: bool = False
    groups: int = 0
    parts: tuple[tuple[str | None, int, bool], ...] = ()
    error: str | None = None


def program(match: str | None, replacement: str) -> Program:
    """Compiles a rule. One that Python couldn't apply either has an error; its lines are withheld (see redact)."""
    if match is None:
        return Program(error="no pattern")
    try:
        pattern = re.compile(match)
        if re.search(r"\\H?\d\d", replacement):
            return Program(error="a replacement uses groups 1 to 9 only")
        java = java_regex(match) if never_empty(match) else None
        if _HASH not in replacement:
            pattern.sub(replacement, "") if parse_template is None else parse_template(replacement, pattern)
            plain = java_replacement(replacement)
            return Program(java if plain is not None else None, plain, groups=pattern.groups)
        # a group that may not take part can't be told from an empty one in Java
        java = java if groups_take_part(match) else None
        return Program(java, None, True, pattern.groups, _hashed_parts(replacement, pattern.groups))
    except (re.error, IndexError) as e:
        return Program(error=str(e) or "not a pattern")


def _hashed_parts(replacement: str, groups: int) -> tuple[tuple[str | None, int, bool], ...]:
    tokens = []
    for n in range(1, min(groups, 9) + 1):
        token = f"{_HASH}{n}" if f"{_HASH}{n}" in replacement else f"\\{n}"
        if token in replacement:
            tokens.append((replacement.index(token), len(token), n, _HASH in token))
    out: list[tuple[str | None, int, bool]] = []
    at = 0
    for start, size, n, hashed in sorted(tokens):
        out += [(replacement[at:start], 0, False), (None, n, hashed)]
        at = start + size
    return tuple(p for p in [*out, (replacement[at:], 0, False)] if p[0] != "")


def _in_python(text: str, rules: list[tuple[str, str, str]]) -> tuple[str, list[int], bool]:
    """The text after the rules (pattern, replacement, salt), the matches of each, and whether one failed: then the text is empty."""
    counts = []
    for match, replacement, salt in rules:
        done = program(match, replacement)
        if done.error is not None:
            return "", [*counts, *[0] * (len(rules) - len(counts))], True
        pattern = re.compile(match)
        if not done.hashes:
            text, n = pattern.subn(replacement, text)
            counts.append(n)
            continue
        pieces, at, n = [], 0, 0
        for m in pattern.finditer(text):
            groups = m.groups()
            if None in groups or any(h and not groups[g - 1] and not salt for _, g, h in done.parts):
                return "", [*counts, n, *[0] * (len(rules) - len(counts) - 1)], True
            pieces += [text[at : m.start()], *(literal if literal is not None else hashlib.md5((groups[g - 1] + salt).encode()).hexdigest() if h else groups[g - 1] for literal, g, h in done.parts)]
            at, n = m.end(), n + 1
        text = "".join([*pieces, text[at:]])
        counts.append(n)
    return text, counts, False


def _python_rule(c: Column, rule: RedactionRule) -> tuple[Column, Column, Column]:
    """For patterns that Java lacks, that match the empty string, or whose groups may not take part: vectors of texts through Python."""
    own = [(rule.match, rule.replacement, rule.hash_salt)]

    @F.pandas_udf("struct<text:string,n:int,failed:boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = [(None, [0], False) if t is None else _in_python(t, own) for t in texts]
        return pd.DataFrame([(t, n[0], f) for t, n, f in out], columns=["text", "n", "failed"])

    out = run(c)
    return out["text"], out["n"], out["failed"]


def _hashed_text(c: Column, java: Column, parts: Column, salt: Column) -> tuple[Column, Column, Column]:
    """The text with each match made of its parts, the number of matches, and whether an empty group was to be hashed without salt."""
    before = F.split(c, java, -1)
    values = F.transform(parts, lambda p: F.struct(p["text"].alias("text"), p["hashed"].alias("hashed"), F.when(p["grp"] > 0, F.regexp_extract_all(c, java, p["grp"])).alias("found")))

    def made(piece: Column, i: Column) -> Column:
        one = lambda v: F.when(v["found"].isNull(), v["text"]).otherwise(F.when(v["hashed"], F.md5(F.concat(F.get(v["found"], i), salt).cast("binary"))).otherwise(F.get(v["found"], i)))
        return F.concat(piece, F.when(i < F.size(before) - 1, F.array_join(F.transform(values, one), "")).otherwise(""))

    failed = F.exists(values, lambda v: v["hashed"] & F.exists(v["found"], lambda x: x == "")) & (salt == "")
    return F.array_join(F.transform(before, made), ""), F.size(before) - 1, F.coalesce(failed, F.lit(False))


def _native_rule(df: DataFrame, column: str, rule: RedactionRule, done: Program) -> tuple[DataFrame, Column, Column, Column]:
    """df, perhaps with a column more, and the expressions of the new text, of the number of matches and of whether the rule failed."""
    c = F.col(column)
    if not done.hashes:
        return df, F.regexp_replace(c, done.java, done.plain), F.regexp_count(c, F.lit(done.java)), F.lit(False)
    groups = sorted({g for _, g, _ in done.parts if g})
    # what lies before each match, with the match's groups; what lies after the last has none. Each array is made once for a text.
    zipped = F.arrays_zip(F.split(c, done.java, -1).alias("before"), *(F.regexp_extract_all(c, F.lit(done.java), F.lit(n)).alias(f"g{n}") for n in groups))
    name = unused(df, "pieces")

    def one(x: Column) -> Column:
        made = [F.lit(text) if text is not None else F.md5(F.concat(x[f"g{g}"], F.lit(rule.hash_salt)).cast("binary")) if hashed else x[f"g{g}"] for text, g, hashed in done.parts]
        return F.concat(x["before"], F.coalesce(F.concat(*made), F.lit(""))) if groups else x["before"]

    hashed = sorted({g for _, g, h in done.parts if h})
    failed = F.coalesce(F.exists(name, lambda x: reduce(lambda a, b: a | b, [x[f"g{g}"] == "" for g in hashed])), F.lit(False)) if hashed and not rule.hash_salt else F.lit(False)
    if not groups:
        literal = "".join(text for text, _, _ in done.parts)
        return df, F.array_join(F.split(c, done.java, -1), literal), F.regexp_count(c, F.lit(done.java)), F.lit(False)
    # two uses of a column keep Spark from computing it where it is used
    return df.withColumn(name, zipped), F.array_join(F.transform(name, one), ""), F.size(name) - 1, failed


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def redact(lines: DataFrame, rules: list[RedactionRule] | tuple[RedactionRule, ...], column: str = "message") -> DataFrame:
    """Applies the rules in order. Adds redactions, redacted, rule_matches (an array with each rule's matches) and redaction_failed.

    redactions counts the matches of each rule, in rules with hashes times the pattern's groups; redacted: whether that is any, or the line failed. A line fails where a
    rule is to hash an empty group without a salt, or has hashes and a group that takes no part in a match: it becomes empty, and no later rule is applied. A rule that can't be compiled is an error.
    """
    added = ("redactions", "redacted", "rule_matches", "redaction_failed")
    if not rules:
        return lines.withColumns(dict(zip(added, (F.lit(0), F.lit(False), F.array().cast("array<int>"), F.lit(False)))))
    df, counts, weights = lines, [], []
    bad = unused(df, "failed")
    df = df.withColumn(bad, F.lit(False))
    for rule in rules:
        done = program(rule.match, rule.replacement)
        if done.error is not None:
            raise ValueError(f"{rule.match}: {done.error}")
        before = df.columns
        df, text, n, failed = (df, *_python_rule(F.col(column), rule)) if done.java is None else _native_rule(df, column, rule, done)
        count, new = unused(df, "count"), unused(df, "text")
        ok = ~F.col(bad)
        # the count is of the text before the rule
        df = df.withColumns({count: F.when(ok, F.coalesce(n, F.lit(0))).otherwise(0), new: F.when(failed & ok, "").when(ok, text).otherwise(F.col(column)), bad: F.col(bad) | failed})
        df = df.drop(column).withColumnRenamed(new, column).select(*before, count)
        counts.append(count)
        weights.append(done.groups if done.hashes else 1)
    total = reduce(lambda a, b: a + b, (F.col(c) * w for c, w in zip(counts, weights)))
    out = df.select(*lines.columns, total.alias("redactions"), ((total > 0) | F.col(bad)).alias("redacted"), F.array(*counts).alias("rule_matches"), F.col(bad).alias("redaction_failed"))
    return out


def apply_configs(lines: DataFrame, configs: list[LogConfig], key: list[str], column: str = "message", config: str = "config", seed: int = 42) -> DataFrame:
    """Each line treated by the rules of its config (see first_matching): sampled, then redacted. Adds sample_rate, redactions, redacted. Lines without a config, or whose config has no rules, stay as they are."""
    rate, own = F.lit(1.0), F.col(config)
    for c in configs:
        if c.sampling:
            rate = F.when(own == c.name, sample_rate(F.col(column), c.sampling)).otherwise(rate)
    df = lines.withColumn("sample_rate", rate).where(kept(F.col("sample_rate"), key, seed)).withColumns({"redactions": F.lit(0), "redacted": F.lit(False)})
    for c in configs:
        if c.redaction:
            # lines of other configs are null for this config's rules
            mine = df.withColumnsRenamed({"redactions": "_so_far", "redacted": "_already"}).withColumn("_own", F.when(own == c.name, F.col(column)))
            mine = redact(mine, c.redaction, "_own").withColumns({"redactions": F.col("redactions") + F.col("_so_far"), "redacted": F.col("redacted") | F.col("_already"), column: F.coalesce("_own", column)})
            df = mine.drop("_own", "_so_far", "_already", "rule_matches", "redaction_failed")
    return df


def rule_tables(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotation rows (keys, path, value: see annotation_rules) as tables of sampling rules, redaction rules and attributes.

    keys, sampling: array of match, rate, java, error; keys, redaction: array of match, replacement, hash_salt, program; keys, attributes: map. Rules are in
    the order of their numbers. Paths: sampling_rules.N.match_expression and sampling_rate; redaction_rules.N.match_expression,
    replacement and hash_salt; attributes.NAME. No rule is left out: one without a pattern, or with one that can't be compiled, says so in its error.
    """

    @F.pandas_udf(_PROGRAM)
    def compiled(patterns: pd.Series, replacements: pd.Series) -> pd.DataFrame:
        programs = [program(p, r) for p, r in zip(patterns, replacements)]
        part = lambda x: {"text": x[0], "grp": x[1], "hashed": x[2]}
        return pd.DataFrame([(d.java, d.plain, d.hashes, d.groups, [part(x) for x in d.parts], d.error) for d in programs], columns=["java", "plain", "hashes", "groups", "parts", "error"])

    @F.pandas_udf("struct<java:string,error:string>")
    def searched(patterns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_searched(p) for p in patterns], columns=["java", "error"])

    part = lambda i: F.get("path", F.lit(i))
    long = rows.select(*keys, part(0).alias("_kind"), part(1).try_cast("int").alias("_n"), part(2).alias("_field"), "value")
    field = lambda f: F.max(F.when(F.col("_field") == f, F.col("value")))
    rules = long.where(F.col("_kind").isin("sampling_rules", "redaction_rules") & F.col("_n").isNotNull()).groupBy(*keys, "_kind", "_n").agg(field("match_expression").alias("match"), field("sampling_rate").try_cast("double").alias("rate"), F.coalesce(field("replacement"), F.lit("")).alias("replacement"), F.coalesce(field("hash_salt"), F.lit("")).alias("hash_salt"))

    def listed(rules: DataFrame, name: str, *columns: str) -> DataFrame:
        own = rules.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", *columns)), lambda a, b: a["_n"] - b["_n"]).alias("_r"))
        return own.select(*keys, F.transform("_r", lambda r: F.struct(*(r[c].alias(c) for c in columns))).alias(name))

    sampling = rules.where("_kind = 'sampling_rules'").withColumn("_s", searched("match")).select("*", "_s.java", "_s.error")
    # a rate that is no number from 0 to 1 is an error
    sampling = sampling.withColumn("error", F.coalesce("error", F.when(F.coalesce(F.col("rate").between(0, 1), F.lit(False)), None).otherwise("no rate from 0 to 1")))
    redaction = rules.where("_kind = 'redaction_rules'").withColumn("program", compiled("match", "replacement"))
    attributes = rows.where((part(0) == "attributes") & (F.size("path") > 1)).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.array_join(F.slice("path", F.lit(2), F.size("path")), ".").alias("k"), "value")))).alias("attributes"))
    return listed(sampling, "sampling", "match", "rate", "java", "error"), listed(redaction, "redaction", "match", "replacement", "hash_salt", "program"), attributes


def _searched(pattern: str | None) -> tuple[str | None, str | None]:
    if pattern is None:
        return None, "no pattern"
    try:
        return java_regex(pattern), None
    except re.error as e:
        return None, str(e)


def _python_rate(texts: pd.Series, rules: pd.Series) -> pd.Series:
    """The rate of the first rule found, by Python's re; null texts: none."""
    of = lambda t, r: next((float(x["rate"]) for x in r if x["error"] is None and re.search(x["match"], t)), None)
    return pd.Series([None if t is None else of(t, r) for t, r in zip(texts, rules)], dtype="float64")


def _python_rules(texts: pd.Series, rules: pd.Series) -> pd.DataFrame:
    out = []
    for t, r in zip(texts, rules):
        if t is None:
            out.append((None, 0, 0, False))
            continue
        text, counts, failed = _in_python(t, [(x["match"], x["replacement"], x["hash_salt"]) for x in r])
        weights = [x["program"]["groups"] if x["program"]["hashes"] else 1 for x in r]
        out.append((text, sum(counts), sum(c * w for c, w in zip(counts, weights)), failed))
    return pd.DataFrame(out, columns=["text", "matches", "redactions", "failed"])


def _step(state: Column, rule: Column) -> Column:
    """One rule of a table: expressions read its program."""
    p, text = rule["program"], state["text"]
    made, n, failed = _hashed_text(text, p["java"], p["parts"], rule["hash_salt"])
    new = lambda text, n, weight, failed: F.struct(text.alias("text"), (state["matches"] + n).cast("bigint").alias("matches"), (state["redactions"] + n * weight).cast("bigint").alias("redactions"), failed.alias("failed"))
    plain = new(F.regexp_replace(text, p["java"], p["plain"]), F.regexp_count(text, p["java"]), F.lit(1), F.lit(False))
    hashed = new(F.when(failed, "").otherwise(made), n, p["groups"], failed)
    return F.when(state["failed"] | text.isNull(), state).when(p["hashes"], hashed).otherwise(plain)


def apply_rule_tables(lines: DataFrame, sampling: DataFrame, redaction: DataFrame, on: list[str], key: list[str], column: str = "message", seed: int = 42, attributes: DataFrame | None = None, attrs: str = "attrs") -> DataFrame:
    """Lines sampled and redacted by the rules of their pod (see rule_tables): adds sample_rate, redactions, redacted, rule_matches (of all rules together), redaction_failed and rule_error.

    The rules are data: patterns that Java has are interpreted by expressions, a line whose rules have another goes through Python, by vectors, with
    all its rules. A line fails as in redact, and also where a redaction rule of its pod has an error: it is withheld (empty) rather than passed in clear. A
    sampling rule with an error is passed over, and rule_error says why. attributes: their map is merged into the column attrs, whose own entries win. A pod's
    tables are looked up by a join, which Spark broadcasts or shuffles by their size.
    """
    df = lines.join(sampling, on, "left").join(redaction, on, "left")
    c = F.col(column)
    usable = F.filter("sampling", lambda r: r["error"].isNull())
    foreign = F.exists(usable, lambda r: r["java"].isNull())
    native = F.get(F.filter(usable, lambda r: F.regexp_like(c, r["java"])), F.lit(0))["rate"]
    by_python = F.pandas_udf(_python_rate, "double")(F.when(foreign, c), F.when(foreign, F.col("sampling")))
    df = df.withColumn("sample_rate", F.coalesce(F.when(foreign, by_python).otherwise(native), F.lit(1.0))).where(kept(F.col("sample_rate"), key, seed))
    error = F.get(F.filter("redaction", lambda r: r["program"]["error"].isNotNull()), F.lit(0))["program"]["error"]
    foreign = F.exists("redaction", lambda r: r["program"]["java"].isNull())
    begin = F.struct(c.alias("text"), F.lit(0).cast("bigint").alias("matches"), F.lit(0).cast("bigint").alias("redactions"), F.lit(False).alias("failed"))
    done, wrong, other = unused(df, "done"), unused(df, "wrong"), unused(df, "other")
    df = df.withColumns({wrong: error, other: F.coalesce(foreign, F.lit(False))})
    by_python = F.pandas_udf(_python_rules, "struct<text:string,matches:bigint,redactions:bigint,failed:boolean>")(F.when(F.col(other) & F.col(wrong).isNull(), c), F.when(F.col(other) & F.col(wrong).isNull(), F.col("redaction")))
    withheld = F.struct(F.when(c.isNotNull(), "").alias("text"), F.lit(0).cast("bigint").alias("matches"), F.lit(0).cast("bigint").alias("redactions"), F.lit(True).alias("failed"))
    df = df.withColumn(done, F.when(F.col(wrong).isNotNull(), withheld).when(F.col("redaction").isNull(), begin).when(F.col(other), by_python).otherwise(F.aggregate("redaction", begin, _step)))
    out = df.withColumns({"redactions": F.col(done)["redactions"], "redacted": (F.col(done)["redactions"] > 0) | F.col(done)["failed"], "rule_matches": F.col(done)["matches"], "redaction_failed": F.col(done)["failed"]})
    out = out.withColumn("rule_error", F.coalesce(F.col(wrong), F.get(F.filter("sampling", lambda r: r["error"].isNotNull()), F.lit(0))["error"])).withColumn(column, F.col(done)["text"]).drop(done, wrong, other, "sampling", "redaction")
    if attributes is None:
        return out
    own = F.col(attrs) if attrs in lines.columns else F.lit(None).cast("map<string,string>")
    return out.join(attributes, on, "left").withColumn(attrs, merge_attrs(F.col("attributes"), own)).drop("attributes")
