"""Queries over lines: the documents of each source are the lines of a log, events are JSON, container and syslog lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from logspark.functions import dates, text
from logspark.model import Grouper, LogConfig, RedactionRule, SamplingRule
from logspark.operators import lines as L
from logspark.operators import parse, sequence
from logspark.operators.joins import first_matching
from logspark.operators.ordered import running
from logspark.operators.reports import rule_report
from logspark.operators.rules import apply_configs, apply_rule_tables, redact, rule_tables, sample
from logspark.plans import pipelines
from logspark.plans.registry import query, table
from logspark.sources.files import document_lines, line_block, newest_rotation, order_rotations

LINES = """L AS (SELECT coalesce(source, '') AS log_path, doc_id * 2147483648 + pos AS line_seq, raw, strlen(raw) + 1 AS raw_len FROM
 (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL))"""


def _grouped_sql(start: str, pattern: str, step: str) -> str:
    return f"""WITH RECURSIVE {LINES},
 N AS (SELECT *, row_number() OVER (PARTITION BY log_path ORDER BY line_seq) AS rn, regexp_matches(raw, '{start}') AS s, regexp_matches(raw, '{pattern}') AS p FROM L),
 R AS (SELECT log_path, rn, false AS g FROM N WHERE rn = 1 UNION ALL
  SELECT n.log_path, n.rn, {step} FROM R JOIN N b ON b.log_path = R.log_path AND b.rn = R.rn JOIN N n ON n.log_path = R.log_path AND n.rn = R.rn + 1),
 G AS (SELECT N.*, sum(CASE WHEN R.g THEN 0 ELSE 1 END) OVER (PARTITION BY N.log_path ORDER BY N.rn) AS gid FROM N JOIN R USING (log_path, rn))
 SELECT log_path, min(line_seq) AS line_seq, count(*) AS n_lines, string_agg(raw, chr(10) ORDER BY line_seq) AS message FROM G GROUP BY log_path, gid"""


@query(_grouped_sql("^[A-E]", "^[A-P]", "n.p AND (R.g OR b.s)"))
def group_continue_through(spark, sf_dir):
    return L.group_lines(document_lines(spark, sf_dir), Grouper("continueThrough", "^[A-E]", "^[A-P]"), block=line_block())


@query(_grouped_sql("^[A-F]", "en", "CASE WHEN R.g THEN b.p ELSE b.s END"))
def group_continue_past(spark, sf_dir):
    return L.group_lines(document_lines(spark, sf_dir), Grouper("continuePast", "^[A-F]", "en"), block=line_block())


@query(_grouped_sql("^[A-M]", "^[N-Z]", "NOT n.p AND (R.g OR b.s)"))
def group_halt_before(spark, sf_dir):
    return L.group_lines(document_lines(spark, sf_dir), Grouper("haltBefore", "^[A-M]", "^[N-Z]"), block=line_block())


@query(_grouped_sql("^[A-F]", "[a-m][.]$", "CASE WHEN R.g THEN NOT b.p ELSE b.s END"))
def group_halt_with(spark, sf_dir):
    return L.group_lines(document_lines(spark, sf_dir), Grouper("haltWith", "^[A-F]", "[a-m][.]$"), block=line_block())


@query(f"""WITH RECURSIVE {LINES},
 N AS (SELECT *, row_number() OVER (PARTITION BY log_path ORDER BY line_seq) AS rn, regexp_matches(raw, '^[A-D]') AS s1, regexp_matches(raw, 'e[.]$') AS p1, regexp_matches(raw, '^[A-M]') AS s2, regexp_matches(raw, '^[E-Z]') AS p2 FROM L),
 R AS (SELECT log_path, rn, CASE WHEN s1 THEN 1 WHEN s2 THEN 2 ELSE 0 END AS k, true AS o, false AS g FROM N WHERE rn = 1 UNION ALL
  SELECT n.log_path, n.rn, CASE WHEN (R.k = 1 AND R.o) OR (R.k = 2 AND n.p2) THEN R.k WHEN s1 THEN 1 WHEN s2 THEN 2 ELSE 0 END,
   CASE WHEN R.k = 1 AND R.o THEN NOT n.p1 ELSE true END, (R.k = 1 AND R.o) OR (R.k = 2 AND n.p2) FROM R JOIN N n ON n.log_path = R.log_path AND n.rn = R.rn + 1),
 G AS (SELECT N.*, sum(CASE WHEN R.g THEN 0 ELSE 1 END) OVER (PARTITION BY N.log_path ORDER BY N.rn) AS gid FROM N JOIN R USING (log_path, rn))
 SELECT log_path, min(line_seq) AS line_seq, count(*) AS n_lines, string_agg(raw, chr(10) ORDER BY line_seq) AS message FROM G GROUP BY log_path, gid""")
def group_several(spark, sf_dir):
    groupers = [Grouper("haltWith", "^[A-D]", r"e[.]$"), Grouper("continueThrough", "^[A-M]", "^[E-Z]")]
    return L.group_lines_by(document_lines(spark, sf_dir), groupers, max_bytes=1 << 30)


_RULES = (SamplingRule("^[A-C]", 0), SamplingRule("en", 1), SamplingRule("^[M-Z]", 0))


@query(f"WITH {LINES} SELECT log_path, line_seq, 1.0::DOUBLE AS sample_rate FROM L WHERE CASE WHEN regexp_matches(raw, '^[A-C]') THEN false WHEN regexp_matches(raw, 'en') THEN true WHEN regexp_matches(raw, '^[M-Z]') THEN false ELSE true END")
def sample_first_match(spark, sf_dir):
    return sample(document_lines(spark, sf_dir), _RULES, ["log_path", "line_seq"], "raw").select("log_path", "line_seq", "sample_rate")


@query(f"""WITH {LINES} SELECT log_path, line_seq, regexp_replace(regexp_replace(raw, '([a-z]+)en([a-z]*)', '<\\2$\\1>', 'g'), '[0-9]+', '#', 'g') AS raw,
 len(regexp_extract_all(raw, '([a-z]+)en([a-z]*)')) + len(regexp_extract_all(regexp_replace(raw, '([a-z]+)en([a-z]*)', '<\\2$\\1>', 'g'), '[0-9]+')) AS redactions FROM L""")
def redact_plain(spark, sf_dir):
    rules = [RedactionRule("([a-z]+)en([a-z]*)", r"<\2$\1>"), RedactionRule("[0-9]+", "#")]
    out = redact(document_lines(spark, sf_dir), rules, "raw")
    return out.select("log_path", "line_seq", "raw", F.col("redactions").cast("long").alias("redactions"))


@query(f"""WITH {LINES}, M AS (SELECT log_path, line_seq, raw, string_split_regex(raw, '([A-Z][a-z]+)') AS parts, regexp_extract_all(raw, '([A-Z][a-z]+)', 1) AS words FROM L)
 SELECT log_path, line_seq, CASE WHEN len(words) = 0 THEN raw ELSE parts[1] || array_to_string(list_transform(range(1, len(words) + 1), lambda i: 'u=' || md5(words[i] || 'salt') || coalesce(parts[i + 1], '')), '') END AS raw, len(words) AS redactions FROM M""")
def redact_hash(spark, sf_dir):
    out = redact(document_lines(spark, sf_dir), [RedactionRule("([A-Z][a-z]+)", r"u=\H1", "salt")], "raw")
    return out.select("log_path", "line_seq", "raw", F.col("redactions").cast("long").alias("redactions"))


@query(f"""WITH {LINES}, M AS (SELECT log_path, line_seq, coalesce(sum(raw_len) OVER (PARTITION BY log_path ORDER BY line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM L)
 SELECT log_path, line_seq, sha256(log_path || '#' || CAST(CAST(b // 50000 AS BIGINT) AS VARCHAR)) AS seq_id, CAST(b % 50000 AS BIGINT) AS seq_num FROM M""")
def sequence_numbers(spark, sf_dir):
    return sequence.sequence(document_lines(spark, sf_dir), 50_000, block=line_block()).select("log_path", "line_seq", "seq_id", "seq_num")


@query(f"""WITH {LINES}, M AS (SELECT log_path, line_seq, CAST(coalesce(sum(raw_len) OVER (PARTITION BY log_path ORDER BY line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM L),
 P AS (SELECT *, b // 50000 AS e, b % 50000 AS n, lag(b // 50000) OVER w AS le, lag(b % 50000) OVER w AS ln FROM M WINDOW w AS (PARTITION BY log_path ORDER BY line_seq))
 SELECT log_path, line_seq, CASE WHEN le IS DISTINCT FROM e THEN e ELSE -1 END AS si, CASE WHEN le IS DISTINCT FROM e THEN n ELSE -1 END AS sn, CASE WHEN le = e THEN n - ln ELSE -1 END AS sd FROM P""")
def encode_sequence(spark, sf_dir):
    lines = running(document_lines(spark, sf_dir).withColumn("_b", line_block()), ["log_path"], ["line_seq"], F.col("raw_len").cast("long"), "_at", before=True, block="_b").drop("_b")
    df = sequence.sequence(lines, 50_000, block=line_block())
    # the number of an id in its log stands for the id
    df = df.withColumn("seq_id", F.coalesce(F.floor(F.col("_at") / 50_000), F.lit(0)))
    return sequence.encode_sequence(df, ["log_path"], ["line_seq"], block=line_block()).select("log_path", "line_seq", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("si", "sn", "sd")))


@query("""WITH E AS (SELECT event_id, user_id, epoch_us(ts) // 100000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
 SELECT event_id, CAST(max(t - n) OVER (PARTITION BY user_id ORDER BY event_id) + n AS BIGINT) AS t FROM E""")
def monotonic_ts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100_000_000).alias("t"))
    return sequence.monotonic_time(e, ["user_id"], ["event_id"], "t", block=F.floor(F.col("event_id") / 2000)).select("event_id", "t")


@query("""WITH E AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS v FROM events),
 S AS (SELECT *, count(*) FILTER (v IS NULL) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM E),
 M AS (SELECT *, max(v) OVER (PARTITION BY user_id, s ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM S)
 SELECT event_id, coalesce(v, -1) AS v FROM M WHERE v IS NULL OR m IS NULL OR v > m""")
def fresh_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.floor("value")).alias("v"))
    return sequence.fresh_versions(e, ["user_id"], ["event_id"], "v", block=F.floor(F.col("event_id") / 2000)).select("event_id", F.coalesce("v", F.lit(-1)).alias("v"))


_BACKLOG = "sum(raw_len) > CASE WHEN log_path LIKE 'src1%' THEN 150000 ELSE 120000 END"


@query(f"WITH {LINES} SELECT log_path, count(*) AS lines FROM L GROUP BY 1 HAVING NOT ({_BACKLOG})")
def trim_backlog(spark, sf_dir):
    """Logs that begin with src1 are known, others new."""
    df = document_lines(spark, sf_dir)
    known = df.select("log_path").distinct().where("log_path like 'src1%'")
    return sequence.trim_backlog(df, known, 120_000, 150_000).groupBy("log_path").agg(F.count("*").alias("lines"))


@query(f"WITH {LINES} SELECT log_path, CAST(sum(raw_len) AS BIGINT) AS bytes, count(*) AS lines, {_BACKLOG} AS skipped FROM L GROUP BY 1")
def backlog(spark, sf_dir):
    df = document_lines(spark, sf_dir)
    known = df.select("log_path").distinct().where("log_path like 'src1%'")
    return sequence.backlog(df, known, 120_000, 150_000)


@query(f"""WITH {LINES}, M AS (SELECT log_path, line_seq, raw, CASE WHEN log_path LIKE 'src1%' THEN 'one' WHEN log_path LIKE 'src2%' THEN 'two' ELSE '' END AS config FROM L)
 SELECT log_path, line_seq, config, CASE config WHEN 'one' THEN regexp_replace(raw, '[A-Z]', 'X', 'g') WHEN 'two' THEN regexp_replace(raw, '[0-9]+', '#', 'g') ELSE raw END AS message,
  CASE config WHEN 'one' THEN len(regexp_extract_all(raw, '[A-Z]')) WHEN 'two' THEN len(regexp_extract_all(raw, '[0-9]+')) ELSE 0 END AS redactions FROM M WHERE NOT (config = 'one' AND regexp_matches(raw, '^[A-C]'))""")
def config_rules(spark, sf_dir):
    """Each log is sampled and redacted by the rules of its own config."""
    configs = [LogConfig("one", path="src1*", sampling=(SamplingRule("^[A-C]", 0),), redaction=(RedactionRule("[A-Z]", "X"),)), LogConfig("two", path="src2*", redaction=(RedactionRule("[0-9]+", "#"),))]
    df = first_matching(document_lines(spark, sf_dir).withColumnRenamed("raw", "message"), configs)
    out = apply_configs(df, configs, ["log_path", "line_seq"])
    return out.select("log_path", "line_seq", F.coalesce("config", F.lit("")).alias("config"), "message", F.col("redactions").cast("long").alias("redactions"))


@query("""WITH T AS (SELECT conv_id, turn, coalesce(text, '') AS t, conv_id % 3 AS k FROM conversations)
 SELECT conv_id, turn, CASE WHEN k = 0 THEN replace(replace(t, 'the', '*'), 'a', '$1') ELSE t END AS message, 1.0::DOUBLE AS sample_rate, k = 0 AND (contains(t, 'the') OR contains(t, 'a')) AS redacted
 FROM T WHERE NOT (k = 1 AND contains(t, 'is') AND NOT contains(t, 'e'))""")
def annotation_rule_tables(spark, sf_dir):
    """Conversations as pods whose annotations carry sampling and redaction rules, applied to their turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("message"))
    key = lambda k: F.lit("log.config/" + k)
    red = F.create_map(key("redaction_rules.1.match_expression"), F.lit("a"), key("redaction_rules.1.replacement"), F.lit("$1"), key("redaction_rules.0.match-expression"), F.lit("the"), key("redaction_rules.0.replacement"), F.lit("*"))
    sam = F.create_map(key("sampling_rules.0.match_expression"), F.lit("e"), key("sampling_rules.0.sampling_rate"), F.lit("1"), key("sampling_rules.1.match_expression"), F.lit("is"), key("sampling_rules.1.sampling_rate"), F.lit("0"))
    k = F.col("conv_id") % 3
    pods = c.select("conv_id").distinct().withColumn("annotations", F.when(k == 0, red).when(k == 1, sam))
    sampling, redaction, _ = rule_tables(parse.annotation_rules(pods, ["conv_id"], "log.config/"), ["conv_id"])
    out = apply_rule_tables(c, sampling, redaction, ["conv_id"], ["conv_id", "turn"])
    return out.select("conv_id", "turn", "message", "sample_rate", "redacted")


@query(r"""WITH T AS (SELECT conv_id, turn, coalesce(text, '') AS t, conv_id % 5 AS k FROM conversations),
 P AS (SELECT *, string_split_regex(t, '([a-z]+)ing') AS parts, regexp_extract_all(t, '([a-z]+)ing', 1) AS words, '-' || regexp_replace(regexp_replace(t, '([^x])', '\1-', 'g'), 'x+', '-', 'g') AS dashed FROM T),
 M AS (SELECT *, CASE k WHEN 0 THEN parts[1] || array_to_string(list_transform(range(1, len(words) + 1), lambda i: '<' || md5(words[i] || 's') || '>' || coalesce(parts[i + 1], '')), '')
  WHEN 1 THEN regexp_replace(t, '([a-z])e', '\1_', 'g') WHEN 2 THEN dashed WHEN 4 THEN '' ELSE t END AS message,
  CASE k WHEN 0 THEN len(words) WHEN 1 THEN len(regexp_extract_all(t, '[a-z]e')) WHEN 2 THEN length(dashed) - length(replace(t, 'x', '')) ELSE 0 END AS redactions FROM P)
 SELECT conv_id, turn, message, redactions, redactions > 0 OR k = 4 AS redacted, k = 4 AS redaction_failed, CASE WHEN k = 1 THEN 'core' ELSE '' END AS team FROM M WHERE NOT (k = 3 AND (contains(t, 'en') OR contains(t, 't')))""")
def annotation_rule_programs(spark, sf_dir):
    """Rules as data: hashes with a salt, groups, a pattern that may match nothing, one that only Python has, one that is none, and attributes."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("message"))

    def annotations(rules: dict[str, str]):
        return F.create_map(*(F.lit(x) for k, v in rules.items() for x in ("log.config/" + k, v)))

    red, sam = "redaction_rules.0.", "sampling_rules.0."
    of = {
        0: {red + "match_expression": "([a-z]+)ing", red + "replacement": r"<\H1>", red + "hash_salt": "s"},
        1: {red + "match-expression": "([a-z])e", red + "replacement": r"\1_", "attributes.team": "core"},
        2: {red + "match_expression": "x*", red + "replacement": "-"},
        3: {sam + "match_expression": "(e)?(?(1)n|t)", sam + "sampling_rate": "0"},
        4: {red + "match_expression": "("},
    }
    own = F.coalesce(*(F.when(F.col("conv_id") % 5 == k, annotations(rules)) for k, rules in of.items()))
    pods = c.select("conv_id").distinct().withColumn("annotations", own)
    sampling, redaction, attributes = rule_tables(parse.annotation_rules(pods, ["conv_id"], "log.config/"), ["conv_id"])
    out = apply_rule_tables(c, sampling, redaction, ["conv_id"], ["conv_id", "turn"], attributes=attributes)
    return out.select("conv_id", "turn", "message", "redactions", "redacted", "redaction_failed", F.coalesce(F.try_element_at("attrs", F.lit("team")), F.lit("")).alias("team"))


@query("""WITH F AS (SELECT doc_id, coalesce(lang, '') || '/' || coalesce(source, '') AS output FROM documents), K AS (SELECT output FROM F GROUP BY 1 ORDER BY min(doc_id) LIMIT 25)
 SELECT doc_id, CASE WHEN output IN (SELECT output FROM K) THEN output ELSE 'base' END AS output FROM F""")
def cap_outputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit(""))).alias("output"))
    return sequence.cap_outputs(d, "output", ["doc_id"], 25, "base").select("doc_id", "output")


@query("""WITH RECURSIVE E AS (SELECT coalesce(source, '') AS session, doc_id AS position, strlen(text) AS size, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS rn FROM documents),
 R AS (SELECT session, position, size, rn, size AS fill, 0 AS batch_id FROM E WHERE rn = 1 UNION ALL
 SELECT e.session, e.position, e.size, e.rn, CASE WHEN R.fill + e.size > 20000 THEN e.size ELSE R.fill + e.size END, CASE WHEN R.fill + e.size > 20000 THEN batch_id + 1 ELSE batch_id END FROM R JOIN E e ON e.session = R.session AND e.rn = R.rn + 1)
 SELECT session, position, size, CAST(batch_id AS BIGINT) AS batch_id FROM R""")
def pack_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", "text")
    return sequence.pack_batches(d, "source", "doc_id", F.octet_length("text"), 20_000)


@query("""SELECT doc_id, CAST(i AS INT) AS fragment, CAST(i * 1000 AS BIGINT) AS fragment_offset, md5(substr(h, i * 2000 + 1, 2000)) AS piece FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(greatest(1, (strlen(text) + 999) // 1000))) AS i FROM documents WHERE text IS NOT NULL)""")
def fragment_lines(spark, sf_dir):
    """The bytes of every piece of every document, cut characters included."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("message"))
    return L.fragment_lines(d, 1000).select("doc_id", "fragment", "fragment_offset", F.md5(F.hex("piece").cast("binary")).alias("piece"))


def _json_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    ok = F.to_json(F.struct(F.concat(F.lit("said "), "event_type").alias("log"), time.alias("time"), F.col("user_id").alias("user"), F.from_json("props", "struct<k:int>").alias("props")))
    bad = F.when(F.col("event_id") % 11 == 0, F.lit('{"nolog": 1}')).when(F.col("event_id") % 11 == 1, F.lit("{broken")).when(F.col("event_id") % 11 == 2, F.lit('{"log": 5}'))
    return e.select(F.col("user_id").cast("string").alias("log_path"), F.col("event_id").alias("line_seq"), F.coalesce(bad, ok).alias("raw"))


@query("""SELECT event_id AS line_seq, CASE event_id % 11 WHEN 0 THEN '{"nolog": 1}' WHEN 1 THEN '{broken' WHEN 2 THEN '{"log": 5}' ELSE 'said ' || event_type END AS message,
 CASE WHEN event_id % 11 > 2 THEN epoch_ns(ts) ELSE -1 END AS ts_nanos, CASE WHEN event_id % 11 > 2 THEN CAST(user_id AS VARCHAR) END AS user, CASE WHEN event_id % 11 > 2 THEN replace(props, ' ', '') END AS props FROM events""")
def json_attrs(spark, sf_dir):
    out = L.parse_json_lines(_json_lines(spark, sf_dir))
    return out.select("line_seq", "message", F.coalesce("ts_nanos", F.lit(-1)).alias("ts_nanos"), F.try_element_at("attrs", F.lit("user")).alias("user"), F.try_element_at("attrs", F.lit("props")).alias("props"))


@query("""WITH C AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 1 THEN chr(10) ELSE '' END AS m, turn % 3 = 1 AS e FROM conversations),
 G AS (SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM C)
 SELECT CAST(conv_id AS VARCHAR) AS log_path, min(turn) AS line_seq, count(*) AS n_pieces, string_agg(m, '' ORDER BY turn) AS message, min(turn) * 10 AS ts_nanos FROM G GROUP BY conv_id, g""")
def merge_json_pieces(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    df = c.select(F.col("conv_id").cast("string").alias("log_path"), F.col("turn").alias("line_seq"), F.concat("text", F.when(F.col("turn") % 3 == 1, "\n").otherwise("")).alias("message"), (F.col("turn") * 10).alias("ts_nanos"), text.empty_map().alias("attrs"))
    return L.merge_pieces(df).select("log_path", "line_seq", "n_pieces", "message", "ts_nanos")


def _cri_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    tag = F.when(F.col("event_id") % 4 < 2, "P").when(F.col("event_id") % 4 == 2, "F").otherwise("F:x")
    stream = F.when(F.col("event_id") % 13 == 0, "stdlog").when(F.col("event_id") % 3 == 0, "stderr").otherwise("stdout")
    raw = F.concat_ws(" ", F.when(F.col("event_id") % 17 == 0, "2024-15-01T00:00:00Z").otherwise(time), stream, tag, F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")))
    return e.select(F.col("user_id").cast("string").alias("log_path"), F.col("event_id").alias("line_seq"), raw.alias("raw"))


@query("""WITH C AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'stderr' ELSE 'stdout' END AS stream, epoch_ns(ts) + 789 AS t, event_type || ' ' || event_id AS m, event_id % 4 >= 2 AS whole FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0),
 G AS (SELECT *, coalesce(sum(whole::INT) OVER (PARTITION BY user_id, stream ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM C)
 SELECT CAST(user_id AS VARCHAR) AS log_path, stream, min(event_id) AS line_seq, arg_min(t, event_id) AS ts_nanos, count(*) AS n_pieces, string_agg(m, '' ORDER BY event_id) AS message, NOT bool_or(whole) AS partial FROM G GROUP BY user_id, stream, g""")
def cri_messages(spark, sf_dir):
    return L.reassemble_cri(L.parse_cri(_cri_lines(spark, sf_dir)))


@query("""WITH RECURSIVE C AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'stderr' ELSE 'stdout' END AS stream, epoch_ns(ts) + 789 AS t, event_type || ' ' || event_id AS m, event_id % 4 >= 2 AS whole FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0),
 N AS (SELECT *, row_number() OVER (PARTITION BY user_id, stream ORDER BY event_id) AS rn FROM C),
 R AS (SELECT user_id, stream, rn, strlen(m) AS size, whole OR strlen(m) >= 30 AS done, 0 AS g FROM N WHERE rn = 1 UNION ALL
  SELECT n.user_id, n.stream, n.rn, CASE WHEN R.done THEN 0 ELSE R.size END + strlen(n.m), n.whole OR CASE WHEN R.done THEN 0 ELSE R.size END + strlen(n.m) >= 30, CASE WHEN R.done THEN g + 1 ELSE g END FROM R JOIN N n ON n.user_id = R.user_id AND n.stream = R.stream AND n.rn = R.rn + 1)
 SELECT CAST(n.user_id AS VARCHAR) AS log_path, n.stream AS stream, min(event_id) AS line_seq, arg_min(t, event_id) AS ts_nanos, count(*) AS n_pieces, string_agg(m, '' ORDER BY event_id) AS message, NOT bool_or(R.done) AS partial FROM N n JOIN R ON n.user_id = R.user_id AND n.stream = R.stream AND n.rn = R.rn GROUP BY n.user_id, n.stream, g""")
def cri_messages_cut(spark, sf_dir):
    return L.reassemble_cri(L.parse_cri(_cri_lines(spark, sf_dir)), max_bytes=30)


@query("""SELECT CASE WHEN event_id % 13 = 0 THEN 'stream' WHEN event_id % 17 = 0 THEN 'time' END AS error, count(*) AS lines FROM events GROUP BY 1""")
def cri_rejects(spark, sf_dir):
    return L.parse_cri(_cri_lines(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("lines"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -1 ELSE epoch_ns(ts) // 1000 * 1000 + CASE WHEN event_id % 9 = 1 THEN 0 ELSE 123 END - CASE WHEN event_id % 9 = 2 THEN 19800000000000 ELSE 0 END END AS nanos,
 CASE WHEN event_id % 9 = 0 THEN -1 ELSE epoch_us(ts) - CASE WHEN event_id % 9 = 2 THEN 19800000000 ELSE 0 END END AS micros FROM events""")
def parse_rfc3339(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.col("event_id") % 9
    s = F.when(k == 0, F.lit("2024-13-01T00:00:00Z")).when(k == 1, base).when(k == 2, F.concat(base, F.lit("123+05:30"))).otherwise(F.concat(base, F.lit("123456Z")))
    return e.select("event_id", F.coalesce(dates.rfc3339_nanos(s), F.lit(-1)).alias("nanos"), F.coalesce(F.unix_micros(dates.rfc3339_ts(s)), F.lit(-1)).alias("micros"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || 'Z' AS shown, epoch_us(ts) AS micros, 'x ' || event_type AS rest, epoch_us(date_trunc('second', ts)) AS time_micros FROM events")
def time_formats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" x "), "event_type")
    time, rest = dates.leading_time(line)
    return e.select("event_id", dates.format_time(F.col("ts")).alias("shown"), dates.epoch_micros(F.col("ts")).alias("micros"), rest.alias("rest"), F.unix_micros(time).alias("time_micros"))


@query("""SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 34 ELSE -1 END AS priority, CASE WHEN event_id % 10 <> 0 THEN 'host' || user_id END AS hostname, CASE WHEN event_id % 10 <> 0 THEN event_type END AS appname FROM events""")
def parse_syslog(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    app = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit("[12]"))).otherwise(F.col("event_type"))
    good = F.concat(F.lit("<34>"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), F.col("user_id").cast("string"), F.lit(" "), app, F.lit(": it's here"))
    df = e.select("event_id", F.when(F.col("event_id") % 10 == 0, "no syslog").otherwise(good).alias("raw"))
    return parse.parse_syslog(df).select("event_id", F.coalesce("priority", F.lit(-1)).alias("priority"), "hostname", "appname")


@query("""SELECT CAST(user_id AS VARCHAR) AS conn_id, count(*) AS frames, CAST(sum(strlen(event_type || ' ' || event_id)) AS BIGINT) AS bytes, count(*) AS complete, sha256(string_agg(event_type || ' ' || event_id, '|' ORDER BY event_id)) AS digest FROM events GROUP BY 1""")
def syslog_frames(spark, sf_dir):
    """Frames, counted and by line in turn, joined per connection and cut into chunks of 37 bytes."""
    e = table(spark, sf_dir, "events").withColumn("m", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")))
    framed = e.select(F.col("user_id").cast("string").alias("conn_id"), "event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.octet_length("m").cast("string"), F.lit(" "), "m")).otherwise(F.concat("m", F.lit("\n"))).alias("f"))
    whole = framed.groupBy("conn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "f"))), lambda x: x["f"]), "").alias("all"))
    chunks = whole.select("conn_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("all") - 1) / 37).cast("int"))).alias("chunk_seq"), "all")
    chunks = chunks.select("conn_id", "chunk_seq", F.substring("all", F.col("chunk_seq") * 37 + 1, F.lit(37)).cast("binary").alias("payload"))
    out = parse.split_syslog_frames(chunks)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_seq", F.decode("frame", "UTF-8").alias("f")))), lambda x: x["f"]), "|")
    return out.groupBy("conn_id").agg(F.count("*").alias("frames"), F.sum(F.octet_length("frame")).alias("bytes"), F.count_if("complete").alias("complete"), F.sha2(body, 256).alias("digest"))


@query("""SELECT page_id, CASE WHEN strlen(s) = 0 THEN '' ELSE s END AS output, length(s0) AS output_chars FROM (SELECT page_id, s0, CASE WHEN length(s0) > 60 THEN substr(s0, 1, 60) || '...' ELSE s0 END AS s FROM (SELECT page_id, CASE WHEN regexp_matches(html, '<title>([^<]*)</title>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE trim(string_split(ltrim(html), chr(10))[1]) END AS s0 FROM pages))""")
def summarise_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    s = text.summarise_output(F.col("html"), "<title>([^<]*)</title>", max_chars=60)
    return p.select("page_id", s["output"].alias("output"), s["output_chars"].alias("output_chars"))


@query("SELECT doc_id, substr(translate(text, chr(10) || chr(13), '  '), 1, 80) AS line FROM documents")
def one_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.one_line(F.col("text"), 80).alias("line"))


@query("""WITH P AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+:', ''), '[?#].*', '') AS p FROM pages), S AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM P)
 SELECT page_id, CASE WHEN len(s) >= 2 THEN s[2] || '/log/' || s[len(s)] ELSE p END AS logfile FROM S""")
def rename_logs(spark, sf_dir):
    """Paths without the template's parts stay as they are."""
    p = table(spark, sf_dir, "pages").withColumn("log_path", F.regexp_replace(F.regexp_replace("url", "^[a-z]+:", ""), r"[?#].*", ""))
    return text.rename_log(p, "${PATH2}/log/${BASENAME}").select("page_id", "logfile")


@query("""WITH F AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'c' || o_custkey || '.log' WHEN 1 THEN 'c' || o_custkey || '.log.' || (o_orderkey % 9 + 1) WHEN 2 THEN 'c' || o_custkey || '-' || strftime(o_orderdate, '%Y%m%d') || '.log' ELSE 'c' || o_custkey || '.log.1.gz' END AS path, o_orderdate AS m, o_custkey FROM orders)
 SELECT 'c' || o_custkey || '.log' AS base, arg_max(path, (m, path)) AS candidate FROM F WHERE o_orderkey % 4 IN (1, 2) GROUP BY 1""")
def newest_rotations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c, k = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderkey") % 4
    path = F.when(k == 0, F.concat(c, F.lit(".log"))).when(k == 1, F.concat(c, F.lit(".log."), (F.col("o_orderkey") % 9 + 1).cast("string"))).when(k == 2, F.concat(c, F.lit("-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".log"))).otherwise(F.concat(c, F.lit(".log.1.gz")))
    return newest_rotation(order_rotations(o.select(path.alias("path"), F.col("o_orderdate").alias("modified"))))


_EVENTS = _grouped_sql("^[A-E]", "^[A-P]", "n.p AND (R.g OR b.s)").replace("SELECT log_path, min(line_seq) AS line_seq, count(*) AS n_lines, string_agg", ", EV AS (SELECT log_path, string_agg")
_SKIPPED = "log_path LIKE '%9'"


@query(f"""{_EVENTS}), K AS (SELECT log_path, strlen(message) + 1 AS raw_len, regexp_matches(message, '^[A-C]') AS dropped, regexp_matches(message, '[0-9]+') AS red, strlen(message) + 1 > 1000 AS failed, {_SKIPPED} AS skipped FROM EV),
 C AS (SELECT *, NOT dropped AND NOT failed AND NOT skipped AS copied FROM K)
 SELECT log_path, count(*) AS lines_read, CAST(sum(raw_len) AS BIGINT) AS bytes_read, count(*) FILTER (WHERE copied) AS lines_copied, CAST(coalesce(sum(CASE WHEN copied THEN raw_len END), 0) AS BIGINT) AS bytes_copied,
 count(*) FILTER (WHERE dropped) AS lines_dropped, CAST(coalesce(sum(CASE WHEN dropped THEN raw_len END), 0) AS BIGINT) AS bytes_dropped, count(*) FILTER (WHERE red AND copied) AS lines_redacted,
 count(*) FILTER (WHERE failed) AS lines_failed, CAST(coalesce(sum(CASE WHEN failed THEN raw_len END), 0) AS BIGINT) AS bytes_failed, count(*) FILTER (WHERE skipped) AS lines_skipped, CAST(coalesce(sum(CASE WHEN skipped THEN raw_len END), 0) AS BIGINT) AS bytes_skipped FROM C GROUP BY log_path""")
def log_pipeline_report(spark, sf_dir):
    """The flagship: lines are grouped, sampled, redacted and counted for each log. Events over 1000 bytes fail, logs whose name ends in 9 are skipped."""
    rules = (SamplingRule("^[A-C]", 0),)
    grouper = Grouper("continueThrough", "^[A-E]", "^[A-P]")
    return pipelines.log_report(document_lines(spark, sf_dir), grouper, rules, (RedactionRule("[0-9]+", "#"),), block=line_block(), max_bytes=1000, skipped=F.col("log_path").like("%9"))


@query(f"""WITH {LINES}, M AS (SELECT log_path, len(regexp_extract_all(raw, '[0-9]+')) AS a, len(regexp_extract_all(regexp_replace(raw, '[0-9]+', '#', 'g'), 'the')) AS b FROM L)
 SELECT log_path, CAST(rule AS INT) AS rule, CAST(sum(n) AS BIGINT) AS matches, count(*) FILTER (WHERE n > 0) AS lines FROM (SELECT log_path, 0 AS rule, a AS n FROM M UNION ALL SELECT log_path, 1, b FROM M) GROUP BY ALL""")
def redaction_rule_report(spark, sf_dir):
    return rule_report(redact(document_lines(spark, sf_dir), [RedactionRule("[0-9]+", "#"), RedactionRule("the", "a")], "raw"), ["log_path"])
