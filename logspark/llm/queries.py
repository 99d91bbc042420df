"""The queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import bpe, chat, collocations, lines, mixing, mpegts, negatives, ranges, repetition, separators, simhash, substrings, warc
from logspark.llm.common import shared_dir

#: Paths of vocabularies are parameters; this one is the queries'.
VOCABULARY = "byte_bpe_50k.tiktoken"
EOD = 50_256


def _vocabulary() -> bytes:
    return bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))


def op1_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.near_duplicates(docs, n=4, radius=4)


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = repetition.verdict(repetition.measure(docs))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_dir(spark, "warc")
    warc.write_archives(pages, folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    turns = rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.read_back(chat.format_turns(turns))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that go, of all lines that have a word; documents without such a line aren't listed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lines.repeated_lines(docs, min_chars=1).select(F.col("doc").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = mpegts.pack_media(mpegts.padded_texts(docs, "doc_id", "text")).drop("payload")
    return mpegts.read_media(stored, ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.round_trip_digests(docs, _vocabulary(), public_tokenizers.PATTERN)


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, by a scan of flat files of their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "tokens")
    written = separators.write_token_files(docs, folder, _vocabulary(), public_tokenizers.PATTERN, EOD)
    counts = separators.count_tokens(spark, folder, EOD)
    return written.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start_token", "n_tokens")


def op11_quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return collocations.collocations(docs)


def op12_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), anchor=F.col("vec_id") % 100 == 0)


def op13_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.range_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pivotal_mix, op2_simhash_trees, op3_repetition_rules, op4_warc_archives, op5_chat_parts, op6_fuzzy_lines, op7_transport_streams, op8_repeated_bytes, op9_byte_bpe, op10_separator_scan, op11_quotient_collocations, op12_residue_negatives, op13_range_join)}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Words in repeated windows of m words, as a correlated count: a word counts if any of the m windows over it occurs twice.
_COVER = """
{name}_grams AS (SELECT doc_id, unnest(range(1, greatest(n_words - {m} + 2, 1))) AS i, w FROM words),
{name}_twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+{m}-1], ' ')) AS c FROM {name}_grams) WHERE c > 1),
{name} AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM {name}_twice, (SELECT unnest(range({m})) AS k) GROUP BY doc_id)"""

OP3_SQL = f"""
WITH words AS (SELECT doc_id, text, {_WORDS} AS w, len({_WORDS}) AS n_words FROM documents),
{_COVER.format(name="three", m=3)},
{_COVER.format(name="eight", m=8)},
long_grams AS (SELECT doc_id, unnest(range(1, greatest(n_words - m + 2, 1))) AS i, m, w FROM (SELECT *, greatest(13, n_words * 15 // 100 + 1) AS m FROM words)),
long_repeats AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM long_grams GROUP BY doc_id, array_to_string(w[i:i+m-1], ' ') HAVING count(*) > 1)),
lines AS (SELECT doc_id, l, count(*) - 1 AS extra FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
dups AS (SELECT doc_id, sum(extra) AS c FROM lines GROUP BY doc_id),
m AS (SELECT w.doc_id, w.n_words, length(array_to_string(w.w, '')) AS word_chars,
 length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(d.c, 0) AS BIGINT) AS n_dup_lines,
 coalesce(t.c, 0) AS n_repeat_words, coalesce(e.c, 0) AS covered, r.doc_id IS NOT NULL AS long_repeat
 FROM words w LEFT JOIN three t USING (doc_id) LEFT JOIN eight e USING (doc_id) LEFT JOIN dups d USING (doc_id) LEFT JOIN long_repeats r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * covered > 20 * n_words) AND NOT long_repeat AS kept FROM m"""

#: Base32 of a hex digest of 20 bytes: 32 groups of five of its bits.
_BASE32 = """array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda b: CAST(substr({bits}, CAST(g * 5 + b + 1 AS BIGINT), 1) AS INT) * (1 << (4 - b)))) AS BIGINT), 1)), '')"""
_BITS = "array_to_string(list_transform(string_split(sha1(p), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST((instr('0123456789abcdef', c) - 1) * 4 + 1 AS BIGINT), 4)), '')"

OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
b AS (SELECT page_id, strlen(p) AS payload_bytes, {_BITS} AS bits, last FROM p)
SELECT page_id, payload_bytes, {_BASE32.format(bits="bits")} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b"""

OP5_SQL = r"""
WITH own AS (SELECT unnest([0, 1]) AS turn), c AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
 SELECT -1, turn, CASE WHEN turn = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM own),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS escaped, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
 CAST(sum(length('<|im_start|>') + length(head) + 1 + length(escaped) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

#: Phrases of words within pieces, each language for itself. Products are of 128 bits.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, greatest(len(w) - m + 2, 1)), lambda i: array_to_string(w[i:i+m-1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
e AS MATERIALIZED (SELECT * FROM f WHERE f >= 10),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS x FROM e WHERE m > 1),
parts AS (SELECT lang, phrase, m, f AS a, 1 AS k, x[1] AS p, array_to_string(x[2:], ' ') AS q FROM c UNION ALL SELECT lang, phrase, m, f, 2, array_to_string(x[1:2], ' '), x[3] FROM c WHERE m = 3),
cuts AS (SELECT parts.*, l.f AS l, r.f AS r, 1000000 * CAST(a AS HUGEINT) * a // (CAST(l.f AS HUGEINT) * r.f) AS score
 FROM parts JOIN e AS l ON l.lang = parts.lang AND l.phrase = p AND l.m = k JOIN e AS r ON r.lang = parts.lang AND r.phrase = q AND r.m = parts.m - k),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase, m ORDER BY score, k) AS nth FROM cuts) WHERE nth = 1),
inside AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS phrase, f FROM c WHERE m = 3) GROUP BY ALL),
k AS (SELECT s.* FROM s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase AND s.m = 2 WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) JOIN n USING (lang) WHERE rank <= 2000"""

OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM s WHERE same) WHERE r <= 5)
SELECT * FROM (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score) WHERE rank <= 5"""

OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.node),
c AS (SELECT node, min(root) AS root FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN n ON n.a = vec_id"""

SQL: dict[str, str] = {"op3_repetition_rules": OP3_SQL, "op4_warc_archives": OP4_SQL, "op5_chat_parts": OP5_SQL, "op11_quotient_collocations": OP11_SQL, "op12_residue_negatives": OP12_SQL, "op13_range_join": OP13_SQL}
