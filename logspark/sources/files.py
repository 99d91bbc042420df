"""Lines of log files, and statistics read from files or databases."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.functions.patterns import matches_any
from logspark.operators.inventory import STATS

#: How rotated files are named after the log `x.log`.
_ROTATED = (
    (r"^(.*\.log)\.(\d+)$", 1, 2),
    (r"^(.*)\.(\d+)\.log$", 1, 2),
    (r"^(.*)-(\d{8})\.log$", 1, 2),
    (r"^(.*\.log)-(\d{8})$", 1, 2),
)


def _reader(spark: SparkSession, modified_after: str | None):
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.option("modifiedAfter", modified_after) if modified_after else reader


#: Bits of a line's number that a file's rank among the rotations of its log has: 8,192 files.
_RANK_BITS = 13
_SUFFIXES = {s: 1 << (10 * i) for i, s in enumerate(("", "k", "m", "g", "t", "p"))}


def byte_size(text: str) -> int:
    """A size as Spark writes it: digits, and b, k, kb, m, mb and so on; without a suffix bytes."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", text.lower())
    if m is None:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) * _SUFFIXES[m[2]]


def _line_seq(spark: SparkSession, start: Column, place: Column, rank: Column | None = None) -> Column:
    """A line's number: its file's rank, its split's start in units no larger than a split, and its place among the rows of the task; as many bits as the session's splits need.

    What doesn't fit is an error, never a wrong order: files over some terabytes (4 MB splits: 16 TB), ranks over 8,191, more rows in a task than a split has bytes.
    """
    most, least = byte_size(spark.conf.get("spark.sql.files.maxPartitionBytes")), byte_size(spark.conf.get("spark.sql.files.openCostInBytes"))
    unit, place_bits = min(most, max(least, 1)).bit_length() - 1, max(20, most.bit_length() + 1)
    start_bits = 63 - _RANK_BITS - place_bits
    if start_bits < 1:
        raise ValueError("spark.sql.files.maxPartitionBytes is too large to number lines")
    start, place = start.cast("long"), place.cast("long").bitwiseAND(F.lit((1 << 33) - 1))  # a task's rows, without the task's number
    limits = [(F.shiftright(start, unit + start_bits) > 0, "a file is too long for its lines to be numbered"), (F.shiftright(place, place_bits) > 0, "a task has too many lines to number them")]
    seq = F.shiftleft(F.shiftright(start, unit), place_bits).bitwiseOR(place)
    if rank is not None:
        limits.append((rank >= 1 << _RANK_BITS, "a log has too many rotated files for its lines to be numbered"))
        seq = seq.bitwiseOR(F.shiftleft(rank.cast("long"), start_bits + place_bits))
    for wrong, why in limits:
        seq = F.when(wrong, F.raise_error(F.lit(why)).cast("long")).otherwise(seq)
    return seq


def read_log_lines(spark: SparkSession, globs: list[str], exclude: list[str] = (), modified_after: str | None = None, rotations: bool = False) -> DataFrame:
    """log_path, line_seq, byte_offset (of the file split), raw, raw_len of the files that the globs find.

    line_seq grows along a file, though not by one: it is the split's start and the line's place in its task, so nothing is
    shuffled (see _line_seq for its limits, which are checked). A carriage return stays.
    rotations: rotated files are one log under its name, oldest first, compressed ones are left out (see order_rotations).
    """
    df = _reader(spark, modified_after).option("lineSep", "\n").text(globs).select("value", F.col("_metadata.file_path").alias("log_path"), F.col("_metadata.file_block_start").alias("byte_offset"))
    if exclude:
        df = df.where(~matches_any(F.col("log_path"), exclude))
    df = df.withColumn("_place", F.monotonically_increasing_id())
    rank = None
    if rotations:
        # a row for each file; contents aren't read
        files = _reader(spark, modified_after).format("binaryFile").load(globs).select("path", F.col("modificationTime").alias("modified"))
        files = order_rotations(files).where("not ignored")
        oldest = Window.partitionBy("base").orderBy(F.desc("generation"), "path")
        files = files.select(F.col("path").alias("log_path"), "base", (F.row_number().over(oldest) - 1).alias("_rank"))
        df = df.join(files, "log_path").drop("log_path").withColumnRenamed("base", "log_path")
        rank = F.col("_rank")
    df = df.withColumn("line_seq", _line_seq(spark, F.col("byte_offset"), F.col("_place"), rank))
    return df.select("log_path", "line_seq", "byte_offset", F.col("value").alias("raw"), (F.octet_length("value") + 1).alias("raw_len"))


def stream_log_lines(spark: SparkSession, path: str, from_end_after: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """log_path, line_seq, byte_offset, modified, raw, raw_len of files as they land; the query's checkpoint remembers what was read. from_end_after: older files are passed over.

    line_seq is that of read_log_lines; Spark numbers no rows of a stream, so they are counted as they pass.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    df = reader.text(path).select(F.col("_metadata.file_path").alias("log_path"), F.col("_metadata.file_block_start").alias("byte_offset"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("raw"))
    if from_end_after:
        df = df.where(F.col("modified") > F.lit(from_end_after).cast("timestamp"))

    def counted(batches):
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(n, n + len(b)), pa.int64())], [*b.schema.names, "_place"])
            n += len(b)

    df = df.mapInArrow(counted, "log_path string, byte_offset long, modified timestamp, raw string, _place long")
    return df.select("log_path", _line_seq(spark, F.col("byte_offset"), F.col("_place")).alias("line_seq"), "byte_offset", "modified", "raw", (F.octet_length("raw") + 1).alias("raw_len"))


def order_rotations(files: DataFrame, path: str = "path", modified: str = "modified", recent_seconds: int = 300) -> DataFrame:
    """Adds base (the log), generation (0: the log itself; greater: older, by number or by age of the date), ignored (compressed) and recent (changed lately, against the newest file)."""
    base, generation, dated = F.col(path), F.lit(0).cast("long"), F.lit(False)
    for pattern, b, g in reversed(_ROTATED):
        hit = F.col(path).rlike(pattern)
        stem = F.regexp_extract(path, pattern, b)
        base = F.when(hit, F.when(stem.endswith(".log"), stem).otherwise(F.concat(stem, F.lit(".log")))).otherwise(base)
        number = F.regexp_extract(path, pattern, g).try_cast("long")
        generation = F.when(hit, F.when(F.length(number.cast("string")) == 8, 99_999_999 - number).otherwise(number)).otherwise(generation)
    newest = files.agg(F.max(modified).alias("_newest"))
    df = files.withColumns({"base": base, "generation": generation, "ignored": F.col(path).endswith(".gz")})
    # one row
    df = df.join(F.broadcast(newest)).withColumn("recent", F.unix_seconds(F.col("_newest").cast("timestamp")) - F.unix_seconds(F.col(modified).cast("timestamp")) < recent_seconds)
    return df.drop("_newest")


def newest_rotation(files: DataFrame, base: str = "base", path: str = "path", modified: str = "modified") -> DataFrame:
    """The rotated file of each log that changed last; of equal times the greater name."""
    return files.where("generation > 0 and not ignored").groupBy(base).agg(F.max_by(path, F.struct(modified, path)).alias("candidate"))


def read_container_stats(spark: SparkSession, path: str) -> DataFrame:
    """container, ts and stats (JSON text, see unpivot_container_stats) of files with a JSON object on each line."""
    fields = ", ".join(["container:string", "ts:timestamp", *(x.replace(" ", ":", 1) for x in STATS.split(", "))])
    kind = "struct<" + fields.split(", ", 2)[2] + ">"
    return spark.read.schema(f"container string, ts timestamp, stats {kind}").json(path).withColumn("stats", F.to_json("stats"))


def read_syslog_capture(df: DataFrame) -> DataFrame:
    """conn_id, chunk_seq, payload of captured packets: proto, srcip, destport, ts, payload. A connection is its protocol, source and port."""
    conn = F.concat_ws("|", "proto", "srcip", F.col("destport").cast("string"))
    return df.select(conn.alias("conn_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("chunk_seq"), F.col("payload").cast("binary").alias("payload"))


def read_db_status(spark: SparkSession, path: str | None = None, url: str | None = None, table: str | None = None, column: str | None = None, rows_of_a_task: int = 1_000_000, **options: str) -> DataFrame:
    """Status rows of a database: from a snapshot on disk, or by JDBC.

    column: a column of whole numbers or times by which a table is read in ranges, each a task's. Their bounds are quantiles of the column, found by the database where its
    values are uneven: it counts them in 64 even steps, and steps are put together to about rows_of_a_task rows. Filters, columns and aggregates on the
    result are the database's work as far as Spark pushes them down.
    """
    if path:
        return spark.read.parquet(path)
    source = {"url": url, **options}
    load = lambda **o: spark.read.format("jdbc").options(**source, **o).load()
    if column is None:
        return load(dbtable=table)
    whole = load(dbtable=table)
    kind = whole.schema[column].dataType.simpleString()
    # one row, counted by the database
    n, low, high = whole.agg(F.count(F.lit(1)), F.min(column), F.max(column)).first()
    if not n or low is None or n <= rows_of_a_task:
        return whole
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return load(dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(-(-n // rows_of_a_task)))
    steps = min(STEPS, high - low + 1)
    width = -(-(high - low + 1) // steps)
    counts = {r["step"]: r["n"] for r in whole.where(F.col(column).isNotNull()).groupBy(((F.col(column) - low) / width).cast("long").alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts, held = [], 0
    for step in range(steps):
        if held and held + counts.get(step, 0) > rows_of_a_task:
            cuts.append(low + step * width)
            held = 0
        held += counts.get(step, 0)
    bounds = [None, *cuts, None]
    # rows without a value are the first range's
    ranges = [" AND ".join([*([f"{name} >= {a}"] if a is not None else []), *([f"{name} < {b}"] if b is not None else [])]) for a, b in zip(bounds, bounds[1:])]
    ranges[0] = f"({ranges[0]}) OR {name} IS NULL" if ranges[0] else "1 = 1"
    return spark.read.jdbc(url, table, predicates=ranges, properties={k: v for k, v in options.items()})


#: Even steps in which a database counts the values of a column.
STEPS = 64


#: Lines of a document are numbered below this.
LINES_OF_A_DOCUMENT = 1 << 31


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores where a scan has fewer tasks than there are cores, as with one small file; else leaves them where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of `documents` as a log for each source, in the order of documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("source", "doc_id", "text"))
    df = docs.select(F.coalesce("source", F.lit("")).alias("log_path"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return df.select("log_path", (F.col("doc_id") * LINES_OF_A_DOCUMENT + F.col("pos")).alias("line_seq"), F.lit(0).cast("long").alias("byte_offset"), "raw", (F.octet_length("raw") + 1).alias("raw_len"))


def line_block():
    """A block of such lines: those of a thousand documents."""
    return F.floor(F.col("line_seq") / (1000 * LINES_OF_A_DOCUMENT))
