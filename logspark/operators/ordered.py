"""Order-dependent work: running aggregates, one-bit automata, and folds.

Running aggregates and automata are windows. A log that is too large for one task can be cut: `block` is a
coarse column that never falls along the order (a date, a file, a range of line numbers). Blocks are scanned
at the same time, one row per block is scanned after them, and what came before a block is added to its rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COMBINE: dict[str, Callable] = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names (see shared_top)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_top(spark))
    return df.checkpoint()


def shared_top(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A temporary one only on one machine, and only where none is named."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (top or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")).rstrip("/")


def in_blocks(df: DataFrame, block: Column | None) -> tuple[DataFrame, str | None]:
    """Adds the column _block once, so that all windows over it share one shuffle; returns its name."""
    return (df, None) if block is None else (df.withColumn("_block", block), "_block")


def _carry(df: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    """Joins what comes before each block to the block's rows, which stay where they are. carried: a row per block, saved so that rows aren't scanned again for each later step."""
    carried = saved(carried)
    names = {c: f"_c{i}" for i, c in enumerate(by)}
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return df.join(carried.withColumnsRenamed(names), on, "left").drop(*names.values())


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, how: str = "sum", before: bool = False, block: str | None = None) -> DataFrame:
    """Adds the running sum, max or min of `value`, of the rows up to this one or (before) up to the one before.

    block: a column of blocks (see in_blocks). Null keys are a key.
    """
    agg, combine = getattr(F, how), _COMBINE[how]
    by = [*keys, block] if block else keys
    df = df.withColumn("_value", value)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = df.withColumn(name, agg("_value").over(w))
    if block is None:
        return out.drop("_value")
    totals = df.groupBy(*by).agg(agg("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    out = _carry(out, totals.select(*by, agg("_total").over(earlier).alias("_carried")), by)
    both = combine(F.col("_carried"), F.col(name)) if how == "sum" else combine("_carried", name)
    return out.withColumn(name, F.when(F.col("_carried").isNull(), F.col(name)).when(F.col(name).isNull(), F.col("_carried")).otherwise(both)).drop("_value", "_carried")


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str, block: str | None = None) -> DataFrame:
    """Adds name, a struct of the columns of the row before; null for a key's first row. block: see running; a row per block carries its last row on."""
    by = [*keys, block] if block else keys
    own = F.struct(*columns)
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name, F.lag(own).over(w))
    if block is None:
        return out
    ends = df.groupBy(*by).agg(F.max_by(own, F.struct(*order)).alias("_end"))
    carried = ends.select(*by, F.lag("_end").over(Window.partitionBy(*keys).orderBy(block)).alias("_carried"))
    return _carry(out, carried, by).withColumn(name, F.coalesce(name, "_carried")).drop("_carried")


def automaton(df: DataFrame, keys: list[str], order: list[str], step: Column, counted: Callable[[Column], Column], name: str, total: str, block: str | None = None) -> DataFrame:
    """Runs a one-bit automaton that begins with false over rows in order. Adds name, the state before each row, and total, the running count of rows for which counted(state before) holds.

    step: what a row does to the state: 0 or 1 sets it, i keeps it, f flips it. The state is the value last set,
    flipped as often as rows have flipped since. A block is scanned for both states that it may begin with: one row per
    block says how it ends and how many it counts in either case, and these rows, scanned in turn, say which case it was.
    So there are two passes over the rows. With blocks also adds edge: whether the count is the first or the last of its block.
    """
    by = [*keys, block] if block else keys
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_step", step).withColumn("_flips", F.count_if(F.col("_step") == "f").over(so_far))
    df = df.withColumn("_set", F.last(F.when(F.col("_step").isin("0", "1"), F.struct((F.col("_step") == "1").alias("v"), F.col("_flips").alias("f"))), ignorenulls=True).over(so_far))
    odd = (F.col("_flips") - F.coalesce(F.col("_set.f"), F.lit(0))) % 2 == 1
    df = df.withColumns({f"_after{e}": F.coalesce(F.col("_set.v"), F.lit(bool(e))) != odd for e in (0, 1)}).drop("_flips", "_set", "_step")
    before = {e: F.lag(f"_after{e}", 1, bool(e)).over(w) for e in (0, 1)}
    if block is None:
        df = df.withColumn(name, before[0]).drop("_after0", "_after1")
        return df.withColumn(total, F.count_if(counted(F.col(name))).over(so_far))
    df = df.withColumns({f"_before{e}": before[e] for e in (0, 1)})
    ends = df.groupBy(*by).agg(F.max_by(F.struct("_after0", "_after1"), F.struct(*order)).alias("_e"), *(F.count_if(counted(F.col(f"_before{e}"))).alias(f"_n{e}") for e in (0, 1)))
    # the blocks are the rows of an automaton themselves
    code = F.when(F.col("_e._after0") == F.col("_e._after1"), F.when(F.col("_e._after0"), "1").otherwise("0")).otherwise(F.when(F.col("_e._after0"), "f").otherwise("i"))
    scanned = automaton(ends.select(*by, "_n0", "_n1", code.alias("_code")), keys, [block], F.col("_code"), lambda _: F.lit(False), "_entry", "_none")
    scanned = scanned.withColumn("_n", F.when(F.col("_entry"), F.col("_n1")).otherwise(F.col("_n0")))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    df = _carry(df, scanned.select(*by, "_entry", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier")), by)
    df = df.withColumn(name, F.when(F.col("_entry"), F.col("_before1")).otherwise(F.col("_before0")))
    df = df.withColumn("_own", F.count_if(counted(F.col(name))).over(so_far))
    out = df.withColumns({total: F.col("_own") + F.col("_earlier"), "edge": (F.col("_own") == 0) | (F.col("_own") == F.col("_n"))})
    return out.drop("_after0", "_after1", "_before0", "_before1", "_entry", "_n", "_own", "_earlier")


class Fold:
    """The state of one key. add() gets a row and returns rows to emit; end() is called after a key's last row.

    state: columns that hold it between the batches of a stream, as a schema; saved() gives their values and restore() takes them. Without, it is kept as a whole.
    takes: columns that add() reads. Then add_lists() gets these columns of several rows, as lists, and returns what add() would for one row after the other.
    """

    state = ""
    takes: tuple[str, ...] = ()

    def saved(self) -> tuple:
        raise NotImplementedError

    def restore(self, values: tuple) -> None:
        raise NotImplementedError

    def add(self, row) -> Iterable[tuple]:
        return ()

    def add_lists(self, *columns: list) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


def ordered_fold(df: DataFrame, keys: list[str], order: list, new: Callable[[], Fold], schema: str, tasks: int | None = None) -> DataFrame:
    """Runs a fold over each key's rows in order. A key is one task's, but only one Arrow batch is held.

    Rows reach the fold as named tuples. The number of tasks is fixed, so that adaptive plans leave the dealing alone.
    """
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0].strip("`") for f in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, at = None, None
        for batch in batches:
            out: list[tuple] = []
            heads = list(batch[keys].astype(object).where(batch[keys].notna(), None).itertuples(index=False, name=None))
            for head, row in zip(heads, batch.itertuples(index=False)):
                if fold is None or head != at:
                    if fold is not None:
                        out += fold.end()
                    fold, at = new(), head
                out += fold.add(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if fold is not None and (out := list(fold.end())):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]
