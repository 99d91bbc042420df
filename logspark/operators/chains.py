"""Work in order in which one row leads to another: batches by size, spaced rows, groups of lines, accepted samples.

In all of these a row that begins something (a batch, a group) says which later row begins the next one, whatever came
before it: a chain of pointers. So the rows of one key need not be one task's. They are range-partitioned by key and order and
written once, sorted; a task then holds a block of them. All pointers inside a block are found by sorted searches
over prefix sums, and pointer doubling gives, for each row that a chain may enter the block by, what the chain leaves behind at the block's end and
how many beginnings it makes. That is a function of what is left behind before the block. Composing the functions of a key's blocks in turn
(only keys at the edges of blocks have more than one) says what each block begins with, and a second pass over the blocks marks the beginnings.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.operators.ordered import Fold, ordered_fold, saved

Rows = dict[str, Any]
#: Rows of a batch that leaves.
OUT_ROWS = 10_000


class Chain:
    """What rows lead to. rows: columns of one key's rows in a block, in order, as arrays; n of them.

    A state says what a block leaves to the next one; None: nothing, so that the next row begins.
    """

    #: Columns that the methods need.
    needs: tuple[str, ...] = ()
    #: Columns that columns() adds, as a schema.
    adds: str = ""

    def prepared(self, rows: Rows) -> Rows:
        """Adds what the other methods share."""
        return rows

    def next(self, rows: Rows) -> np.ndarray:
        """For each row, if it begins: the place of the next beginning, n if it isn't in these rows."""
        raise NotImplementedError

    def left(self, rows: Rows, last: int) -> Any:
        """The state after the rows if the last beginning is there."""
        raise NotImplementedError

    def window(self, rows: Rows) -> int:
        """So many rows from the first one tell for every state where a chain enters, unless it passes by all."""
        raise NotImplementedError

    def head(self, rows: Rows, size: int) -> Any:
        """What enter() and passed() need of the first rows."""
        raise NotImplementedError

    def enter(self, head: Any, state: Any) -> int:
        """The place of the first beginning after a state that isn't None; n if it isn't in these rows."""
        raise NotImplementedError

    def passed(self, head: Any, state: Any) -> Any:
        """The state after rows that none of begins."""
        return state

    def columns(self, rows: Rows, starts: np.ndarray, state: Any) -> dict[str, pa.Array]:
        return {}


def ends_of_chains(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last place of the chain from each place, and the number of places on it: by pointer doubling."""
    n = len(following)
    at = np.arange(n)
    jump, count = np.where(following < n, following, at), np.where(following < n, 2, 1)
    while True:
        onward = jump[jump]
        if (onward == jump).all():
            return jump, count
        count = count + count[jump] - 1
        jump = onward


def first_at_least(values: np.ndarray, start: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The first place from start[i] on whose value is least[i] or more; n if there is none. By maxima of runs of 1, 2, 4.. places."""
    n = len(values)
    tops = [values]
    while 2 << (len(tops) - 1) <= n:
        half = 1 << (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
    at = start.astype(np.int64)
    for k in range(len(tops) - 1, -1, -1):
        inside = at + (1 << k) <= n
        skip = np.zeros(len(at), bool)
        skip[inside] = tops[k][at[inside]] < least[inside]
        at = at + skip * (1 << k)
    return at


class _Effect:
    """What a block does: state before to state after and beginnings made."""

    def __init__(self, chain: Chain, rows: Rows, n: int):
        following = chain.next(rows)
        size = min(n, max(1, chain.window(rows)))
        last, count = ends_of_chains(following)
        self.n, self.head = n, chain.head(rows, size)
        self.exits = [(chain.left(rows, int(last[i])), int(count[i])) for i in range(size)]

    def __call__(self, chain: Chain, state: Any) -> tuple[Any, int]:
        at = 0 if state is None else chain.enter(self.head, state)
        return (chain.passed(self.head, state), 0) if at >= self.n else self.exits[at]


class _Composed(Fold):
    def __init__(self, chain: Chain):
        self.chain, self.state, self.count = chain, None, 0

    def add(self, row):
        yield row.key, row.block, pickle.dumps((self.state, self.count))
        self.state, n = pickle.loads(row.effect)(self.chain, self.state)
        self.count += n


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each key of a sorted partition; one key's are held at a time."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        key = b["_key"]
        new = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)) + 1
        for s, e in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
            own = key[s].as_py()
            if held and own != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = own
            held.append(b.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)


def _rows(chain: Chain, table: pa.Table) -> Rows:
    return chain.prepared({c: table[c].combine_chunks() for c in chain.needs})


def chained(df: DataFrame, keys: list[str], order: list[str], chain: Chain, apart: int | None = None, tasks: int | None = None) -> DataFrame:
    """The rows with start (whether the row begins something), nth (beginnings of its key up to it, itself included) and the chain's own columns.

    apart: rows with the same keys and the first `apart` columns of the order stay in one block; else those of equal order do. A key's rows are in as many
    tasks as their share of all rows needs.
    """
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = df.columns
    df = df.withColumn("_key", F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))) if keys else F.lit(""))
    ranged = df.repartitionByRange(n, "_key", *order[:apart]).sortWithinPartitions("_key", *order)
    # blocks are told apart by where rows were written
    ranged = saved(ranged.withColumn("_block", F.spark_partition_id()))

    def effects(batches):
        found: list[tuple[str, int, pa.Table]] = []
        for key, table in _runs(batches):
            # of a block only the first and the last key may go on in others
            found = [*found[:1], (key, table["_block"][0].as_py(), table)]
        for key, block, table in found:
            body = pickle.dumps(_Effect(chain, _rows(chain, table), table.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([block], pa.int32()), pa.array([body], pa.binary())], ["key", "block", "effect"])

    needed = list(dict.fromkeys(["_key", "_block", *chain.needs]))
    edges = ranged.select(*needed).mapInArrow(effects, "key string, block int, effect binary")
    composed = ordered_fold(edges, ["key"], ["block"], lambda: _Composed(chain), "key string, block int, state binary")
    # two rows a block at most
    before = {(r["block"], r["key"]): bytes(r["state"]) for r in composed.collect()}

    def marked(batches):
        # small keys leave together
        held, n = [], 0
        for table in _marked(batches):
            held.append(table)
            n += table.num_rows
            if n >= OUT_ROWS:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    def _marked(batches):
        for key, table in _runs(batches):
            rows, size = _rows(chain, table), table.num_rows
            state, count = pickle.loads(before[at]) if (at := (table["_block"][0].as_py(), key)) in before else (None, 0)
            place = 0 if state is None else chain.enter(chain.head(rows, size), state)
            start, following = np.zeros(size, bool), chain.next(rows).tolist()
            while place < size:
                start[place] = True
                place = following[place]
            table = table.drop_columns(["_key", "_block"]).append_column("start", pa.array(start)).append_column("nth", pa.array(np.cumsum(start) + count))
            for name, column in chain.columns(rows, np.flatnonzero(start), state).items():
                table = table.append_column(name, column)
            yield table

    added = [ranged.schema[c] for c in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in added), "start boolean", "nth bigint", *([chain.adds] if chain.adds else [])])
    return ranged.select(*columns, "_key", "_block").mapInArrow(marked, schema)


class SizeCuts(Chain):
    """Rows in order go together until the next would make more than `limit`; a larger row is alone. The state is what the last batch holds."""

    def __init__(self, size: str, limit: int):
        self.limit, self.needs, self.size = limit, (size,), size

    def prepared(self, rows):
        return {"total": np.cumsum(pc.fill_null(rows[self.size].cast(pa.int64()), 0).to_numpy(zero_copy_only=False))}

    def next(self, rows):
        total = rows["total"]
        before = np.r_[0, total[:-1]]
        # a batch of nothing yet takes any row
        return np.maximum(np.searchsorted(total, before + self.limit, "right"), np.searchsorted(total, before, "right") + 1).clip(max=len(total))

    def left(self, rows, last):
        total = rows["total"]
        return int(total[-1] - (total[last - 1] if last else 0))

    def window(self, rows):
        total = rows["total"]
        return max(int(np.searchsorted(total, self.limit, "right")), int(np.searchsorted(total, 0, "right")) + 1) + 1

    def head(self, rows, size):
        return len(rows["total"]), rows["total"][:size], int(rows["total"][-1])

    def enter(self, head, state):
        n, total, _ = head
        at = int(np.searchsorted(total, self.limit - state, "right"))
        at = at if state else max(at, int(np.searchsorted(total, 0, "right")) + 1)
        return n if at >= len(total) else at

    def passed(self, head, state):
        return state + head[2]


class Spaced(Chain):
    """The first row, and each that is `seconds` or more after the last one that counts. The state is when that was."""

    def __init__(self, time: str, seconds: float):
        self.seconds, self.needs, self.time = seconds, (time,), time

    def prepared(self, rows):
        return {"t": rows[self.time].to_numpy(zero_copy_only=False)}

    def _after(self, t: np.ndarray, since: np.ndarray) -> np.ndarray:
        at = np.searchsorted(t, since + self.seconds, "left")
        # the rule is about the difference, which may be rounded otherwise than the sum
        while len(early := np.flatnonzero((at > 0) & (t[at - 1] - since >= self.seconds))):
            at[early] -= 1
        while len(late := np.flatnonzero(at < len(t))) and len(late := late[t[at[late]] - since[late] < self.seconds]):
            at[late] += 1
        return at

    def next(self, rows):
        t = rows["t"]
        return np.maximum(self._after(t, t), np.arange(1, len(t) + 1)).clip(max=len(t))

    def left(self, rows, last):
        return float(rows["t"][last])

    def window(self, rows):
        return int(np.searchsorted(rows["t"], rows["t"][0] + 2 * self.seconds, "right")) + 1

    def head(self, rows, size):
        return len(rows["t"]), rows["t"][:size]

    def enter(self, head, state):
        n, t = head
        at = int(self._after(t, np.array([state]))[0])
        return n if at >= len(t) else at


class Accepted(Chain):
    """Samples that count: the first; the first one `gap` seconds or more after the last that counts; and any later one that isn't less than it.

    The state is time (milliseconds) and value of the last that counts. Adds since and base, those of the one before, where there is one within the gap.
    """

    adds = "since bigint, base double"

    def __init__(self, gap: float, time: str = "ts_ms", value: str = "value"):
        self.gap, self.needs, self.time, self.value = gap, (time, value), time, value

    def prepared(self, rows):
        return {"t": rows[self.time].to_numpy(zero_copy_only=False), "v": rows[self.value].to_numpy(zero_copy_only=False)}

    def _far(self, t: np.ndarray, since: np.ndarray) -> np.ndarray:
        """The first place a gap after; the rule is about seconds as doubles."""
        at = np.searchsorted(t, since + self.gap * 1000, "left")
        while len(early := np.flatnonzero(at > 0)) and len(early := early[t[at[early] - 1] / 1000 - since[early] / 1000 >= self.gap]):
            at[early] -= 1
        while len(late := np.flatnonzero(at < len(t))) and len(late := late[t[at[late]] / 1000 - since[late] / 1000 < self.gap]):
            at[late] += 1
        return at

    def next(self, rows):
        t, v = rows["t"], rows["v"]
        # a later sample can't have the same time
        return np.minimum(np.maximum(self._far(t, t), np.arange(1, len(t) + 1)), first_at_least(v, np.searchsorted(t, t, "right"), v)).clip(max=len(t))

    def left(self, rows, last):
        return int(rows["t"][last]), float(rows["v"][last])

    def window(self, rows):
        t = rows["t"]
        return int(np.searchsorted(t, t[0] + self.gap * 1000 + 1, "right")) + 1

    def head(self, rows, size):
        t, v = rows["t"], rows["v"]
        record = np.flatnonzero(np.r_[True, v[1:] > np.maximum.accumulate(v)[:-1]])
        # after the window only a gap's end can come first, so of the values only the records before it matter
        return len(t), t[:size], record[record < size], v[record[record < size]]

    def enter(self, head, state):
        n, t, record, top = head
        far = int(self._far(t, np.array([state[0]]))[0])
        i = int(np.searchsorted(top, state[1], "left"))
        at = min(far, int(record[i]) if i < len(record) else n)
        return n if at >= len(t) else at

    def columns(self, rows, starts, state):
        t, v, n = rows["t"], rows["v"], len(rows["t"])
        since, base, known = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        if len(starts):
            since[starts[1:]], base[starts[1:]], known[starts[1:]] = t[starts[:-1]], v[starts[:-1]], True
            if state is not None:
                since[starts[0]], base[starts[0]], known[starts[0]] = state[0], state[1], True
            known[starts] &= t[starts] / 1000 - since[starts] / 1000 < self.gap
        return {"since": pa.array(since, mask=~known), "base": pa.array(base, mask=~known)}


class Pieces(Chain):
    """Pieces go together up to one that is full, or that makes `limit` bytes or more. The state is the bytes of what is open."""

    needs = ("full", "size")

    def __init__(self, limit: int):
        self.limit = limit

    def prepared(self, rows):
        total = np.cumsum(rows["size"].cast(pa.int64()).to_numpy(zero_copy_only=False))
        full = rows["full"].to_numpy(zero_copy_only=False).astype(bool)
        return {"total": total, "full": _next_true(full)}

    def next(self, rows):
        total = rows["total"]
        before = np.r_[0, total[:-1]]
        large = np.maximum(np.searchsorted(total, before + self.limit, "left"), np.arange(len(total)))
        return (np.minimum(rows["full"], large) + 1).clip(max=len(total))

    def left(self, rows, last):
        total, n = rows["total"], len(rows["total"])
        size = int(total[-1] - (total[last - 1] if last else 0))
        return None if min(int(rows["full"][last]), n) < n or size >= self.limit else size

    def window(self, rows):
        return min(int(rows["full"][0]), int(np.searchsorted(rows["total"], self.limit, "left"))) + 2

    def head(self, rows, size):
        return len(rows["total"]), rows["total"][:size], int(rows["full"][0]), int(rows["total"][-1])

    def enter(self, head, state):
        n, total, full, _ = head
        return min(n, min(full, int(np.searchsorted(total, self.limit - state, "left"))) + 1)

    def passed(self, head, state):
        n, _, full, size = head
        return None if full < n or state + size >= self.limit else state + size


def _next_true(flags: np.ndarray) -> np.ndarray:
    """The first place from each place on where a flag is set; n if none is."""
    n = len(flags)
    return np.minimum.accumulate(np.where(flags, np.arange(n), n)[::-1])[::-1]


class Groups(Chain):
    """Groups of lines by several rules, of at most `limit` bytes: a line outside groups begins one by the first rule whose start it is, or is alone.

    needs flags (an array: for each rule whether the line is a start and whether its pattern is found) and size. The state is the open group's rule and bytes. A
    group of k rules is an automaton of k + 1 states; its size makes it a chain.
    """

    needs = ("flags", "size")

    def __init__(self, kinds: list[str], limit: int):
        self.kinds, self.limit = kinds, limit

    def prepared(self, rows):
        total = np.cumsum(rows["size"].cast(pa.int64()).to_numpy(zero_copy_only=False))
        n, k = len(total), len(self.kinds)
        flags = rows["flags"].flatten().to_numpy(zero_copy_only=False).reshape(n, 2 * k).astype(bool)
        starts, hits = flags[:, ::2], flags[:, 1::2]
        kind = np.where(starts.any(1), starts.argmax(1), -1)
        # the first line from each place on that the rule's group doesn't take, or (past, with) after which it takes no more
        ends = [_next_true(~hits[:, g] if name.startswith("continue") else hits[:, g]) + name.endswith(("Past", "With")) for g, name in enumerate(self.kinds)]
        return {"total": total, "kind": kind, "ends": ends}

    def next(self, rows):
        total, kind, n = rows["total"], rows["kind"], len(rows["total"])
        at = np.arange(n)
        out = at + 1
        before = np.r_[0, total[:-1]]
        large = np.maximum(np.searchsorted(total, before + self.limit, "right"), at + 1)
        for g, ends in enumerate(rows["ends"]):
            own = kind == g
            out[own] = np.minimum(np.r_[ends, n][at[own] + 1], large[own])
        return out.clip(max=n)

    def left(self, rows, last):
        total, n, g = rows["total"], len(rows["total"]), int(rows["kind"][last])
        if g < 0:
            return None
        # closed by its last line: n, by none: n + 1
        closed = self.kinds[g].endswith(("Past", "With")) and last + 1 < n and int(rows["ends"][g][last + 1]) == n
        return None if closed else (g, int(total[-1] - (total[last - 1] if last else 0)))

    def window(self, rows):
        reach = max(int(e[0]) for e in rows["ends"]) if rows["ends"] else 0
        return min(reach, int(np.searchsorted(rows["total"], self.limit, "right"))) + 2

    def head(self, rows, size):
        return len(rows["total"]), rows["total"][:size], [int(e[0]) for e in rows["ends"]], int(rows["total"][-1])

    def enter(self, head, state):
        n, total, ends, _ = head
        g, size = state
        return min(n, ends[g], int(np.searchsorted(total, self.limit - size, "right")))

    def passed(self, head, state):
        n, _, ends, size = head
        g, so_far = state
        closed = self.kinds[g].endswith(("Past", "With")) and ends[g] == n
        return None if closed else (g, so_far + size)
