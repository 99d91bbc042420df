"""Connected components of a graph given as a table of links, by alternating large and small stars.

A large star links every neighbour greater than a node to the least of the node and its neighbours; a
small star links a node and its lesser neighbours to the least of them. Links never multiply, and after a
few rounds every node is linked to the least node of its component. Before the first round each batch
of links is thinned to a spanning forest where it lies, unless the caller's links are forests already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import checkpoint, lean

#: Rounds at most: links that touch fall by a constant factor in a round or two, so 60 are for far more links than can be stored.
ROUNDS = 60
LINKS_OF_A_TASK = 500_000
#: Tasks that the rows of one component are dealt to in a join by component.
SALTS = 16
#: Members of a block of a group whose pieces are compared.
PIECE_BLOCK = 500


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each of n nodes' components, links being a[i] - b[i]."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _thin(batches):
    for x in batches:
        a, b = x["a"].to_numpy(), x["b"].to_numpy()
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        root = union_find(at[: len(a)], at[len(a) :], len(nodes))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own], pa.int64()), pa.array(nodes[root[own]], pa.int64())], ["a", "b"])


def connected_components(links: DataFrame, thin: bool = True) -> DataFrame:
    """node and component (its least node) of all nodes that have a link. links: a, b (long); nulls and loops are ignored."""
    e = links.select("a", "b").where("a is not null and b is not null and a <> b")
    e = e.mapInArrow(lean(_thin), "a long, b long") if thin else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e, seen = checkpoint(e.distinct()), None
    for _ in range(ROUNDS):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
        # as many tasks as the links need: a shuffle writes files for each of them, in every round
        e = e.coalesce(1 + state[0] // LINKS_OF_A_TASK)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = checkpoint(small)
    raise RuntimeError(f"no fixed point after {ROUNDS} rounds")


def join_components(rows: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """rows joined with dim, which has one row for each value of `on`: the rows of one component, which may be a third of all, are dealt to SALTS tasks."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(dim.withColumn("_salt", salt), [on, "_salt"]).drop("_salt")


def sets_between_pieces(nodes: DataFrame, key: str) -> DataFrame:
    """set, key, _piece: members of the groups that are in pieces, so that any two members of different pieces of a group share a set. nodes: _group, key, _piece.

    Pieces of over PIECE_BLOCK members are cut into blocks of their own, the others of a group are dealt to blocks
    together; each two blocks that aren't of one piece are a set. A group in one piece gives none.
    """
    sizes = nodes.groupBy("_group", "_piece").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_large", F.col("_n") > PIECE_BLOCK)
    broken = sizes.groupBy("_group").agg(F.count("*").alias("_pieces"), F.sum(F.when(F.col("_large"), 0).otherwise(F.col("_n"))).alias("_rest")).where("_pieces > 1")
    nodes = nodes.join(sizes.join(broken, "_group"), ["_group", "_piece"])
    cuts = F.ceil(F.when(F.col("_large"), F.col("_n")).otherwise(F.col("_rest")) / PIECE_BLOCK)
    of = F.when(F.col("_large"), F.col("_piece"))
    nodes = checkpoint(nodes.select("_group", key, "_piece", of.alias("_of"), F.pmod(F.xxhash64(key), cuts).alias("_cut")))
    blocks = nodes.select("_group", "_of", "_cut").distinct().withColumn("_block", F.struct("_of", "_cut"))
    i, j = blocks.select("_group", F.col("_block").alias("_i")), blocks.select("_group", F.col("_block").alias("_j"))
    pairs = i.join(j, "_group").where("_i < _j and not (_i._of is not null and _i._of <=> _j._of)")
    alone = blocks.groupBy("_group").agg(F.count("*").alias("_n"), F.first("_block").alias("_i")).where("_n = 1").select("_group", "_i", F.col("_i").alias("_j"))
    pairs = pairs.select("_group", "_i", "_j").unionByName(alone).withColumn("set", F.xxhash64("_group", "_i._of", "_i._cut", "_j._of", "_j._cut"))
    asked = pairs.select("set", "_group", F.explode(F.array_distinct(F.array("_i", "_j"))).alias("_b")).select("set", "_group", F.col("_b._of").alias("_of"), F.col("_b._cut").alias("_cut"))
    m = nodes.withColumnRenamed("_group", "_g").withColumnRenamed("_of", "_o").withColumnRenamed("_cut", "_c")
    return m.join(asked, (F.col("_g") == F.col("_group")) & F.col("_o").eqNullSafe(F.col("_of")) & (F.col("_c") == F.col("_cut"))).select("set", key, "_piece")
