"""Connected components of a distributed edge table by hooking and pointer jumping.

Every node with a smaller neighbour hooks to its smallest one; jumping turns the hooks into roots in a logarithmic
number of steps; edges then join roots, and the rounds go on until none is left. A graph of at most ``ONE_TASK`` edges
goes through these rounds as arrays in one task, whose memory that bound limits; a larger one as tables, each step an
aggregation or a join with one row for each key on one side, until what is left is that small. Both give the same rows.
Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups

#: Edges of one task: 32 MB of ids, and about four times that beside them.
ONE_TASK = 1 << 21


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the smallest node that each of them reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)) for b in batches if b.num_rows]
        if held:
            node, comp = smallest_reached(*(np.concatenate(ends) for ends in zip(*held)))
            for at in range(0, len(node), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(node[at : at + (1 << 16)]), pa.array(comp[at : at + (1 << 16)])], names=["node", "comp"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, comp long")


def _follow(rows: DataFrame, key: str, to: DataFrame, into: str, scratch: Scratch, name: str) -> DataFrame:
    """Adds what ``to`` (node, p) says of ``key``, null without; a key of many rows is hot in no task."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    groups = scratch.put(name, counts.join(to.select(F.col("node").alias(key), F.col("p").alias(into)), key))
    return join_groups(rows, groups, key, "_rows", how="left").drop("_rows")


def components(edges: DataFrame, scratch: Scratch, label: str = "cc", one_task: int = ONE_TASK) -> DataFrame:
    """(node, comp) of each node of the edges (a, b); comp is the smallest node that it reaches."""
    ends = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current = scratch.put(f"{label}-edges0", ends)
    labels, level = None, 0
    while (count := current.count()) > one_task:
        parent = scratch.put(f"{label}-parent{level}", current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("p")))
        step, moved = 0, True
        while moved:  # parent of the parent
            jumped = _follow(parent, "p", parent, "pp", scratch, f"{label}-up{level}-{step}")
            nxt = scratch.put(f"{label}-jump{level}-{step}", jumped.select("node", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            moved = bool(nxt.where("moved").take(1))
            parent, step = nxt.select("node", "p"), step + 1
        if labels is None:
            roots = current.select(F.col("a").alias("node")).distinct().join(parent.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
            labels = parent.select("node", F.col("p").alias("comp")).unionByName(roots)
        else:
            labels = _follow(labels, "comp", parent, "root", scratch, f"{label}-roots{level}").select("node", F.coalesce("root", "comp").alias("comp"))
        labels = scratch.put(f"{label}-labels{level}", labels)
        a = _follow(current, "a", parent, "ra", scratch, f"{label}-a{level}")
        ab = _follow(a, "b", parent, "rb", scratch, f"{label}-b{level}").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a != b")
        level += 1
        current = scratch.put(f"{label}-edges{level}", ab.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rest = scratch.put(f"{label}-rest", _in_one_task(current)) if count or labels is None else None
    if labels is None or rest is None:
        return rest if labels is None else labels
    rest = rest.select("node", F.col("comp").alias("p"))
    return scratch.put(f"{label}-labels{level}", _follow(labels, "comp", rest, "root", scratch, f"{label}-roots{level}").select("node", F.coalesce("root", "comp").alias("comp")))
