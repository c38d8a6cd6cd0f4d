"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironlog.llm.common import discard, stored

#: Edges that a task contracts at a time.
BLOCK = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) with a > b from each node to the smallest one that the given edges reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while not np.array_equal(above := root[root], root):
            root = above
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The edges of each ``block`` rows as stars: the same components with at most as many edges."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        kind = rows.schema.field("a").type
        ends = _stars(*(c.to_numpy() for c in rows.columns))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(e, kind) for e in ends], ["a", "b"])

    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            if sum(h.num_rows for h in held) + part.num_rows > block:
                yield out()
            held.append(part)
    if held:
        yield out()


def _combined(edges: DataFrame, block: int) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()
    return edges.mapInArrow(lambda it: _blocks(it, block), f"a {kind}, b {kind}")


def _contract(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges (a, b) with a > b.

    ``large``: all neighbours of a node that are larger than it are hung on its smallest neighbour (or itself).
    Otherwise: all its smaller neighbours are hung on the smallest one.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = both.join(least, "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    out = out.where("a > b")
    return out if large else out.distinct()  # what the first step repeats goes with the second


def components(pairs: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """(node, component): the smallest node of each node's component, for every node that has an edge.

    Tasks first contract the edges they hold, ``block`` at a time, so copies and short chains go before any shuffle.  If
    more than one block is left, large-star and small-star steps follow in turn, each round written to the shared folder
    in files of about a block and contracted there again, until nothing changes: about log2 of the longest chain many
    rounds.  Rows shuffled per round: at most twice the edges; stars of any size are joined by key, never gathered.  Null
    ends and loops give no edge.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = stored(_combined(edges.select(high.alias("a"), low.alias("b")), block), "edges")
    sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    state = sums(edges)
    files = max(1, math.ceil(state[0] / block))
    if files == 1:
        before, edges = edges, stored(_combined(edges.coalesce(1), block), "stars")
        discard(before)
    while files > 1:
        before, edges = edges, stored(_combined(_contract(_contract(edges, True), False).coalesce(files), block), "stars")
        discard(before)
        now = sums(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(files))
