"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironlog.llm.common import stored
from ironlog.llm.components import components

#: Trees, vectors compared at once, and vectors of a leaf that a split is learned from (on average, by a hash of the id).
TREES, LEAF, SAMPLE = 6, 1024, 4096
#: Spill on either side of a cut, in standard deviations of a linked pair's distance along a random direction.
SPILL = 0.5
#: A split that leaves more than this part on one side is no split.
LARGEST = 0.85


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _direction(seed: int, dim: int) -> np.ndarray:
    r = np.random.default_rng(seed).standard_normal(dim)
    return r / np.linalg.norm(r)


def _margin(threshold: float, dim: int) -> float:
    return SPILL * float(np.sqrt(max(0.0, 2 - 2 * threshold) / dim))


def _cut(p: np.ndarray, margin: float) -> tuple[float, float]:
    """A cut in the middle of the values with the least spill, and the larger side's part of the rows."""
    tries = np.quantile(p, np.linspace(0.3, 0.7, 21))
    values = np.sort(p)
    left = np.searchsorted(values, tries + margin, "right") / len(p)
    right = 1 - np.searchsorted(values, tries - margin, "left") / len(p)
    best = int(np.argmin(left + right + 0.2 * np.abs(left - right)))
    return float(tries[best]), float(max(left[best], right[best]))


def _grow(x: np.ndarray, limit: int, seed: int, threshold: float, out: list[tuple[int, int, float, int, int]]) -> int:
    """Adds the subtree over ``x`` to ``out``: (node, seed of its direction, cut, left node, right node); a leaf has no children."""
    node = len(out)
    out.append((node, 0, 0.0, -1, -1))
    if len(x) > limit:
        margin = _margin(threshold, x.shape[1])
        for attempt in range(3):
            own = (seed * 1_000_003 + node * 31 + attempt) % (1 << 62)
            p = x @ _direction(own, x.shape[1])
            cut, part = _cut(p, margin)
            if part <= LARGEST:
                left = _grow(x[p <= cut + margin], limit, seed, threshold, out)
                right = _grow(x[p >= cut - margin], limit, seed, threshold, out)
                out[node] = (node, own, cut, left, right)
                break
    return node


def _fit(threshold: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        x, count = _unit(rows["vector"].to_numpy()), int(rows["members"].iloc[0])
        nodes: list[tuple[int, int, float, int, int]] = []
        _grow(x, max(16, LEAF * len(x) // max(count, 1)), abs(int(key[0])) % (1 << 40), threshold, nodes)
        ids, seeds, cuts, left, right = (list(c) for c in zip(*nodes, strict=True))
        return pd.DataFrame({"leaf": [key[0]], "seeds": [seeds], "cuts": [cuts], "lefts": [left], "rights": [right]})

    return run


def _route(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Each vector to the leaves of its leaf's subtree; near a cut it goes both ways."""
    for batch in batches:
        for leaf, rows in batch.groupby("leaf", sort=False):
            seeds, cuts, left, right = (rows[c].iloc[0] for c in ("seeds", "cuts", "lefts", "rights"))
            x = _unit(rows["vector"].to_numpy())
            margin = _margin(threshold, x.shape[1])
            todo, at, to = [(0, np.arange(len(x)))], [], []
            while todo:
                node, who = todo.pop()
                if left[node] < 0:
                    at.append(who)
                    to.append(np.full(len(who), node, np.int64))
                    continue
                p = x[who] @ _direction(int(seeds[node]), x.shape[1])
                todo.append((int(left[node]), who[p <= cuts[node] + margin]))
                todo.append((int(right[node]), who[p >= cuts[node] - margin]))
            chosen = rows.iloc[np.concatenate(at)]
            yield pd.DataFrame(
                {"node": chosen["node"].to_numpy(), "weight": chosen["weight"].to_numpy(), "vector": chosen["vector"].to_numpy(), "leaf": leaf, "part": np.concatenate(to), "leaves": len(seeds)}
            )


def _least_label(linked: np.ndarray) -> np.ndarray:
    """The least row number that each row reaches through links."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        leaf, one, two = (int(k) for k in key)
        rows = rows.sort_values("node")
        x, weight = _unit(rows["vector"].to_numpy()), rows["weight"].to_numpy(np.int64)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if one != two:  # two blocks of a large leaf: only pairs across them
            side = rows["block"].to_numpy() == one
            linked &= side[:, None] != side[None, :]
        # A pair that meets in several leaves counts in the first of them.
        earlier = [[v for v in leaves if v < leaf] for leaves in rows["leaves"]]
        names = {v: i for i, v in enumerate(sorted({v for e in earlier for v in e}))}
        fresh = linked
        if names:
            there = np.zeros((len(rows), len(names)), np.float32)
            for i, e in enumerate(earlier):
                there[i, [names[v] for v in e]] = 1
            fresh = linked & (there @ there.T < 0.5)
        nodes = rows["node"].to_numpy()
        out = pd.DataFrame({"node": nodes, "links": (fresh * weight[None, :]).sum(axis=1), "root": nodes[_least_label(linked)]})
        return out[(out["links"] > 0) | (out["root"] != out["node"])]

    return run


def _leaves(nodes: DataFrame, threshold: float, kind: str, of: str) -> DataFrame:
    """(leaf, node, weight, vector) over all trees; leaves above LEAF are left only where no cut divides them."""
    trees = F.explode(F.sequence(F.lit(1), F.lit(TREES))).alias("tree")
    live = nodes.select("node", "weight", "vector", "grp", trees).select(F.xxhash64("grp", "tree").alias("leaf"), "node", "weight", "vector")
    done = []
    for turn in range(64):
        sizes = live.groupBy("leaf").agg(F.count("*").alias("members"))
        live = stored(live.join(sizes, "leaf"), "leaves")
        done.append(live.where(F.col("members") <= LEAF).select("leaf", "node", "weight", "vector"))
        large = live.where(F.col("members") > LEAF)
        if large.isEmpty():
            break
        sample = large.where(F.pmod(F.xxhash64("node", "leaf"), "members") < SAMPLE)
        fitted = sample.groupBy("leaf").applyInPandas(_fit(threshold), "leaf long, seeds array<long>, cuts array<double>, lefts array<int>, rights array<int>")
        routed = large.drop("members").join(fitted, "leaf")
        schema = f"node {kind}, weight long, vector {of}, leaf long, part long, leaves int"
        routed = stored(routed.mapInPandas(lambda it: _route(it, threshold), schema), "routed")
        # a subtree of one node: no cut divides this leaf
        done.append(routed.where("leaves = 1").select("leaf", "node", "weight", "vector"))
        live = routed.where("leaves > 1").select(F.xxhash64("leaf", "part").alias("leaf"), "node", "weight", "vector")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors are linked when their labels are equal and not null and their cosine in double precision is at least
    ``threshold``.  Vectors that are null, empty, zero, or hold a null or non-finite component, and rows without vec_id,
    link with nothing: n_links 0, their own component, kept.  Vectors of different lengths link with nothing of the other
    length.  component_id is the smallest vec_id that links reach; kept says that it is the row's own.

    Equal vectors of a label are one node with a weight.  Each of TREES trees splits the nodes of a label and length by random
    directions; those near a cut go both ways.  Cuts are learned from a sample of about SAMPLE nodes of a leaf, every node
    is routed, and leaves above LEAF are split again, round by round.  Leaves are compared whole: every pair with enough similarity is verified,
    counted in the first leaf where it meets, and joined into stars; only counts and star edges leave the leaf.  A dense
    leaf that no cut divides is compared in pairs of blocks of LEAF nodes, so no task holds more than two blocks.
    """
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    usable = F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding")
    kind, of = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "embedding"))
    nodes = rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    nodes = nodes.withColumn("grp", F.xxhash64("label", F.size("embedding"))).withColumnRenamed("embedding", "vector")
    nodes = stored(nodes, "nodes")

    leaves = stored(_leaves(nodes, threshold, kind, of), "members").distinct()
    lists = leaves.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF).alias("blocks"))
    block = F.pmod(F.xxhash64("node", "leaf"), "blocks")
    dealt = leaves.join(sizes.where("blocks > 0"), "leaf").withColumn("block", block).join(lists, "node")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(
        "leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "weight", "vector", "leaves"
    )
    found = dealt.groupBy("leaf", "one", "two").applyInPandas(_compare(threshold), f"node {kind}, links long, root {kind}")
    found = stored(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node <> root"), "node", "root")
    of_node = nodes.join(links, "node", "left").join(joined, "node", "left").select(
        "label", F.col("vector").alias("embedding"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    of_node = stored(of_node, "answers").withColumn("mark", F.xxhash64("label", "embedding"))
    marked = rows.withColumn("mark", F.xxhash64("label", "embedding"))
    out = marked.where(usable).join(of_node, ["mark", "label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
