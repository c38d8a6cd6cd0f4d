"""Hard negatives for contrastive training: exact integer scores by Strassen multiplication, kept in mergeable heaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ironlog.llm.common import only, stored

#: Rows of a tile on either side; a product of two tiles has at most 32 MB.
ANCHORS, CANDIDATES = 1024, 4096
#: Matrices with a side of at most this many are multiplied row by column.
SMALL = 16
#: Components are multiplied by this and rounded down.
SCALE = 256


def strassen(a: np.ndarray, b: np.ndarray, small: int = SMALL) -> np.ndarray:
    """a @ b over int64 with seven products of quarters in place of eight; odd sides get a row or column of zeros.

    Additions and products are those of the integers modulo 2**64, so the result is exact wherever it fits int64.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= small:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.empty((2 * i, 2 * l), np.int64)
    c11, c12, c21, c22 = out[:i, :l], out[:i, l:], out[i:, :l], out[i:, l:]
    # each product is added where it belongs and let go
    p = strassen(a11 + a22, b11 + b22, small)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, small)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, small)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, small)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, small)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, small)
    c11 += strassen(a12 - a22, b21 + b22, small)
    return out[:m, :n]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones end in zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - at] = flat
    return out


def _scores(anchors: pa.Table, candidates: pa.Table) -> np.ndarray:
    width = max(pc.max(pc.list_value_length(t.column("vector"))).as_py() for t in (anchors, candidates))
    return strassen(_matrix(anchors.column("vector"), width), np.ascontiguousarray(_matrix(candidates.column("vector"), width).T))


def first(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, highest first, ties in order of place."""
    if len(scores) > most:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:most]


def _positives(anchors: pa.Table, candidates: pa.Table, most: int) -> pa.Table:
    """A heap of ``most`` positives for each anchor of the tile, from one tile of candidates with the same label."""
    out: list[list[np.ndarray]] = [[], [], []]
    if anchors.num_rows and candidates.num_rows:
        candidates = candidates.sort_by("vec_id")
        scores = _scores(anchors, candidates)
        rows, ids = candidates.column("row").to_numpy(), candidates.column("vec_id").to_numpy()
        for own, s in zip(anchors.column("row").to_numpy(), scores, strict=True):
            others = np.flatnonzero(rows != own)
            at = others[first(s[others], most)]
            for column, values in zip(out, (np.full(len(at), own), ids[at], s[at]), strict=True):
                column.append(values)
    return pa.table({n: pa.array(np.concatenate([*c, np.zeros(0, np.int64)])) for n, c in zip(("row", "positive_id", "positive_score"), out, strict=True)})


def _negatives(anchors: pa.Table, candidates: pa.Table, most: int, low: int, high: int) -> pa.Table:
    """For each anchor and each of its positives a heap of ``most`` negatives in the positive's window, from one tile."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    if anchors.num_rows and candidates.num_rows:
        candidates = candidates.sort_by("vec_id")
        scores = _scores(anchors, candidates)
        labels, ids = candidates.column("label").to_numpy(), candidates.column("vec_id").to_numpy()
        for own, label, wanted, s in zip(anchors.column("row").to_numpy(), anchors.column("label").to_numpy(), anchors.column("scores").to_pylist(), scores, strict=True):
            at = np.flatnonzero((labels != label) & (100 * s <= high * max(wanted)) & (100 * s >= low * min(wanted)))
            at = at[np.argsort(-s[at], kind="stable")]
            falling = -s[at]
            for place, p in enumerate(wanted):
                begin = np.searchsorted(100 * falling, -high * p, "left")
                found = at[begin : begin + most]
                found = found[100 * s[found] >= low * p]
                for column, values in zip(out, (np.full(len(found), own), np.full(len(found), place), ids[found], s[found]), strict=True):
                    column.append(values)
    names = ("row", "place", "negative_id", "negative_score")
    return pa.table({n: pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for n, c in zip(names, out, strict=True)})


def _heap(rows: DataFrame, key: list[str], score: str, tie: str, most: int) -> DataFrame:
    """The heaps of all tiles as one: ``most`` rows of a key with ``rank``; Spark keeps no more of them in any map task."""
    order = Window.partitionBy(*key).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _tiles(n: Column, rows: int) -> Column:
    return F.ceil(n / rows).cast("int")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows of (vec_id, label, vector).

    Vectors are integers (array of long), scores inner products in int64.  Rows where ``anchor`` holds are anchors.  An
    anchor's positives are its first ``positives`` other rows of the same label by falling score, ties by vec_id.  For each
    one the first ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive are returned.

    Every anchor meets every row: tiles of anchors and of candidates meet by equality of their numbers, first within a
    label, then over all.  Rows are dealt to tiles by a random number that is written down, so a label, or an id that
    repeats, may hold any part of them.  A tile pair leaves heaps of ``positives`` or ``negatives`` rows; they are merged by key.
    A shorter vector counts as ended by zeros; a score beyond int64 wraps around.  Rows that repeat are rows of their own.
    """
    rows = only(rows.withColumn("anchor", anchor), "vec_id", "label", "vector", "anchor")
    rows = stored(rows.withColumn("row", F.xxhash64(F.expr("uuid()"))), "vectors")
    counts = stored(rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).where("a > 0"), "labels")
    lane = lambda tiles: F.pmod(F.col("row"), tiles).cast("int")

    sized = rows.join(counts.select("label", _tiles(F.col("a"), ANCHORS).alias("a"), _tiles(F.col("n"), CANDIDATES).alias("c")), "label")
    columns = ["vec_id", "label", "row", "vector"]
    left = sized.where("anchor").select(*columns, lane(F.col("a")).alias("i"), _each(F.col("c")).alias("j"))
    fresh = [F.col(c).alias(c) for c in columns]  # columns of their own, for the sides come from one table
    right = sized.select(*fresh, _each(F.col("a")).alias("i"), lane(F.col("c")).alias("j"))
    near = left.groupBy("label", "i", "j").cogroup(right.groupBy("label", "i", "j")).applyInArrow(
        lambda a, c: _positives(a, c, positives), "row long, positive_id long, positive_score long"
    )
    near = stored(_heap(near, ["row"], "positive_score", "positive_id", positives), "positives")

    lists = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("near"))
    anchors = rows.where("anchor").join(lists, "row").select(*columns, F.col("near.positive_score").alias("scores"))
    n, a = rows.count(), int(counts.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0])
    a_tiles, c_tiles = (F.lit(max(1, -(-x // size))) for x, size in ((a, ANCHORS), (n, CANDIDATES)))
    left = anchors.select(*columns, "scores", lane(a_tiles).alias("i"), _each(c_tiles).alias("j"))
    right = rows.select(*fresh, _each(a_tiles).alias("i"), lane(c_tiles).alias("j"))
    far = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(
        lambda a, c: _negatives(a, c, negatives, low, high), "row long, place long, negative_id long, negative_score long"
    )
    far = _heap(far, ["row", "place"], "negative_score", "negative_id", negatives)
    ids = rows.where("anchor").select("row", F.col("vec_id").alias("anchor_id"))
    out = far.join(near.select("row", (F.col("rank") - 1).cast("long").alias("place"), "positive_id", "positive_score"), ["row", "place"]).join(ids, "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """``hard_negatives`` of ``embeddings`` for the rows whose vec_id is divisible by ``every``.

    Rows without vec_id or label, without a vector, or with a null or non-finite component take no part.  Where 7 divides
    vec_id, the label is moved on by one modulo ten.  Components are scaled by SCALE and rounded down to long.
    """
    rows = only(embeddings, "vec_id", "embedding", "label")
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(True)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    vector = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % every == 0)


#: The same result from all pairs of anchors and rows.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.e, b.e)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
