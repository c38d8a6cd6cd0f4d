"""Merkle manifest of a dataset, with a proof for every row found by pointer jumping."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ironlog.llm.common import discard, only, stored

#: Consecutive nodes that hang on one parent.
FAN = 3
#: Levels that grow from one shuffle.
CLIMB = 6
#: The tree over the roots of all sources.
TOP = -1

_PATH = "array<struct<left:binary,right:binary>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length: "-" if null, else its UTF-8 byte count, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*(field(c) for c in (doc_id, source, lang, n_chars, text)))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with tree (the number of their ``source_key`` in order), place (from 0 inside the tree) and total (its rows).

    Rows are dealt out by ranges of (source_key, order), so a source of any size is spread over tasks.  A row's place
    follows from its rank in its range and from counts per range and source: one small table.
    """
    key = ["source_key", *order]
    rows = stored(rows.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("part", "source_key").agg(F.count("*").alias("n"))
    first = Window.partitionBy("source_key")
    counts = stored(counts.withColumn("begins", (F.col("part") == F.min("part").over(first)).cast("long")).withColumn("total", F.sum("n").over(first)), "counts")
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"), F.sum("begins").alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_parts") for c in ("n", "b")))
    inside = Window.partitionBy("part").orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    held = counts.withColumns({"n_inside": F.coalesce(F.sum("n").over(inside), F.lit(0)), "b_inside": F.coalesce(F.sum("begins").over(inside), F.lit(0))})
    held = held.join(parts, "part").withColumn("at", F.col("n_parts") + F.col("n_inside"))
    held = held.select(
        "part", "source_key", "total", (F.col("at") - F.min("at").over(first)).alias("offset"),
        (F.col("b_parts") + F.col("b_inside") + F.col("begins") - 1).alias("tree"),
    )
    held = stored(held, "offsets")
    rank = F.row_number().over(Window.partitionBy("part", "source_key").orderBy(*order))
    out = rows.withColumn("rank", rank).join(held, ["part", "source_key"])
    columns = [c for c in rows.columns if c not in ("part", "source_key")]
    out = stored(out.select(*columns, "tree", "total", (F.col("offset") + F.col("rank") - 1).alias("place")), "placed")
    discard(rows)
    return out


def _level(below: Column) -> Column:
    """Digests of the runs of FAN digests in order."""
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda j: F.unhex(F.sha2(F.array_join(F.transform(F.slice(below, FAN * j + 1, F.lit(FAN)), _hex), ""), 256)))


def _parents(k: int, level: int) -> Column:
    """The nodes of a block's k-th level as structs."""
    place, total = (F.col("block") * FAN ** (CLIMB - k)).cast("long"), F.ceil(F.col("total") / FAN**k).cast("long")
    return F.transform(f"level{k}", lambda digests, j: F.struct(
        F.lit(level + k).alias("level"), (place + j).alias("place"), total.alias("total"), digests.alias("hash"),
        F.slice(f"level{k - 1}", FAN * j + 1, F.lit(FAN)).alias("members"),
    ))


def _grown(nodes: DataFrame, most: int) -> tuple[list[DataFrame], int]:
    """The runs of all levels over (tree, place, total, hash) leaves, and the number of levels.

    A row is a parent, (tree, level, place, total, hash), with the digests of its members in order; ``level`` is its own,
    ``total`` the number of nodes there.  A tree ends where one node remains; ``most`` is the largest tree's number of leaves.
    A shuffle gathers FAN ** CLIMB consecutive nodes, from which CLIMB levels follow inside the row.
    """
    tables, level, height = [], 0, 0
    while most > 1:
        rows = nodes.where("total > 1").groupBy("tree", F.floor(F.col("place") / FAN**CLIMB).alias("block"), "total")
        rows = rows.agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("m")).withColumn("level0", F.col("m.hash"))
        for k in range(1, CLIMB + 1):
            more = F.ceil(F.col("total") / FAN ** (k - 1)) > 1
            rows = rows.withColumn(f"level{k}", F.when(more, _level(F.col(f"level{k - 1}"))).otherwise(F.array().cast("array<binary>")))
            most, height = (ceil(most / FAN), height + 1) if most > 1 else (most, height)
        tables.append(stored(rows.select("tree", F.inline(F.concat(*(_parents(k, level) for k in range(1, CLIMB + 1))))), "runs"))
        level += CLIMB
        nodes = tables[-1].where(F.col("level") == level).select("tree", "place", "total", "hash")
    return tables, height


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _siblings(runs: DataFrame) -> DataFrame:
    """(tree, level, place, left, right, up_tree, up_level, up_place) of the runs' members.

    left and right hold the digests of the siblings on either side; up_ names the parent.  The root of a source's
    tree is known as the leaf of the top tree whose place is the number of the source.
    """
    side = lambda which: F.unhex(F.array_join(F.transform(F.filter("members", which), lambda m: F.hex(m)), ""))
    rows = runs.select("tree", F.col("level").alias("up_level"), F.col("place").alias("up_place"), "total", "members", F.posexplode("members").alias("i", "own"))
    ends = (F.col("total") == 1) & (F.col("tree") != TOP)
    return rows.select(
        "tree", (F.col("up_level") - 1).alias("level"), (FAN * F.col("up_place") + F.col("i")).alias("place"),
        side(lambda _, j: j < F.col("i")).alias("left"), side(lambda _, j: j > F.col("i")).alias("right"),
        F.when(ends, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("up_tree"),
        F.when(ends, F.lit(0)).otherwise(F.col("up_level")).alias("up_level"),
        F.when(ends, F.col("tree")).otherwise(F.col("up_place")).alias("up_place"),
    )


_NODE = ["tree", "level", "place"]
_UP = ["up_tree", "up_level", "up_place"]


def _jumped(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, level, place, path): the siblings of each node and of its ancestors up to the root, which has an empty path.

    Every node holds the segment towards its up_ node.  A join of the table with itself appends the segment that the
    up_ node holds and points to where that one points: the distance doubles each time, so ``height`` needs log2 rounds.
    Few nodes are far up: a join key may be pointed at by many rows, which adaptive execution splits.
    """
    path = F.array(F.struct("left", "right")).cast(_PATH)
    none = F.array().cast(_PATH)
    nodes = nodes.select(*_NODE, F.when(F.col("up_level").isNull(), none).otherwise(path).alias("path"), *_UP)
    nodes = stored(nodes, "segments")
    distance = 1
    while distance < height:
        ahead = nodes.select(*(F.col(n).alias(u) for n, u in zip(_NODE, _UP, strict=True)), F.col("path").alias("rest"), *(F.col(u).alias(f"next_{u}") for u in _UP))
        joined = nodes.join(ahead, _UP, "left").select(*_NODE, F.concat("path", F.coalesce("rest", none)).alias("path"), *(F.col(f"next_{u}").alias(u) for u in _UP))
        done, nodes = nodes, stored(joined, "segments")
        discard(done)
        distance *= 2
    return nodes.select(*_NODE, "path")


def manifest(docs: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path, and the ``extra`` columns (binary, computed from documents).

    leaf is the digest of doc_id, source, lang, n_chars and text, each with its length.  Per source, leaves stand in the
    order of doc_id (null first, then by their digest, so rows that share an id have one order); every FAN consecutive
    nodes become the digest of them, the last run perhaps of fewer, until one remains: the subroot, which for a lone leaf is
    the leaf.  Subroots in the order of their sources (null first, then by UTF-8 bytes) become the root in the same way.
    path lists, from the leaf to the root, the digests left and right of the row's ancestor in its run.

    Equal rows are leaves of their own; an empty table gives an empty result; further columns are ignored.  Nothing is
    gathered but FAN ** CLIMB digests, whatever a source holds.
    """
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = only(docs, *names)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    extra = extra or {}
    leaves = docs.select("doc_id", key.alias("source_key"), F.unhex(leaf_hash(*(F.col(n) for n in names))).alias("hash"), *(c.alias(n) for n, c in extra.items()))
    leaves = placed(leaves, ["doc_id", "hash", *extra])
    most, trees = leaves.agg(F.max("total"), F.max("tree")).first()
    if most is None:
        shape = ("leaf", "subroot", "root")
        return leaves.select("doc_id", *(F.hex("hash").alias(c) for c in shape), F.array().cast(_PATH).alias("path"), *extra)

    runs, height = _grown(leaves, most)
    lone = leaves.where("total = 1").select("tree", "hash")
    subroots = stored(_union([lone, *(r.where("total = 1").select("tree", "hash") for r in runs)]), "subroots")
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees + 1).cast("long").alias("total"), "hash")
    top_runs, top_height = _grown(tops, trees + 1)
    last = _union([r.where("total = 1").select("hash") for r in top_runs]) if top_runs else tops
    root = last.select(_hex(F.col("hash"))).first()[0]

    ends = leaves.sparkSession.createDataFrame([(TOP, top_height, 0)], "tree long, level int, place long")
    nothing = {"left": "binary", "right": "binary", "up_tree": "long", "up_level": "int", "up_place": "long"}
    ends = ends.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()))
    inner = _union([ends, *(_siblings(r.where("level > 1")) for r in runs), *(_siblings(r) for r in top_runs)])
    paths = _jumped(inner, height + top_height)

    # A leaf's first segment leads to its parent; one more jump appends what the parent has gathered.
    held = leaves.select("tree", "place", "total", "doc_id", "hash", *extra)
    if runs:
        held = held.join(_siblings(runs[0].where("level = 1")).drop("level"), ["tree", "place"], "left")
        own = F.when(F.col("up_level").isNotNull(), F.array(F.struct("left", "right")).cast(_PATH)).otherwise(F.array().cast(_PATH))
    else:
        held = held.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()))
        own = F.array().cast(_PATH)
    alone = F.col("total") == 1
    held = held.select(
        "doc_id", "hash", *extra, F.col("tree").alias("of"), own.alias("first"),
        F.when(alone, F.lit(TOP)).otherwise(F.col("up_tree")).cast("long").alias("tree"),
        F.when(alone, F.lit(0)).otherwise(F.col("up_level")).alias("level"),
        F.when(alone, F.col("tree")).otherwise(F.col("up_place")).alias("place"),
    )
    out = held.join(paths, _NODE).join(subroots.select(F.col("tree").alias("of"), F.col("hash").alias("sub")), "of")
    return out.select("doc_id", _hex(F.col("hash")).alias("leaf"), _hex(F.col("sub")).alias("subroot"), F.lit(root).alias("root"), F.concat("first", "path").alias("path"), *extra)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: _hex(F.concat(s["left"], s["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf (hex) and its path."""
    return F.aggregate(path, leaf, lambda below, s: digest(_hex(s["left"]), below, _hex(s["right"])))


def tamper_check(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 2 divides the crc32 of the decimal doc_id, the text that is checked has lost its line feeds (a row without
    doc_id is never changed).  The leaf of what is there now is folded with the siblings of the original; the row
    is verified if that gives the root.
    """
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(changed, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    now = F.unhex(leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))
    rows = manifest(docs, {"now": now})
    rows = rows.withColumn("folded_root", folded(_hex(F.col("now")), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same result level by level; crc32 bit by bit.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295, [CAST(ord(c) AS BIGINT) FOR c IN str_split(CAST(doc_id AS VARCHAR), '')]),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, i: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295) % 2 = 0
    THEN replace(text, chr(10), '') ELSE text END AS now FROM documents
), l AS (
  SELECT doc_id, source, now IS DISTINCT FROM text AS changed,
    [coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || coalesce(strlen(x) || ':' || x, '-') FOR x IN [text, now]] AS versions,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM t
), leaves AS (
  SELECT *, sha256(versions[1]) AS leaf, sha256(versions[2]) AS leaf_now FROM l
), up AS (
  SELECT 0 AS lvl, s, place, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lvl + 1, s, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY lvl, s, place // 3
), subs AS (
  SELECT s, h, (SELECT count(DISTINCT s) FROM leaves) AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS lvl, s AS place, n, h FROM subs
  UNION ALL
  SELECT lvl + 1, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY lvl, place // 3
), path AS (
  SELECT leaves.s, leaves.place, u.lvl AS k, u.lvl, false AS of_top, leaves.place // CAST(power(3, u.lvl) AS BIGINT) AS pos FROM leaves JOIN (SELECT DISTINCT s, lvl FROM up WHERE n > 1) u USING (s)
  UNION ALL
  SELECT leaves.s, leaves.place, 1000 + u.lvl, u.lvl, true, leaves.s // CAST(power(3, u.lvl) AS BIGINT) FROM leaves, (SELECT DISTINCT lvl FROM top WHERE n > 1) u
), sides AS (
  SELECT path.s, path.place, k, pos, node.place AS other, h FROM path JOIN up node ON NOT of_top AND node.s = path.s AND node.lvl = path.lvl AND node.place // 3 = pos // 3
  UNION ALL
  SELECT path.s, path.place, k, pos, node.place, h FROM path JOIN top node ON of_top AND node.lvl = path.lvl AND node.place // 3 = pos // 3
), steps AS (
  SELECT s, place, row_number() OVER (PARTITION BY s, place ORDER BY k) AS step,
         coalesce(string_agg(h, '' ORDER BY other) FILTER (other < pos), '') AS l, coalesce(string_agg(h, '' ORDER BY other) FILTER (other > pos), '') AS r
  FROM sides GROUP BY s, place, k, pos
), fold AS (
  SELECT s, place, 0 AS step, leaf_now AS h FROM leaves
  UNION ALL
  SELECT f.s, f.place, f.step + 1, sha256(l || h || r) FROM fold f JOIN steps ON steps.s = f.s AND steps.place = f.place AND steps.step = f.step + 1
), ends AS (
  SELECT s, place, arg_max(h, step) AS folded_root FROM fold GROUP BY 1, 2
), proofs AS (
  SELECT s, place, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY 1, 2
)
SELECT doc_id, leaf, subs.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
       folded_root, folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM leaves JOIN subs USING (s) JOIN ends USING (s, place) LEFT JOIN proofs USING (s, place)
"""
