"""Near-duplicate documents by an LSH forest over MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ironlog.llm.common import only, stored
from ironlog.llm.components import components
from ironlog.llm.words import mix, shingle_hashes, stream, word_hashes

WIDTH = 5
#: Signature values, sorted orders ("trees"), and values by which an order grows deeper.
VALUES, TREES, STEP, LEVELS = 128, 16, 4, 4
#: Chance that two documents of the asked similarity agree on the first STEP values of no tree; lower similarities get more trees.
MISS = 1e-5
#: A region with more members than this is read at the next depth.
REGION = 8
#: Members whose common shingles are a crowd's reference; rows of a crowd or of one shingle that a task takes at a time.
SAMPLE, LANE = 63, 1000
#: Standard deviations below the threshold at which a signature's estimate still sends a pair to the exact check.
SLACK = 5.0

_U = np.uint64
_FACTORS = stream(7, VALUES)
_SEALS = (_U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F))


def _shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    words, counts = word_hashes(texts)
    hashes, per = shingle_hashes(words, counts, WIDTH)
    at = 0
    for n in per:
        yield np.unique(hashes[at : at + n])
        at += n


def _signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of each of VALUES multiplicative hashes, the upper 32 bits."""
    least = np.full(VALUES, ~_U(0))
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 4096):
            np.minimum(least, (_FACTORS[:, None] * shingles[None, a : a + 4096]).min(axis=1), out=least)
    return (least >> _U(32)).astype(np.uint32).view(np.int32)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            sizes, one, two, signatures = [], [], [], []
            for s in _shingle_sets(part.column(1)):
                sizes.append(len(s))
                with np.errstate(over="ignore"):
                    one.append((mix(s + _SEALS[0]).sum(dtype=_U)).view(np.int64))
                    two.append((mix(s + _SEALS[1]).sum(dtype=_U)).view(np.int64))
                signatures.append(_signature(s) if len(s) else np.zeros(0, np.int32))
            at = np.cumsum([0, *(len(s) for s in signatures)]).astype(np.int32)
            flat = np.concatenate([*signatures, np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["doc_id", "n_shingles", "mark_a", "mark_b", "signature"],
            )


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, mark_a, mark_b, signature) of each row; the two marks stand for the whole set."""
    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        _profiles, f"doc_id {kind}, n_shingles long, mark_a long, mark_b long, signature array<int>"
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            sets = pa.array([s.tobytes() for s in _shingle_sets(part.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), sets], ["node", "shingles"])


def _close(a: Column, b: Column, percent: int) -> Column:
    """Sizes that allow the asked similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _trees(percent: int) -> int:
    """TREES, or so many more, up to one for each STEP values, that pairs at the threshold are missed by less than MISS."""
    agree = (percent / 100) ** STEP
    return TREES if (1 - agree) ** TREES < MISS else VALUES // STEP


def _keys(nodes: DataFrame, trees: int) -> DataFrame:
    """(node, n_shingles, key0, key1, ...): for every tree the prefixes of the signature read in this tree's order, each STEP values longer."""
    rows = nodes.select("node", "n_shingles", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    for level in range(LEVELS):
        at = (F.col("tree") * (VALUES // trees) + level * STEP) % VALUES
        above = F.col(f"key{level - 1}") if level else F.col("tree").cast("long")
        rows = rows.withColumn(f"key{level}", F.xxhash64(above, F.slice("signature", at.cast("int") + 1, STEP)))
    return rows.select("node", "n_shingles", *(f"key{level}" for level in range(LEVELS)))


def _regions(nodes: DataFrame, n_trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Regions (key, node, n_shingles) of about REGION members, and (node, n_shingles, hub, hub_n) for large ones.

    Tree ``t`` sorts the nodes by their signature read from its own starting place.  Nodes that agree on STEP values
    are neighbours there; where more than REGION agree, the region is read STEP values deeper, and so on.  A node that is
    alone at the deeper level, or a region still large at the last level, stays with the last common prefix and is dealt
    to a region by a hash.

    Copies of one text may each be close to that text only and not to each other.  So each node is also paired with the
    hub of the deepest large region that it is in, in every tree, and a region's hub with the hub of the region around it.
    The hub is the member that shares most prefixes with others over all trees and levels.  What the hubs and the dealt
    regions leave apart is searched by ``crowd_links``.

    Keys of all levels come from the signature at once, so no signature is fetched again for each tree.
    """
    live = _keys(nodes, n_trees)
    names = [f"key{level}" for level in range(LEVELS)]
    small, loose, parts = [], [], []
    record = lambda last: F.struct(F.lit(last).alias("last"), F.array(*names).alias("keys"))
    none = F.lit(None).cast("struct<last:int,keys:array<bigint>>")
    for level, key in enumerate(names):
        groups = live.groupBy(key).agg(F.count("*").alias("members"))
        if not level:
            groups = groups.where("members > 1")
        live = stored(live.join(groups, key), "region")
        parts.append(live.where("members > 1").select("node", "n_shingles", "members", none.alias("record")))
        small.append(live.where((F.col("members") > 1) & (F.col("members") <= REGION)).select(F.col(key).alias("key"), "node", "n_shingles"))
        if level:  # these were in a large region one level above
            loose.append(live.where("members = 1").select(F.col(names[level - 1]).alias("key"), "node", "n_shingles"))
            out = live.where(F.col("members") <= REGION)
            parts.append(out.select("node", "n_shingles", F.lit(0).cast("long").alias("members"), record(level - 1).alias("record")))
        live = live.where(F.col("members") > REGION)
        if level + 1 == LEVELS:
            loose.append(live.select(F.col(key).alias("key"), "node", "n_shingles"))
            parts.append(live.select("node", "n_shingles", F.lit(0).cast("long").alias("members"), record(level).alias("record")))
        elif live.isEmpty():
            break
        live = live.drop("members")
    regions = _union(small)
    if loose:
        rest = stored(_union(loose), "loose")
        rest = rest.join(rest.groupBy("key").agg(F.count("*").alias("members")), "key")
        lane = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / REGION))
        regions = regions.unionByName(rest.select(F.xxhash64("key", lane).alias("key"), "node", "n_shingles"))

    # one row per node and tree with the node's degree; a region's hub is the greatest of its members, whatever their depth
    degrees = _union(parts).groupBy("node", "n_shingles").agg(F.sum("members").alias("degree"), F.collect_list("record").alias("records"))
    held = stored(degrees.where(F.size("records") > 0).select("node", "n_shingles", "degree", F.inline("records")), "members")
    best = F.max_by(F.struct("node", "n_shingles"), F.struct("degree", -F.col("node"))).alias("hub")
    hubs = [
        held.where(F.col("last") >= level).groupBy(F.col("keys")[level].alias("key")).agg(best, F.first(F.col("keys")[max(0, level - 1)]).alias("above"))
        for level in range(LEVELS)
    ]
    hubs = stored(_union([h.withColumn("level", F.lit(level)) for level, h in enumerate(hubs)]), "hubs")
    own = held.select("node", "n_shingles", F.col("keys")[F.col("last")].alias("key"), F.col("last").alias("level"))
    inner = hubs.where("level > 0").select("hub.node", "hub.n_shingles", F.col("above").alias("key"), (F.col("level") - 1).alias("level"))
    stars = own.unionByName(inner).join(hubs.select("key", "level", "hub"), ["key", "level"]).where("node <> hub.node")
    stars = stars.select("node", "n_shingles", F.col("hub.node").alias("hub"), F.col("hub.n_shingles").alias("hub_n"))
    return regions, stars.distinct()


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def candidate_pairs(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, alike) with a < b: neighbours in some order whose signatures allow the asked similarity; and the large regions' (node, hub)."""
    regions, stars = _regions(nodes, _trees(percent))
    stars = stored(stars, "hubs")
    left = regions.select("key", F.col("node").alias("a"), F.col("n_shingles").alias("a_n"))
    right = regions.select("key", F.col("node").alias("b"), F.col("n_shingles").alias("b_n"))
    pairs = left.join(right, "key").where("a < b").select("a", "a_n", "b", "b_n")
    first = F.col("node") < F.col("hub")
    pick = lambda x, y: (F.when(first, F.col(x)).otherwise(F.col(y)), F.when(first, F.col(y)).otherwise(F.col(x)))
    (a, b), (a_n, b_n) = pick("node", "hub"), pick("n_shingles", "hub_n")
    pairs = pairs.unionByName(stars.select(a.alias("a"), a_n.alias("a_n"), b.alias("b"), b_n.alias("b_n")))
    pairs = pairs.where(_close(F.col("a_n"), F.col("b_n"), percent)).select("a", "b").distinct()
    share = percent / 100
    least = int(VALUES * share - SLACK * (VALUES * share * (1 - share)) ** 0.5)
    of = nodes.select("node", "signature")
    both = pairs.join(of.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a").join(
        of.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b"
    )
    alike = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda same: same))
    return stored(both.select("a", "b", alike.alias("alike")).where(F.col("alike") >= least), "candidates"), stars.select("node", "hub")


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            at = np.searchsorted(p, q)
            common = int((p[np.minimum(at, len(p) - 1)] == q).sum())
            keep[i] = 100 * common >= percent * (len(p) + len(q) - common)
        yield batch.select([0, 1]).filter(pa.array(keep))


def shingle_sets(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) for the documents of the pairs only, written once.

    The texts always meet the ids in a shuffle: the ids grow with the input, so they are not broadcast.
    """
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = only(docs, "doc_id", "text").hint("merge").join(needed, "doc_id", "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(texts.mapInArrow(_sets, f"node {kind}, shingles binary"), "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""
    kind = sets.schema["node"].dataType.simpleString()
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(lambda it: _confirm(it, percent), f"a {kind}, b {kind}")


def _reference(key: tuple, rows: pa.Table) -> pa.Table:
    """The shingles that more than half of a crowd's sampled members hold."""
    sets = [np.frombuffer(s.as_buffer(), _U) for s in rows.column("shingles")]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    return pa.table({"crowd": [key[0]], "reference": pa.array([values[2 * counts > len(sets)].tobytes()], pa.binary())})


def _differences(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The shingles that a member and its crowd's reference do not share, and the member's weight."""
    for batch in batches:
        apart, weights, sizes = [], [], []
        for x, y in zip(batch.column(3), batch.column(4), strict=True):
            p = np.frombuffer(x.as_buffer(), _U)
            d = np.setxor1d(p, np.frombuffer(y.as_buffer(), _U), assume_unique=True)
            apart.append(d.tobytes())
            sizes.append(len(d))
            weights.append((100 + percent) * len(d) - (100 - percent) * len(p))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(weights, pa.int64()), pa.array(sizes, pa.int64()), pa.array(apart, pa.binary())],
            ["node", "crowd", "part", "weight", "n_apart", "apart"],
        )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of ``apart``, the last column."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(part.num_columns - 1)]
            of = pa.array(np.repeat(np.arange(len(sets)), [len(d) for d in sets]))
            flat = pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in part.columns[:-1]), flat], [*part.schema.names[:-1], "token"])


def _share(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        wanted = batch.column(2).to_numpy()
        for i, (x, y) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
            common = np.intersect1d(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), assume_unique=True)
            keep[i] = wanted[i] <= 2 * (100 + percent) * len(common)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _rooted(rows: DataFrame, known: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of ``node`` so far, itself if it has no link."""
    at = known.select(F.col("node").alias(node), F.col("component").alias("__root"))
    return rows.join(at, node, "left").withColumn(name, F.coalesce("__root", node)).drop("__root")


def _open(members: DataFrame) -> DataFrame:
    """The (crowd) ids whose members are in several components."""
    return members.groupBy("crowd").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("crowd")


def crowd_links(stars: DataFrame, known: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The components ``known`` joined as all similar pairs inside large regions would join them.

    Large regions that share members or hubs are one crowd.  Any set R may be its reference; here it is what most of a
    sample of its members hold, which restores a common original that is not in the table.  With D(a) the shingles that
    a and R do not share and weight w(a) = (100 + percent) |D(a)| - (100 - percent) |a|, a pair is similar exactly when
    w(a) + w(b) <= 2 (100 + percent) |D(a) & D(b)|.  So:

    - pairs with w(a) + w(b) <= 0 are similar, and linking each such member with the crowd's least weight connects them all;
    - any other similar pair shares a shingle of D among the first |D| - k + 1 of both, in one order, k being the number it
      must share.  Rarest first, these meet by equality, in lanes where many members hold one.
    """
    across = _rooted(_rooted(stars, known, "node", "x"), known, "hub", "y").where("x <> y")
    if across.isEmpty():
        return known
    crowds = stored(components(stars, "node", "hub").select("node", F.col("component").alias("crowd")), "crowds")
    members = _rooted(crowds, known, "node", "root")
    members = stored(members.join(_open(members), "crowd", "left_semi").select("node", "crowd"), "members")

    ids = members.select(F.col("node").alias("a"), F.col("node").alias("b"))
    sets = shingle_sets(ids, docs).withColumn("part", F.xxhash64("shingles")).dropDuplicates(["node", "part"])  # an id may have several texts
    held = members.join(sets, "node")
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = Window.partitionBy("crowd").orderBy(F.xxhash64("node"), "node")
    sample = members.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= SAMPLE)
    sample = held.join(sample.select("node"), "node", "left_semi")
    references = sample.groupBy("crowd").applyInArrow(_reference, f"crowd {kind}, reference binary")
    lanes = members.groupBy("crowd").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    references = references.join(lanes, "crowd").select("crowd", "reference", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
    dealt = held.join(lanes, "crowd").withColumn("lane", F.pmod(F.xxhash64("node"), F.col("lanes")).cast("int"))
    both = dealt.join(references, ["crowd", "lane"]).select("node", "crowd", "part", "shingles", "reference")
    apart = stored(both.mapInArrow(lambda it: _differences(it, percent), f"node {kind}, crowd {kind}, part long, weight long, n_apart long, apart binary"), "apart")

    centres = stored(apart.groupBy("crowd").agg(F.min_by(F.struct("node", "weight"), F.struct("weight", "node")).alias("c")).select("crowd", "c.*"), "centres")
    centres = centres.select("crowd", F.col("node").alias("centre"), F.col("weight").alias("least"))
    near = apart.drop("apart").join(centres, "crowd").where("node <> centre AND weight + least <= 0")
    links = stored(near.select(F.col("node").alias("a"), F.col("centre").alias("b")), "links")
    edges = links.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
    now = stored(components(edges, "a", "b"), "known")

    rooted = _rooted(apart, now, "node", "root")
    need = F.greatest(F.lit(1), F.ceil((F.col("weight") + F.col("least")) / (2 * (100 + percent)))).cast("long")
    live = rooted.join(_open(rooted.drop("apart")), "crowd", "left_semi").join(centres, "crowd").withColumn("need", need).where("need <= n_apart")
    live = stored(live.select("node", "crowd", "part", "root", "weight", "n_apart", "need", "apart"), "live")
    if live.isEmpty():
        return now
    fields = f"node {kind}, crowd {kind}, part long, root {kind}, weight long, n_apart long, need long"
    tokens = stored(live.select("node", "crowd", "part", "root", "weight", "n_apart", "need", "apart").mapInArrow(_tokens, f"{fields}, token long"), "tokens")
    counts = tokens.groupBy("crowd", "token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    place = Window.partitionBy("crowd", "node", "part").orderBy("n", "token")
    ranked = tokens.join(counts, ["crowd", "token"]).withColumn("place", F.row_number().over(place))
    ranked = stored(ranked.where("low <> high AND place <= n_apart - need + 1").withColumn("lanes", F.ceil(F.col("n") / LANE).cast("int")), "ranked")
    side = lambda x, lane: ranked.select(
        "crowd", "token", lane.alias("lane"), *(F.col(c).alias(f"{x}_{c}") for c in ("node", "part", "root", "weight", "n_apart", "place"))
    )
    met = side("a", F.pmod(F.xxhash64("node"), F.col("lanes")).cast("int")).join(
        side("b", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))), ["crowd", "token", "lane"]
    )
    wanted = F.col("a_weight") + F.col("b_weight")
    share = F.greatest(F.lit(1), F.ceil(wanted / (2 * (100 + percent))))
    met = met.where("a_node < b_node AND a_root <> b_root")
    met = met.where((F.col("a_place") <= F.col("a_n_apart") - share + 1) & (F.col("b_place") <= F.col("b_n_apart") - share + 1))
    met = stored(met.select("a_node", "a_part", "b_node", "b_part", wanted.alias("wanted")).distinct(), "met")
    of = lambda x: live.select(*(F.col(c).alias(f"{x}_{c}") for c in ("node", "part", "apart")))
    met = met.join(of("a"), ["a_node", "a_part"]).join(of("b"), ["b_node", "b_part"])
    met = met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "wanted", "a_apart", "b_apart")
    found = stored(met.mapInArrow(lambda it: _share(it, percent), f"a {kind}, b {kind}"), "links")
    if found.isEmpty():
        return now
    return stored(components(found.unionByName(now.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b"), "known")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of five-word shingles
    (A-Z lower-cased).  Texts of one to four words have one shingle, all their words; null and blank texts
    have none, link with nothing and are kept.  Equal sets are one node from the start, so copies add no pairs.
    component_id is the smallest doc_id that links reach; kept says that it is the row's own.  Rows that
    share a doc_id count as one document; rows without doc_id link with nothing, have a null component and are kept.
    """
    rows = stored(profiles(docs), "profiles")
    marks = ["mark_a", "mark_b", "n_shingles"]
    named = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = stored(named.groupBy(*marks).agg(F.min("doc_id").alias("node"), F.min_by("signature", "doc_id").alias("signature")), "nodes")
    pairs, stars = candidate_pairs(nodes.select("node", "n_shingles", "signature"), percent)

    # First each node's most similar partner, then only pairs that this has not yet connected.
    best = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "alike")).groupBy("a").agg(
        F.max_by("b", F.struct("alike", -F.col("b"))).alias("b")
    )
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = shingle_sets(pairs, docs)
    first = stored(confirmed(best, sets, percent), "links")
    known = stored(components(first, "a", "b"), "known")
    tried = pairs.join(best, ["a", "b"], "left_anti")
    roots = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"{x}_root"))
    tried = tried.join(roots("a"), "a", "left").join(roots("b"), "b", "left")
    apart = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
    second = stored(confirmed(stored(tried.where(apart).select("a", "b"), "apart"), sets, percent), "links")
    same = rows.where("doc_id IS NOT NULL").join(nodes.select(*marks, "node"), marks).where("doc_id <> node")
    repeated = rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = same.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    later = second.unionByName(twice)
    if later.isEmpty():
        found = known
    else:
        found = stored(components(later.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b"), "found")
    found = crowd_links(stars, found, docs, percent)

    of = nodes.join(found, "node", "left").select(*marks, F.coalesce("component", "node").alias("root"))
    out = rows.join(stored(of, "roots"), marks, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def survivors(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group of near duplicates at ``percent``, all columns."""
    kept = near_duplicates(docs, percent).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
