"""Mixing sources to target weights: fixed-length blocks of words, taken in pseudorandom order per source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ironlog.llm.common import SPACE, only, slices, stored
from ironlog.llm.running import with_start
from ironlog.llm.words import mix

#: Words in a block, blocks in an output shard, output shards that are drawn together.
BLOCK, SHARD_BLOCKS, TOGETHER = 256, 4096, 64
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 20_11
WORD = SPACE.replace("[", "[^", 1) + "+"
_U = np.uint64


def permuted(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. n - 1 puts ``index``; all three differ from row to row.

    Four Feistel rounds over the least even number of bits that holds n; places beyond n are permuted again.
    """
    x, n, seed = index.astype(_U), n.astype(_U), seed.astype(np.int64).view(_U)
    half = np.ones(len(x), _U)
    while (wide := (n > (_U(1) << (half * _U(2))))).any():
        half[wide] += _U(1)
    mask = (_U(1) << half) - _U(1)
    todo = np.ones(len(x), bool)
    while todo.any():
        h, m, s = half[todo], mask[todo], seed[todo]
        left, right = x[todo] >> h, x[todo] & m
        with np.errstate(over="ignore"):
            for turn in range(4):
                left, right = right, left ^ (mix(right + s * _U(2 * turn + 1) + _U(turn)) & m)
        x[todo] = (left << h) | right
        todo = x >= n
    return x.astype(np.int64)


@F.pandas_udf(T.LongType())
def _slot(block: pd.Series, blocks: pd.Series, seed: pd.Series) -> pd.Series:
    # a source without words has no block; its slot is not used
    return pd.Series(permuted(np.maximum(block.to_numpy(np.int64), 0), np.maximum(blocks.to_numpy(np.int64), 1), seed.to_numpy(np.int64)))


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: their part of ``share`` times all words.

    Sources by code point, null last, weigh ``weights`` in turn.  No target is above ``most`` times its source's size;
    the excess goes to the others by weight until none is above.  That is min(limit, weight * level) with one level for
    all, found from running sums over the sources in the order in which they reach their limit.  This window sees one
    row per source and nothing else.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    rows = sources.withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy()
    first = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "wanted": F.sum("source_size").over(whole) * F.lit(float(share)),
            "full": F.coalesce(F.sum("limit").over(first), F.lit(0.0)),
            "open": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(first), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("level", F.max((F.col("wanted") - F.col("full")) / F.col("open")).over(whole))
    return rows.select(*sources.columns, F.least("limit", F.col("w") * F.col("level")).alias("target"))


def _super(slot: str, groups: int) -> Column:
    """The group of output shards that takes this slot: ``slots`` are spread evenly over the groups."""
    return F.expr(f"(({slot} + 1) * {groups} + slots - 1) div slots - 1")


def _draw(seed: int, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Source counts of each output shard of a group: multinomial, given the totals that the group must use up."""
    rng = np.random.default_rng([seed, int(key[0])])
    rows = rows.sort_values("skey")
    left = rows["n"].to_numpy(np.int64).copy()
    sizes = np.diff(np.arange(TOGETHER + 1) * left.sum() // TOGETHER)
    drawn = []
    for size in sizes:
        counts = rng.multivariate_hypergeometric(left, int(size), method="marginals")
        left = left - counts
        drawn.append(counts)
    ends = np.cumsum(drawn, axis=0).T + rows["first_slot"].to_numpy(np.int64)[:, None]
    return pd.DataFrame({"skey": rows["skey"].to_numpy(), "grp": rows["grp"].to_numpy(), "ends": list(ends)})


def spans(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per document and block taken from it, at least one per row of ``docs`` (``words`` 0 if nothing is taken).

    Columns: doc_id, mark (hash of the text), size, source_size, target, start (place in the source's stream of words),
    word (first word taken, from 0), words, epoch, slot, shard (output shard).

    A source's documents form one stream of words in a fixed pseudorandom order, cut into blocks of ``block`` words.  Its
    word budget is its target, rounded: whole rounds over all blocks, then a part of one, in which the order is given by the
    source's own permutation of block numbers; the last block is cut so that the budget is met to the word.  Output shards draw their
    counts of blocks per source (``seed`` decides), and slots meet blocks by number.

    Null text has no words; null sources are one source.  Repeated rows are separate rows of the stream.
    """
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = only(docs, "doc_id", "text", "source").select(
        "doc_id", "source", skey.alias("skey"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("mark")
    )
    rows = with_start(stored(rows, "sizes"), "skey", ["doc_id", "mark"], "size")
    sizes = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, share, most, weights).drop("source")
    size, budget = F.col("source_size"), F.col("budget")
    plan = plan.withColumn("budget", F.round("target").cast("long")).withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    plan = plan.withColumn("rounds", F.when(size > 0, F.expr("budget div source_size")).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", budget - F.col("rounds") * size)
    plan = plan.withColumn("last_size", size - (F.col("blocks") - 1) * block)
    plan = plan.withColumn("last_slot", _slot(F.col("blocks") - 1, "blocks", F.xxhash64("skey", "rounds")))
    full = F.col("last_slot") * block
    touched = (
        F.when(F.col("rest") <= full, F.ceil(F.col("rest") / block))
        .when(F.col("rest") <= full + F.col("last_size"), F.col("last_slot") + 1)
        .otherwise(F.col("last_slot") + 1 + F.ceil((F.col("rest") - full - F.col("last_size")) / block))
    )
    plan = stored(plan.withColumn("slots", F.col("rounds") * F.col("blocks") + F.when(size > 0, touched).otherwise(0).cast("long")), "plan")

    groups = max(1, ceil((plan.agg(F.sum("slots")).first()[0] or 0) / (shard_blocks * TOGETHER)))
    used = plan.where("slots > 0").select("skey", "slots", F.explode(F.sequence(F.lit(0), F.least("slots", F.lit(groups)) - 1)).alias("i"))
    grp = F.when(F.col("slots") >= groups, F.col("i")).otherwise(_super("i", groups))
    first = F.expr(f"grp * slots div {groups}")
    used = used.withColumn("grp", grp.cast("long")).withColumn("first_slot", first).withColumn("n", F.expr(f"(grp + 1) * slots div {groups}") - F.col("first_slot"))
    shards = used.select("skey", "grp", "first_slot", "n").groupBy("grp").applyInPandas(lambda key, drawn: _draw(seed, key, drawn), "skey string, grp long, ends array<long>")

    taken = rows.drop("source").join(plan, "skey")
    blocks = F.when(F.col("size") > 0, F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))
    taken = taken.withColumn("block", F.explode_outer(blocks))
    rounds = F.when(budget > 0, F.sequence(F.lit(0), F.when(F.col("rest") > 0, F.col("rounds")).otherwise(F.col("rounds") - 1)))
    taken = taken.withColumn("epoch", F.explode_outer(F.when(F.col("block").isNotNull(), rounds)))
    there = F.col("epoch").isNotNull()
    inner = _slot(F.coalesce("block", F.lit(0)), "blocks", F.xxhash64("skey", F.coalesce("epoch", F.lit(0).cast("long"))))
    taken = taken.withColumn("inner", inner)
    before = F.col("inner") * block - F.when(F.col("inner") > F.col("last_slot"), block - F.col("last_size")).otherwise(0)
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    allowed = F.when(F.col("epoch") < F.col("rounds"), whole).otherwise(F.greatest(F.lit(0), F.least(whole, F.col("rest") - before)))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + allowed)
    taken = taken.withColumn("words", F.when(there, F.greatest(F.lit(0), end - begin)).otherwise(0).cast("long"))
    taken = taken.withColumn("word", begin - F.col("start")).withColumn("slot", F.col("epoch") * F.col("blocks") + F.col("inner"))
    taken = taken.withColumn("grp", F.when(F.col("words") > 0, _super("slot", groups)))
    joined = taken.join(shards, ["skey", "grp"], "left")
    shard = F.col("grp") * TOGETHER + F.size(F.filter("ends", lambda e: e <= F.col("slot")))
    return joined.select("doc_id", "mark", "skey", "size", "source_size", "target", "start", "word", "words", "epoch", "slot", shard.alias("shard"))


def mixture(docs: DataFrame, **settings: float) -> DataFrame:
    """doc_id, size, source_size, target, taken and blocks of every document (see ``spans``); taken counts repeats.

    ``blocks`` lists what the mix takes of the document, in order: the output shard that drew the slot, the slot in its source's
    permutation, the first word and the number of words; empty if nothing is taken.  Joined by shard and slot, over all
    documents, these are the shards.  A document has one entry per block of its own words and round.
    """
    row = ["doc_id", "skey", "mark", "size", "start", "source_size", "target"]
    block = F.when(F.col("words") > 0, F.struct("shard", "slot", "word", "words"))
    rows = spans(docs, **settings).groupBy(*row).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(block)).alias("blocks"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "blocks")


def _cut(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    word = re.compile(WORD)
    for rows in slices(batches):
        texts, keep = [], []
        for i, (text, parts) in enumerate(zip(rows.column("text").to_pylist(), rows.column("__parts").to_pylist(), strict=True)):
            at = [m.span() for m in word.finditer(text)]
            for p in parts:
                keep.append(i)
                texts.append(text[at[p["word"]][0] : at[p["word"] + p["words"] - 1][1]])
        new = {"text": texts, "n_chars": list(map(len, texts))}
        kept = pa.array(keep, pa.int64())
        of = {name: rows.schema.field(name).type for name in columns}
        yield pa.RecordBatch.from_arrays([pa.array(new[c], of[c]) if c in new else rows.column(c).take(kept) for c in columns], columns)


def mixed(docs: DataFrame, **settings: float) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row per document, round and run of taken words.

    ``text`` is the run as it stands in the document; ``n_chars``, if there, is its length.  A document that is taken
    whole in two rounds gives two rows, one that is not taken gives none.  Rows that share doc_id and text are
    one document here.
    """
    marked = docs.withColumn("__mark", F.xxhash64("text")).dropDuplicates(["doc_id", "__mark"])
    part = spans(marked, **settings).where("words > 0")
    # Neighbouring blocks of a document that are taken in one round are one run.
    rows = Window.partitionBy("doc_id", "mark", "epoch").orderBy("word")
    fresh = F.coalesce(F.lag(F.col("word") + F.col("words")).over(rows) != F.col("word"), F.lit(True))
    part = part.withColumn("run", F.sum(fresh.cast("int")).over(rows))
    part = part.groupBy("doc_id", "mark", "epoch", "run").agg(F.min("word").alias("word"), F.sum("words").alias("words"))
    part = part.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("epoch", "word", "words"))).alias("__parts"))
    part = part.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__m"), "__parts")
    both = marked.join(part, marked["doc_id"].eqNullSafe(part["__doc"]) & (marked["__mark"] == part["__m"]))
    columns = docs.columns
    return both.select(*columns, "__parts").mapInArrow(lambda it: _cut(it, columns), docs.schema)
