"""Shards of near-equal bytes by best-fit-decreasing packing of indivisible groups."""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironlog.llm.common import only, stored
from ironlog.llm.running import with_start

#: Items that one task packs, and the parts of a shard below which groups are first put together in crates.
LANE_ITEMS, FINENESS = 20_000, 64


def best_fit_decreasing(sizes: np.ndarray, capacity: int, bins: int | None = None) -> np.ndarray:
    """The bin of each item: the largest item first, each into the fullest bin that still has room for it.

    Bins are kept in order of their room (a sorted sequence searched by bisection, in the place of a balanced tree).
    Without ``bins`` a new bin is opened when none has room, also for an item above the capacity.  With ``bins`` so many are
    open from the start, and an item that fits nowhere goes where most room is.  Ties: earlier items and lower bins first.
    """
    out = np.zeros(len(sizes), np.int64)
    rooms: list[tuple[int, int]] = [(capacity, b) for b in range(bins or 0)]
    opened = len(rooms)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        elif bins:
            room, b = rooms.pop()
        else:
            room, b, opened = capacity, opened, opened + 1
        out[i] = b
        insort(rooms, (room - size, b))
    return out


def equal_bins(sizes: np.ndarray, bins: int) -> np.ndarray:
    """Best fit decreasing into ``bins`` bins of the least capacity, found by bisection, that holds all items.

    An item that is at least an equal share of what is left gets a bin to itself first, the last ones counted from the end.
    """
    out = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    alone, left = 0, int(sizes.sum())
    while alone < min(len(order), bins - 1) and int(sizes[order[alone]]) * (bins - alone) >= left:
        out[order[alone]] = bins - 1 - alone
        left -= int(sizes[order[alone]])
        alone += 1
    rest, bins = np.sort(order[alone:]), bins - alone
    own = sizes[rest]
    low, high = max(-(-left // bins), int(own.max(initial=0))), left
    best = np.zeros(len(rest), np.int64)
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(own, middle, bins)
        if int(np.bincount(found, own, bins).max()) <= middle:
            best, high = found, middle
        else:
            low = middle + 1
    if len(rest) and int(np.bincount(best, own, bins).max()) > high:
        best = best_fit_decreasing(own, high, bins)
    out[rest] = best
    return out


def _lane(key: tuple, rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values("item")
    bins = best_fit_decreasing(rows["bytes"].to_numpy(np.int64), capacity)
    return pd.DataFrame({"item": rows["item"].to_numpy(), "bytes": rows["bytes"].to_numpy(), "bin": [f"{key[0]}.{b}" for b in bins]})


def _in_lanes(items: DataFrame, capacity: int, count: int, level: int) -> DataFrame:
    """(item, bytes, bin): each lane of about LANE_ITEMS items packed by itself."""
    lanes = max(1, ceil(count / LANE_ITEMS))
    dealt = items.select("item", "bytes", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(lanes)).alias("lane"))
    packed = dealt.groupBy("lane").applyInPandas(lambda k, x: _lane(k, x, capacity), "item string, bytes long, bin string")
    return stored(packed.withColumn("bin", F.concat(F.lit(f"{level}."), "bin")), "crates")


def pack(spark: SparkSession, items: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(item, shard) for ``items`` (item string, bytes long): indivisible, all placed.

    ``shards``: so many shards of near-equal bytes.  ``capacity``: as few shards as best fit finds that hold at most so
    many bytes each (an item above it gets a shard of its own).

    Items are first packed into crates of a 64th of a shard at most, in lanes of about 20,000, and crates again until
    20,000 (or four a shard) are left; those are packed last.  No task and not the driver holds more than that.
    Under ``capacity`` with more crates than that, lanes are packed separately, at the cost of one shard each that may stay half empty.
    """
    count, total = items.agg(F.count("*"), F.sum("bytes")).first()
    if not count:
        return items.select("item", F.lit(0).alias("shard"))
    if capacity is None:
        limit = max(LANE_ITEMS, 4 * shards)
        crate = max(1, total // min(shards * FINENESS, limit // 4))
    else:
        limit, crate = LANE_ITEMS, max(1, capacity // FINENESS)
    chain = stored(items.select("item", F.col("item").alias("bin"), "bytes"), "items")
    level = 0
    while count > limit:
        packed = _in_lanes(chain.groupBy("bin").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("bin", "item"), crate, count, level)
        to = packed.select(F.col("item").alias("bin"), F.col("bin").alias("to"))
        chain = stored(chain.join(to, "bin").select("item", F.col("to").alias("bin"), "bytes"), "chain")
        now = packed.select("bin").distinct().count()
        level += 1
        shrinks, count = now < 0.9 * count, now
        if capacity is not None and not shrinks:
            break
    crates = chain.groupBy("bin").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("bin", "item")
    if count > limit:
        last = _in_lanes(crates, capacity, count, level)
        bins = stored(last.select("bin").distinct().withColumns({"all": F.lit(0), "one": F.lit(1)}), "bins")
        number = with_start(bins, "all", ["bin"], "one", "shard").select("bin", F.col("shard").cast("int").alias("shard"))
        last = last.join(number, "bin").select(F.col("item").alias("bin"), "shard")
    else:
        rows = crates.orderBy("item").toPandas()
        sizes = rows["bytes"].to_numpy(np.int64)
        bins = equal_bins(sizes, shards) if capacity is None else best_fit_decreasing(sizes, capacity)
        last = spark.createDataFrame(pd.DataFrame({"bin": rows["item"], "shard": bins.astype(np.int32)}), "bin string, shard int")
    return chain.join(last, "bin").select("item", "shard")


def byte_shards(docs: DataFrame, shards: int | None = 16, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Documents with equal texts are one group and stay together; null counts as empty.  ``size`` is the text's UTF-8
    bytes plus 1.  Shards get near-equal bytes as far as single groups allow (law ``bytes``), or at most
    ``capacity`` bytes.  ``slot`` numbers a shard's rows from 0 without gaps.  ``grown_shard`` is null under this law.
    Repeated rows are rows of their own in the same group; an empty table gives an empty result.

    A group is one row with its total while it is packed, however many rows it has; rows meet their group by equality.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("item")
    )
    rows = stored(rows, "rows")
    items = rows.groupBy("item").agg(F.sum("size").alias("bytes"))
    placed = rows.join(stored(pack(docs.sparkSession, items, shards, capacity), "packed"), "item")
    out = with_start(placed.withColumn("one", F.lit(1)), "shard", ["doc_id", "item"], "one", "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
