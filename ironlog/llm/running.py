"""Running sums over groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ironlog.llm.common import stored

LANE_ROWS = 20_000


def with_start(rows: DataFrame, key: str, order: list[str], amount: str, name: str = "start", lane_rows: int = LANE_ROWS) -> DataFrame:
    """``rows`` (written to the shared folder) with ``name``: the sum of ``amount`` over earlier rows of the same ``key``.

    Rows are dealt by a hash of the ``order`` columns to lanes of about ``lane_rows`` rows; they are put in order inside
    a lane, and lanes follow one another.  A window over whole groups sees one row per lane only.  Rows that tie in
    ``order`` keep one fixed order once written.
    """
    total = rows.count()
    lanes = max(1, ceil(total / lane_rows))
    rows = rows.withColumn("__lane", F.pmod(F.xxhash64(*order), F.lit(lanes)))
    sums = rows.groupBy(key, "__lane").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(key).orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sums.select(key, "__lane", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")), "offsets")
    inside = Window.partitionBy(key, "__lane").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(offsets, [key, "__lane"])
    columns = [c for c in rows.columns if c != "__lane"]
    return stored(placed.select(*columns, (F.col("__before") + F.col("__inside")).alias(name)), "placed")
