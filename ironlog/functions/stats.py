"""Statistics that need care under ANSI arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def volume() -> Column:
    """Sets x Reps x Load; null as soon as one of them is unknown."""
    return F.col("Sets") * F.col("Reps") * F.col("Load")


def share(part: Column, whole: Column) -> Column:
    """Percentage; null for an empty whole."""
    return 100.0 * part / F.nullif(whole, F.lit(0))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation of the complete pairs; null when a side is constant.

    The built-in ``corr`` raises a division error on constants in ANSI mode.
    ``x`` must be null wherever ``y`` is, and the other way round.
    """
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null when either side is constant or has a gap."""
    whole = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) == F.count(F.lit(1))
    return F.when(whole, pearson(x, y))


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1
) -> DataFrame:
    """First ``n`` rows per key.

    Written as ``row_number() <= n`` so that Spark limits every map task to its
    own best ``n`` rows per key before the shuffle: a hot key costs no more
    than ``n`` rows per task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def with_status(found: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of the log: ``ok`` with its figures, else ``insufficient`` and nulls.

    Reads the key columns of the log once more.
    """
    every = log.select(*keys).distinct()
    known = found.withColumn("status", F.lit("ok"))
    return every.join(known, list(keys), "left").withColumn(
        "status", F.coalesce("status", F.lit("insufficient"))
    )
