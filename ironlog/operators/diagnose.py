"""Diagnostics: why a trend may be unreliable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ironlog.functions.stats import top_rows, with_status
from ironlog.keys import KEYS
from ironlog.operators.onerm import ESTIMATE

DAYS_PER_DIAGNOSTIC_MONTH = 30
SESSIONS_PER_MONTH = 8
MIN_SESSIONS = 3
EDGE_SESSIONS = 7
NOTABLE_CHANGE = 20


def _since(as_of: str, days: int) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), days)


def _recent(log: DataFrame, as_of: str, months_back: int) -> DataFrame:
    """Rows of the last months.

    Whether a row has a positive estimate is decided inside the aggregates that
    follow: as a filter it would be pushed to the scan and compute every
    estimate twice.
    """
    cutoff = _since(as_of, months_back * DAYS_PER_DIAGNOSTIC_MONTH)
    return log.filter(F.col("Date") >= cutoff)


def _valid(column: str) -> Column:
    return F.when(F.col(ESTIMATE) > 0, F.col(column))


def _daily(
    log: DataFrame, as_of: str, months_back: int, keys: Sequence[str]
) -> DataFrame:
    """Best estimate, top load and first exercise of each recent day.

    At most one row per calendar day and key.  Rows have no order of their own;
    "first" is the alphabetically first name.
    """
    return (
        _recent(log, as_of, months_back)
        .groupBy(*keys, "Date")
        .agg(
            F.max(_valid(ESTIMATE)).alias(ESTIMATE),
            F.max(_valid("Load")).alias("Load"),
            F.min(_valid("Exercise")).alias("Exercise"),
        )
        .filter(F.col(ESTIMATE).isNotNull())
    )


def _sessions(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with enough recent sessions for a diagnosis."""
    days = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sessions"))
    return days.filter(F.col("_sessions") >= MIN_SESSIONS).select(*keys)


def recent_daily(
    log: DataFrame,
    as_of: str,
    months_back: int = 6,
    n: int = 10,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Last ``n`` training days: best estimate, heaviest load, first exercise."""
    daily = _daily(log, as_of, months_back, keys)
    return top_rows(daily, keys, [F.desc("Date")], n)


def session_trend(
    log: DataFrame, as_of: str, months_back: int = 6, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Slope of the daily best per session, and per month of eight sessions."""
    ordinal = F.row_number().over(W.partitionBy(*keys).orderBy("Date"))
    found = (
        _daily(log, as_of, months_back, keys)
        .withColumn("_ordinal", ordinal.cast("double"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.regr_slope(ESTIMATE, "_ordinal").alias("per_session"),
        )
        .filter(F.col("sessions") >= MIN_SESSIONS)
        .withColumn("per_month", F.col("per_session") * SESSIONS_PER_MONTH)
    )
    return with_status(found, log, keys)


def high_low(
    log: DataFrame, as_of: str, months_back: int = 6, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Highest and lowest daily best with their (first) dates."""
    est, date = F.col(ESTIMATE), F.col("Date")
    found = (
        _daily(log, as_of, months_back, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_sessions"),
            F.max(est).alias("highest"),
            F.min_by(date, F.struct(-est, date)).alias("highest_date"),
            F.min(est).alias("lowest"),
            F.min_by(date, F.struct(est, date)).alias("lowest_date"),
        )
        .filter(F.col("_sessions") >= MIN_SESSIONS)
        .drop("_sessions")
    )
    return with_status(found, log, keys)


def exercise_variants(
    log: DataFrame, as_of: str, months_back: int = 6, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Recent exercises of each key, one per row, and whether there are several.

    The list is kept as rows because its length is not bounded.  A key with too few
    sessions has one row without an exercise.
    """
    enough = _sessions(_daily(log, as_of, months_back, keys), keys)
    names = (
        _recent(log, as_of, months_back)
        .groupBy(*keys, "Exercise")
        .agg(F.count(_valid(ESTIMATE)).alias("_rows"))
        .filter(F.col("_rows") > 0)
        .drop("_rows")
    )
    counts = names.groupBy(*keys).agg(F.count("Exercise").alias("n_exercises"))
    found = (
        names.join(counts, list(keys))
        .join(enough, list(keys), "left_semi")
        .withColumn("several", F.col("n_exercises") > 1)
    )
    return with_status(found, log, keys)


def load_variability(
    log: DataFrame, as_of: str, months_back: int = 6, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Spread of the daily top load, flagged above 30 % of its mean."""
    found = (
        _daily(log, as_of, months_back, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_sessions"),
            F.stddev_samp("Load").alias("load_std"),
            F.avg("Load").alias("load_mean"),
        )
        .filter(F.col("_sessions") >= MIN_SESSIONS)
        .drop("_sessions")
        .withColumn("high_variability", F.col("load_std") > F.col("load_mean") * 0.3)
    )
    return with_status(found, log, keys)


def rep_breakdown(
    log: DataFrame,
    as_of: str,
    months_back: int = 6,
    decimals: int = 1,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Rows and mean estimate per repetition count, for keys with enough sessions."""
    enough = _sessions(_daily(log, as_of, months_back, keys), keys)
    found = (
        _recent(log, as_of, months_back)
        .filter(F.col("Reps").isNotNull())
        .groupBy(*keys, "Reps")
        .agg(
            F.count(_valid(ESTIMATE)).alias("count"),
            F.bround(F.avg(_valid(ESTIMATE)), decimals).alias("mean"),
        )
        .filter(F.col("count") > 0)
        .join(enough, list(keys), "left_semi")
    )
    return with_status(found, log, keys)


def recent_vs_earlier(
    log: DataFrame, as_of: str, months_back: int = 6, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean of the last sessions against the first ones.

    Seven on either side; with fewer than fourteen sessions the early side is
    their first half.
    """
    group = W.partitionBy(*keys)
    early = F.when(F.col("_n") >= 2 * EDGE_SESSIONS, EDGE_SESSIONS).otherwise(
        F.floor(F.col("_n") / 2)
    )
    change = F.col("change")
    found = (
        _daily(log, as_of, months_back, keys)
        .withColumn("_place", F.row_number().over(group.orderBy("Date")))
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .filter(F.col("_n") >= MIN_SESSIONS)
        .groupBy(*keys)
        .agg(
            F.avg(
                F.when(F.col("_place") > F.col("_n") - EDGE_SESSIONS, F.col(ESTIMATE))
            ).alias("recent_avg"),
            F.avg(F.when(F.col("_place") <= early, F.col(ESTIMATE))).alias(
                "earlier_avg"
            ),
        )
        .withColumn("change", F.col("recent_avg") - F.col("earlier_avg"))
        .withColumn(
            "verdict",
            F.when(change < -NOTABLE_CHANGE, "deload")
            .when(change > NOTABLE_CHANGE, "improved")
            .otherwise("steady"),
        )
    )
    return with_status(found, log, keys)


def top_exercises(
    log: DataFrame, n: int = 3, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Most frequent exercises of each key; ties by name."""
    counts = (
        log.filter(F.col("Exercise").isNotNull())
        .groupBy(*keys, "Exercise")
        .agg(F.count(F.lit(1)).alias("entries"))
    )
    return top_rows(counts, keys, [F.desc("entries"), F.asc("Exercise")], n)


def recent_load_drop(
    log: DataFrame, as_of: str, days: int = 60, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Recent loads against the all-time best; ``insufficient`` without recent rows."""
    recent = F.col("Date") >= _since(as_of, days)
    load = F.when(recent, F.col("Load"))
    return (
        log.groupBy(*keys)
        .agg(
            F.count_if(recent).alias("_rows"),
            F.max(load).alias("recent_max"),
            F.avg(load).alias("recent_mean"),
            F.max("Load").alias("overall_max"),
        )
        .withColumn("dropped", F.col("recent_max") < F.col("overall_max") * 0.85)
        .withColumn("status", F.when(F.col("_rows") > 0, "ok").otherwise("insufficient"))
        .drop("_rows")
    )
