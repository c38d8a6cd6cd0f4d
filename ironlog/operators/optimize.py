"""Which repetition range, frequency and volume go with progress.

As in the progress tables, raw rows become weekly rows by a map-side combined
aggregation before any window sees them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ironlog.functions.stats import pearson, safe_corr, top_rows, volume, with_status
from ironlog.keys import KEYS
from ironlog.operators.onerm import ESTIMATE
from ironlog.operators.progress import week_of

# Repetition bands, both ends included.
REP_BANDS = (
    ("1-3 (Strength)", 1, 3),
    ("4-6 (Power)", 4, 6),
    ("7-10 (Hypertrophy)", 7, 10),
    ("11+ (Endurance)", 11, 50),
)
# Volume quartiles from lowest to highest.
VOLUME_BUCKETS = (
    "Low (Bottom 25%)",
    "Moderate (25-50%)",
    "High (50-75%)",
    "Very High (Top 25%)",
)
MIN_BAND_ROWS = 5
MIN_WEEKS = 4
MAX_SESSIONS = 7


def rep_band_stats(
    log: DataFrame,
    keys: Sequence[str] = KEYS,
    window_days: int | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Progress correlation, mean estimate and volume per repetition band.

    With ``window_days``, only rows of so many days up to ``as_of`` count.
    """
    if window_days is not None:
        if as_of is None:
            raise ValueError("window_days needs as_of")
        today = F.lit(as_of).cast("date")
        log = log.filter(F.col("Date").between(F.date_sub(today, window_days), today))
    reps = F.col("Reps")
    band = F.lit(None).cast("int")
    name = F.lit(None).cast("string")
    for number, (label, low, high) in enumerate(REP_BANDS, start=1):
        band = F.when(reps.between(low, high), number).otherwise(band)
        name = F.when(F.col("band_no") == number, label).otherwise(name)
    # A correlation does not depend on the day that is counted from.  Rows
    # without an estimate are left out inside the aggregates, not by a filter
    # that would compute every estimate a second time.
    est = F.col(ESTIMATE)
    date = F.when(est.isNotNull(), F.col("Date"))
    day = F.datediff(date, F.lit("2000-01-01").cast("date")).cast("double")
    known = F.when(est.isNotNull(), volume())
    return (
        log.withColumn("band_no", band)
        .filter(F.col("band_no").isNotNull())
        .groupBy(*keys, "band_no")
        .agg(
            pearson(day, est).alias("_corr"),
            (F.min(date) == F.max(date)).alias("_one_day"),
            F.avg(est).alias("average_1rm"),
            F.coalesce(F.sum(known), F.lit(0.0)).alias("total_volume"),
            F.count(est).alias("session_count"),
        )
        .filter(F.col("session_count") >= MIN_BAND_ROWS)
        .select(
            *keys,
            "band_no",
            name.alias("rep_range"),
            F.when(F.col("_one_day"), 0.0)
            .otherwise(F.col("_corr"))
            .alias("correlation_with_progress"),
            "average_1rm",
            "total_volume",
            "session_count",
            (F.col("total_volume") / F.col("session_count")).alias(
                "avg_volume_per_session"
            ),
        )
    )


def rep_band_rank(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bands by correlation; at most four per key."""
    order = [F.desc_nulls_last("correlation_with_progress"), F.asc("band_no")]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (
        rep_band_stats(log, keys)
        .withColumn("rank", place)
        .withColumn("recommended", F.col("rank") == 1)
        .select(
            *keys, "rep_range", "correlation_with_progress", "rank", "recommended"
        )
    )


def weekly_sessions(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Training days and best estimate per week."""
    return log.groupBy(*keys, week_of(F.col("Date")).alias("Week")).agg(
        F.count_distinct("Date").alias("Sessions"),
        F.max(ESTIMATE).alias("Best_1RM"),
    )


def _enough_weeks(weekly: DataFrame, keys: Sequence[str]) -> DataFrame:
    weeks = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return weekly.withColumn("_weeks", weeks).filter(F.col("_weeks") >= MIN_WEEKS)


def frequency_stats(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean best estimate and trend per number of sessions in a week."""
    same = W.partitionBy(*keys, "Sessions").orderBy("Week")
    weekly = _enough_weeks(weekly_sessions(log, keys), keys).filter(
        F.col("Sessions").between(1, MAX_SESSIONS)
    )
    ordinal = F.col("_ordinal").cast("double")
    weeks = F.col("week_count")
    return (
        weekly.withColumn("_ordinal", F.row_number().over(same))
        .groupBy(*keys, "Sessions")
        .agg(
            F.avg("Best_1RM").alias("average_1rm"),
            F.count(F.lit(1)).alias("week_count"),
            safe_corr(ordinal, F.col("Best_1RM")).alias("_corr"),
        )
        .filter(weeks >= 2)
        .select(
            *keys,
            "Sessions",
            "average_1rm",
            "week_count",
            F.when(weeks >= 3, F.col("_corr"))
            .otherwise(0.0)
            .alias("progress_correlation"),
            F.when(weeks >= 4, "Good").otherwise("Limited").alias("sample_size"),
        )
    )


def optimal_frequency(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frequency with the highest mean, and how often the lift is trained.

    One pass: the weekly table is summed up per number of sessions, and those
    few rows per key give both the overall figures and the winner.
    """
    sessions, weeks = F.col("Sessions"), F.col("weeks")
    per_frequency = (
        weekly_sessions(log, keys)
        .groupBy(*keys, "Sessions")
        .agg(F.avg("Best_1RM").alias("average_1rm"), F.count(F.lit(1)).alias("weeks"))
    )
    candidate = (weeks >= 2) & sessions.between(1, MAX_SESSIONS)
    # highest mean first, missing means last, then the lowest frequency
    order = F.struct(
        F.col("average_1rm").isNull(), -F.col("average_1rm"), sessions.alias("n")
    )
    enough = F.col("_weeks") >= MIN_WEEKS
    overall = per_frequency.groupBy(*keys).agg(
        F.sum(weeks).alias("_weeks"),
        (F.sum(weeks * sessions) / F.sum(weeks)).alias("average_frequency"),
        F.concat_ws("-", F.min(sessions), F.max(sessions)).alias("frequency_range"),
        F.min(F.when(candidate, order)).alias("_best"),
    )
    return overall.select(
        *keys,
        F.when(enough, F.col("_best.n")).alias("optimal_frequency"),
        F.when(enough, F.col("average_frequency")).alias("average_frequency"),
        F.when(enough, F.col("frequency_range")).alias("frequency_range"),
        F.when(enough, "ok").otherwise("insufficient").alias("status"),
    )


def weekly_volume_stats(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Volume and best estimate of every week with volume; four weeks or more."""
    weekly = (
        log.groupBy(*keys, week_of(F.col("Date")).alias("Week"))
        .agg(
            F.sum(volume()).alias("Weekly_Volume"), F.max(ESTIMATE).alias("Best_1RM")
        )
        .filter(F.col("Weekly_Volume") > 0)
    )
    return _enough_weeks(weekly, keys).drop("_weeks")


def _bucket(value: Column, quartiles: Column) -> Column:
    """1 to 4; a value on a boundary belongs to the upper bucket."""
    return (
        F.when(value < quartiles[0], 1)
        .when(value < quartiles[1], 2)
        .when(value < quartiles[2], 3)
        .otherwise(4)
    )


def volume_buckets(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weeks grouped by exact volume quartiles of their own key."""
    quartiles = F.percentile(
        "Weekly_Volume", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    ).over(W.partitionBy(*keys))
    name = F.element_at(F.array(*map(F.lit, VOLUME_BUCKETS)), F.col("bucket_no"))
    amount = F.col("Weekly_Volume")
    # halves to even before formatting, which would round them up
    whole = [F.format_string("%.0f", F.bround(f(amount), 0)) for f in (F.min, F.max)]
    return (
        weekly_volume_stats(log, keys)
        .withColumn("_quartiles", quartiles)
        .withColumn("bucket_no", _bucket(amount, F.col("_quartiles")))
        .groupBy(*keys, "bucket_no")
        .agg(
            F.avg("Best_1RM").alias("average_1rm"),
            F.count(F.lit(1)).alias("week_count"),
            F.avg(amount).alias("avg_volume"),
            F.concat_ws("-", *whole).alias("volume_range"),
        )
        .filter(F.col("week_count") >= 2)
        .withColumn("bucket", name)
    )


def optimal_volume(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bucket with the best mean estimate; ``insufficient`` if no bucket qualifies."""
    order = [F.desc_nulls_last("average_1rm"), F.asc("bucket_no")]
    found = top_rows(volume_buckets(log, keys), keys, order).select(
        *keys,
        F.col("bucket").alias("optimal_volume_bucket"),
        F.col("avg_volume").alias("optimal_volume"),
    )
    return with_status(found, log, keys)


def volume_advice(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of weekly volume with strength, put into a word.

    No correlation (a constant side) counts as ``Decrease``: it passes neither
    threshold.
    """
    r = F.col("volume_correlation")
    found = (
        weekly_volume_stats(log, keys)
        .groupBy(*keys)
        .agg(
            safe_corr(F.col("Weekly_Volume"), F.col("Best_1RM")).alias(
                "volume_correlation"
            ),
            F.avg("Weekly_Volume").alias("average_weekly_volume"),
        )
        .withColumn(
            "volume_recommendation",
            F.when(r > 0.3, "Increase").when(r > -0.3, "Maintain").otherwise("Decrease"),
        )
    )
    return with_status(found, log, keys)
