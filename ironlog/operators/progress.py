"""Progress tables: records, recent form, weekly and monthly load.

Raw rows are always aggregated before anything is partitioned by athlete or
lift alone: first to one row per day (or week, or month), which Spark combines
on the map side, and only then do windows run, over at most one row per
calendar day of a series.  A single athlete with a third of all rows is
therefore no larger for a task than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ironlog.functions import onerm
from ironlog.functions.stats import top_rows, volume
from ironlog.keys import KEYS, LIFT, MAIN_LIFTS, owner_of
from ironlog.operators.onerm import ESTIMATE, main_lifts

PR_MAX_REPS = 10
DEFAULT_GOAL = 400
GOAL_STEP = 25


def _between(column: Column, start: str | None, end: str | None) -> Column:
    low = F.lit(True) if start is None else column >= F.lit(start).cast("date")
    high = F.lit(True) if end is None else column <= F.lit(end).cast("date")
    return low & high


def week_of(date: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", date).cast("date")


def month_of(date: Column) -> Column:
    return F.date_trunc("month", date).cast("date")


def rm_progression(
    log: DataFrame,
    lift: str | None = None,
    method: str = "best",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Best estimate of a method per day and series."""
    column = ESTIMATE if method == "best" else f"1rm_{method}"
    rows = log if lift is None else log.filter(F.col(LIFT) == lift)
    # missing estimates are left out after the aggregation: a filter before it
    # would be pushed to the scan and compute every estimate twice
    return (
        rows.groupBy(*keys, "Date")
        .agg(F.max(column).alias(ESTIMATE))
        .filter(F.col(ESTIMATE).isNotNull())
    )


def max_1rm_by_lift(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The row with the highest estimate of each series; ties to the earliest."""
    order = [
        F.desc_nulls_last(ESTIMATE),
        F.asc_nulls_last("Date"),
        F.asc_nulls_last("Load"),
        F.asc_nulls_last("Reps"),
        F.asc_nulls_last("RPE"),
    ]
    best = top_rows(
        log.select(*keys, ESTIMATE, "Date", "Load", "Reps", "RPE"), keys, order
    )
    return best.select(
        *keys,
        F.col(ESTIMATE).alias("Max_1RM"),
        "Date",
        F.col("Load").alias("Weight_Used"),
        "Reps",
        "RPE",
    )


def _daily_with_cutoff(log: DataFrame, days: int, keys: Sequence[str]) -> DataFrame:
    """Best estimate and row count per day; ``recent`` marks the last ``days``."""
    newest = F.max("Date").over(W.partitionBy(*owner_of(keys)))
    return (
        log.groupBy(*keys, "Date")
        .agg(F.max(ESTIMATE).alias(ESTIMATE), F.count(F.lit(1)).alias("entries"))
        .withColumn("recent", F.col("Date") >= F.date_sub(newest, days))
    )


def recent_progress(
    log: DataFrame, days: int = 90, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Best estimate and rows within ``days`` of the owner's newest row."""
    return (
        _daily_with_cutoff(log, days, keys)
        .filter("recent")
        .groupBy(*keys)
        .agg(
            F.max(ESTIMATE).alias("Recent_Max_1RM"),
            F.sum("entries").alias("Entries"),
        )
    )


def progress_delta(
    log: DataFrame, days: int = 90, keys: Sequence[str] = KEYS
) -> DataFrame:
    """All-time best, recent best and their difference, from one daily table."""
    recent_best = F.max(F.when(F.col("recent"), F.col(ESTIMATE)))
    return (
        _daily_with_cutoff(log, days, keys)
        .groupBy(*keys)
        .agg(
            F.max(ESTIMATE).alias("Max_1RM"),
            recent_best.alias("Recent_Max_1RM"),
            F.count_if("recent").alias("_recent_days"),
        )
        .withColumn(
            "Progress",
            F.when(
                F.col("_recent_days") > 0, F.col("Recent_Max_1RM") - F.col("Max_1RM")
            ).otherwise(0.0),
        )
        .drop("_recent_days")
    )


def workout_stats(
    log: DataFrame, by: Sequence[str] = ("athlete_id",), main_only: bool = False
) -> DataFrame:
    """Training days, rows, span and days per week; of the main lifts only if asked."""
    if main_only:
        log = main_lifts(log)
    per_day = log.groupBy(*by, "Date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(LIFT).isin(*MAIN_LIFTS)).alias("main"),
        F.count_if(F.col(LIFT) == "Accessory").alias("accessory"),
    )
    totals = per_day.groupBy(*by).agg(
        F.count("Date").alias("total_workouts"),
        F.sum("rows").alias("total_entries"),
        F.min("Date").alias("first_workout"),
        F.max("Date").alias("last_workout"),
        F.sum("main").alias("main_lift_entries"),
        F.sum("accessory").alias("accessory_entries"),
    )
    span = F.datediff("last_workout", "first_workout")
    return totals.withColumns(
        {
            "date_range_days": span,
            "workouts_per_week": F.col("total_workouts")
            / F.greatest(F.lit(1.0), span / 7),
        }
    )


def rep_prs(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Heaviest load per series and repetition count, with its date and exercise."""
    rows = main_lifts(log).filter(F.col("Reps") <= PR_MAX_REPS)
    order = [
        F.desc_nulls_last("Load"),
        F.asc_nulls_last("Date"),
        F.asc_nulls_last("Exercise"),
    ]
    group = [*keys, "Reps"]
    best = top_rows(rows.select(*group, "Load", "Date", "Exercise"), group, order)
    known = F.col("Load").isNotNull()
    return best.select(
        *group,
        F.col("Load").alias("Max_Weight"),
        F.when(known, F.col("Date")).alias("Date"),
        F.when(known, F.col("Exercise")).alias("Exercise"),
    )


def rep_pr_matrix(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Records as a grid: one row per repetition count, one column per lift."""
    rows = main_lifts(log).filter(F.col("Reps") <= PR_MAX_REPS)
    return (
        rows.groupBy(*owner_of(keys), "Reps")
        .pivot(LIFT, sorted(MAIN_LIFTS))
        .agg(F.max("Load"))
        .na.fill(0.0, sorted(MAIN_LIFTS))
    )


def progression_series(
    log: DataFrame,
    start: str | None = None,
    end: str | None = None,
    lifts: Sequence[str] = MAIN_LIFTS,
    method: str = "best",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Daily best estimate in a date range, without days far below the median."""
    load, reps, rpe = F.col("Load"), F.col("Reps"), F.col("RPE")
    est = F.col(ESTIMATE)
    daily = (
        log.filter(
            F.col(LIFT).isin(*lifts)
            & _between(F.col("Date"), start, end)
            & (load > 0)
            & (reps > 0)
        )
        .withColumn(ESTIMATE, onerm.estimate(method, load, reps, rpe))
        .groupBy(*keys, "Date")
        .agg(F.max(F.when((est > 0) & (est < 1000), est)).alias(ESTIMATE))
        .filter(est.isNotNull())
    )
    series = W.partitionBy(*keys)
    # a single day is its own median, so it always stays
    return (
        daily.withColumn("_median", F.percentile(ESTIMATE, F.lit(0.5)).over(series))
        .filter(F.col(ESTIMATE) >= F.col("_median") * 0.5)
        .drop("_median")
    )


def weekly_rpe(
    log: DataFrame,
    start: str | None = None,
    end: str | None = None,
    lifts: Sequence[str] = MAIN_LIFTS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    return (
        log.filter(
            F.col(LIFT).isin(*lifts)
            & _between(F.col("Date"), start, end)
            & (F.col("RPE") > 0)
        )
        .groupBy(*keys, week_of(F.col("Date")).alias("Week"))
        .agg(F.bround(F.avg("RPE"), 1).alias("RPE"))
    )


def weekly_volume(
    log: DataFrame,
    start: str | None = None,
    end: str | None = None,
    lifts: Sequence[str] = MAIN_LIFTS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    return (
        log.filter(F.col(LIFT).isin(*lifts) & _between(F.col("Date"), start, end))
        .groupBy(*keys, week_of(F.col("Date")).alias("Week"))
        .agg(F.coalesce(F.sum(volume()), F.lit(0.0)).alias("volume"))
    )


def monthly_frequency(
    log: DataFrame,
    start: str | None = None,
    end: str | None = None,
    by: Sequence[str] = ("athlete_id",),
) -> DataFrame:
    """Training days per month, the owner's average and a low-activity flag."""
    monthly = (
        log.filter(_between(F.col("Date"), start, end))
        .groupBy(*by, month_of(F.col("Date")).alias("Month"))
        .agg(F.count_distinct("Date").alias("Workouts"))
    )
    average = F.avg("Workouts").over(W.partitionBy(*by))
    return monthly.withColumn("Average", average).withColumn(
        "Low_Activity", F.col("Workouts") < F.col("Average") * 0.5
    )


def recent_prs(
    log: DataFrame,
    as_of: str,
    days: int = 180,
    n: int = 8,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Newest ``n`` repetition records of the last ``days`` per owner."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days)
    order = [F.desc("Date"), F.asc(LIFT), F.asc("Reps")]
    recent = rep_prs(log, keys).filter(F.col("Date") >= cutoff)
    return top_rows(recent, owner_of(keys), order, n).drop("Exercise")


def competition_bests(meet_rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Heaviest competition lift per series, with its date and place."""
    order = [
        F.desc_nulls_last("Load"),
        F.asc_nulls_last("Date"),
        F.asc_nulls_last("Place"),
    ]
    best = top_rows(meet_rows.select(*keys, "Load", "Date", "Place"), keys, order)
    return best.withColumnRenamed("Load", "Best_Weight")


def meet_results_recent(
    meet_rows: DataFrame, n: int = 8, by: Sequence[str] = ("athlete_id",)
) -> DataFrame:
    """Newest ``n`` competition lifts per owner."""
    columns = [LIFT, "Load", "Place", "Total"]
    order = [F.desc_nulls_last("Date"), *[F.asc_nulls_last(c) for c in columns]]
    return top_rows(meet_rows.select(*by, "Date", *columns), by, order, n)


def overlay_series(
    log: DataFrame,
    meet_rows: DataFrame,
    start: str | None = None,
    end: str | None = None,
    lifts: Sequence[str] = MAIN_LIFTS,
    method: str = "best",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Training estimates and competition lifts as points of one chart."""
    training = progression_series(log, start, end, lifts, method, keys).select(
        *keys,
        "Date",
        F.col(ESTIMATE).alias("Weight"),
        F.lit(None).cast("string").alias("Place"),
        F.lit("Training").alias("source"),
    )
    meets = meet_rows.filter(
        F.col(LIFT).isin(*lifts) & _between(F.col("Date"), start, end)
    ).select(
        *keys, "Date", F.col("Load").alias("Weight"), "Place",
        F.lit("Meets").alias("source"),
    )
    return training.unionByName(meets)


def default_goal(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Best estimate plus a step for every lift, a fixed goal where none exists."""
    owner = owner_of(keys)
    wide = log.groupBy(*owner).agg(
        *[
            F.max(F.when(F.col(LIFT) == lift, F.col(ESTIMATE))).alias(lift)
            for lift in MAIN_LIFTS
        ]
    )
    goal = F.coalesce(
        F.expr(f"cast(best as bigint) + {GOAL_STEP}"), F.lit(DEFAULT_GOAL)
    )
    return wide.unpivot(owner, list(MAIN_LIFTS), LIFT, "best").select(
        *owner, LIFT, goal.cast("bigint").alias("goal")
    )
