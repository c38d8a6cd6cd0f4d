"""Trend fits, forecasts, goals and competition attempts.

A series is first reduced to one value per day, so all later windows and sums
run over at most one row per calendar day and key; days outside the window are
kept, flagged, so that their keys are.  Every key of the input gets a
row; what cannot be computed is told by ``status``, never by a missing row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ironlog.functions import polyfit
from ironlog.functions.stats import top_rows
from ironlog.keys import KEYS, LIFT, owner_of
from ironlog.operators.onerm import ESTIMATE

DAYS_PER_MONTH = 30.44
GOAL_HORIZON = 730
MEET_MARGIN = 30

# Attempts as shares of the predicted maximum.
OPENER, SECOND, THIRD = 0.90, 0.97, 1.03
MAX_CONFIDENCE = 0.95

# Targets of the goal grid.
GOAL_GRID = {
    "Squat": (575, 600, 625),
    "Bench": (425, 450, 475),
    "Deadlift": (575, 600, 625),
}

# Targets per lift, or a table of keys and ``target``.
Goals = Mapping[str, Sequence[float]] | DataFrame

FIT_COLUMNS = (
    "data_points",
    "first_day",
    "last_day",
    "current_1rm",
    "degree",
    "model_type",
    "r2_score",
    "slope",
    "p0",
    "p1",
    "p2",
    "p3",
    "status",
)


def _as_date(value: str | Column) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("date")


# --- series -----------------------------------------------------------------


def _daily_in_window(
    log: DataFrame, days_back: int, keys: Sequence[str]
) -> DataFrame:
    """Daily best of every key; ``used`` marks valid days inside the window.

    The window ends at the owner's newest row over all lifts.
    """
    newest = F.max("Date").over(W.partitionBy(*owner_of(keys)))
    valid = F.when(F.col(ESTIMATE) > 0, F.col(ESTIMATE))
    return (
        log.groupBy(*keys, "Date")
        .agg(F.max(valid).alias(ESTIMATE))
        .withColumn("_newest", newest)
        .withColumn(
            "used",
            F.col(ESTIMATE).isNotNull()
            & (F.col("Date") >= F.date_sub("_newest", days_back)),
        )
    )


def progression_prep(
    log: DataFrame, days_back: int = 365, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Daily best per key in the window, with days since the first kept day."""
    first = F.min("Date").over(W.partitionBy(*keys))
    return (
        _daily_in_window(log, days_back, keys)
        .filter("used")
        .select(
            *keys,
            "Date",
            ESTIMATE,
            F.datediff("Date", first).alias("days_since_start"),
        )
    )


def _exercise_days(log: DataFrame, days_back: int, keys: Sequence[str]) -> DataFrame:
    """Per key, exercise and day: valid rows, and moments of the low-rep ones.

    Limited to the window, but with at least the keys of the whole log: rows
    outside it carry zero counts.
    """
    est = F.col(ESTIMATE)
    valid = F.coalesce(est > 0, F.lit(False))
    strength = F.when(valid & (F.col("Reps") <= 6), est)
    newest = F.max("Date").over(W.partitionBy(*owner_of(keys)))
    daily = (
        log.groupBy(*keys, "Exercise", "Date")
        .agg(
            F.count_if(valid).alias("rows"),
            F.count(strength).alias("n"),
            F.avg(strength).alias("mean"),
            F.coalesce(F.var_pop(strength), F.lit(0.0)).alias("var"),
        )
        .withColumn("cutoff", F.date_sub(newest, days_back))
    )
    inside = F.col("Date") >= F.col("cutoff")
    return daily.withColumns(
        {
            "rows": F.when(inside, F.col("rows")).otherwise(0),
            "n": F.when(inside, F.col("n")).otherwise(0),
        }
    )


def _main_exercise_stats(
    log: DataFrame, days_back: int, keys: Sequence[str]
) -> DataFrame:
    """Most frequent exercise per key, with mean and spread of its low-rep rows.

    Daily moments are merged by the law of total variance, so the raw rows are
    read once and combined on the map side.
    """
    group = [*keys, "Exercise"]
    mean, var, n = F.col("mean"), F.col("var"), F.col("n")
    whole = W.partitionBy(*group)
    weighted = F.sum(F.when(n > 0, n * mean)).over(whole)
    center = weighted / F.nullif(F.sum(n).over(whole), F.lit(0))
    squares = n * (var + F.pow(mean - F.col("center"), F.lit(2.0)))
    per_exercise = (
        _exercise_days(log, days_back, keys)
        .withColumn("center", center)
        .groupBy(*group)
        .agg(
            F.max("cutoff").alias("cutoff"),
            F.max("center").alias("center"),
            F.sum("rows").alias("entries"),
            F.sum("n").alias("n_low"),
            F.sum(F.when(n > 0, squares)).alias("squares"),
        )
    )
    order = [F.desc("entries"), F.asc_nulls_last("Exercise")]
    chosen = top_rows(per_exercise, keys, order)
    freedom = F.nullif(F.col("n_low") - 1, F.lit(0))
    present = F.col("entries") > 0
    return chosen.select(
        *keys,
        F.when(present, F.col("Exercise")).alias("main_exercise"),
        F.when(present, F.col("entries")).alias("entries"),
        "cutoff",
        "center",
        F.sqrt(F.col("squares") / freedom).alias("spread"),
    )


def main_exercise(
    log: DataFrame, days_back: int = 180, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Most frequent exercise of each key in the window; ties by name."""
    return _main_exercise_stats(log, days_back, keys).select(
        *keys, "main_exercise", "entries"
    )


def _filtered_daily(
    log: DataFrame, stats: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Daily best of the low-rep rows of the main exercise within two deviations.

    ``stats`` has one row per key.  The join key contains the exercise, which
    the aggregation after it does not, so adaptive execution is free to
    broadcast ``stats`` when it is small and to split a skewed key when it is
    not; the maximum is then combined on the map side.
    """
    bounds = stats.filter(F.col("spread").isNotNull()).select(
        *keys,
        F.col("main_exercise").alias("Exercise"),
        "cutoff",
        "center",
        # rounding of the mean must not put a constant series outside
        (2 * F.col("spread") + 1e-12 * F.abs("center")).alias("reach"),
    )
    est = F.col(ESTIMATE)
    rows = log.filter((est > 0) & (F.col("Reps") <= 6)).select(
        *keys, "Exercise", "Date", ESTIMATE
    )
    return (
        rows.join(bounds, [*keys, "Exercise"])
        .filter(
            (F.col("Date") >= F.col("cutoff"))
            & (F.abs(est - F.col("center")) <= F.col("reach"))
        )
        .groupBy(*keys, F.col("Exercise").alias("main_exercise"), "Date")
        .agg(F.max(ESTIMATE).alias(ESTIMATE))
    )


def progression_filtered(
    log: DataFrame, days_back: int = 180, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Filtered daily series with days since its first day."""
    first = F.min("Date").over(W.partitionBy(*keys))
    stats = _main_exercise_stats(log, days_back, keys)
    return _filtered_daily(log, stats, keys).select(
        *keys,
        "Date",
        ESTIMATE,
        F.datediff("Date", first).alias("days_since_start"),
    )


# --- fits -------------------------------------------------------------------


def _finish_fit(sums: DataFrame, keys: Sequence[str], robust: bool) -> DataFrame:
    r1, r2, r3 = F.col("r2_1"), F.col("r2_2"), F.col("r2_3")
    if robust:
        degree = F.when((r1 < 0.3) & (r2 > r1 + 0.1), 2).otherwise(1)
    else:
        degree = (
            F.when((r3 > r1) & (r3 > r2), 3).when(r2 > r1, 2).otherwise(1)
        )
    enough = F.col("data_points") >= polyfit.MIN_DAYS
    degree = F.when(enough, degree)
    fit = polyfit.coefficients(polyfit.solve(sums), degree)
    fit = fit.withColumns(
        {
            "model_type": F.when(F.col("degree") == 1, polyfit.DEGREE_NAMES[1])
            .when(F.col("degree") == 2, polyfit.DEGREE_NAMES[2])
            .when(F.col("degree") == 3, polyfit.DEGREE_NAMES[3]),
            "r2_score": F.when(F.col("degree") == 1, r1)
            .when(F.col("degree") == 2, r2)
            .when(F.col("degree") == 3, r3),
            "status": F.when(enough, "ok").otherwise("insufficient"),
        }
    )
    hidden = ["slope", "p0", "p1", "p2", "p3", "current_1rm"]
    fit = fit.withColumns({c: F.when(enough, F.col(c)) for c in hidden})
    return fit.select(*keys, *FIT_COLUMNS)


def trend_fit(
    log: DataFrame, days_back: int = 365, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Best of the straight line, quadratic and cubic by in-sample R-squared."""
    daily = _daily_in_window(log, days_back, keys)
    sums = polyfit.power_sums(daily, keys, F.col("used"), ESTIMATE)
    return _finish_fit(sums, keys, robust=False)


def trend_fit_robust(
    log: DataFrame, days_back: int = 180, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Straight line on the filtered series; quadratic only if clearly better."""
    by = [*keys, "main_exercise"]
    stats = _main_exercise_stats(log, days_back, keys)
    daily = _filtered_daily(log, stats, keys)
    sums = polyfit.power_sums(daily, by, F.lit(True), ESTIMATE)
    fit = _finish_fit(sums, by, robust=True)
    # the statistics have a row for every key of the log
    return stats.select(*keys).join(fit, list(keys), "left").withColumns(
        {
            "data_points": F.coalesce("data_points", F.lit(0)),
            "status": F.coalesce("status", F.lit("insufficient")),
        }
    )


def window_sweep(
    log: DataFrame,
    windows: Sequence[int] = (90, 180, 365),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The trend fit once per window length, from one daily table."""
    daily = _daily_in_window(log, max(windows), keys)
    swept = daily.withColumn(
        "window_days", F.explode(F.array(*[F.lit(w) for w in windows]))
    )
    used = F.col("used") & (
        F.col("Date") >= F.expr("date_sub(_newest, window_days)")
    )
    by = [*keys, "window_days"]
    sums = polyfit.power_sums(swept.withColumn("used", used), by, F.col("used"), ESTIMATE)
    return trend_metrics(_finish_fit(sums, by, robust=False))


# --- what follows from a fit -------------------------------------------------


def forecast(fit: DataFrame, days: int = 180, keys: Sequence[str] = KEYS) -> DataFrame:
    """One predicted value per day after the last day of the series."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(days)))
    return (
        fit.filter(F.col("status") == "ok")
        .withColumn("_ahead", ahead)
        .withColumn("_day", F.col("last_day") + F.col("_ahead"))
        .select(
            *keys,
            F.expr("date_add(first_day, _day)").alias("forecast_date"),
            polyfit.predict(F.col("_day")).alias("value"),
        )
    )


def trend_metrics(fit: DataFrame, days: int = 180) -> DataFrame:
    """Forecast at the horizon, gain in total and per month, direction."""
    end = polyfit.predict(F.col("last_day") + days)
    gain = F.col("forecast_1rm") - F.col("current_1rm")
    return (
        fit.withColumn("forecast_1rm", F.when(F.col("status") == "ok", end))
        .withColumn("projected_gain", gain)
        .withColumn(
            "monthly_gain", F.col("projected_gain") / (days / DAYS_PER_MONTH)
        )
        .withColumn(
            "trend_direction",
            F.when(F.col("monthly_gain") > 0, "increasing").when(
                F.col("monthly_gain").isNotNull(), "decreasing"
            ),
        )
    )


def _with_goals(fit: DataFrame, goals: Goals) -> DataFrame:
    """Every fit once per target of its lift (a mapping) or key (a table)."""
    if isinstance(goals, DataFrame):
        return fit.join(goals, [c for c in goals.columns if c != "target"])
    targets = F.lit(None).cast("array<double>")
    for lift, values in goals.items():
        listed = F.array(*[F.lit(float(v)) for v in values])
        targets = F.when(F.col(LIFT) == lift, listed).otherwise(targets)
    return fit.withColumn("target", F.explode(targets))


def goal_timeline(fit: DataFrame, goals: Goals, as_of: str) -> DataFrame:
    """First day within two years on which the forecast reaches the target.

    The horizon is searched inside the row, so goals do not multiply rows.
    """
    joined = trend_metrics(_with_goals(fit, goals), GOAL_HORIZON)
    horizon = F.sequence(F.lit(1), F.lit(GOAL_HORIZON))
    reaching = F.filter(
        horizon,
        lambda d: polyfit.predict(F.col("last_day") + d) >= F.col("target"),
    )
    ok = F.col("status") == "ok"
    achieved = F.col("target") <= F.col("current_1rm")
    return (
        joined.withColumn("_ahead", F.when(ok & ~achieved, F.get(reaching, F.lit(0))))
        .withColumn(
            "status",
            F.when(~ok, F.col("status"))
            .when(achieved, "already_achieved")
            .when(F.col("_ahead").isNull(), "unreachable")
            .otherwise("reachable"),
        )
        .withColumn("target_date", F.expr("date_add(first_day, last_day + _ahead)"))
        .withColumn("days_to_target", F.datediff("target_date", _as_date(as_of)))
        .withColumn("months_to_target", F.col("days_to_target") / DAYS_PER_MONTH)
        .drop("_ahead")
    )


def goal_timeline_linear(fit: DataFrame, goals: Goals, as_of: str) -> DataFrame:
    """Days to the target along the straight line, with a confidence word."""
    joined = _with_goals(fit, goals)
    ok = F.col("status") == "ok"
    achieved = F.col("target") <= F.col("current_1rm")
    rising = F.col("slope") > 0
    state = (
        F.when(~ok, F.col("status"))
        .when(achieved, "already_achieved")
        .when(rising, "reachable")
        .otherwise("unreachable")
    )
    needed = (F.col("target") - F.col("current_1rm")) / F.col("slope")
    reachable = F.col("status") == "reachable"
    open_goal = F.col("status").isin("reachable", "unreachable")
    r2 = F.col("r2_score")
    return (
        joined.withColumn("status", state)
        .withColumn("days_to_target", F.when(reachable, needed))
        .withColumn("months_to_target", F.col("days_to_target") / DAYS_PER_MONTH)
        .withColumn(
            "target_date", _add_days(_as_date(as_of), F.col("days_to_target"))
        )
        .withColumn(
            "monthly_gain", F.when(open_goal, F.col("slope") * DAYS_PER_MONTH)
        )
        .withColumn(
            "confidence",
            F.when(reachable & (r2 > 0.5), "High")
            .when(reachable & (r2 > 0.2), "Medium")
            .when(reachable, "Low"),
        )
    )


# Last day a timestamp can show in the usual calendars.
LAST_DATE = "9999-12-31"


def _add_days(start: Column, days: Column) -> Column:
    """Whole days added to a date; null beyond the calendar."""
    room = F.datediff(F.lit(LAST_DATE).cast("date"), start)
    return F.date_add(start, F.when(days <= room, F.floor(days)).cast("int"))


def goal_grid(
    fit: DataFrame, as_of: str, goals: Mapping[str, Sequence[float]] = GOAL_GRID
) -> DataFrame:
    """Several targets per lift along the straight line."""
    return goal_timeline_linear(fit, goals, as_of)


def meet_attempts(fit: DataFrame, meet_date: str, as_of: str) -> DataFrame:
    """Predicted maximum at a meet and three attempts.

    Forecast days are contiguous, so the nearest one is the meet day clamped
    to the forecast range.
    """
    meet, today = _as_date(meet_date), _as_date(as_of)
    days_to_meet = F.datediff(meet, today)
    last = F.col("last_day")
    nearest = F.greatest(
        F.least(F.datediff(meet, F.col("first_day")), last + days_to_meet + MEET_MARGIN),
        last + 1,
    )
    ok = (F.col("status") == "ok") & (days_to_meet >= 0)
    predicted = F.col("predicted_1rm")
    return (
        fit.withColumn("meet_date", meet)
        .withColumn("days_to_meet", days_to_meet)
        .withColumn("predicted_1rm", F.when(ok, polyfit.predict(nearest)))
        .withColumns(
            {
                "opener": predicted * OPENER,
                "second_attempt": predicted * SECOND,
                "third_attempt": predicted * THIRD,
                "confidence": F.when(
                    ok, F.least(F.col("r2_score"), F.lit(MAX_CONFIDENCE))
                ),
                "status": F.when(days_to_meet < 0, "past_meet").otherwise(
                    F.col("status")
                ),
            }
        )
    )


def model_compare(
    log: DataFrame, days: int = 180, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Monthly gain of the plain and of the robust fit side by side."""
    def metrics(fit: DataFrame, name: str) -> DataFrame:
        return trend_metrics(fit, days).select(
            *keys,
            F.col("status").alias(f"{name}_status"),
            F.col("current_1rm").alias(f"{name}_current_1rm"),
            F.col("monthly_gain").alias(f"{name}_monthly_gain"),
            F.col("data_points").alias(f"{name}_data_points"),
            F.col("r2_score").alias(f"{name}_r2_score"),
        )

    plain = metrics(trend_fit(log, keys=keys), "plain")
    robust = metrics(trend_fit_robust(log, keys=keys), "robust")
    return plain.join(robust, list(keys), "full")
