import math

import pytest
from pyspark.sql import functions as F

from ironlog.operators import progress
from ironlog.operators.onerm import ESTIMATE, with_1rm
from tests.helpers import D, entry, log_rows, rows


def _rm(spark, data):
    return log_rows(spark, data).withColumn(ESTIMATE, F.col("Load"))


def test_best_row_breaks_ties_by_date(spark):
    log = _rm(
        spark,
        [
            entry(D(2024, 3, 1), 200, 2),
            entry(D(2024, 2, 1), 200, 3),
            entry(D(2024, 1, 1), None, 3),
            entry(D(2024, 1, 1), None, 1, lift="Bench"),
        ],
    )
    got = {r["Lift_Type"]: r for r in rows(progress.max_1rm_by_lift(log), "Lift_Type")}
    assert got["Squat"]["Date"] == D(2024, 2, 1) and got["Squat"]["Reps"] == 3
    assert got["Bench"]["Max_1RM"] is None


def test_best_rows_are_limited_before_the_shuffle(spark):
    plan = spark._jvm.PythonSQLUtils.explainString(
        progress.max_1rm_by_lift(_rm(spark, [entry(D(2024, 1, 1), 1)]))
        ._jdf.queryExecution(),
        "simple",
    )
    before = plan.index("WindowGroupLimit") < plan.index("Exchange")
    assert before and plan.count("WindowGroupLimit") == 2
    assert plan.count("Exchange") == 1


def test_recent_window_is_measured_over_all_lifts(spark):
    log = _rm(
        spark,
        [
            entry(D(2024, 1, 1), 300),
            entry(D(2024, 3, 1), 250),
            entry(D(2024, 3, 1), None),
            entry(D(2024, 5, 1), 100, lift="Bench"),
            entry(D(2023, 1, 1), 400, lift="Deadlift"),
        ],
    )
    got = {r["Lift_Type"]: r for r in rows(progress.recent_progress(log), "Lift_Type")}
    assert set(got) == {"Squat", "Bench"}
    assert got["Squat"]["Recent_Max_1RM"] == 250 and got["Squat"]["Entries"] == 2
    delta = {r["Lift_Type"]: r for r in rows(progress.progress_delta(log), "Lift_Type")}
    assert delta["Squat"]["Progress"] == -50
    assert delta["Bench"]["Progress"] == 0
    assert delta["Deadlift"]["Progress"] == 0


def test_progression_methods(spark):
    day = D(2024, 1, 1)
    log = with_1rm(
        log_rows(spark, [entry(day, 100, 5, 8.0), entry(day, 90, 5), entry(day, None)])
    )
    best = progress.rm_progression(log).collect()
    assert len(best) == 1 and math.isclose(best[0][ESTIMATE], 100 / 0.84)
    epley = progress.rm_progression(log, "Squat", "epley").first()
    assert math.isclose(epley[ESTIMATE], 100 * (1 + 5 / 30))
    assert progress.rm_progression(log, "Bench").count() == 0


def test_stats_of_one_short_week(spark):
    log = log_rows(
        spark,
        [
            entry(D(2024, 1, 1), 100),
            entry(D(2024, 1, 1), 50, lift="Accessory"),
            entry(D(2024, 1, 3), 100),
        ],
    )
    got = progress.workout_stats(log).first()
    assert (got.total_workouts, got.total_entries, got.date_range_days) == (2, 3, 2)
    assert got.workouts_per_week == 2.0  # a span below one week counts as one
    assert (got.main_lift_entries, got.accessory_entries) == (2, 1)


def test_rep_records(spark):
    log = log_rows(
        spark,
        [
            entry(D(2024, 1, 1), 200, 3, exercise="A"),
            entry(D(2024, 1, 2), 200, 3, exercise="B"),
            entry(D(2024, 1, 1), None, 4),
            entry(D(2024, 1, 1), 300, 11),
            entry(D(2024, 1, 1), 300, None),
            entry(D(2024, 1, 1), 500, 3, lift="Accessory"),
        ],
    )
    got = {r["Reps"]: r for r in rows(progress.rep_prs(log), "Reps")}
    assert set(got) == {3.0, 4.0}
    assert got[3.0]["Exercise"] == "A" and got[3.0]["Max_Weight"] == 200
    assert got[4.0]["Max_Weight"] is None and got[4.0]["Date"] is None
    grid = {r["Reps"]: r for r in rows(progress.rep_pr_matrix(log), "Reps")}
    assert grid[3.0]["Squat"] == 200 and grid[3.0]["Bench"] == 0
    recent = progress.recent_prs(log, "2024-06-01", n=1)
    assert [r.Reps for r in recent.collect()] == [3.0]
    assert progress.recent_prs(log, "2025-06-01").count() == 0


def test_series_drops_days_below_half_the_median(spark):
    log = log_rows(
        spark,
        [entry(D(2024, 1, d), 200) for d in range(1, 5)]
        + [entry(D(2024, 1, 9), 99), entry(D(2024, 1, 10), 1500)],
    )
    days = {r.Date.day for r in progress.progression_series(log).collect()}
    assert days == {1, 2, 3, 4}
    only = progress.progression_series(log, "2024-01-09", "2024-01-09")
    assert only.count() == 1


def test_weekly_tables(spark):
    log = log_rows(
        spark,
        [
            entry(D(2024, 1, 7), 100, 2, 7.0),
            entry(D(2024, 1, 8), 100, 2, 7.0),
            entry(D(2024, 1, 14), 100, 3, 7.5),
            entry(D(2024, 1, 15), None, 3),
        ],
    )
    volume = {r.Week: r.volume for r in progress.weekly_volume(log).collect()}
    assert volume == {D(2024, 1, 1): 200, D(2024, 1, 8): 500, D(2024, 1, 15): 0}
    rpe = {r.Week: r.RPE for r in progress.weekly_rpe(log).collect()}
    assert rpe == {D(2024, 1, 1): 7.0, D(2024, 1, 8): 7.2}  # 7.25, half to even


def test_monthly_frequency(spark):
    days = [D(2024, 1, d) for d in range(1, 9)] + [D(2024, 3, 1), D(2024, 3, 1)]
    got = {
        r.Month: r
        for r in progress.monthly_frequency(
            log_rows(spark, [entry(d, 1) for d in days])
        ).collect()
    }
    assert {m: r.Workouts for m, r in got.items()} == {
        D(2024, 1, 1): 8, D(2024, 3, 1): 1,
    }
    assert got[D(2024, 3, 1)].Low_Activity and not got[D(2024, 1, 1)].Low_Activity
    assert got[D(2024, 3, 1)].Average == 4.5


def test_default_goal(spark):
    log = _rm(spark, [entry(D(2024, 1, 1), 300.9)])
    got = {r.Lift_Type: r.goal for r in progress.default_goal(log).collect()}
    assert got == {"Squat": 325, "Bench": 400, "Deadlift": 400}


@pytest.mark.parametrize("salt", [0, 1])
def test_order_of_rows_does_not_matter(spark, salt):
    data = [entry(D(2024, 1, 1 + i % 20), 100 + i % 7, 1 + i % 5) for i in range(200)]
    log = with_1rm(log_rows(spark, data)).repartition(16, F.rand(salt))
    got = rows(progress.max_1rm_by_lift(log), "Lift_Type")
    assert got == rows(progress.max_1rm_by_lift(log.coalesce(1)), "Lift_Type")
