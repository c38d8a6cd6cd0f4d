import datetime as dt
import math
import random

import numpy as np
import pytest

from ironlog.operators import trend
from ironlog.operators.onerm import ESTIMATE, with_1rm
from tests.helpers import D, entry, log_rows, rows

START = D(2024, 1, 1)


def _log(spark, series, **more):
    """Log whose estimate column is given: {(athlete, lift): [(day, value)]}."""
    data = [
        entry(
            START + dt.timedelta(days=day), value, 1, lift=lift, athlete_id=athlete,
            **more,
        )
        for (athlete, lift), points in series.items()
        for day, value in points
    ]
    return log_rows(spark, data).withColumn(ESTIMATE, _load())


def _load():
    from pyspark.sql import functions as F

    return F.col("Load")


def _random_series(n, seed):
    r = random.Random(seed)
    days = sorted(r.sample(range(0, 300), n))
    return [(d, 300 + 0.2 * d + r.gauss(0, 20)) for d in days]


def _polyfit(points, degree):
    x0 = points[0][0]
    x = np.array([p[0] - x0 for p in points], float)
    y = np.array([p[1] for p in points])
    fit = np.polynomial.Polynomial.fit(x, y, degree)
    r2 = 1 - ((y - fit(x)) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    return fit, r2, x[-1]


@pytest.fixture(scope="module")
def many():
    return {(a, "Squat"): _random_series(5 + 3 * a, a) for a in range(1, 21)}


@pytest.mark.parametrize("shuffles", ["1", "64"])
def test_fit_matches_numpy(spark, many, shuffles):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        fit = trend.trend_fit(_log(spark, many))
        metrics = {r.athlete_id: r for r in trend.trend_metrics(fit).collect()}
        last = {}
        for r in trend.forecast(fit, 180).collect():
            last.setdefault(r.athlete_id, []).append((r.forecast_date, r.value))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for (athlete, _), points in many.items():
        expected, r2, end = _polyfit(points, 3)
        got = metrics[athlete]
        assert got.model_type == "polynomial_3" and got.data_points == len(points)
        assert math.isclose(got.r2_score, r2, abs_tol=1e-9)
        assert math.isclose(got.forecast_1rm, expected(end + 180), rel_tol=1e-8)
        assert got.current_1rm == points[-1][1]
        values = sorted(last[athlete])
        assert len(values) == 180
        first_day = START + dt.timedelta(days=points[0][0] + int(end) + 1)
        assert values[0][0] == first_day
        assert math.isclose(values[0][1], expected(end + 1), rel_tol=1e-8)


def test_too_few_days_and_constant_values(spark):
    series = {
        (1, "Squat"): [(d, 300.0) for d in range(0, 40, 10)],
        (2, "Squat"): [(d, 300.0) for d in range(0, 50, 10)],
        (3, "Squat"): [(0, 300.0)],
        # nothing inside the window: the owner's newest row is of another lift
        (4, "Squat"): [(d, 300.0) for d in range(0, 50, 10)],
        (4, "Bench"): [(d, 200.0 + d) for d in range(500, 550, 10)],
    }
    got = {
        (r.athlete_id, r.Lift_Type): r
        for r in trend.trend_metrics(trend.trend_fit(_log(spark, series))).collect()
    }
    assert set(got) == set(series)
    assert got[1, "Squat"].status == "insufficient"
    assert got[1, "Squat"].data_points == 4 and got[1, "Squat"].forecast_1rm is None
    flat = got[2, "Squat"]
    assert flat.status == "ok" and flat.r2_score == 1.0
    assert flat.model_type == "linear" and flat.trend_direction == "decreasing"
    assert math.isclose(flat.forecast_1rm, 300)
    assert got[3, "Squat"].status == "insufficient"
    assert got[4, "Squat"].data_points == 0
    assert math.isclose(got[4, "Bench"].forecast_1rm, 200 + 540 + 180, rel_tol=1e-6)


def test_filtered_series_by_brute_force(spark):
    r = random.Random(5)
    data = []
    for i in range(400):
        day = START + dt.timedelta(days=r.randrange(0, 260))
        data.append(
            entry(
                day, round(r.gauss(300, 30)) + (900 if i % 97 == 0 else 0),
                r.randint(1, 9), exercise=r.choice(["A", "A", "B"]),
            )
        )
    log = log_rows(spark, data).withColumn(ESTIMATE, _load())
    newest = max(e["Date"] for e in data)
    recent = [e for e in data if e["Date"] >= newest - dt.timedelta(days=180)]
    low = [e for e in recent if e["Exercise"] == "A" and e["Reps"] <= 6]
    loads = np.array([e["Load"] for e in low])
    kept = [
        e for e in low if abs(e["Load"] - loads.mean()) <= 2 * loads.std(ddof=1)
    ]
    assert len(kept) < len(low)
    best = {}
    for e in kept:
        best[e["Date"]] = max(best.get(e["Date"], 0), e["Load"])
    got = {x.Date: x[ESTIMATE] for x in trend.progression_filtered(log).collect()}
    assert got == best
    main = trend.main_exercise(log).first()
    assert main.main_exercise == "A"
    assert main.entries == sum(e["Exercise"] == "A" for e in recent)


def test_single_low_rep_row_has_no_spread_and_drops(spark):
    fit = trend.trend_fit_robust(_log(spark, {(1, "Squat"): [(0, 300.0)]})).first()
    assert fit.status == "insufficient" and fit.data_points == 0


def test_robust_fit_prefers_the_line(spark):
    noisy = [(d, 300 + (15 if d % 4 else -15)) for d in range(0, 90, 2)]
    bow = [(d, 300 + (d - 45) ** 2 / 20) for d in range(0, 91, 5)]
    series = {(1, "Squat"): noisy, (2, "Squat"): bow}
    fits = {r.athlete_id: r for r in trend.trend_fit_robust(_log(spark, series)).collect()}
    assert fits[1].model_type == "linear"
    assert fits[2].model_type == "polynomial_2"
    assert fits[2].main_exercise == "Squat"


def test_goals(spark):
    series = {
        (1, "Squat"): [(d, 300 + d) for d in range(0, 60, 10)],
        (2, "Squat"): [(d, 400 - d) for d in range(0, 60, 10)],
        (3, "Squat"): [(0, 300.0)],
    }
    log = _log(spark, series)
    goals = {"Squat": [350.0, 360.0, 5000.0]}
    last = START + dt.timedelta(days=50)
    line = trend.goal_timeline_linear(trend.trend_fit_robust(log), goals, str(last))
    got = {(r.athlete_id, r.target): r for r in line.collect()}
    assert len(got) == 9
    assert got[1, 350.0].status == "already_achieved"
    assert got[1, 360.0].status == "reachable"
    assert math.isclose(got[1, 360.0].days_to_target, 10)
    assert got[1, 360.0].confidence == "High"
    assert got[2, 5000.0].status == "unreachable"
    assert math.isclose(got[2, 5000.0].monthly_gain, -30.44)
    assert got[3, 360.0].status == "insufficient"

    full = trend.goal_timeline(trend.trend_fit(log), goals, str(last))
    got = {(r.athlete_id, r.target): r for r in full.collect()}
    assert got[1, 350.0].status == "already_achieved"
    assert got[1, 5000.0].status == "unreachable"
    # rounding of an exact fit may move the crossing by a day
    assert got[1, 360.0].days_to_target in (10, 11)
    assert got[3, 360.0].status == "insufficient"


def test_goals_as_a_table(spark):
    log = _log(spark, {(1, "Squat"): [(d, 300 + d) for d in range(0, 60, 10)]})
    goals = spark.createDataFrame(
        [(1, "Squat", 370.0)], "athlete_id int, Lift_Type string, target double"
    )
    got = trend.goal_timeline_linear(trend.trend_fit_robust(log), goals, "2024-02-20")
    assert math.isclose(got.first().days_to_target, 20)


def test_attempts(spark):
    log = _log(spark, {(1, "Squat"): [(d, 300 + d) for d in range(0, 60, 10)]})
    fit = trend.trend_fit(log)
    today = str(START + dt.timedelta(days=50))
    meet = str(START + dt.timedelta(days=80))
    got = trend.meet_attempts(fit, meet, today).first()
    assert got.days_to_meet == 30
    assert math.isclose(got.predicted_1rm, 380, rel_tol=1e-6)
    assert math.isclose(got.opener, 380 * 0.9, rel_tol=1e-6)
    assert got.confidence == 0.95
    assert trend.meet_attempts(fit, today, meet).first().status == "past_meet"
    # a meet before the newest row takes the first forecast day
    old = trend.meet_attempts(fit, str(START), str(START)).first()
    assert math.isclose(old.predicted_1rm, 351, rel_tol=1e-6)


def test_window_sweep(spark):
    log = _log(spark, {(1, "Squat"): [(d, 300 + d % 7) for d in range(0, 360, 10)]})
    got = {r.window_days: r.data_points for r in trend.window_sweep(log).collect()}
    assert got == {90: 10, 180: 19, 365: 36}
    assert len(rows(trend.model_compare(log), "athlete_id")) == 1


@pytest.mark.parametrize("value", [100.1, 205.33333333333334, 1e-3])
@pytest.mark.parametrize("noise", [0.0, 1e-12])
def test_constant_series_are_level_lines(spark, value, noise):
    """Rounding of a mean is no trend: straight line, R-squared 1, slope 0."""
    start = dt.date(2024, 1, 1)
    noise = noise if value > 1 else 0.0
    rows = [
        entry(start + dt.timedelta(2 * i), value + noise * (-1) ** i, 1)
        for i in range(11)
    ]
    log = with_1rm(log_rows(spark, rows))
    for fit in (trend.trend_fit, trend.trend_fit_robust):
        got = fit(log).first()
        assert (got.status, got.model_type, got.r2_score) == ("ok", "linear", 1.0)
        assert got.slope == 0 and got.p1 == 0


def test_r_squared_is_never_above_one(spark):
    start = dt.date(2024, 1, 1)
    rows = [
        entry(start + dt.timedelta(i), 100 + 1e-9 * i**2, 1, lift="Bench") for i in range(9)
    ]
    got = trend.trend_fit(with_1rm(log_rows(spark, rows))).first()
    assert 0 <= got.r2_score <= 1
