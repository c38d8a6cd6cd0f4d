import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from ironlog.operators import diagnose, optimize
from ironlog.operators.onerm import ESTIMATE
from tests.helpers import D, entry, log_rows

START = D(2024, 1, 1)


def _day(n):
    return START + dt.timedelta(days=n)


def _rm(spark, data):
    return log_rows(spark, data).withColumn(ESTIMATE, F.col("Load"))


def test_bands(spark):
    data = [entry(_day(i), 100 + i * i, 2) for i in range(6)]
    data += [entry(_day(0), 100 + i, 5) for i in range(5)]  # one day only
    data += [entry(_day(i), 100, 8) for i in range(5)]  # constant
    data += [entry(_day(i), 100 + i, 3.5) for i in range(6)]  # between bands
    data += [entry(_day(i), 100 + i, 51) for i in range(6)]
    data += [entry(_day(i), 100 + i, 12) for i in range(4)]  # too few
    log = _rm(spark, data)
    got = {r.band_no: r for r in optimize.rep_band_stats(log).collect()}
    assert set(got) == {1, 2, 3}
    expected = np.corrcoef(range(6), [100 + i * i for i in range(6)])[0, 1]
    assert math.isclose(got[1].correlation_with_progress, expected)
    assert got[2].correlation_with_progress == 0
    assert got[3].correlation_with_progress is None
    assert got[1].session_count == 6
    assert got[1].total_volume == sum(2 * (100 + i * i) for i in range(6))
    ranked = {r.rep_range: r for r in optimize.rep_band_rank(log).collect()}
    assert ranked["1-3 (Strength)"].recommended
    assert ranked["7-10 (Hypertrophy)"].rank == 3


def test_frequency(spark):
    data = []
    for week, (sessions, best) in enumerate([(1, 100), (2, 150), (1, 110), (1, 105)]):
        data += [entry(_day(7 * week + s), best) for s in range(sessions)]
    log = _rm(spark, data)
    got = {r.Sessions: r for r in optimize.frequency_stats(log).collect()}
    assert set(got) == {1}  # two sessions happened in one week only
    assert math.isclose(
        got[1].progress_correlation, np.corrcoef(range(3), [100, 110, 105])[0, 1]
    )
    assert got[1].sample_size == "Limited"
    best = optimize.optimal_frequency(log).first()
    assert best.optimal_frequency == 1 and best.frequency_range == "1-2"
    assert best.average_frequency == 1.25 and best.status == "ok"
    short = optimize.optimal_frequency(log.filter(F.col("Date") < F.lit(_day(20))))
    assert short.first().status == "insufficient"


def test_volume(spark):
    r = random.Random(1)
    weekly = [(float(r.randint(10, 90)), 100.0 + r.random()) for _ in range(30)]
    data = [
        {**entry(_day(7 * i), best, 1), "Sets": vol}
        for i, (vol, best) in enumerate(weekly)
    ]
    log = _rm(spark, data)
    volumes = np.array([v * b for v, b in weekly])
    bests = np.array([b for _, b in weekly])
    edges = np.percentile(volumes, [25, 50, 75])
    place = np.searchsorted(edges, volumes, side="right") + 1
    got = {x.bucket_no: x for x in optimize.volume_buckets(log).collect()}
    for number in range(1, 5):
        inside = place == number
        assert got[number].week_count == inside.sum()
        assert math.isclose(got[number].average_1rm, bests[inside].mean())
        low, high = volumes[inside].min(), volumes[inside].max()
        assert got[number].volume_range == f"{low:.0f}-{high:.0f}"
    advice = optimize.volume_advice(log).first()
    assert math.isclose(advice.volume_correlation, np.corrcoef(volumes, bests)[0, 1])
    top = max(range(1, 5), key=lambda n: bests[place == n].mean())
    assert optimize.optimal_volume(log).first().optimal_volume_bucket == (
        optimize.VOLUME_BUCKETS[top - 1]
    )
    flat = _rm(spark, [entry(_day(7 * i), 100) for i in range(5)])
    assert optimize.volume_advice(flat).first().volume_recommendation == "Decrease"


def test_diagnostics(spark):
    values = [300, 310, 305, 290, 280, 285, 275, 260, 255, 250, 240, 245, 230, 235, 220]
    data = [
        entry(_day(2 * i), v, 1 + i % 2, exercise="AB"[i % 2])
        for i, v in enumerate(values)
    ]
    data += [entry(_day(0), 0, 1), entry(_day(-400), 900, 1, exercise="C")]
    log, today = _rm(spark, data), str(_day(40))
    daily = diagnose.recent_daily(log, today).collect()
    assert {r[ESTIMATE] for r in daily} == set(map(float, values[-10:]))
    slope = diagnose.session_trend(log, today).first()
    expected = np.polyfit(np.arange(15), values, 1)[0]
    assert math.isclose(slope.per_session, expected)
    assert math.isclose(slope.per_month, 8 * expected)
    ends = diagnose.high_low(log, today).first()
    assert (ends.highest, ends.highest_date) == (310, _day(2))
    assert (ends.lowest, ends.lowest_date) == (220, _day(28))
    names = {r.Exercise: r for r in diagnose.exercise_variants(log, today).collect()}
    assert set(names) == {"A", "B"} and names["A"].several
    spread = diagnose.load_variability(log, today).first()
    assert math.isclose(spread.load_std, np.std(values, ddof=1))
    assert not spread.high_variability
    counts = {r.Reps: r["count"] for r in diagnose.rep_breakdown(log, today).collect()}
    assert counts == {1.0: 8, 2.0: 7}
    change = diagnose.recent_vs_earlier(log, today).first()
    assert math.isclose(change.recent_avg, np.mean(values[-7:]))
    assert math.isclose(change.earlier_avg, np.mean(values[:7]))
    assert change.verdict == "deload"
    top = [r.Exercise for r in diagnose.top_exercises(log, 2).collect()]
    assert sorted(top) == ["A", "B"]
    drop = diagnose.recent_load_drop(log, today).first()
    assert drop.overall_max == 900 and drop.recent_max == 310 and drop.dropped
    late = diagnose.recent_load_drop(log, "2030-01-01").first()
    assert late.status == "insufficient" and late.recent_max is None


def test_short_series_compares_halves(spark):
    log = _rm(spark, [entry(_day(i), v) for i, v in enumerate([100, 110, 120, 130, 140])])
    got = diagnose.recent_vs_earlier(log, str(_day(5))).first()
    assert got.recent_avg == 120 and got.earlier_avg == 105
    assert got.verdict == "steady"
    two = log.filter("Load < 115")
    for report in (
        diagnose.recent_vs_earlier,
        diagnose.session_trend,
        diagnose.high_low,
        diagnose.load_variability,
        diagnose.exercise_variants,
        diagnose.rep_breakdown,
    ):
        got = report(two, str(_day(5))).collect()
        assert [r.status for r in got] == ["insufficient"]
        assert report(log, str(_day(5))).first().status == "ok"
    for report in (optimize.optimal_volume, optimize.volume_advice):
        assert [r.status for r in report(two).collect()] == ["insufficient"]
