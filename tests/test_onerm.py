import math

import pytest
from pyspark.sql import functions as F

from ironlog.functions import onerm
from ironlog.operators.onerm import main_lifts, with_1rm, with_1rm_strict
from tests.helpers import D, entry, log_rows, rows


def _estimate(spark, method, load, reps, rpe=None):
    df = spark.createDataFrame(
        [(load, reps, rpe)], "load double, reps double, rpe double"
    )
    columns = [F.col(c) for c in ("load", "reps", "rpe")]
    return df.select(onerm.estimate(method, *columns)).first()[0]


@pytest.mark.parametrize(
    "method, load, reps, rpe, expected",
    [
        ("epley", 300.0, 6.0, None, 300 * 1.2),
        ("epley", 300.0, 0.0, None, None),
        ("epley", None, 5.0, None, None),
        ("brzycki", 300.0, 10.0, None, 300 * 36 / 27),
        ("brzycki", 300.0, 37.0, None, None),
        ("brzycki", 300.0, -1.0, None, None),
        ("lombardi", 300.0, 5.0, None, 300 * 5**0.1),
        ("lombardi", 300.0, 0.0, None, None),
        ("rpe_based", 300.0, 5.0, 8.0, 300 / 0.84),
        ("rpe_based", 300.0, 5.0, 8.5, 300 / 0.84),  # 8.5 rounds to 8
        ("rpe_based", 300.0, 5.0, 7.5, 300 / 0.84),  # and so does 7.5
        ("rpe_based", 300.0, 5.0, 6.5, 300 / 0.77),
        ("rpe_based", 300.0, 5.0, 9.5, 300 / 0.89),
        ("rpe_based", 300.0, 2.5, 10.0, 300 / 0.97),  # two repetitions
        ("rpe_based", 300.0, 5.0, 5.0, 300 * (1 + 5 / 30)),  # not in the table
        ("rpe_based", 300.0, 5.0, 1e12, 300 * (1 + 5 / 30)),
        ("rpe_based", 300.0, 5.0, None, None),
        ("best", 300.0, 5.0, 9.0, 300 / 0.86),
        ("best", 300.0, 5.0, 5.0, 300 * (1 + 5 / 30)),
        ("best", 300.0, 5.0, None, 300 * 36 / 32),
        ("best", 300.0, 12.0, 9.0, 300 * 1.4),
        ("best", 300.0, 10.4, 9.0, 300 * (1 + 10.4 / 30)),
        ("best", 300.0, 0.6, None, 300 * (1 + 0.6 / 30)),
        ("best", 300.0, 0.0, 9.0, None),
        ("best", 300.0, None, 9.0, None),
        ("best", None, 3.0, 9.0, None),
    ],
)
def test_formulas(spark, method, load, reps, rpe, expected):
    got = _estimate(spark, method, load, reps, rpe)
    if expected is None:
        assert got is None
    else:
        assert math.isclose(got, expected, rel_tol=1e-12)


# Percentage of the maximum for RPE 6 to 10, one row per repetition count.
PERCENTAGES = (
    (0.86, 0.92, 0.95, 0.97, 1.00),
    (0.84, 0.89, 0.92, 0.95, 0.97),
    (0.81, 0.86, 0.89, 0.92, 0.95),
    (0.79, 0.84, 0.86, 0.89, 0.92),
    (0.77, 0.81, 0.84, 0.86, 0.89),
    (0.75, 0.79, 0.81, 0.84, 0.86),
    (0.73, 0.77, 0.79, 0.81, 0.84),
    (0.71, 0.75, 0.77, 0.79, 0.81),
    (0.69, 0.73, 0.75, 0.77, 0.79),
    (0.67, 0.71, 0.73, 0.75, 0.77),
)


def test_table_is_complete(spark):
    table = {(r.reps, r.rpe): r.pct for r in onerm.rpe_table(spark).collect()}
    assert table == {
        (reps, rpe): value
        for reps, row in enumerate(PERCENTAGES, 1)
        for rpe, value in zip(range(6, 11), row, strict=True)
    }


def test_lookup_agrees_with_table(spark):
    looked_up = onerm.rpe_percent(
        F.col("reps").cast("double"), F.col("rpe").cast("double")
    )
    table = onerm.rpe_table(spark).withColumn("got", looked_up)
    assert table.filter("got is null or got <> pct").count() == 0


def test_annotation_keeps_rows_and_columns_aligned(spark):
    day = D(2024, 1, 1)
    log = log_rows(
        spark,
        [
            entry(day, 100, 5, 8.0),
            entry(day, 100, 5),
            entry(day, 50, 5, lift="Accessory"),
            entry(day, None, 5),
        ],
    )
    got = rows(with_1rm(main_lifts(log)), "Load", "RPE")
    assert len(got) == 3
    with_rpe = next(r for r in got if r["RPE"] == 8.0)
    assert math.isclose(with_rpe["1rm_rpe_based"], 100 / 0.84)
    assert math.isclose(with_rpe["estimated_1rm"], 100 / 0.84)
    without = next(r for r in got if r["Load"] == 100 and r["RPE"] is None)
    assert without["1rm_rpe_based"] is None
    assert math.isclose(without["estimated_1rm"], 100 * 36 / 32)


def test_strict_drops_unusable_and_absurd(spark):
    day = D(2024, 1, 1)
    log = log_rows(
        spark,
        [
            entry(day, 100, 1),
            entry(day, 0, 5),
            entry(day, 100, 0),
            entry(day, 1200, 1),
            entry(day, None, 5),
        ],
    )
    strict = with_1rm_strict(log)
    assert [r["Load"] for r in rows(strict, "Load")] == [100.0]
    assert with_1rm_strict(strict) is strict
