import datetime as dt

from pyspark.sql import functions as F

from ironlog.functions import parsing
from tests.helpers import one_column


def _apply(spark, values, op):
    df = one_column(spark, values).select("x", op(F.col("x")).alias("y"))
    found = {r.x: r.y for r in df.collect()}
    return [found[v] for v in values]


def test_dates(spark):
    texts = [
        "2024-1-5", "01/05/2024", "13/01/2024", "2024-01-05 00:00:00", "45000", "",
        None, "2024-02-30",
    ]
    fifth = dt.date(2024, 1, 5)
    assert _apply(spark, texts, parsing.parse_date_multi) == [
        fifth, fifth, dt.date(2024, 1, 13), fifth, None, None, None, None,
    ]


def test_numbers(spark):
    texts = ["225 lbs", "@8", "8-10", "5.", "-", "", None, " 12.5kg", "-3"]
    assert _apply(spark, texts, parsing.clean_numeric) == [
        225.0, 8.0, None, 5.0, None, None, None, 12.5, -3.0,
    ]


def test_day_labels(spark):
    texts = ["Day 1", "DAY2", " day 3 ", "Today 1", "Day", "day\t4 heavy", "Day x"]
    assert _apply(spark, texts, parsing.is_day_label) == [
        True, True, True, False, False, True, False,
    ]
    assert _apply(spark, ["Day 1", "DAY2", " day 13 "], parsing.day_number) == [
        1, 2, 13,
    ]


def test_lift_classes(spark):
    names = [
        "Hack Squat", "RDL", "Leg Press", "Overhead Press", "Hurdle", None,
        "Romanian Deadlift", "Close-Grip BENCH", "Curl", "Squat to Press",
    ]
    assert _apply(spark, names, parsing.classify_lift) == [
        "Squat", "Deadlift", "Accessory", "Bench", "Deadlift", "Accessory",
        "Deadlift", "Bench", "Accessory", "Squat",
    ]
