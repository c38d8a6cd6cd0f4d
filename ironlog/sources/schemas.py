"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

LOG = T.StructType(
    [
        T.StructField("athlete_id", T.IntegerType()),
        T.StructField("Date", T.DateType()),
        T.StructField("Block", T.StringType()),
        T.StructField("Day", T.StringType()),
        T.StructField("Exercise", T.StringType()),
        T.StructField("Sets", T.DoubleType()),
        T.StructField("Reps", T.DoubleType()),
        T.StructField("Load", T.DoubleType()),
        T.StructField("RPE", T.DoubleType()),
        T.StructField("Notes", T.StringType()),
        T.StructField("Lift_Type", T.StringType()),
    ]
)

# One row per non-empty spreadsheet cell.
CELLS = T.StructType(
    [
        T.StructField("athlete_id", T.IntegerType()),
        T.StructField("block", T.StringType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("col_idx", T.IntegerType()),
        T.StructField("value", T.StringType()),
    ]
)

MEET_TEXT = (
    "Name",
    "MeetName",
    "Federation",
    "Equipment",
    "Division",
    "WeightClassKg",
    "Place",
)
MEET_WEIGHTS = (
    "Best3SquatKg",
    "Best3BenchKg",
    "Best3DeadliftKg",
    "TotalKg",
    "BodyweightKg",
)
MEET_SCORES = ("Dots", "Wilks")

# Columns of a lifter's meet list, in output order.
MEET_COLUMNS = (
    "Date",
    "MeetName",
    "Federation",
    "Equipment",
    "Division",
    "WeightClassKg",
    "BodyweightKg",
    "Place",
    "Best3SquatKg",
    "Best3BenchKg",
    "Best3DeadliftKg",
    "TotalKg",
    "Dots",
    "Wilks",
)

RULES = {
    "RPE": (1, 10),
    "Sets": (1, 8),
    "Reps": (1, 50),
    "Load": (1, 700),
}
