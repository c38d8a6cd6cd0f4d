"""Text, date and number parsing for spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, tried in this order.
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy-M-d H:m:s")

# A day label starts with "day" and a number.
DAY_LABEL = r"(?i)^\s*day\s*\d+"
DAY_NUMBER = r"(?i)day\s*(\d+)"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_date_multi(text: Column) -> Column:
    return F.coalesce(*[F.try_to_date(text, fmt) for fmt in DATE_FORMATS])


def clean_numeric(text: Column) -> Column:
    """Keep digits, dots and minus signs; null when that is not one number."""
    kept = F.regexp_replace(text, r"[^\d.-]", "")
    return F.nullif(kept, F.lit("")).try_cast("double")


def is_day_label(text: Column) -> Column:
    return text.rlike(DAY_LABEL)


def day_number(label: Column) -> Column:
    digits = F.regexp_extract(label, DAY_NUMBER, 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def classify_lift(exercise: Column) -> Column:
    """Substring rules in order of precedence; unknown or null is Accessory."""
    name = F.lower(exercise)
    return (
        F.when(name.contains("squat"), "Squat")
        .when(name.contains("deadlift") | name.contains("rdl"), "Deadlift")
        .when(
            (name.contains("bench") | name.contains("press")) & ~name.contains("leg"),
            "Bench",
        )
        .otherwise("Accessory")
    )
