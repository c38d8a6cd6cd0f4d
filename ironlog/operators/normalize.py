"""Spreadsheet grids to the long training log.

Input is the exploded grid: one row per non-empty cell.  All sheets of all
athletes are processed together.  A sheet holds training weeks side by side;
every cell of row 1 that is a date starts a week of twelve columns.

Scale notes.  Cells meet their week through an equi-join on (sheet, stretch of
twelve columns), so no range join is needed.  Labels are carried down in two steps, inside fixed
chunks of rows and then across chunks, so that not even one huge sheet puts a
whole column through a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ironlog.functions.parsing import (
    classify_lift,
    clean_numeric,
    day_number,
    is_day_label,
    parse_date_multi,
    strip,
)

SHEET = ("athlete_id", "block")

# Layout of a week.
HEADER_ROW = 1
FIRST_DATA_ROW = 2
WEEK_WIDTH = 12
OFFSETS = {"exercise": 0, "load": 6, "sets": 7, "reps": 8, "rpe": 9, "notes": 10}

# Rows of one sheet whose labels are filled by one task.
CHUNK_ROWS = 10_000


def week_columns(cells: DataFrame, sheet: Sequence[str] = SHEET) -> DataFrame:
    """Start column and date of every week."""
    return (
        cells.filter(F.col("row_idx") == HEADER_ROW)
        .select(
            *sheet,
            F.col("col_idx").alias("base_col"),
            parse_date_multi(F.col("value")).alias("week_start"),
        )
        .filter(F.col("week_start").isNotNull() & F.col("base_col").isNotNull())
    )


def week_cells(cells: DataFrame, sheet: Sequence[str] = SHEET) -> DataFrame:
    """Data cells with the week(s) whose twelve columns cover them.

    Columns are taken in stretches of twelve.  Each week lists the one or two stretches that
    it touches, which turns "column between base and base+11" into equality and a check.
    """
    def stretch(column: Column) -> Column:
        return F.floor(column / WEEK_WIDTH)

    base, column = F.col("base_col"), F.col("col_idx")
    touched = F.array_distinct(F.array(stretch(base), stretch(base + (WEEK_WIDTH - 1))))
    weeks = week_columns(cells, sheet).select("*", F.explode(touched).alias("_stretch"))
    data = cells.filter(F.col("row_idx") >= FIRST_DATA_ROW).withColumn("_stretch", stretch(column))
    return (
        data.join(weeks, [*sheet, "_stretch"])
        .withColumn("offset", column - base)
        .filter(F.col("offset").between(0, WEEK_WIDTH - 1))
        .drop("_stretch")
    )


def _week(sheet: Sequence[str]) -> list[str]:
    """What identifies a week of a sheet."""
    return [*sheet, "base_col", "week_start"]


def grid_rows(
    cells: DataFrame,
    sheet: Sequence[str] = SHEET,
    chunk_rows: int = CHUNK_ROWS,
    more: Sequence[Column] = (),
) -> DataFrame:
    """One row per sheet row and week: its label (if any) and entry fields.

    ``more`` are further aggregates over the row's cells (``offset``, ``value``).

    Distributed by (week of a sheet, chunk of rows) once; the grouping here and
    the label fill afterwards both use that distribution and its sort order.
    """
    group = [*_week(sheet), "chunk"]
    placed = week_cells(cells, sheet).withColumns(
        {
            # never null, so that both uses of the rows keep the same filters
            # and share one shuffle
            "chunk": F.coalesce(F.floor(F.col("row_idx") / chunk_rows), F.lit(0)),
            "is_label": is_day_label(F.col("value")),
        }
    )
    label = F.when(F.col("is_label"), strip(F.col("value")))
    place = F.when(F.col("is_label"), F.col("offset"))
    return (
        placed.repartition(*group)
        .groupBy(*group, "row_idx")
        .agg(
            F.min_by(label, place).alias("label"),
            *[
                F.max(F.when(F.col("offset") == k, F.col("value"))).alias(name)
                for name, k in OFFSETS.items()
            ],
            *more,
        )
    )


def labelled_rows(
    cells: DataFrame, sheet: Sequence[str] = SHEET, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Grid rows with the day label above them; label rows themselves removed."""
    rows = grid_rows(cells, sheet, chunk_rows)
    week = _week(sheet)
    group = [*week, "chunk"]

    above = (
        W.partitionBy(*group)
        .orderBy("row_idx")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    inside = rows.withColumn("Day", F.last("label", ignorenulls=True).over(above))

    earlier = (
        W.partitionBy(*week)
        .orderBy("chunk")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    has_label = F.when(F.col("label").isNotNull(), F.col("row_idx"))
    carried = (
        rows.groupBy(*group)
        .agg(F.max_by("label", has_label).alias("_tail"))
        .withColumn("_carried", F.last("_tail", ignorenulls=True).over(earlier))
        .drop("_tail")
    )
    return (
        inside.filter(F.col("label").isNull())
        .join(carried, group)
        .withColumn("Day", F.coalesce("Day", "_carried"))
        .drop("_carried", "label", "chunk")
    )


def session_rows(
    cells: DataFrame, sheet: Sequence[str] = SHEET, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Labelled rows with day number and date; rows above the first label drop."""
    return (
        labelled_rows(cells, sheet, chunk_rows)
        .withColumn("day_number", day_number(F.col("Day")))
        .filter(F.col("day_number").isNotNull())
        .withColumn("Date", F.expr("date_add(week_start, day_number - 1)"))
    )


def project_offsets(
    cells: DataFrame, sheet: Sequence[str] = SHEET, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Entry rows with their raw text fields; rows without an exercise drop."""
    return session_rows(cells, sheet, chunk_rows).filter(
        F.col("exercise").isNotNull() & (strip(F.col("exercise")) != "")
    )


def normalize(
    cells: DataFrame, sheet: Sequence[str] = SHEET, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The long training log of all weeks of all sheets."""
    exercise = strip(F.col("exercise"))
    extra = [F.col(c) for c in sheet if c != "block"]
    return project_offsets(cells, sheet, chunk_rows).select(
        *extra,
        "Date",
        F.col("block").alias("Block"),
        "Day",
        exercise.alias("Exercise"),
        clean_numeric(F.col("sets")).alias("Sets"),
        clean_numeric(F.col("reps")).alias("Reps"),
        clean_numeric(F.col("load")).alias("Load"),
        clean_numeric(F.col("rpe")).alias("RPE"),
        F.coalesce(strip(F.col("notes")), F.lit("")).alias("Notes"),
        classify_lift(exercise).alias("Lift_Type"),
    )


def log_summary(log: DataFrame, by: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """Entries, distinct exercises and blocks, and date range per owner."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_distinct("Exercise").alias("unique_exercises"),
        F.count_distinct("Block").alias("unique_blocks"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
    )


def log_blocks(log: DataFrame, by: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """Block list of the summary, as rows: its length is not bounded."""
    return log.select(*by, "Block").distinct()


def log_lift_counts(log: DataFrame, by: Sequence[str] = ("athlete_id",)) -> DataFrame:
    return log.groupBy(*by, "Lift_Type").agg(F.count(F.lit(1)).alias("entries"))
