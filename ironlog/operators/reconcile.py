"""Check the normalised log against the grid it came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ironlog.functions.parsing import strip
from ironlog.operators.normalize import (
    FIRST_DATA_ROW,
    SHEET,
    grid_rows,
    week_columns,
)

DAYS_PER_WEEK = 7


def reconcile_raw(
    log: DataFrame, cells: DataFrame, sheet: Sequence[str] = SHEET
) -> DataFrame:
    """Distinct log entries (sheet, date, exercise) with their raw grid row.

    An entry is found when its name is contained, ignoring case, in a base
    column cell of the week around its date; the topmost such row is returned.

    Containment is an equality join: every cell text is cut into its substrings
    of the lengths that are asked for in that week.  The work is linear in the
    number of distinct texts.  Of the substrings only those move that hash to one of
    64 values taken by a name of that length in that week, so few besides real matches.

    Grid rows are made once; each distinct text takes its topmost row along.
    """
    week = [*sheet, "base_col"]
    keys = [*sheet, "Date", "Exercise"]

    asked = log.select(
        *[F.col("Block").alias("block") if c == "block" else F.col(c) for c in sheet],
        "Date",
        "Exercise",
    ).distinct()

    # a week lists its seven dates: "date within week" becomes equality
    dates = week_columns(cells, sheet).select(
        *week,
        F.explode(
            F.expr(f"sequence(week_start, date_add(week_start, {DAYS_PER_WEEK - 1}))")
        ).alias("Date"),
    )
    wanted = asked.join(dates, [*sheet, "Date"], "left").withColumn(
        "needle", F.lower(strip(F.col("Exercise")))
    )

    def bit(text: str) -> Column:
        return F.expr(f"shiftleft(1L, cast(pmod(xxhash64({text}), 64) as int))")

    lengths = (
        wanted.filter(F.col("base_col").isNotNull() & F.col("needle").isNotNull())
        .groupBy(*week, F.length("needle").alias("size"))
        .agg(F.bit_or(bit("needle")).alias("bits"))
    )

    # texts of the base column, each once in a chunk of rows with its topmost row
    fields = ("exercise", "load", "sets", "reps", "rpe", "notes")
    text = F.when(F.col("offset") == 0, F.lower(strip(F.col("value"))))
    rows = grid_rows(cells, sheet, more=[F.collect_set(text).alias("_texts")])
    raw = F.struct(*[F.col(c).alias(f"raw_{c}") for c in fields])
    top = F.min_by("_raw", "row_idx").alias("_raw"), F.min("row_idx").alias("row_idx")
    base = (
        rows.select(*week, "week_start", "chunk", "row_idx", raw.alias("_raw"), F.explode("_texts").alias("text"))
        .groupBy(*week, "week_start", "chunk", "text")
        .agg(*top)
    )
    pieces = (
        base.join(lengths, week)
        .filter(F.col("size") <= F.length("text"))
        .select("*", F.explode(F.expr("sequence(1, length(text) - size + 1)")).alias("_at"))
        .withColumn("needle", F.expr("substring(text, _at, size)"))
        .filter(F.col("bits").bitwiseAND(bit("needle")) != 0)
    )
    first = pieces.groupBy(*week, "needle").agg(*top)
    place = F.when(F.col("row_idx").isNotNull(), F.struct("base_col", "row_idx"))
    return (
        wanted.join(first, [*week, "needle"], "left")
        .groupBy(*keys)
        .agg(F.min_by("_raw", place).alias("_raw"), F.count("row_idx").alias("_hits"))
        .select(
            *keys,
            *[F.col(f"_raw.raw_{c}").alias(f"raw_{c}") for c in fields],
            (F.col("_hits") > 0).alias("found"),
        )
    )
