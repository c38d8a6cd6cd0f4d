"""Registered queries: one per operator, each over whole tables.

Every result is put into a comparable shape: whole numbers as bigint, floating
point numbers rounded to four decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformance import views
from conformance.views import AS_OF, MEET_DATE, RANGE
from ironlog.functions import onerm as rm
from ironlog.functions import parsing
from ironlog.operators import (
    diagnose,
    meets,
    normalize,
    optimize,
    progress,
    quality,
    reconcile,
    trend,
)
from ironlog.operators.normalize import OFFSETS, WEEK_WIDTH
from ironlog.operators.onerm import main_lifts, with_1rm, with_1rm_strict
from ironlog.plans.ingest import ingest_grids
from ironlog.sources import readers, writers
from ironlog.streaming.incremental import incremental_ingest, read_ingested

Query = Callable[[SparkSession, str], DataFrame]

SEARCHES = (
    "customer#000000007",
    "Customer#00000001",
    "000000012 customer",
    "nobody here",
    "a 1",
)

PATTERNS = ("customer#0+7$", "^customer#[0-9]*[02]{2}$", "1{2}$ ^cust", "zz y")


def comparable(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column, 4)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)


def _log(op: Callable[[DataFrame], DataFrame]) -> Query:
    """Operator over the training log."""
    return lambda spark, d: comparable(op(views.training_log(spark, d)))


def _messy(op: Callable[[DataFrame], DataFrame]) -> Query:
    """Operator over the log with pasted header and note lines."""
    return lambda spark, d: comparable(op(views.messy_log(spark, d)))


def _rm(op: Callable[[DataFrame], DataFrame]) -> Query:
    """Operator over the main lifts with their estimates."""
    return lambda spark, d: comparable(
        op(with_1rm(main_lifts(views.training_log(spark, d))))
    )


def _strict(op: Callable[[DataFrame], DataFrame]) -> Query:
    """Operator over strictly validated estimates of all lifts."""
    return lambda spark, d: comparable(
        op(with_1rm_strict(views.training_log(spark, d)))
    )


def _cells(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: comparable(op(views.cells(spark, d)))


def _meets(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: comparable(op(views.meets(spark, d)))


# --- sources and sinks ---------------------------------------------------------


def read_log(spark: SparkSession, d: str) -> DataFrame:
    path = views.scratch(spark, "log")
    writers.write_log(
        views.training_log(spark, d), path, fmt="csv", partition_by=()
    )
    return comparable(readers.read_log(spark, path))


def read_cells(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as header-less CSV sheets of a few hundred rows and read back."""
    path = views.scratch(spark, "sheets")
    piece = F.expr("p_partkey div 2000").cast("string")
    parts = views.table(spark, d, "part").select(
        F.concat("p_brand", F.lit(" "), piece).alias("sheet"),
        "p_partkey", "p_name", "p_type", "p_size", "p_retailprice",
    )
    ordered = parts.repartition("sheet").sortWithinPartitions("sheet", "p_partkey")
    ordered.write.partitionBy("sheet").csv(path)
    return comparable(readers.read_cells(spark, path, folder="sheet"))


def sheets_to_1rm(spark: SparkSession, d: str) -> DataFrame:
    """CSV sheets to the log to the best estimates."""
    path = views.scratch(spark, "team-sheets")
    views.write_sheets(spark, d, path)
    cells = readers.read_cells(spark, path, folder="Block", athlete="athlete_id")
    log = with_1rm(main_lifts(normalize.normalize(cells)))
    return comparable(progress.max_1rm_by_lift(log))


def read_meets(spark: SparkSession, d: str) -> DataFrame:
    path = views.scratch(spark, "meets")
    raw = views.raw_meets(spark, d)
    raw.write.option("header", True).csv(path)
    return comparable(readers.read_meets(spark, path, raw.columns))


def write_log(spark: SparkSession, d: str) -> DataFrame:
    annotated = with_1rm(main_lifts(views.training_log(spark, d)))
    path = writers.output_path(views.scratch(spark, "annotated"), "1rm")
    writers.write_log(annotated, path)
    return comparable(spark.read.schema(annotated.schema).parquet(path))


def ingest(spark: SparkSession, d: str) -> DataFrame:
    out = ingest_grids(
        views.cells(spark, d), views.scratch(spark, "ingest"), run="first"
    )
    return comparable(spark.read.parquet(out["validated"]))


def incremental(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries of grids, each ingested by its own run."""
    base = views.scratch(spark, "incremental")
    drop, out = f"{base}/drop", f"{base}/out"
    # laid out once: both deliveries come from the entries as they were placed
    cells = views.cells_of(views.kept_entries(spark, d))
    for early in (True, False):
        part = cells.filter((F.col("block") < "Block 1999") == F.lit(early))
        part.write.mode("append").parquet(drop)
        incremental_ingest(spark, drop, out, f"{base}/state").awaitTermination()
    columns = views.training_log(spark, d).columns
    return comparable(read_ingested(spark, out).select(*columns))


def corrected_sheets(spark: SparkSession, d: str) -> DataFrame:
    """All grids, the early ones with wrong loads; then the early ones again, corrected."""
    base = views.scratch(spark, "corrected")
    drop, out = f"{base}/drop", f"{base}/out"
    cells = views.cells_of(views.kept_entries(spark, d))
    early = F.col("block") < "Block 1996"
    load = F.pmod("col_idx", F.lit(WEEK_WIDTH)) == OFFSETS["load"]
    wrong = F.when(early & load, "1").otherwise(F.col("value"))
    for part in (cells.withColumn("value", wrong), cells.filter(early)):
        part.write.mode("append").parquet(drop)
        incremental_ingest(spark, drop, out, f"{base}/state").awaitTermination()
    columns = views.training_log(spark, d).columns
    return comparable(read_ingested(spark, out).select(*columns))


def reconcile_raw(spark: SparkSession, d: str) -> DataFrame:
    """The log against its grids, with names that are not there and parts of names."""
    exercise = F.col("Exercise")
    # the entry itself, some entries under a name that is not there, some under part of one;
    # made from each entry in place, so that the log is joined once; the grids come from the same entries
    names = F.array(
        F.struct(exercise.alias("name")),
        F.when(F.col("Reps") == 3, F.struct(F.concat(F.lit("Paused "), exercise).alias("name"))),
        F.when(exercise == "Low Bar Squat", F.struct(F.lit("low BAR").alias("name"))),
    )
    entries = views.kept_entries(spark, d)
    asked = (
        entries.withColumnRenamed("block", "Block")
        .withColumn("_as", F.explode(F.filter(names, lambda n: n.isNotNull())))
        .withColumn("Exercise", F.col("_as.name"))
        .drop("_as")
    )
    return comparable(
        reconcile.reconcile_raw(asked, views.cells_of(entries)).select(
            "athlete_id", "block", "Date", "Exercise", "found", "raw_exercise"
        )
    )


# --- normalisation ---------------------------------------------------------------


def _date_texts(spark: SparkSession, d: str) -> DataFrame:
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = (
        F.when(key % 6 == 0, F.date_format(date, "yyyy-M-d"))
        .when(key % 6 == 1, F.date_format(date, "MM/dd/yyyy"))
        .when(key % 6 == 2, F.date_format(date, "d/M/yyyy"))
        .when(key % 6 == 3, F.concat(date.cast("string"), F.lit(" 00:00:00")))
        .when(key % 6 == 4, key.cast("string"))
        .otherwise("")
    )
    return views.table(spark, d, "orders").select("o_orderkey", text.alias("text"))


def parse_date_multi(spark: SparkSession, d: str) -> DataFrame:
    return _date_texts(spark, d).withColumn(
        "date", parsing.parse_date_multi(F.col("text"))
    )


def day_labels(cells: DataFrame) -> DataFrame:
    week = ["athlete_id", "block", "base_col", "Day"]
    return (
        normalize.labelled_rows(cells)
        .filter(F.col("Day").isNotNull())
        .groupBy(*week)
        .agg(F.count("exercise").alias("entries"))
    )


def day_number(cells: DataFrame) -> DataFrame:
    labels = cells.filter(parsing.is_day_label(F.col("value"))).select("value")
    return labels.groupBy("value").agg(
        F.count(F.lit(1)).alias("labels"),
        F.max(parsing.day_number(F.col("value"))).alias("day_number"),
    )


def session_date(cells: DataFrame) -> DataFrame:
    return (
        normalize.session_rows(cells)
        .groupBy("athlete_id", "block", "Date")
        .agg(F.count("exercise").alias("entries"))
    )


def project_offsets(cells: DataFrame) -> DataFrame:
    return normalize.project_offsets(cells).select(
        "athlete_id", "block", "Date", "exercise", "load", "sets", "reps", "rpe"
    )


def clean_numeric(spark: SparkSession, d: str) -> DataFrame:
    items = views.table(spark, d, "lineitem")
    line, amount = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    text = (
        F.when(line == 1, F.concat(amount, F.lit(" lbs")))
        .when(line == 2, F.concat(F.lit("@"), amount))
        .when(line == 3, F.concat(amount, F.lit("-"), amount + 2))
        .when(line == 4, F.concat(amount, F.lit(".")))
        .when(line == 5, F.concat(F.lit("-"), amount))
        .when(line == 6, F.lit(""))
        .otherwise(F.concat(F.lit(" ~"), amount, F.lit(".5kg ")))
    )
    return (
        items.select(text.alias("text"))
        .withColumn("number", parsing.clean_numeric(F.col("text")))
        .groupBy("text", "number")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def classify_lift(spark: SparkSession, d: str) -> DataFrame:
    names = views.table(spark, d, "part").select(
        F.concat_ws(
            " ",
            F.element_at(
                F.array(
                    *map(
                        F.lit,
                        (
                            "Front Squat",
                            "leg press",
                            "Close-Grip BENCH",
                            "Hurdle",
                            "Romanian Deadlift",
                            "Shoulder Press",
                            "Curl",
                        ),
                    )
                ),
                (F.col("p_partkey") % 7 + 1).cast("int"),
            ),
            "p_name",
        ).alias("exercise")
    )
    lift = parsing.classify_lift(F.col("exercise"))
    return names.groupBy("exercise", lift.alias("lift_type")).agg(
        F.count(F.lit(1)).alias("parts")
    )


# --- one-rep max -------------------------------------------------------------------

_ENTRY = ["athlete_id", "Date", "Exercise", "Load", "Reps", "RPE"]


def _formula(value: Callable[[Column, Column, Column], Column]) -> Query:
    columns = F.col, ("Load", "Reps", "RPE")

    def run(log: DataFrame) -> DataFrame:
        load, reps, rpe = map(*columns)
        return log.select(*_ENTRY, value(load, reps, rpe).alias("value"))

    return _log(run)


def rpe_table(spark: SparkSession, d: str) -> DataFrame:
    """Training entries per entry of the RPE table."""
    entries = views.training_log(spark, d).select(
        F.bround("Reps", 0).cast("int").alias("reps"),
        F.bround("RPE", 0).cast("int").alias("rpe"),
    )
    # fixed table of 50 rows
    return comparable(
        entries.groupBy("reps", "rpe")
        .agg(F.count(F.lit(1)).alias("entries"))
        .join(F.broadcast(rm.rpe_table(spark)), ["reps", "rpe"])
    )


# --- competition ---------------------------------------------------------------------


def _meet_rows(spark: SparkSession, d: str) -> DataFrame:
    return meets.meets_long(views.meets(spark, d))


def integrate_meets(spark: SparkSession, d: str) -> DataFrame:
    return comparable(
        meets.integrate_meets(views.training_log(spark, d), _meet_rows(spark, d))
    )


def overlay_series(spark: SparkSession, d: str) -> DataFrame:
    log = main_lifts(views.training_log(spark, d))
    return comparable(progress.overlay_series(log, _meet_rows(spark, d), *RANGE))


# --- trend -----------------------------------------------------------------------------

_FIT = ("first_day", "last_day", "degree", "p0", "p1", "p2", "p3", "slope")


def _shown(df: DataFrame) -> DataFrame:
    """Without the internals of a fit."""
    return df.drop(*_FIT)


def registry() -> dict[str, Query]:
    return {
        # sources and sinks
        "read_log": read_log,
        "read_cells": read_cells,
        "sheets_to_1rm": sheets_to_1rm,
        "read_meets": read_meets,
        "write_log": write_log,
        "ingest_grids": ingest,
        "incremental_ingest": incremental,
        "corrected_sheets": corrected_sheets,
        # normalisation
        "week_columns": _cells(normalize.week_columns),
        "parse_date_multi": parse_date_multi,
        "day_labels": _cells(day_labels),
        "day_number": _cells(day_number),
        "session_date": _cells(session_date),
        "project_offsets": _cells(project_offsets),
        "clean_numeric": clean_numeric,
        "classify_lift": classify_lift,
        "normalize": _cells(normalize.normalize),
        "log_summary": _log(normalize.log_summary),
        "log_blocks": _log(normalize.log_blocks),
        "log_lift_counts": _log(normalize.log_lift_counts),
        # quality
        "main_lifts": _log(main_lifts),
        "blank_profile": _log(quality.blank_profile),
        "blank_top_exercises": _messy(quality.blank_top_exercises),
        "suspicious_rows": _log(quality.suspicious_rows),
        "rule_violations": _log(quality.rule_violations),
        "rule_violation_examples": _log(quality.rule_violation_examples),
        "clean_dataset": _messy(
            lambda log: quality.clean_dataset(log, remove_suspicious=True)
        ),
        "clean_removal_counts": _messy(
            lambda log: quality.clean_removal_counts(log, remove_suspicious=True)
        ),
        "header_like": _messy(quality.header_like),
        "missing_profile": _log(quality.missing_profile),
        "extreme_values": _log(quality.extreme_values),
        "lift_distribution": _log(quality.lift_distribution),
        "date_coverage": _log(quality.date_coverage),
        "block_top10": _log(quality.block_top10),
        "search_exercise": _log(lambda log: quality.search_exercise(log, "bar|^rd")),
        "sample_rows": _log(lambda log: quality.sample_rows(log, 25, seed=7)),
        "show_exercise_examples": _log(
            lambda log: quality.show_exercise_examples(log, "press", 25, seed=7)
        ),
        "reconcile_raw": reconcile_raw,
        # one-rep max
        "rm_epley": _formula(lambda load, reps, rpe: rm.epley(load, reps)),
        "rm_brzycki": _formula(lambda load, reps, rpe: rm.brzycki(load, reps)),
        "rm_lombardi": _formula(lambda load, reps, rpe: rm.lombardi(load, reps)),
        "rpe_table": rpe_table,
        "rm_rpe": _formula(rm.rpe_based),
        "rm_best": _formula(rm.best),
        "rm_all_methods": _log(
            lambda log: with_1rm(log).select(
                *_ENTRY, "1rm_epley", "1rm_brzycki", "1rm_lombardi", "1rm_rpe_based"
            )
        ),
        "with_1rm": _rm(lambda log: log),
        "with_1rm_strict": _strict(lambda log: log),
        # progress
        "rm_progression": _rm(progress.rm_progression),
        "rm_progression_rpe": _rm(
            lambda log: progress.rm_progression(log, "Bench", "rpe_based")
        ),
        "max_1rm_by_lift": _rm(progress.max_1rm_by_lift),
        "recent_progress": _rm(progress.recent_progress),
        "progress_delta": _rm(progress.progress_delta),
        "workout_stats": _log(progress.workout_stats),
        "rep_prs": _log(progress.rep_prs),
        "rep_pr_matrix": _log(progress.rep_pr_matrix),
        "progression_series": _log(
            lambda log: progress.progression_series(log, *RANGE)
        ),
        "weekly_rpe": _log(lambda log: progress.weekly_rpe(log, *RANGE)),
        "weekly_volume": _log(lambda log: progress.weekly_volume(log, *RANGE)),
        "monthly_frequency": _log(lambda log: progress.monthly_frequency(log, *RANGE)),
        "recent_prs": _log(lambda log: progress.recent_prs(log, AS_OF, days=360)),
        "competition_bests": lambda spark, d: comparable(
            progress.competition_bests(_meet_rows(spark, d))
        ),
        "meet_results_recent": lambda spark, d: comparable(
            progress.meet_results_recent(_meet_rows(spark, d))
        ),
        "overlay_series": overlay_series,
        "default_goal": _rm(progress.default_goal),
        # competition
        "search_lifter": _meets(
            lambda m: meets.search_lifter(m, SEARCHES).select(
                "query", "tier", "Name", "Date", "MeetName"
            )
        ),
        "search_lifter_regex": _meets(
            lambda m: meets.search_lifter(m, PATTERNS, regex=True).select(
                "query", "tier", "Name", "Date", "MeetName"
            )
        ),
        "lifter_meets": _meets(lambda m: meets.lifter_meets(m, SEARCHES[:3])),
        "kg_to_lbs": _meets(meets.kg_to_lbs),
        "meets_long": _meets(meets.meets_long),
        "integrate_meets": integrate_meets,
        "meets_profile": _meets(meets.meets_profile),
        "latest_meet": _meets(meets.latest_meet),
        # trend
        "progression_prep": _rm(trend.progression_prep),
        "main_exercise": _rm(trend.main_exercise),
        "progression_filtered": _rm(trend.progression_filtered),
        "trend_fit": _rm(lambda log: _shown(trend.trend_fit(log))),
        "trend_fit_robust": _rm(lambda log: _shown(trend.trend_fit_robust(log))),
        "forecast": _rm(lambda log: trend.forecast(trend.trend_fit(log), 180)),
        "trend_metrics": _rm(
            lambda log: _shown(trend.trend_metrics(trend.trend_fit(log)))
        ),
        "trend_metrics_robust": _rm(
            lambda log: _shown(trend.trend_metrics(trend.trend_fit_robust(log)))
        ),
        "goal_timeline": _rm(
            lambda log: _shown(
                trend.goal_timeline(trend.trend_fit(log), trend.GOAL_GRID, AS_OF)
            )
        ),
        "goal_timeline_linear": _rm(
            lambda log: _shown(
                trend.goal_timeline_linear(
                    trend.trend_fit_robust(log), {"Squat": [600.0]}, AS_OF
                )
            )
        ),
        "goal_grid": _rm(
            lambda log: _shown(trend.goal_grid(trend.trend_fit_robust(log), AS_OF))
        ),
        "meet_attempts": _rm(
            lambda log: _shown(
                trend.meet_attempts(trend.trend_fit(log), MEET_DATE, AS_OF)
            )
        ),
        "model_compare": _rm(trend.model_compare),
        # optimisation
        "rep_band_stats": _rm(optimize.rep_band_stats),
        "rep_band_rank": _rm(optimize.rep_band_rank),
        "weekly_sessions": _rm(optimize.weekly_sessions),
        "frequency_stats": _rm(optimize.frequency_stats),
        "optimal_frequency": _rm(optimize.optimal_frequency),
        "weekly_volume_stats": _rm(optimize.weekly_volume_stats),
        "volume_buckets": _rm(optimize.volume_buckets),
        "optimal_volume": _rm(optimize.optimal_volume),
        "volume_advice": _rm(optimize.volume_advice),
        # diagnostics
        "recent_daily": _strict(lambda log: diagnose.recent_daily(log, AS_OF, 12)),
        "session_trend": _strict(lambda log: diagnose.session_trend(log, AS_OF, 12)),
        "high_low": _strict(lambda log: diagnose.high_low(log, AS_OF, 12)),
        "exercise_variants": _strict(
            lambda log: diagnose.exercise_variants(log, AS_OF, 12)
        ),
        "load_variability": _strict(
            lambda log: diagnose.load_variability(log, AS_OF, 12)
        ),
        "rep_breakdown": _strict(
            lambda log: diagnose.rep_breakdown(log, AS_OF, 12, decimals=4)
        ),
        "recent_vs_earlier": _strict(
            lambda log: diagnose.recent_vs_earlier(log, AS_OF, 12)
        ),
        "top_exercises": _strict(diagnose.top_exercises),
        "recent_load_drop": _strict(
            lambda log: diagnose.recent_load_drop(log, AS_OF, 90)
        ),
        "window_sweep": _strict(lambda log: _shown(trend.window_sweep(log))),
    }
