"""Filters, validation, cleaning and profiling of a training log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ironlog.functions.stats import share
from ironlog.sources.schemas import RULES

Rules = Mapping[str, tuple[float, float]]

# Text that marks a pasted header or note line.
HEADER_TEXT = "exercise|notes:"
HEADER_IN_BLANKS = "Exercise|exercise"

MEASURES = ("Sets", "Reps", "Load")


def _blank() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in MEASURES])


def _any_missing() -> Column:
    return reduce(or_, [F.col(c).isNull() for c in MEASURES])


def _outside(column: Column, low: Column | float, high: Column | float) -> Column:
    return (column < low) | (column > high)


def _violates(df: DataFrame, rules: Rules) -> Column:
    """True when any present column breaks its rule; missing values never do."""
    broken = [
        F.coalesce(_outside(F.col(c), low, high), F.lit(False))
        for c, (low, high) in rules.items()
        if c in df.columns
    ]
    return reduce(or_, broken, F.lit(False))


def blank_profile(log: DataFrame) -> DataFrame:
    """Completely and partially blank rows, counted in one pass."""
    counts = log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_blank()).alias("completely_blank"),
        F.count_if(_any_missing() & ~_blank()).alias("partially_blank"),
    )
    return counts.withColumns(
        {
            "completely_blank_pct": share(F.col("completely_blank"), F.col("total")),
            "partially_blank_pct": share(F.col("partially_blank"), F.col("total")),
        }
    )


def blank_top_exercises(log: DataFrame, n: int = 10) -> DataFrame:
    return (
        log.filter(_blank() & F.col("Exercise").isNotNull())
        .groupBy("Exercise")
        .agg(F.count(F.lit(1)).alias("entries"))
        .orderBy(F.desc("entries"), F.asc("Exercise"))
        .limit(n)
    )


def suspicious_rows(log: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Distinct rows that break at least one rule."""
    return log.filter(_violates(log, rules)).distinct()


def _measurements(log: DataFrame, rules: Rules, carry: Sequence[str]) -> DataFrame:
    """One row per broken rule: ``carry`` columns, rule column, value, limits."""
    present = [c for c in rules if c in log.columns]
    checks = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).cast("double").alias("value"),
                F.lit(float(rules[c][0])).alias("min"),
                F.lit(float(rules[c][1])).alias("max"),
            )
            for c in present
        ]
    )
    broken = F.filter(checks, lambda k: _outside(k["value"], k["min"], k["max"]))
    return (
        log.filter(_violates(log, rules))
        .select(*carry, F.explode(broken).alias("_check"))
        .select(*carry, "_check.*")
    )


def rule_violations(log: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Rows outside the limits per column; a row counts once per broken rule."""
    return (
        _measurements(log, rules, [])
        .groupBy("column", "min", "max")
        .agg(F.count(F.lit(1)).alias("violations"))
    )


def rule_violation_examples(
    log: DataFrame,
    rules: Rules = RULES,
    n: int = 3,
    keys: Sequence[str] = ("athlete_id",),
) -> DataFrame:
    """First ``n`` offenders per rule, by date and then the remaining columns."""
    carry = [*keys, "Date", "Exercise"]
    order = [F.asc_nulls_first(c) for c in (*carry, "value")]
    rank = F.row_number().over(W.partitionBy("column").orderBy(*order))
    return (
        _measurements(log, rules, carry)
        .withColumn("example", rank)
        .filter(F.col("example") <= n)
    )


def reject_reason(
    log: DataFrame,
    remove_completely_blank: bool = True,
    remove_header_like: bool = True,
    remove_suspicious: bool = False,
    rules: Rules = RULES,
) -> Column:
    """Why a row would be removed: the first stage that catches it, or null."""
    stages: list[tuple[str, Column]] = []
    if remove_header_like:
        stages.append(("header_like", F.lower("Exercise").rlike(HEADER_TEXT)))
    if remove_completely_blank:
        stages.append(("completely_blank", _blank()))
    if remove_suspicious:
        stages.append(("suspicious", _violates(log, rules)))
    reason = F.lit(None).cast("string")
    for name, hit in reversed(stages):
        reason = F.when(hit, F.lit(name)).otherwise(reason)
    return reason


def clean_dataset(log: DataFrame, **stages) -> DataFrame:
    """Log without rejected rows; ``stages`` as in :func:`reject_reason`."""
    return log.filter(reject_reason(log, **stages).isNull())


def clean_removal_counts(log: DataFrame, **stages) -> DataFrame:
    """Rows removed per stage, and what is left."""
    judged = log.select(reject_reason(log, **stages).alias("reason"))
    counts = judged.agg(
        F.count(F.lit(1)).alias("original"),
        *[
            F.count_if(F.col("reason") == name).alias(name)
            for name in ("header_like", "completely_blank", "suspicious")
        ],
        F.count_if(F.col("reason").isNull()).alias("clean"),
    )
    return counts.withColumn("clean_pct", share(F.col("clean"), F.col("original")))


def header_like(log: DataFrame) -> DataFrame:
    """Completely blank rows that carry a header word, case-sensitive."""
    return log.filter(_blank() & F.col("Exercise").rlike(HEADER_IN_BLANKS))


def missing_profile(log: DataFrame) -> DataFrame:
    """Null count and percentage of every column that has nulls."""
    counts = log.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in log.columns],
    )
    return (
        counts.unpivot(["_rows"], list(log.columns), "column", "missing")
        .filter(F.col("missing") > 0)
        .select(
            "column", "missing", share(F.col("missing"), F.col("_rows")).alias("pct")
        )
    )


def extreme_values(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_if(F.col("Load") > 1000).alias("high_loads"),
        F.max("Load").alias("max_load"),
        F.count_if(F.col("Reps") > 50).alias("high_reps"),
        F.count_if(_outside(F.col("RPE"), 1, 10)).alias("odd_rpe"),
    )


def lift_distribution(log: DataFrame) -> DataFrame:
    """Rows and percentage per lift type.

    The key-less window runs after the aggregation, over one row per type.
    """
    counts = log.groupBy("Lift_Type").agg(F.count(F.lit(1)).alias("entries"))
    everything = F.sum("entries").over(W.partitionBy())
    return counts.withColumn("pct", share(F.col("entries"), everything)).filter(
        F.col("Lift_Type").isNotNull()
    )


def date_coverage(log: DataFrame) -> DataFrame:
    span = log.agg(F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))
    return span.withColumn("span_days", F.datediff("last_date", "first_date"))


def block_top10(log: DataFrame, n: int = 10) -> DataFrame:
    return (
        log.filter(F.col("Block").isNotNull())
        .groupBy("Block")
        .agg(F.count(F.lit(1)).alias("entries"))
        .orderBy(F.desc("entries"), F.asc("Block"))
        .limit(n)
    )


def search_exercise(log: DataFrame, pattern: str) -> DataFrame:
    """Rows whose exercise matches a regular expression, ignoring case."""
    return log.filter(F.col("Exercise").rlike("(?i)" + pattern))


def sample_rows(log: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` pseudo-random rows, the same ones on every run and every engine.

    Rows are ordered by a digest of their text, in which a null differs from any
    text and each column has its place; equal digests are ordered by the columns.
    Each task keeps its own ``n`` smallest digests, so there is no full sort.
    """
    text = [
        F.concat(F.lit(f"{i}:"), F.coalesce(F.col(c).cast("string"), F.lit("\\N")))
        for i, c in enumerate(log.columns)
    ]
    digest = F.md5(F.concat_ws("|", *text, F.lit(str(seed))))
    return log.orderBy(digest, *log.columns).limit(n)


def show_exercise_examples(
    log: DataFrame, pattern: str, n: int = 3, seed: int = 0
) -> DataFrame:
    return sample_rows(search_exercise(log, pattern), n, seed)
