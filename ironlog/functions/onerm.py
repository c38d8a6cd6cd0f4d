"""One-rep-max estimates as Column expressions.

All of it stays inside whole-stage codegen: the RPE table is a constant array
indexed by position, so the annotation needs neither a join nor a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Share of the one-rep max, one line per repetition count 1..10,
# one column per RPE 6..10.
RPE_PERCENT = (
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
FIRST_REP, LAST_REP = 1, len(RPE_PERCENT)
FIRST_RPE, LAST_RPE = 6, 10

METHODS = ("best", "epley", "brzycki", "lombardi", "rpe_based")


def rpe_table(spark: SparkSession) -> DataFrame:
    """The percentage table as rows ``(reps, rpe, pct)``."""
    rows = [
        (FIRST_REP + i, FIRST_RPE + j, pct)
        for i, line in enumerate(RPE_PERCENT)
        for j, pct in enumerate(line)
    ]
    return spark.createDataFrame(rows, "reps int, rpe int, pct double")


def epley(load: Column, reps: Column) -> Column:
    return F.when(reps > 0, load * (1 + reps / 30))


def brzycki(load: Column, reps: Column) -> Column:
    return F.when((reps > 0) & (reps < 37), load * (36 / (37 - reps)))


def lombardi(load: Column, reps: Column) -> Column:
    return F.when(reps > 0, load * F.pow(reps, F.lit(0.10)))


def rpe_percent(reps: Column, rpe: Column) -> Column:
    """Table value after rounding both to whole numbers, halves to even.

    Anything outside the table indexes outside the array, which gives null.
    """
    table = F.array(*[F.array(*map(F.lit, line)) for line in RPE_PERCENT])
    line = (F.rint(reps) - FIRST_REP).try_cast("int")
    column = (F.rint(rpe) - FIRST_RPE).try_cast("int")
    return F.get(F.get(table, line), column)


def rpe_based(
    load: Column, reps: Column, rpe: Column, percent: Column | None = None
) -> Column:
    """Load over the table percentage; Epley where the table has no entry.

    ``percent`` is the table value where a caller has it already.
    """
    if percent is None:
        percent = rpe_percent(reps, rpe)
    return F.when(rpe.isNotNull(), F.coalesce(load / percent, epley(load, reps)))


def best(
    load: Column, reps: Column, rpe: Column, percent: Column | None = None
) -> Column:
    """RPE table where it applies, else Brzycki up to ten reps, else Epley.

    With an RPE outside the table, ten reps or fewer use Epley as well.
    """
    if percent is None:
        percent = rpe_percent(reps, rpe)
    # one to ten repetitions are always in the domain of the second formula
    low = F.coalesce(load / percent, F.when(rpe.isNull(), load * (36 / (37 - reps))))
    return F.coalesce(F.when(reps.between(1, 10), low), epley(load, reps))


def estimate(method: str, load: Column, reps: Column, rpe: Column) -> Column:
    if method == "epley":
        return epley(load, reps)
    if method == "brzycki":
        return brzycki(load, reps)
    if method == "lombardi":
        return lombardi(load, reps)
    if method == "rpe_based":
        return rpe_based(load, reps, rpe)
    return best(load, reps, rpe)
