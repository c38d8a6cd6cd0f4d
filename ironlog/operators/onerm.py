"""One-rep-max annotation of whole logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironlog.functions import onerm
from ironlog.keys import LIFT, MAIN_LIFTS

ESTIMATE = "estimated_1rm"


def main_lifts(log: DataFrame) -> DataFrame:
    return log.filter(F.col(LIFT).isin(*MAIN_LIFTS))


# Table value of a row, looked up once and shared by the estimates.
_PERCENT = "_rpe_percent"


def with_percent(log: DataFrame) -> DataFrame:
    return log.withColumn(
        _PERCENT, onerm.rpe_percent(F.col("Reps"), F.col("RPE"))
    )


def with_1rm(log: DataFrame) -> DataFrame:
    """Add the best estimate and one column per method."""
    load, reps, rpe = F.col("Load"), F.col("Reps"), F.col("RPE")
    percent = F.col(_PERCENT)
    return (
        with_percent(log)
        .withColumns(
            {
                ESTIMATE: onerm.best(load, reps, rpe, percent),
                "1rm_epley": onerm.epley(load, reps),
                "1rm_brzycki": onerm.brzycki(load, reps),
                "1rm_lombardi": onerm.lombardi(load, reps),
                "1rm_rpe_based": onerm.rpe_based(load, reps, rpe, percent),
            }
        )
        .drop(_PERCENT)
    )


def with_1rm_strict(log: DataFrame) -> DataFrame:
    """Best estimate only for positive load and reps, kept within (0, 1000).

    A log that already carries an estimate is returned as it is.
    """
    if ESTIMATE in log.columns:
        return log
    load, reps, rpe = F.col("Load"), F.col("Reps"), F.col("RPE")
    est = F.col(ESTIMATE)
    return (
        with_percent(log.filter((load > 0) & (reps > 0)))
        .withColumn(ESTIMATE, onerm.best(load, reps, rpe, F.col(_PERCENT)))
        .drop(_PERCENT)
        # positive load and repetitions make every estimate positive
        .filter(est < 1000)
    )
