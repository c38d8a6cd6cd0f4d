"""Small fixtures in the library's schemas."""

from __future__ import annotations

import datetime as dt

from ironlog.sources import schemas

D = dt.date


def log_rows(spark, rows):
    """Log from dicts; what is not given is null, one athlete by default."""
    names = [f.name for f in schemas.LOG.fields]
    defaults = {"athlete_id": 1, "Block": "B", "Day": "Day 1", "Notes": ""}
    data = [tuple({**defaults, **row}.get(n) for n in names) for row in rows]
    return spark.createDataFrame(data, schemas.LOG)


def entry(date, load, reps=1.0, rpe=None, lift="Squat", exercise="Squat", **more):
    return {
        "Date": date,
        "Load": None if load is None else float(load),
        "Reps": None if reps is None else float(reps),
        "RPE": rpe,
        "Sets": 1.0,
        "Lift_Type": lift,
        "Exercise": exercise,
        **more,
    }


def rows(df, *order):
    """Rows as dicts, sorted by the given columns."""
    found = [r.asDict() for r in df.collect()]
    return sorted(found, key=lambda r: tuple(str(r[c]) for c in order))


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")
