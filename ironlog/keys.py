"""Grouping keys shared by the operators.

``keys`` names the columns that identify one progress series.  Everything in
``keys`` except the lift is the *owner* of the series: "now minus N days"
windows are measured from the owner's newest row, over all lifts.
"""

from __future__ import annotations

from collections.abc import Sequence

LIFT = "Lift_Type"
KEYS = ("athlete_id", LIFT)
MAIN_LIFTS = ("Squat", "Bench", "Deadlift")


def owner_of(keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k != LIFT]
