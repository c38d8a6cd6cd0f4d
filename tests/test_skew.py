"""Results must not depend on join strategy, partition count or hot keys."""

import datetime as dt
import random

import pytest

from ironlog.operators import meets, normalize, progress, trend
from ironlog.operators.onerm import with_1rm
from ironlog.operators.reconcile import reconcile_raw
from ironlog.sources import schemas
from tests.helpers import D, entry, log_rows, rows

# No broadcast, and every partition counts as skewed.
HARSH = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
    "spark.sql.shuffle.partitions": "31",
}


@pytest.fixture
def harsh(spark):
    before = {k: spark.conf.get(k, None) for k in HARSH}

    def run(df_of):
        for key, value in HARSH.items():
            spark.conf.set(key, value)
        try:
            return df_of()
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    return run


def _hot_log(spark):
    """Athlete 1 owns most rows, and one of its days most of those."""
    r = random.Random(3)
    data = []
    for i in range(3000):
        athlete = 1 if i % 3 else r.randint(2, 12)
        day = 100 if i % 2 else r.randint(0, 200)
        data.append(
            entry(
                D(2024, 1, 1) + dt.timedelta(days=day), r.randint(100, 400),
                r.randint(1, 10), r.choice([None, 6.0, 7.5, 9.0]),
                athlete_id=athlete, exercise=r.choice(["A", "A", "B"]),
                lift=r.choice(["Squat", "Bench"]),
            )
        )
    return log_rows(spark, data)


@pytest.mark.parametrize(
    "operator",
    [
        trend.progression_filtered,
        progress.max_1rm_by_lift,
        progress.rep_prs,
        progress.recent_progress,
    ],
)
def test_hot_athlete(spark, harsh, operator):
    def found():
        return rows(operator(with_1rm(_hot_log(spark))), "athlete_id", "Lift_Type")

    key = lambda r: tuple(str(v) for v in r.values())
    assert sorted(found(), key=key) == sorted(harsh(found), key=key)


def test_hot_sheet(spark, harsh):
    cells = [(1, "hot", 1, c, "2024-01-01") for c in (0, 12)]
    for day in range(1, 6):
        cells.append((1, "hot", day * 100, 3, f"Day {day}"))
        for i in range(1, 90):
            cells.append((1, "hot", day * 100 + i, 0, f"Squat {i}"))
            cells.append((1, "hot", day * 100 + i, 6, str(100 + i)))
            cells.append((1, "hot", day * 100 + i, 12, "beside, without a label"))
    grid = spark.createDataFrame(cells, schemas.CELLS)

    def found():
        log = normalize.normalize(grid, chunk_rows=37)
        assert reconcile_raw(log, grid).filter("not found").count() == 0
        return rows(log, "Date", "Exercise")

    got = harsh(found)
    assert len(got) == 5 * 89
    assert {r["Date"].day for r in got} == {1, 2, 3, 4, 5}
    assert all(r["Load"] == 100 + int(r["Exercise"].split()[1]) for r in got)
    assert got == found()


def test_hot_name(spark, harsh):
    data = [("Same Name" if i % 3 else f"Other {i}", D(2024, 1, 1)) for i in range(600)]
    table = spark.createDataFrame(data, "Name string, Date date")

    def found():
        hits = meets.search_lifter(table, ["same", "other 3", "name same"])
        return {(r["query"], r["tier"]): r["count"]
                for r in hits.groupBy("query", "tier").count().collect()}

    got = harsh(found)
    assert got == found()
    assert got["same", 1] == 400 and got["name same", 2] == 400
