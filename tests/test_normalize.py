import pytest
from pyspark.sql import functions as F

from ironlog.operators import normalize as nz
from ironlog.operators.reconcile import reconcile_raw
from ironlog.sources import readers, schemas
from tests.helpers import D, rows

BASE = 3


def _grid(spark, lines, block="Block A", athlete=1):
    """Cells from rows given as {column: text}."""
    data = [
        (athlete, block, r, c, v)
        for r, line in enumerate(lines)
        for c, v in line.items()
    ]
    return spark.createDataFrame(data, schemas.CELLS)


def _entry(base, exercise, load=None, sets=None, reps=None, rpe=None, notes=None):
    fields = {0: exercise, 6: load, 7: sets, 8: reps, 9: rpe, 10: notes}
    return {base + k: v for k, v in fields.items() if v is not None}


@pytest.fixture(scope="module")
def cells(spark):
    second = BASE + 12
    return _grid(
        spark,
        [
            {0: "title"},
            {BASE: "2024-01-01", second: "01/08/2024", 1: "not a date", 40: "45000"},
            _entry(BASE, "Squat before any label", "100"),
            {BASE + 5: " DAY 1 "},
            {**_entry(BASE, " Low Bar Squat ", "225 lbs", "3", "5", "@8", " hard "),
             **_entry(second, "too early", "1")},
            {**_entry(BASE, "  ", "1"), second: "Day 2"},
            {**_entry(BASE, "Bench Press", "8-10"), **_entry(second, "RDL", "300")},
            {BASE: "day3"},
            {**_entry(BASE, "Leg Press", notes="x"), **_entry(second, "Curl", "20")},
        ],
    )


def _key(r):
    return (r["Date"], r["Exercise"])


def test_weeks(cells):
    got = {(r.base_col, r.week_start) for r in nz.week_columns(cells).collect()}
    assert got == {(BASE, D(2024, 1, 1)), (BASE + 12, D(2024, 1, 8))}


@pytest.mark.parametrize("chunk_rows", [10_000, 2, 1])
def test_log(cells, chunk_rows):
    got = {_key(r): r for r in rows(nz.normalize(cells, chunk_rows=chunk_rows), "Date")}
    assert set(got) == {
        (D(2024, 1, 1), "Low Bar Squat"),
        (D(2024, 1, 1), "Bench Press"),
        (D(2024, 1, 3), "Leg Press"),
        (D(2024, 1, 9), "RDL"),
        (D(2024, 1, 9), "Curl"),
    }
    squat = got[D(2024, 1, 1), "Low Bar Squat"]
    assert (squat["Load"], squat["Sets"], squat["Reps"], squat["RPE"]) == (225, 3, 5, 8)
    assert squat["Day"] == "DAY 1" and squat["Notes"] == "hard"
    assert squat["Block"] == "Block A" and squat["athlete_id"] == 1
    bench = got[D(2024, 1, 1), "Bench Press"]
    assert bench["Load"] is None and bench["Notes"] == ""
    assert {k[1]: r["Lift_Type"] for k, r in got.items()} == {
        "Low Bar Squat": "Squat", "Bench Press": "Bench", "Leg Press": "Accessory",
        "RDL": "Deadlift", "Curl": "Accessory",
    }


def test_weeks_closer_than_their_width_share_cells(spark):
    cells = _grid(
        spark,
        [
            {},
            {0: "2024-01-01", 6: "2024-02-05"},
            {0: "Day 1", 6: "Day 2"},
            {0: "Squat", 6: "Bench"},
        ],
    )
    got = {(r.Date, r.Exercise, r.Day) for r in nz.normalize(cells).collect()}
    # the label of a row is its first one within the week's twelve columns
    assert got == {
        (D(2024, 1, 1), "Squat", "Day 1"),
        (D(2024, 2, 6), "Bench", "Day 2"),
    }


def test_sheets_do_not_mix(spark, cells):
    other = cells.withColumn("block", F.lit("Block B")).filter("row_idx <> 3")
    both = nz.normalize(cells.unionByName(other))
    counts = {r.Block: r["count"] for r in both.groupBy("Block").count().collect()}
    # without its first label, block B loses what stood under it
    assert counts == {"Block A": 5, "Block B": 3}


def test_csv_sheets(spark, tmp_path):
    comma = "," * 12
    sheet = "\n".join(
        [
            "title" + comma,
            "2024-01-01" + comma,
            "Day 1" + comma,
            ",,",
            '"Squat, paused",,,,,,"1""00",3,5,8,"two\nlines"',
        ]
    )
    (tmp_path / "Block A.csv").write_text(sheet)
    (tmp_path / "Empty.csv").write_text("")
    cells = readers.read_cells(spark, str(tmp_path))
    got = rows(nz.normalize(cells, sheet=["block"]), "Exercise")
    assert len(got) == 1
    assert got[0]["Block"] == "Block A" and got[0]["Exercise"] == "Squat, paused"
    assert got[0]["Load"] == 100 and got[0]["Notes"] == "two\nlines"
    assert cells.filter("row_idx = 4 and col_idx = 0").count() == 1


def test_reconcile(spark, cells):
    log = nz.normalize(cells)
    assert reconcile_raw(log, cells).filter("not found").count() == 0
    missing = log.limit(1).withColumn("Exercise", F.lit("Snatch"))
    other_week = log.filter("Exercise = 'RDL'").withColumn(
        "Date", F.lit("2024-01-02").cast("date")
    )
    part = log.filter("Exercise = 'Low Bar Squat'").withColumn(
        "Exercise", F.lit("bar SQ")
    )
    odd = missing.unionByName(other_week).unionByName(part)
    got = {r["Exercise"]: r for r in rows(reconcile_raw(odd, cells), "Exercise")}
    assert not got["Snatch"]["found"] and not got["RDL"]["found"]
    assert got["bar SQ"]["found"]
    assert got["bar SQ"]["raw_exercise"] == " Low Bar Squat "
    assert got["bar SQ"]["raw_load"] == "225 lbs"


def test_reconcile_against_brute_force(spark, cells):
    texts = ["squat", "a", "press", "l", "curl up", "rdl", "Leg Press"]
    dates = [D(2024, 1, d) for d in (1, 7, 8, 14, 15)]
    log = spark.createDataFrame(
        [(1, "Block A", d, t) for d in dates for t in texts],
        "athlete_id int, Block string, Date date, Exercise string",
    )
    base = {BASE: D(2024, 1, 1), BASE + 12: D(2024, 1, 8)}
    raw = [r for r in cells.collect() if r.row_idx >= 2 and r.col_idx in base]

    def expected(date, text):
        return any(
            0 <= (date - base[r.col_idx]).days < 7 and text.lower() in r.value.lower()
            for r in raw
        )

    for r in reconcile_raw(log, cells).collect():
        assert r.found == expected(r.Date, r.Exercise), r


def test_weeks_meet_their_cells_by_stretches_of_columns(spark):
    """Every week was listed once for each of its twelve columns."""
    bases = (-13, 0, 5, 12, 30, 47)
    data = [(1, "A", 1, b, f"2024-01-{i + 1:02d}") for i, b in enumerate(bases)]
    data += [(1, "A", 2, c, f"v{c}") for c in range(-20, 70)] + [(1, "A", 3, None, "nowhere")]
    grid = spark.createDataFrame(data, schemas.CELLS)
    joined = nz.week_cells(grid)
    got = sorted((r.base_col, r.col_idx, r.offset, r.value) for r in joined.collect())
    assert got == sorted((b, c, c - b, f"v{c}") for b in bases for c in range(b, b + 12) if -20 <= c < 70)
    weeks = [n for n in _nodes(joined._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Generate"]
    assert len(weeks) == 1 and "array_distinct" in weeks[0].toString()


def _nodes(plan):
    found = [plan]
    for i in range(plan.children().size()):
        found += _nodes(plan.children().apply(i))
    return found


def test_reconcile_lays_the_grid_out_once(spark, cells):
    """The grid was joined with its weeks for the texts and again for the rows."""
    log = nz.normalize(cells).limit(5).localCheckpoint()
    nodes = _nodes(reconcile_raw(log, cells)._jdf.queryExecution().optimizedPlan())
    assert sum(n.nodeName() == "RepartitionByExpression" for n in nodes) == 1
    assert sum(n.nodeName() == "Join" for n in nodes) <= 5


def test_reconcile_sees_every_text_of_a_place(spark):
    data = [(1, "A", 1, 0, "2024-01-01"), (1, "A", 2, 0, "Day 1"), (1, "A", 9, 0, "squat, last")]
    data += [(1, "A", 3, 0, t) for t in ("Squat", "Bench", "Row")] + [(1, "A", 3, 6, "100")]
    grid = spark.createDataFrame(data, schemas.CELLS)
    names = ("squat", "BENCH", "ro", "day 1", "s", "last", "snatch")
    log = spark.createDataFrame(
        [(1, "A", D(2024, 1, 2), n) for n in names] + [(1, "A", D(2024, 1, 9), "squat"), (None, None, None, None)],
        "athlete_id int, Block string, Date date, Exercise string",
    )
    got = {(r.Exercise, r.Date): (r.found, r.raw_load, r.raw_exercise) for r in reconcile_raw(log, grid).collect()}
    there = (True, "100", "Squat")
    assert got == {
        **{(n, D(2024, 1, 2)): there for n in ("squat", "BENCH", "ro", "s")},
        ("day 1", D(2024, 1, 2)): (True, None, "Day 1"),
        ("last", D(2024, 1, 2)): (True, None, "squat, last"),
        ("snatch", D(2024, 1, 2)): (False, None, None),
        ("squat", D(2024, 1, 9)): (False, None, None),
        (None, None): (False, None, None),
    }
