"""The input tables that the registered queries derive."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from conformance import views
from conformance.queries import reconcile_raw
from ironlog.operators.normalize import normalize, week_columns
from ironlog.sources import readers


def _tables(spark, folder, items, customers=((0, 3),)):
    """``items``: rows of (order, customer, line, quantity, ship date)."""
    def save(name, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")

    ordered = dt.datetime(1996, 5, 1)
    save("customer", list(customers), "c_custkey long, c_nationkey int")
    save("part", [(1, "LARGE", 5)], "p_partkey long, p_type string, p_size int")
    save(
        "orders",
        sorted({(o, c, ordered) for o, c, *_ in items}, key=str),
        "o_orderkey long, o_custkey long, o_orderdate timestamp",
    )
    save(
        "lineitem",
        [(o, 1, n, float(q), 1400.0 * q, 0.04, 0.01, "N", "F", day) for o, _, n, q, day in items],
        "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    )
    return str(folder)


def _entries(log):
    columns = ["athlete_id", "Date", "Block", "Exercise", "Sets", "Reps", "Load", "RPE"]
    return sorted(map(str, log.select(*columns).collect()))


def test_sheets_grow_with_their_entries(spark, tmp_path):
    """Weeks share lines: 200 weeks of an entry each made 200 lines of up to 2400 columns."""
    first = dt.datetime(1996, 1, 3)
    items = [(w, 0, 1, w % 40 + 1, first + dt.timedelta(days=7 * w)) for w in range(200)]
    # a week with three days, one of them with several and with equal entries
    items += [(300, 0, n, 5, first + dt.timedelta(days=d)) for n, d in ((1, 1), (2, 1), (2, 1), (3, 2))]
    # the sheet of another team has an entry without a date and is not read
    items += [(400, 60, 1, 5, first), (400, 60, 2, 5, None)]
    d = _tables(spark, tmp_path / "t", items, ((0, 3), (60, 4)))
    views.write_sheets(spark, d, str(tmp_path / "sheets"))
    size = sum(f.stat().st_size for f in Path(tmp_path / "sheets").rglob("part-*"))
    assert size < 50_000
    cells = readers.read_cells(spark, str(tmp_path / "sheets"), folder="Block", athlete="athlete_id")
    team = views.training_log(spark, d, F.floor(F.col("c_custkey") / 60)).filter("athlete_id = 0")
    assert len(_entries(team)) == 204
    assert _entries(normalize(cells)) == _entries(team)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_week_columns_do_not_lay_out_the_entries(spark, tmp_path):
    """Header rows came from a second layout of all entries: a window and three joins of the order lines."""
    first = dt.datetime(1996, 1, 3)
    items = [(w % 5, 0, w, w % 40 + 1, first + dt.timedelta(days=3 * w)) for w in range(60)]
    items.append((6, 0, 1, 4, None))
    d = _tables(spark, tmp_path / "t", items)
    cells = views.cells(spark, d)
    headers = week_columns(cells)
    plan = _plan(headers)
    assert "Window" not in plan and "Generate" not in plan
    log = views.training_log(spark, d)
    weeks = log.select(F.date_trunc("week", "Date").cast("date")).distinct().collect()
    assert sorted(r.week_start for r in headers.collect()) == sorted(w[0] for w in weeks if w[0])
    # undated entries keep their cells, as rows without a number
    assert cells.filter("row_idx is null and value = 'Bench Press'").count() == 1
    assert _entries(normalize(cells)) == _entries(log.filter("Date is not null"))


def test_reconciled_names_come_from_one_log(spark, tmp_path):
    first = dt.datetime(1996, 1, 3)
    items = [(w, 0, 1, w % 12 + 1, first + dt.timedelta(days=w)) for w in range(24)]
    d = _tables(spark, tmp_path / "t", items)
    got = {(r.Exercise, r.found) for r in reconcile_raw(spark, d).collect()}
    assert got == {("Bench Press", True), ("Paused Bench Press", False)}


def test_kept_entries_give_the_same_cells_without_a_join(spark, tmp_path):
    """Each delivery of grids joined and numbered all order lines again."""
    first = dt.datetime(1996, 1, 3)
    items = [(w % 7, 0, w, w % 40 + 1, first + dt.timedelta(days=5 * w)) for w in range(40)]
    # entries that are equal, and one without a date
    items += [(1, 0, 1, 4, first), (1, 0, 1, 4, first), (2, 0, 3, 4, None)]
    d = _tables(spark, tmp_path / "t", items)
    kept = views.cells_of(views.kept_entries(spark, d))
    assert kept.schema == views.cells(spark, d).schema
    assert sorted(map(str, kept.collect())) == sorted(map(str, views.cells(spark, d).collect()))
    plan = _plan(kept)
    assert "Join" not in plan and "Window" not in plan
