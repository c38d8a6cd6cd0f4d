import os
import random
import re

import pytest

from ironlog.operators.quality import clean_dataset
from ironlog.operators.normalize import normalize
from ironlog.plans.ingest import ingest_grids
from ironlog.sources import readers, schemas, writers
from ironlog.streaming.incremental import RECORD, incremental_ingest, read_ingested
from tests.helpers import D, entry, log_rows, rows


def _cells(spark, block, *names):
    data = [(1, block, 1, 0, "2024-01-01"), (1, block, 2, 0, "Day 1")]
    for i, name in enumerate(names):
        data += [(1, block, 3 + i, 0, name), (1, block, 3 + i, 6, "100"),
                 (1, block, 3 + i, 7, "3"), (1, block, 3 + i, 8, "5")]
    return spark.createDataFrame(data, schemas.CELLS)


def test_log_csv(spark, tmp_path):
    log = log_rows(
        spark,
        [
            entry(D(2024, 1, 1), 100, 5, 8.0, Notes='quoted "text", here'),
            entry(D(2024, 1, 2), None, 5),
        ],
    )
    path = writers.write_log(log, str(tmp_path / "log"), fmt="csv", partition_by=())
    got = rows(readers.read_log(spark, path), "Date")
    assert got[0]["Notes"] == 'quoted "text", here' and got[0]["Load"] == 100
    # missing and empty text are the same in CSV
    assert got[1]["Notes"] is None and got[1]["Load"] is None


def test_nan_becomes_null(spark, tmp_path):
    (tmp_path / "log.csv").write_text(
        ",".join(f.name for f in schemas.LOG.fields)
        + "\n1,2024-01-01,B,Day 1,Squat,NaN,5,100,NaN,,Squat\n"
    )
    got = readers.read_log(spark, str(tmp_path / "log.csv")).first()
    assert got.Sets is None and got.RPE is None and got.Load == 100


def test_partitioned_output_prunes(spark, tmp_path):
    log = log_rows(
        spark, [entry(D(2024, 1, 1), 1), entry(D(2024, 1, 1), 2, lift="Bench")]
    )
    path = writers.write_log(log, str(tmp_path / "log"))
    bench = spark.read.parquet(path).filter("Lift_Type = 'Bench'")
    assert len(bench.inputFiles()) == 2 and bench.count() == 1
    plan = spark._jvm.PythonSQLUtils.explainString(
        bench._jdf.queryExecution(), "simple"
    )
    assert "PartitionFilters: [isnotnull(Lift_Type" in plan


def test_output_names():
    assert writers.output_path("x/log.csv", "1rm") == "x/log_with_1rm"
    assert writers.output_path("x/log/", "clean") == "x/log_clean"


def test_ingest(spark, tmp_path):
    cells = _cells(spark, "A", "Squat", "Exercise", "Bench")
    out = ingest_grids(cells, str(tmp_path), run="r1")
    assert out["entries"] == 2
    raw = spark.read.parquet(out["raw"])
    assert raw.count() == 3
    assert spark.read.parquet(out["validated"]).count() == clean_dataset(
        normalize(cells), remove_suspicious=True
    ).count()
    plain = ingest_grids(
        cells, str(tmp_path), run="r1", apply_validation=False, output_suffix="_raw"
    )
    assert plain["entries"] == 3 and "validated" not in plain
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        ingest_grids(cells, str(tmp_path), run="r1")


def test_incremental(spark, tmp_path):
    drop, out, state = (str(tmp_path / n) for n in ("drop", "out", "state"))

    def sync():
        incremental_ingest(spark, drop, out, state).awaitTermination()
        return {(r.Block, r.Exercise) for r in read_ingested(spark, out).collect()}

    _cells(spark, "A", "Squat", "Bench").write.mode("append").parquet(drop)
    assert sync() == {("A", "Squat"), ("A", "Bench")}
    assert sync() == {("A", "Squat"), ("A", "Bench")}  # nothing new
    _cells(spark, "B", "Deadlift").write.mode("append").parquet(drop)
    assert sync() == {("A", "Squat"), ("A", "Bench"), ("B", "Deadlift")}
    assert read_ingested(spark, out).count() == 3
    assert read_ingested(spark, out, validated=False).count() == 3


def test_logs_of_one_athlete_need_no_athlete_column(spark, tmp_path):
    names = [f.name for f in schemas.LOG.fields][1:]
    (tmp_path / "log.csv").write_text(
        ",".join(names) + "\n2024-01-01,B,Day 1,Squat,1,5,100,8,,Squat\n"
    )
    got = readers.read_log(spark, str(tmp_path / "log.csv"), athlete=4)
    assert got.schema.names == schemas.LOG.names
    assert got.first().athlete_id == 4 and got.first().Load == 100


@pytest.mark.parametrize("whole", [0, 1 << 24])
def test_sheets_keep_every_cell_and_every_line(spark, tmp_path, whole):
    wide = "," * 3000 + "far"
    text = '\n\n"a, ""b""\nc",,x\r\n' + wide + "\n\r\n,last"
    (tmp_path / "Block 1.csv").write_bytes(("\ufeff" + text).encode())
    (tmp_path / "Empty.csv").write_text("")
    (tmp_path / "Ended.csv").write_text("p\n")
    cells = readers.read_cells(spark, str(tmp_path), athlete=3, whole_up_to=whole)
    got = rows(cells, "block", "row_idx", "col_idx")
    assert [(r["block"], r["row_idx"], r["col_idx"], r["value"]) for r in got] == [
        ("Block 1", 2, 0, 'a, "b"\nc'), ("Block 1", 2, 2, "x"), ("Block 1", 3, 3000, "far"),
        ("Block 1", 5, 1, "last"), ("Ended", 0, 0, "p"),
    ]
    assert {r["athlete_id"] for r in got} == {3}
    assert normalize(readers.read_cells(spark, str(tmp_path))).count() == 0


@pytest.mark.parametrize("whole", [0, 1 << 24])
def test_a_sheet_in_several_files(spark, tmp_path, whole):
    lines = [f'"x{i}, {i}\n",,{i}\n' if i % 7 else "\n" for i in range(60)]
    lines[-1] = lines[-1].rstrip("\n") if lines[-1] != "\n" else "end"
    want = None
    for files in (1, 3, 50):
        folder = tmp_path / str(files) / "Block=B 1"
        folder.mkdir(parents=True)
        cuts = [len(lines) * k // files for k in range(files + 1)]
        for k in range(files):
            # 10 comes after 9, and what follows the number does not count
            (folder / f"grid {k} {99 - k}.csv").write_text("".join(lines[cuts[k] : cuts[k + 1]]))
        cells = readers.read_cells(spark, str(tmp_path / str(files)), folder="Block", whole_up_to=whole)
        got = sorted(tuple(r) for r in cells.collect())
        assert len({(r[1], r[2], r[3]) for r in got}) == len(got)
        want = want or got
        assert got == want and ("B 1", 8, 2) in {r[1:4] for r in got}


@pytest.mark.parametrize("names", [("a.csv", "b.csv"), ("p1.csv", "q1.csv"), ("1.csv", "b.csv")])
def test_files_without_an_order_are_an_error(spark, tmp_path, names):
    for name in names:
        (tmp_path / "Block=B").mkdir(exist_ok=True)
        (tmp_path / "Block=B" / name).write_text("x\n")
    with pytest.raises(Exception, match="no order of files"):
        readers.read_cells(spark, str(tmp_path), folder="Block").collect()


def test_equal_names_in_different_folders_are_an_error(spark, tmp_path):
    for where in ("a", "b"):
        (tmp_path / where).mkdir()
        (tmp_path / where / "Block 1.csv").write_text("x\n")
    with pytest.raises(Exception, match="no order of files"):
        readers.read_cells(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()


def test_a_sheet_delivered_again_replaces_the_first(spark, tmp_path):
    drop, out, state = (str(tmp_path / n) for n in ("drop", "out", "state"))

    def sync(*sheets):
        for cells in sheets:
            cells.write.mode("append").parquet(drop)
        incremental_ingest(spark, drop, out, state).awaitTermination()
        return sorted((r.Block, r.Exercise) for r in read_ingested(spark, out).collect())

    first = sync(_cells(spark, "A", "Squat", "Bench"), _cells(spark, "B", "Squat"))
    assert first == [("A", "Bench"), ("A", "Squat"), ("B", "Squat")]
    assert sync(_cells(spark, "A", "Deadlift")) == [("A", "Deadlift"), ("B", "Squat")]
    # corrected to a sheet without a valid row
    assert sync(_cells(spark, "B", "Exercise")) == [("A", "Deadlift")]
    assert read_ingested(spark, out, validated=False).count() == 2


def test_a_batch_without_its_record_is_not_seen(spark, tmp_path):
    drop, out, state = (str(tmp_path / n) for n in ("drop", "out", "state"))
    for name in ("A", "B"):
        _cells(spark, name, "Squat").write.mode("append").parquet(drop)
        incremental_ingest(spark, drop, out, state).awaitTermination()
    assert read_ingested(spark, out).count() == 2
    # as if the last batch had stopped before its record
    kept = str(tmp_path / "kept")
    os.rename(f"{out}/{RECORD}batch=00000001", kept)
    for validated in (True, False):
        assert [r.Block for r in read_ingested(spark, out, validated).collect()] == ["A"]


def _plain_cells(text):
    """Cells of a sheet, read from its first character to its last."""
    found, row, col, at = {}, 0, 0, 0
    while at < len(text):
        closed = re.compile(r'"[^"]*(?:""[^"]*)*"(?!")').match(text, at)
        end = closed.end() if closed else at
        end = re.compile(r"[^,\r\n]*").match(text, end).end()
        value = text[at:end]
        if len(value) > 1 and value[0] == value[-1] == '"':
            value = value[1:-1].replace('""', '"')
        if value:
            found[row, col] = value
        stop = re.compile(r"\r\n|\n|\r|,|\Z").match(text, end)
        row, col = (row, col + 1) if stop.group() == "," else (row + 1, 0)
        at = stop.end()
    return found


def _random_sheet(seed):
    pick = random.Random(seed)
    pieces = ['"a, b"', '"x\ny"', '"q""q\n\n,z"', "plain", '5" bar', '"', '""', '"t"u', "", "\u00e9", "1.5"]
    ends = [",", ",", ",", "\n", "\n", "\r\n", "\r"]
    return "".join(pick.choice(pieces) + pick.choice(ends) for _ in range(pick.randint(1, 120)))


@pytest.mark.parametrize(("split", "whole"), [(7, 0), (64, 0), (100_000, 0), (100_000, 1 << 24)])
def test_a_sheet_in_many_splits(spark, tmp_path, split, whole):
    sheets = {f"S{i}": _random_sheet(i) for i in range(24)}
    sheets["Long"] = '"' + "line\n" * 200 + '"' + ",tail\n" + "a,b\n" * 200
    sheets["Loose"] = "a,b\n" * 50 + '"never closed,c\n' + 'd,"",""\n' * 50
    sheets["Mark"] = '\ufeff"first\nfield",x\ny'
    for name, text in sheets.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    changed = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    kept = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        cells = readers.read_cells(spark, [str(tmp_path / f"{n}.csv") for n in sheets], whole_up_to=whole)
        got = {name: {} for name in sheets}
        for r in cells.collect():
            assert (r.row_idx, r.col_idx) not in got[r.block]
            got[r.block][r.row_idx, r.col_idx] = r.value
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for name, text in sheets.items():
        assert got[name] == _plain_cells(text.removeprefix("\ufeff")), name


def _cells_by_field(text):
    """Cells of a CSV text, field by field."""
    field = re.compile(r'"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^,\r\n]*+')
    at, row, column, found = 0, 0, 0, set()
    while at < len(text):
        value = field.match(text, at).group()
        at += len(value)
        if re.fullmatch('".*"', value, re.DOTALL):
            value = value[1:-1].replace('""', '"')
        if value:
            found.add((row, column, value))
        column += 1
        if at < len(text):
            end = re.compile(r"\r\n|\n|\r|,").match(text, at).group()
            at += len(end)
            if end != ",":
                row, column = row + 1, 0
    return found


def test_sheets_of_one_file_are_cut_in_place(spark, tmp_path):
    """A file per sheet was parsed four times, and its fields were sorted by file to count their columns."""
    r = random.Random(5)
    pieces = [",", ",", ",,", "\n", "\r\n", '"', '""', '"a,b"', '"c\nd"', "x", '"y"', '"', ' z"', '","']
    texts = {f"B{i}": "".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for i in range(60)}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    cells = readers.read_cells(spark, str(tmp_path))
    got = {name: set() for name in texts}
    for c in cells.collect():
        got[c.block].add((c.row_idx, c.col_idx, c.value))
    for name, text in texts.items():
        assert got[name] == _cells_by_field(text), text
    plan = spark._jvm.PythonSQLUtils.explainString(cells._jdf.queryExecution(), "simple")
    assert not re.search("Exchange|Window|Sort", plan)
