import pytest
from pyspark.sql import functions as F

from ironlog.functions.patterns import needed
from ironlog.operators import meets, progress
from ironlog.sources import readers
from tests.helpers import D, entry, log_rows, rows

HEADER = (
    "Name", "Date", "MeetName", "Federation", "Division", "Place",
    "Best3SquatKg", "Best3BenchKg", "Best3DeadliftKg", "TotalKg", "Dots",
)


def _meets(spark):
    raw = spark.createDataFrame(
        [
            ("A. Smith", "2024-01-05", "Open", None, "M", "1", "100", "-60", "abc",
             "160", "300"),
            ("Jo Li", "never", "Open", "USA", "F", "2", None, "50", "120", "170", "x"),
            ("Anna Smithson", "2023-05-01", "Cup", "USA", "F", "3", "90", "45", "NaN",
             "235", "1"),
        ],
        ", ".join(f"{c} string" for c in HEADER),
    )
    return readers.coerce_meets(raw).withColumn("athlete_id", F.lit(1))


def test_coercion(spark):
    got = {r["Name"]: r for r in rows(_meets(spark), "Name")}
    assert got["A. Smith"]["Best3DeadliftKg"] is None
    assert got["Anna Smithson"]["Best3DeadliftKg"] is None
    assert got["Jo Li"]["Date"] is None and got["Jo Li"]["Dots"] is None
    assert got["A. Smith"]["Date"] == D(2024, 1, 5)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "meets")
    _meets(spark).drop("athlete_id").write.option("header", True).csv(path)
    assert rows(readers.read_meets(spark, path), "Name") == rows(
        _meets(spark).drop("athlete_id"), "Name"
    )


def _found(df):
    return {(r["query"], r["tier"], r["Name"]) for r in rows(df, "query")}


def test_search(spark):
    m = _meets(spark)
    got = _found(meets.search_lifter(m, ["smith", "a. s", "smithson anna", "xyz q"]))
    assert got == {
        ("smith", 1, "A. Smith"),
        ("smith", 1, "Anna Smithson"),
        ("a. s", 1, "A. Smith"),
        ("smithson anna", 2, "Anna Smithson"),
    }
    # only short words and no direct match: everything matches
    assert len(_found(meets.search_lifter(m, "zz q"))) == 3
    assert meets.search_lifter(m, "zz q", fuzzy=False).count() == 0
    # as an expression the dot matches any character
    assert len(_found(meets.search_lifter(m, "a.na", regex=True))) == 1
    assert len(_found(meets.search_lifter(m, "a.na", fuzzy=False))) == 0
    assert len(_found(meets.search_lifter(m, "^.n+a", regex=True))) == 1


def test_search_takes_any_number_of_names(spark):
    m = _meets(spark)
    names = [f"nobody {i}" for i in range(5000)] + ["smith", "li", "", None]
    got = _found(meets.search_lifter(m, names))
    assert {g for g in got if g[0] != ""} == {
        ("smith", 1, "A. Smith"), ("smith", 1, "Anna Smithson"), ("li", 1, "Jo Li"),
    }
    assert len([g for g in got if g[0] == ""]) == 3
    table = spark.createDataFrame([("SMITH", 1), ("smithson anna", 2)], "who string, n int")
    assert len(_found(meets.search_lifter(m, table))) == 3
    patterns = [f"x{i}$" for i in range(120)] + ["li$"]
    assert _found(meets.search_lifter(m, patterns, regex=True)) == {("li$", 1, "Jo Li")}
    assert meets.search_lifter(m, []).count() == 0


@pytest.mark.parametrize("fuzzy", [True, False])
def test_many_expressions_meet_names_by_needed_text(spark, monkeypatch, fuzzy):
    names = ["Jon Smithson", "Jonathan  O'Neil", "JANE smith", "Bo Li", "Zoë Ünal", "", "smi", "Smith\nJane", None]
    m = spark.createDataFrame([(n, i) for i, n in enumerate(names * 2)], "Name string, row int")
    queries = [
        "smith", "smith jane", "son$", "^jo(n|nathan) ", "ab{2,3}", "(smi){2}", "o'neil", "(?i)LI", "[a-z]+son\\b", "ünal",
        "(?m)^jane", "smi\\x74h", "jane|smith", "jane|li", "(jane smith|bo li)", "(zzz)?bo li", "smi.?h ja", "zz q", "", "j.n.",
        "(?!jane)smith", "smith(?=son)", "nal .zo", "athan neil",
    ]
    plain = meets.search_lifter(m, queries, fuzzy, regex=True)
    monkeypatch.setattr(meets, "_PATTERNS", 3)
    indexed = meets.search_lifter(m, queries, fuzzy, regex=True)
    assert plain.count() > 20
    assert rows(indexed, "query", "tier", "row") == rows(plain, "query", "tier", "row")
    plan = spark._jvm.PythonSQLUtils.explainString(indexed._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_short_and_long_lists_find_the_same(spark, monkeypatch):
    m = _meets(spark)
    queries = ["smith", "a. s", "smithson anna", "xyz q", "", "LI", "li  jo", "%", "smith"]
    short = rows(meets.search_lifter(m, queries), "query", "Name")
    monkeypatch.setattr(meets, "_PATTERNS", 1)
    assert rows(meets.search_lifter(m, queries), "query", "Name") == short


def test_needed_text():
    known = {
        "smith": ("smith",), "a.na": None, "(john|jane) smi": (" smi",), "jane|smith": ("jane", "smith"), "jane|li": None,
        "x?smith": ("smith",), "(smith)?": None, "(smith)+": ("smith",), "ab{2,3}cde": ("cde",), "smi\\x41th": None,
        "(?x)s m i t h": None, "(?iu)smith": None, "(?i:smith)": ("smith",), "(?!abc)de": None, "[smith]": None, "(smith": None,
    }
    assert {p: needed(p) for p in known} == known


def test_short_words_also_find_rows_without_a_name(spark):
    m = _meets(spark)
    unnamed = m.withColumn("Name", F.when(F.col("Name") != "Jo Li", F.col("Name")))
    for regex in (False, True):
        got = _found(meets.search_lifter(unnamed, ["zz q", "smith"], regex=regex))
        assert ("zz q", 2, None) in got and len(got) == 5


def test_meet_lists_are_in_order(spark):
    got = meets.lifter_meets(_meets(spark), ["zz q", "smith"]).collect()
    place = [(r["query"], str(r["Date"] or "")) for r in got]
    assert place == sorted(place) and len(place) == 5


def test_search_has_no_unbounded_join(spark):
    names = [f"name {i}" for i in range(20)]
    df = meets.search_lifter(_meets(spark), names)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_format(spark):
    long = meets.meets_long(_meets(spark))
    got = {(r["Block"], r["Lift_Type"]): r for r in rows(long, "Block")}
    assert set(got) == {
        ("MEET: Open", "Squat"), ("MEET: Open", "Bench"), ("MEET: Open", "Deadlift"),
        ("MEET: Cup", "Squat"), ("MEET: Cup", "Bench"),
    }
    squat = got["MEET: Open", "Squat"]
    assert squat["Load"] == 220.5 and squat["Total"] == 352.7
    assert squat["Notes"] == "Competition -  M"
    assert squat["Meet_Result"] and squat["RPE"] is None and squat["Sets"] == 1.0
    bare = meets.meets_long(_meets(spark).drop("MeetName", "Place", "Dots", "TotalKg"))
    first = bare.first()
    assert first.Block == "MEET: Unknown Meet" and first.Place == ""
    assert first.Total == 0 and first.Dots == 0


def test_integration_and_bests(spark):
    log = log_rows(spark, [entry(D(2024, 1, 1), 100)])
    long = meets.meets_long(_meets(spark))
    both = meets.integrate_meets(log, long)
    assert both.filter("not Meet_Result").count() == 1
    assert both.filter("Meet_Result and Place is not null").count() == 5
    assert meets.integrate_meets(log, None).first().Meet_Result is False
    best = {r.Lift_Type: r for r in progress.competition_bests(long).collect()}
    assert best["Squat"].Best_Weight == 220.5 and best["Squat"].Place == "1"
    newest = progress.meet_results_recent(long, 1).first()
    assert newest.Date == D(2024, 1, 5)
    points = progress.overlay_series(log, long)
    assert {r.source for r in points.collect()} == {"Training", "Meets"}


def test_profile_and_latest(spark):
    got = meets.meets_profile(_meets(spark)).first()
    assert (got.entries, got.federations) == (3, 1)
    latest = {r.Name: r.MeetName for r in meets.latest_meet(_meets(spark)).collect()}
    assert latest["A. Smith"] == "Open" and len(latest) == 3
