from ironlog.operators import quality
from tests.helpers import D, entry, log_rows, rows

DAY = D(2024, 1, 1)


def _log(spark):
    return log_rows(
        spark,
        [
            entry(DAY, 100, 5, 8.0),
            {"Date": DAY, "Exercise": "Exercise", "Lift_Type": "Accessory"},
            {"Date": DAY, "Exercise": "EXERCISE", "Lift_Type": "Accessory"},
            entry(DAY, 100, 5, exercise="notes: rest"),
            {"Date": DAY, "Exercise": "Curl", "Lift_Type": "Accessory"},
            entry(DAY, None, 5),
            entry(DAY, 100, 5, 11.0),
            entry(DAY, 701, 5, 8.0, Sets=9.0),
            entry(DAY, 701, 5, 8.0, Sets=9.0),
        ],
    )


def test_blank_rows(spark):
    got = quality.blank_profile(_log(spark)).first()
    assert (got.total, got.completely_blank, got.partially_blank) == (9, 3, 1)
    top = quality.blank_top_exercises(_log(spark), 2).collect()
    assert [r.Exercise for r in top] == ["Curl", "EXERCISE"]
    assert quality.header_like(_log(spark)).count() == 1


def test_rules(spark):
    log = _log(spark)
    counts = {r.column: r.violations for r in quality.rule_violations(log).collect()}
    assert counts == {"RPE": 1, "Sets": 2, "Load": 2}
    assert quality.suspicious_rows(log).count() == 2
    shown = quality.rule_violation_examples(log, n=1)
    assert {(r.column, r.value) for r in shown.collect()} == {
        ("RPE", 11.0), ("Sets", 9.0), ("Load", 701.0),
    }
    assert quality.rule_violations(log, {"Load": (1, 800)}).count() == 0


def test_cleaning_counts_the_first_reason(spark):
    log = _log(spark)
    got = quality.clean_removal_counts(log, remove_suspicious=True).first()
    assert got.asDict() == {
        "original": 9, "header_like": 3, "completely_blank": 1, "suspicious": 3,
        "clean": 2, "clean_pct": got.clean_pct,
    }
    assert quality.clean_dataset(log, remove_suspicious=True).count() == 2
    assert quality.clean_dataset(log).count() == 5
    kept = quality.clean_dataset(
        log, remove_completely_blank=False, remove_header_like=False
    )
    assert kept.count() == 9


def test_profiles_of_an_empty_log(spark):
    empty = _log(spark).limit(0)
    assert quality.blank_profile(empty).first().completely_blank_pct is None
    assert quality.missing_profile(empty).count() == 0
    assert quality.lift_distribution(empty).count() == 0


def test_search_and_samples(spark):
    log = _log(spark)
    assert quality.search_exercise(log, "SQU.T").count() == 5
    assert quality.sample_rows(log, 100).count() == 9
    first = rows(quality.sample_rows(log, 4, seed=3), "Exercise", "Load")
    again = rows(quality.sample_rows(log.repartition(5), 4, seed=3), "Exercise", "Load")
    assert first == again and len(first) == 4
