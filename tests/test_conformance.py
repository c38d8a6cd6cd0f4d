"""Every registered query against its SQL twin, and what its plan may contain."""

import datetime as dt
import glob
import math
import os
import re

import duckdb
import pytest

from conformance.oracle import statements
from conformance.queries import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = registry(), statements()
# Queries that write and read files before they return.
EAGER = {
    "read_log", "read_cells", "read_meets", "write_log", "ingest_grids",
    "incremental_ingest", "sheets_to_1rm",
}
TYPES = {
    "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN",
}

pytestmark = pytest.mark.skipif(
    not os.path.isdir(SF_DIR), reason="test tables are not installed"
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4) + 0.0
    if isinstance(value, dt.datetime):
        return value.date()
    return value


def test_every_query_has_a_statement():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLE[name])
    types = {c[0]: str(c[1]) for c in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    columns = sorted(types)
    at = [list(types).index(c) for c in columns]
    expected = sorted(
        (tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=repr
    )
    got = sorted(
        (tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr
    )
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan(spark, name):
    """No Python, no nested-loop or cross join, no window over all rows."""
    df = QUERIES[name](spark, SF_DIR)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert not re.search("Python|Arrow|NestedLoop|Cartesian", plan)
    if name != "lift_distribution":  # there after the aggregation
        assert "Exchange SinglePartition, ENSURE" not in _windows(plan)


def _windows(plan):
    lines = plan.splitlines()
    return "\n".join(
        "\n".join(lines[i : i + 3]) for i, line in enumerate(lines) if "Window [" in line
    )
