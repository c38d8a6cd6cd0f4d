"""The library's input tables, derived from the supplied ones.

``training_log`` reads order lines as training entries, ``meets`` reads orders
as competition results, and ``cells`` lays the training log out as spreadsheet
grids.  All of it is lazy, native and free of hand-picked join strategies.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ironlog.functions.parsing import classify_lift
from ironlog.operators.normalize import HEADER_ROW, OFFSETS, WEEK_WIDTH

# "Now" of every report: the day after the newest possible entry.
AS_OF = "2002-01-01"
MEET_DATE = "2002-03-26"
RANGE = ("1997-01-01", "2000-12-31")
# Column 0 of the grids; earlier than every entry.
FIRST_MONDAY = "1990-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that all executors share, gone when the session ends.

    That storage is ``spark.checkpoint.dir``.  Only under a local master, where the
    driver is the only machine, a temporary folder may stand in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="ironlog-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _half_pounds(price: Column) -> Column:
    """Price over 140 to the nearest half, by whole cents.

    Halves are exact in binary, so sums and means do not depend on row order.
    """
    cents = F.rint(price * 100)
    return F.floor(cents / 7000.0 + 0.5) / 2.0


def training_log(
    spark: SparkSession, sf_dir: str, athlete: Column | None = None
) -> DataFrame:
    """Order lines as training entries: 25 athletes with many, others with few."""
    c = F.col
    kind = c("p_type")
    exercise = (
        F.when(kind == "ECONOMY", "Low Bar Squat")
        .when(kind == "STANDARD", "Hack Squat")
        .when(kind == "LARGE", "Bench Press")
        .when(kind == "PROMO", "Overhead Press")
        .when((kind == "MEDIUM") & (c("p_size") <= 15), "RDL")
        .when(kind == "MEDIUM", "Deadlift")
        .otherwise("Leg Press")
    )
    # what depends on one dimension is computed there, not per order line
    parts = (
        table(spark, sf_dir, "part")
        .select("p_partkey", exercise.alias("Exercise"))
        .withColumn("Lift_Type", classify_lift(c("Exercise")))
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.concat(F.lit("Block "), F.year("o_orderdate")).alias("Block"),
    )
    # some customers are athletes of their own, with series that are short; half of
    # those lift the same weight on every day
    own = c("c_custkey") % 40 == 7
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        (
            F.when(own, (c("c_custkey") + 1000).cast("int")).otherwise(c("c_nationkey"))
            if athlete is None
            else athlete.cast("int")
        ).alias("athlete_id"),
        (c("c_custkey") % 80 == 7).alias("steady"),
    )
    skipped = (c("l_tax") == 0.08) & (c("l_returnflag") == "R")
    items = table(spark, sf_dir, "lineitem").withColumns(
        {
            "logged": ~skipped,
            "weighed": ~skipped & ~((c("l_tax") == 0.07) & (c("l_returnflag") == "N")),
            "rated": ~((c("l_linestatus") == "O") & (c("l_tax") <= 0.02)),
            "Date": c("l_shipdate").cast("date"),
        }
    )
    # orders meet their customers first, so that the order lines move once less
    owned = orders.join(customers, orders.o_custkey == customers.c_custkey)
    joined = items.join(owned, items.l_orderkey == orders.o_orderkey).join(
        parts, items.l_partkey == parts.p_partkey
    )
    sets = c("l_linenumber") + F.when(c("l_quantity") == 50, 4).otherwise(0)
    # halves from 5 to 10
    rpe = F.rint(c("l_discount") * 100) / 2 + 5
    return joined.select(
        "athlete_id",
        "Date",
        "Block",
        F.concat(F.lit("Day "), F.weekday("Date") + 1).alias("Day"),
        "Exercise",
        F.when(c("logged"), sets.cast("double")).alias("Sets"),
        F.when(
            c("logged"), F.when(c("steady"), 1.0).otherwise(c("l_quantity") % 12 + 1)
        ).alias("Reps"),
        F.when(
            c("weighed"),
            F.when(c("steady"), 100.1).otherwise(_half_pounds(c("l_extendedprice"))),
        ).alias("Load"),
        F.when(c("rated") & ~c("steady"), rpe).alias("RPE"),
        F.lit("").alias("Notes"),
        "Lift_Type",
    )


def messy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log with header and note lines pasted into it, for cleaning."""
    log = training_log(spark, sf_dir)
    blank = F.col("Sets").isNull() & F.col("Reps").isNull() & F.col("Load").isNull()
    pasted = (
        F.when(blank & (F.col("Exercise") == "RDL"), "Exercise")
        .when(F.col("RPE") == 5.5, F.concat(F.lit("Notes: "), F.col("Exercise")))
        .otherwise(F.col("Exercise"))
    )
    return log.withColumn("Exercise", pasted)


def meets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as meet results of the customers; ``athlete_id`` as in the log."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations, customers.c_nationkey == nations.n_nationkey
    )
    key = F.col("o_orderkey")

    def kilos(percent: int, divisor: int = 700) -> Column:
        """Share of the price as kilograms with two decimals, by whole cents."""
        cents = "cast(round(o_totalprice * 100) as bigint)"
        return F.expr(f"({cents} * {percent} div {divisor * 100}) / 100.0D")

    def lift(percent: int) -> Column:
        sign = F.when(key % 11 == 0, -1.0).otherwise(1.0)
        return F.when(key % 7 != 0, kilos(percent) * sign)

    return joined.select(
        F.col("c_nationkey").alias("athlete_id"),
        F.col("c_name").alias("Name"),
        F.col("o_orderdate").cast("date").alias("Date"),
        F.concat(F.lit("Meet "), key % 50).alias("MeetName"),
        F.col("n_name").alias("Federation"),
        F.col("c_mktsegment").alias("Division"),
        (key % 10 + 1).cast("string").alias("Place"),
        lift(37).alias("Best3SquatKg"),
        lift(23).alias("Best3BenchKg"),
        lift(40).alias("Best3DeadliftKg"),
        kilos(100).alias("TotalKg"),
        kilos(100, 977).alias("Dots"),
    )


def raw_meets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results as text, with some unreadable dates and weights."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    price = F.floor("o_totalprice").cast("string")
    return orders.select(
        F.concat(F.lit("Lifter "), F.col("o_custkey")).alias("Name"),
        F.when(key % 13 == 0, "soon")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("Date"),
        F.concat(F.lit("Meet "), key).alias("MeetName"),
        F.when(key % 5 == 0, F.concat(price, F.lit("kg")))
        .when(key % 7 == 0, F.concat(price, F.lit("d")))
        .otherwise(price)
        .alias("TotalKg"),
        F.when(key % 9 != 0, price).alias("Best3SquatKg"),
    )


def write_sheets(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The log of teams of sixty customers as CSV sheets, one per team and block.

    As in a log kept by hand, weeks stand side by side and share lines: the first training
    day of every week, below it the second of every week that has one, and so on.  Weeks
    without entries take no columns, so a sheet grows with its entries, not with entries times
    weeks.  Sheets have blank lines before each day, some also as their first line, and those
    of odd teams have weeks of 24 columns, which makes them wider than 1500 columns.  Their
    number grows with the customers, not their size.
    """
    log = training_log(spark, sf_dir, F.floor(F.col("c_custkey") / 60))
    key = ["athlete_id", "Block"]
    commas = lambda n: F.repeat(F.lit(","), n)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    wide = F.when(F.col("athlete_id") % 2 == 1, 2 * WEEK_WIDTH).otherwise(WEEK_WIDTH)
    entry = F.concat(
        F.lit('"'), "Exercise", F.lit('"'), commas(F.lit(OFFSETS["load"])),
        text("Load"), F.lit(","), text("Sets"), F.lit(","), text("Reps"), F.lit(","), text("RPE"),
    )
    whole_week = [*key, "week"]
    # all that follows keeps this distribution, and the first order serves all three ranks; sheets are small
    placed = (
        log.select(*key, "Date", "Day", entry.alias("entry"))
        .withColumn("week", F.date_trunc("week", F.col("Date")).cast("date"))
        .repartition(*key)
        .withColumn("row", F.row_number().over(W.partitionBy(*whole_week, "Date").orderBy("entry")))
        .withColumn("level", F.dense_rank().over(W.partitionBy(*whole_week).orderBy("Date")))
    )
    by_week = W.partitionBy(*key).orderBy("week")
    # entries without a date come first and take no columns
    undated = F.max(F.col("week").isNull().cast("int")).over(by_week)
    placed = placed.withColumn("base", ((F.dense_rank().over(by_week) - 1 - undated) * wide).cast("int"))
    dated, opens = F.col("Date").isNotNull(), F.col("row") == 1
    start = F.date_format("week", "yyyy-MM-dd")

    def cell(when: Column, level: Column, kind: int, row: Column, value: Column) -> Column:
        fields = level.alias("level"), F.lit(kind).alias("kind"), row.alias("row"), value.alias("value")
        return F.when(when, F.struct(*fields))

    none = F.lit(0)
    kinds = F.array(
        # entries without a date are left out; their sheet has a line above its first, so no weeks
        cell(~dated & opens, F.lit(-1), 3, none, F.lit("")),
        cell(dated & opens & (F.col("level") == 1), none, 0, none, start),
        cell(dated & opens, F.col("level"), 1, none, F.col("Day")),
        cell(dated, F.col("level"), 2, F.col("row"), F.col("entry")),
    )
    cut = placed.select(*key, "base", F.explode(kinds).alias("cell")).filter(F.col("cell").isNotNull())
    cut = cut.select(*key, "base", "cell.*")
    # the columns that a cell takes besides its own
    inner = F.when(F.col("kind") == 2, OFFSETS["rpe"]).otherwise(0)
    parts = F.col("parts")

    def behind(part: Column, i: Column) -> Column:
        taken = F.when(i > 0, F.try_element_at(parts, i)["base"] + inner).otherwise(0)
        return F.concat(commas(part["base"] - taken), part["value"])

    lines = (
        cut.groupBy(*key, "level", "kind", "row")
        .agg(F.sort_array(F.collect_list(F.struct("base", "value"))).alias("parts"))
        .withColumn("value", F.array_join(F.transform("parts", behind), ""))
    )
    top = F.when(F.col("athlete_id") % 3 == 0, "\n").otherwise("Log\n")
    above = F.when(F.col("kind") == 0, top).when(F.col("kind") == 1, "\n").otherwise("")
    lines = lines.withColumn("value", F.concat(above, "value"))
    # one row, and so one file, per sheet
    whole = F.sort_array(F.collect_list(F.struct("level", "kind", "row", "value")))
    sheets = lines.groupBy(*key).agg(F.array_join(whole["value"], "\n").alias("value"))
    # tasks put their files in place themselves, not the driver one after another; no reader starts before the last
    writer = sheets.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(*key).text(path)


# Rows of one training day that are numbered by one task.
_LANES = 64
# Sheet rows reserved per training day.
_DAY_ROWS = 10**12
_FIELDS = ["Exercise", "Sets", "Reps", "Load", "RPE"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training log laid out as grids: the inverse of ``normalize``.

    One sheet per athlete and block, one week per twelve columns, one label row
    per day.  Entries of a day are spread over numbering lanes, which gives
    unique rows without a window over a whole day.
    """
    entries = _entries(training_log(spark, sf_dir))
    # weeks and days are few, and both are taken from the same distinct days
    return cells_of(_placed(_numbered(entries)), _days(_placed(entries)))


def kept_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries with their places, written once to be read more than once."""
    path = scratch(spark, "entries")
    _numbered(_entries(training_log(spark, sf_dir))).write.parquet(path)
    return _placed(spark.read.parquet(path))


def _entries(log: DataFrame) -> DataFrame:
    return log.select("athlete_id", F.col("Block").alias("block"), "Date", "Day", *_FIELDS)


def _numbered(entries: DataFrame) -> DataFrame:
    """Entries with their row in the sheet, ``_row``; what follows from the date is left for later."""
    numbered = entries.withColumn("lane", F.pmod(F.xxhash64(*_FIELDS), F.lit(_LANES)))
    line = W.partitionBy("athlete_id", "block", "Date", "lane").orderBy(*_FIELDS)
    row = _top(_day_no()) + F.row_number().over(line) * _LANES + F.col("lane")
    return numbered.withColumn("_row", row).drop("lane")


def _day_no() -> Column:
    return F.weekday("Date") + 1


def _top(day_no: Column) -> Column:
    """Row of the label of a training day."""
    return day_no * F.lit(_DAY_ROWS).cast("long")


def _placed(entries: DataFrame) -> DataFrame:
    """Entries with the week, first column and day that they belong to."""
    week = F.date_trunc("week", F.col("Date")).cast("date")
    weeks = F.floor(F.datediff(week, F.lit(FIRST_MONDAY).cast("date")) / 7)
    return entries.withColumns(
        {"week_start": week, "base_col": (weeks * WEEK_WIDTH).cast("int"), "day_no": _day_no()}
    )


def _days(placed: DataFrame) -> DataFrame:
    return placed.select("athlete_id", "block", "base_col", "week_start", "day_no", "Day").distinct()


def cells_of(entries: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Cells of entries that have their places; ``days`` are their distinct days."""
    days = _days(entries) if days is None else days
    sheet = [F.col("athlete_id"), F.col("block")]
    headers = (
        days.select(*sheet, "base_col", "week_start")
        .distinct()
        .select(
            *sheet,
            F.lit(HEADER_ROW).cast("long").alias("row_idx"),
            F.col("base_col").alias("col_idx"),
            F.date_format("week_start", "yyyy-MM-dd").alias("value"),
        )
    )
    # even days have their label in the sixth column of the week
    label_col = F.col("base_col") + F.when(F.col("day_no") % 2 == 0, 5).otherwise(0)
    labels = _placed_cells(days, sheet, _top(F.col("day_no")), [(label_col, F.col("Day"))])
    text = [
        (F.col("base_col") + OFFSETS[name.lower()], F.col(name).cast("string"))
        for name in _FIELDS
    ]
    rows = _placed_cells(entries, sheet, F.col("_row"), text)
    return headers.unionByName(labels).unionByName(rows)


def _placed_cells(
    rows: DataFrame, sheet: list[Column], row: Column, cells: list[tuple[Column, Column]]
) -> DataFrame:
    """The (column, text) pairs of each row that have a text, as cells below the header row.

    The last filter removes nothing: it tells Spark that a reader of header rows needs none of these.
    """
    place = F.col("_place")
    made = F.array(*[F.struct(place.alias("row_idx"), c.alias("col_idx"), v.alias("value")) for c, v in cells])
    cut = rows.withColumn("_place", row).select(*sheet, F.inline(made)).filter(F.col("value").isNotNull())
    return cut.filter(F.coalesce("row_idx", F.lit(HEADER_ROW + 1)) > HEADER_ROW)
