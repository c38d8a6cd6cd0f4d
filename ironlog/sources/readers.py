"""Readers: training log, exploded spreadsheet grids, competition results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ironlog.functions.parsing import parse_date_multi
from ironlog.sources import schemas


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing; Spark would otherwise sort it above every number."""
    floats = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns(
        {c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}
    )


def read_log(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    schema: T.StructType = schemas.LOG,
    athlete: int | None = None,
) -> DataFrame:
    """Training log with an explicit schema, NaN already turned into null.

    ``athlete`` is for files of one athlete, which have no ``athlete_id``.
    """
    if athlete is not None:
        schema = T.StructType([f for f in schema.fields if f.name != "athlete_id"])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    log = nan_to_null(reader.format(fmt).load(path))
    if athlete is not None:
        log = log.select(F.lit(athlete).cast("int").alias("athlete_id"), "*")
    return log


def _block_name(folder: str | None) -> Column:
    if folder is not None:
        return F.col(folder).cast("string")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return F.url_decode(stem)


# A run of commas, the field behind it, and the line break if it ends the line.
_FIELD = (
    r',*+("[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^,\r\n]*+)(?:\r\n|\n|\r|\z|(?=,))'
)
# A line whose last field opens a quote and does not close it.
_OPENS = (
    r'\A(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,\r]*+|(?!")[^,\r]*+)[,\r])*+"[^"]*+(?:""[^"]*+)*+\z'
)
# Up to the end of the field in which a quote, open since an earlier line, closes.
_CLOSES = r'\A[^"]*+(?:""[^"]*+)*+"[^,\r]*+'

# A field, and a row of fields without its line break.
_ANY_FIELD = r'(?>"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^,\r\n]*+)'
_ROW = rf"({_ANY_FIELD}(?:,++{_ANY_FIELD})*+)(?:\r\n|\n|\r|\z)"
# A field that opens a quote and has a comma before it closes.
_QUOTED_COMMA = r'(?:\A|,)"[^",]*+(?:""[^",]*+)*+,'

_SPLIT = ("_file", "_start")

#: Bytes up to which a file is read as one record.
WHOLE_UP_TO = 16 * 1024 * 1024


def _begins_quoted(steps: DataFrame, of: Sequence[str], order: str) -> DataFrame:
    """``_parity`` and ``_free``: the quote state in which each step begins.

    A step takes a state (0 outside, 1 inside a quoted field) to ``_out`` from outside and
    to ``_in`` from inside: it fixes the state, keeps it or turns it.  Before a step the
    state is what the last fixing step left, turned as often as steps since then turn it.
    ``_free`` says that no step of the group has fixed it so far: then ``_parity`` is to be
    turned by the state in which the group begins.
    """
    ordered = W.partitionBy(*of).orderBy(order)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    turn = ((F.col("_out") == 1) & (F.col("_in") == 0)).cast("int")
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("to"), F.col("_turns").alias("turns")))
    return (
        steps.withColumn("_turns", F.sum(turn).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_fixed", F.last(fixed, ignorenulls=True).over(before))
        .withColumn("_since", F.col("_turns") - turn - F.coalesce("_fixed.turns", F.lit(0)))
        .withColumns({
            "_parity": F.pmod(F.coalesce("_fixed.to", F.lit(0)) + F.col("_since"), F.lit(2)).cast("int"),
            "_free": F.col("_fixed").isNull(),
        })
        .drop("_turns", "_fixed", "_since")
    )


def _state(begin: Column | int) -> Column:
    """State before a step of ``_begins_quoted`` when its group begins in ``begin``."""
    start = F.lit(begin) if isinstance(begin, int) else begin
    return F.when(F.col("_free"), F.col("_parity").bitwiseXOR(start)).otherwise(F.col("_parity"))


def _records(lines: DataFrame) -> DataFrame:
    """Lines joined to records where a quoted field holds line breaks.

    ``lines`` has the file, the start of the split, and the order within the split.  Each
    line is evaluated for both quote states, each split is summed up for both, and the
    splits of a file, one narrow row each, are put in a row; a task never sees more of a
    file than a split and the record that crosses its end.  A quote that no later line of
    the file closes is text, so from its line on each line is a record.
    """
    first = (F.col("_start") == 0) & (F.col("_line") == 1)
    bare = F.when(first, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    behind = F.regexp_replace("value", _CLOSES, "")
    lines = (
        lines.withColumn("_line", F.row_number().over(W.partitionBy(*_SPLIT).orderBy("_id")))
        .withColumn("value", bare)
        .withColumns({
            "_out": F.col("value").rlike(_OPENS).cast("int"),
            "_in": F.when(F.col("value").rlike(_CLOSES), behind.rlike(_OPENS).cast("int")).otherwise(1),
        })
    )
    lines = _begins_quoted(lines, _SPLIT, "_line")

    def after(begin: int) -> Column:
        return F.max_by(F.when(_state(begin) == 1, F.col("_in")).otherwise(F.col("_out")), "_line")

    def opened(begin: int) -> Column:
        return F.max(F.when(_state(begin) == 0, F.col("_line")))

    splits = lines.groupBy(*_SPLIT).agg(
        after(0).alias("_out"), after(1).alias("_in"), opened(0).alias("_opened0"), opened(1).alias("_opened1")
    )
    file = W.partitionBy("_file").orderBy("_start")
    whole = file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earlier = file.rowsBetween(W.unboundedPreceding, -1)
    line = F.when(F.col("_begin") == 0, F.col("_opened0")).otherwise(F.col("_opened1"))
    place = F.when(line.isNotNull(), F.struct("_start", line.alias("_line")))
    end = F.when(F.col("_begin") == 1, F.col("_in")).otherwise(F.col("_out"))
    splits = (
        _begins_quoted(splits, ["_file"], "_start")
        .withColumn("_begin", _state(0))
        .withColumns({
            "_prior": F.last(place, ignorenulls=True).over(earlier),
            "_loose": F.when(F.last(end).over(whole) == 1, F.last(place, ignorenulls=True).over(whole)),
        })
        .select(*_SPLIT, "_begin", "_prior", "_loose")
    )
    here = F.struct("_start", "_line")
    alone = F.coalesce(here >= F.col("_loose"), F.lit(False))
    begun = F.when((_state(F.col("_begin")) == 0) | alone, here)
    so_far = W.partitionBy(*_SPLIT).orderBy("_line").rowsBetween(W.unboundedPreceding, 0)
    of = F.coalesce(F.last(begun, ignorenulls=True).over(so_far), F.col("_prior"))
    parts = F.array_sort(F.collect_list(F.struct("_start", "_line", "value")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["value"], F.lit("\n"))), "")
    return (
        lines.join(splits, list(_SPLIT))
        .withColumn("_of", of)
        # both the records and what is counted per split of them need no further shuffle
        .repartition("_file", "_of._start")
        .groupBy("_file", F.col("_of._start").alias("_first"), F.col("_of._line").alias("_at"))
        .agg(F.first("athlete_id").alias("athlete_id"), F.first("block").alias("block"), text.alias("_text"))
        .withColumnRenamed("_first", "_start")
        .withColumnRenamed("_at", "_line")
    )


def _whole_records(files: DataFrame) -> DataFrame:
    """A record per file, as ``_records`` gives them: a last line ends with a line break, too."""
    text = F.regexp_replace("value", "^\ufeff", "")
    open_end = (text != "") & ~text.rlike(r"[\r\n]\z")
    text = F.when(open_end, F.concat(text, F.lit("\n"))).otherwise(text)
    return files.select("_file", "_start", F.lit(1).alias("_line"), "athlete_id", "block", text.alias("_text"))


def _sheet_cells(files: DataFrame) -> DataFrame:
    """Cells of sheets that are a file each: a file is cut to rows and these to fields, in place."""
    # behind the last row an empty one is found, which has no cells
    rows = F.regexp_extract_all("_text", F.lit(_ROW), F.lit(1))
    quoted = F.regexp_extract_all(F.concat(F.lit(","), "_row"), F.lit(f",({_ANY_FIELD})"), F.lit(1))
    fields = F.when(F.col("_row").rlike(_QUOTED_COMMA), quoted).otherwise(F.split("_row", ","))
    sheet = ["athlete_id", "block"]
    lines = files.select(*sheet, F.posexplode(rows).alias("_at", "_row"))
    lines = lines.select(*sheet, F.col("_at").cast("long").alias("row_idx"), "_row")
    # exploded as they are made: of a named array Spark would infer filters and so make it three times
    cut = lines.select(*sheet, "row_idx", F.posexplode(fields).alias("col_idx", "_value"))
    cut = cut.filter(~F.col("_value").isin("", '""'))
    return cut.select(*sheet, "row_idx", "col_idx", _unquoted(F.col("_value")).alias("value"))


def _unquoted(field: Column) -> Column:
    quoted = field.startswith('"') & field.endswith('"') & (F.length(field) > 1)
    inner = F.substring(field, F.lit(2), F.length(field) - 2)
    return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)


def _row_offsets(splits: DataFrame) -> DataFrame:
    """(_file, _start, _offset): the sheet's rows before each split.

    Running sums see one narrow row per split.  Files of a sheet stand in the order of the
    first number in their names; an order that names do not define is an error.
    """
    number = F.regexp_extract(F.element_at(F.split("_file", "/"), -1), r"\d+", 0).try_cast("decimal(38,0)")
    sheet = W.partitionBy("athlete_id", "block").orderBy("_number", "_file", "_start")
    whole = sheet.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    splits = splits.withColumn("_number", number).withColumns({
        "_several": F.min("_file").over(whole) != F.max("_file").over(whole),
        "_other": (F.lag("_file").over(sheet) != F.col("_file")) & F.lag("_number").over(sheet).eqNullSafe(F.col("_number")),
        "_before": F.sum("_rows").over(sheet.rowsBetween(W.unboundedPreceding, -1)),
    })
    unclear = F.col("_several") & (F.col("_number").isNull() | F.col("_other"))
    message = F.concat(F.lit("no order of files is defined for sheet "), F.col("block"), F.lit(": "), F.col("_file"))
    offset = F.when(unclear, F.raise_error(message).cast("long")).otherwise(F.coalesce("_before", F.lit(0)))
    return splits.select(*_SPLIT, offset.alias("_offset"))


def read_cells(
    spark: SparkSession,
    path: str | list[str],
    folder: str | None = None,
    athlete: int | str = 0,
    whole_up_to: int = WHOLE_UP_TO,
) -> DataFrame:
    """Header-less CSV sheets, one per training block, as grid cells.

    Nothing is lost: a sheet may have any number of columns, and blank lines count as
    rows, so every cell keeps its place.  Empty cells yield no row.  The block is the
    file name or, with ``folder``, the value in ``<folder>=<block>/``; ``athlete`` is
    the athlete's number or the name of the folder level ``<athlete>=<number>/``.

    A sheet may lie in several files, cut at line breaks: rows are numbered through in
    the order of the first number in the file names (``part-00007-...``, ``grid 7.csv``).
    Two files of one sheet with the same number, or without one, are an error when read.

    Quoted fields may hold commas, quotes and line breaks.  A quote that is never closed is text.
    Where no file is larger than ``whole_up_to`` bytes, a file is one record; otherwise a file is
    read by as many tasks as it has splits, quoted fields across their ends included, and only
    a single row of the sheet must fit in a task.  Where besides no sheet has several files,
    every file is cut in place, without a shuffle.  The cells are the same either way.  Sizes
    and sheets of the files are looked up when the reader is called, by a job that opens no file.
    """
    owner = F.lit(athlete) if isinstance(athlete, int) else F.col(athlete)
    of = [owner.cast("int").alias("athlete_id"), _block_name(folder).alias("block")]
    files = spark.read.format("binaryFile").load(path).select(*of, "length").groupBy("athlete_id", "block")
    files = files.agg(F.max("length").alias("largest"), F.count(F.lit(1)).alias("files"))
    largest, most = files.agg(F.max("largest"), F.max("files")).first()
    whole = largest is None or largest <= whole_up_to
    read = spark.read.text(path, wholetext=True) if whole else spark.read.text(path, lineSep="\n")
    read = read.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        *of,
        "value",
    )
    if whole and most is not None and most == 1:
        return _sheet_cells(_whole_records(read))
    fields = F.regexp_extract_all("_text", F.lit(_FIELD), F.lit(0))
    ended = F.filter("_fields", lambda f: f.rlike(r"[\r\n]\z"))
    records = (
        (_whole_records(read) if whole else _records(read))
        # behind the last field an empty one is found
        .withColumn("_fields", F.slice(fields, 1, F.size(fields) - 1))
        .withColumn("_rows", F.size(ended).cast("long"))
    )
    if whole:
        numbered, splits = records.withColumn("_above", F.lit(0)), records
    else:
        above = W.partitionBy(*_SPLIT).orderBy("_line").rowsBetween(W.unboundedPreceding, -1)
        numbered = records.withColumn("_above", F.coalesce(F.sum("_rows").over(above), F.lit(0)))
        owners = (F.first(c).alias(c) for c in ("athlete_id", "block"))
        splits = records.groupBy(*_SPLIT).agg(*owners, F.sum("_rows").alias("_rows"))
    splits = splits.select(*_SPLIT, "athlete_id", "block", "_rows")
    numbered = numbered.join(_row_offsets(splits), list(_SPLIT))
    before = (
        W.partitionBy(*_SPLIT, "_line").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    )
    commas = F.length(F.regexp_extract("_field", r"\A,*", 0))
    value = F.regexp_replace("_field", r"(\r\n|\n|\r)\z", "")
    value = F.regexp_replace(value, r"\A,+", "")
    ends = F.col("_field").rlike(r"[\r\n]\z")
    passed = F.coalesce(F.sum("_commas").over(before), F.lit(0)) + F.col("_commas")
    first = F.col("_offset") + F.col("_above")
    cut = (
        numbered.select(
            *_SPLIT, "_line", "athlete_id", "block", first.alias("_row"), F.posexplode("_fields").alias("_at", "_field")
        )
        .withColumns({"_commas": commas, "_value": value, "_ends": ends})
        .withColumns(
            {
                "row_idx": F.col("_row") + F.coalesce(F.count_if("_ends").over(before), F.lit(0)),
                "_passed": passed,
            }
        )
        # commas up to the end of the line before
        .withColumn("_base", F.max(F.when(F.col("_ends"), F.col("_passed"))).over(before))
    )
    return cut.select(
        "athlete_id",
        "block",
        F.col("row_idx").cast("long").alias("row_idx"),
        (F.col("_passed") - F.coalesce("_base", F.lit(0))).cast("int").alias("col_idx"),
        F.nullif(_unquoted(F.col("_value")), F.lit("")).alias("value"),
    ).filter(F.col("value").isNotNull())


def read_exploded_cells(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    schema: T.StructType = schemas.CELLS,
) -> DataFrame:
    """Grids already stored one cell per row; splittable, any number of sheets."""
    return spark.read.schema(schema).format(fmt).load(path)


def coerce_meets(
    raw: DataFrame, weights: Sequence[str] = schemas.MEET_WEIGHTS
) -> DataFrame:
    """All-string meet rows to typed ones; what does not parse becomes null."""
    numeric = [c for c in (*weights, *schemas.MEET_SCORES) if c in raw.columns]
    # a cast alone would also take type suffixes such as 100d
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    casts = {
        c: F.when(F.col(c).rlike(number), F.col(c).try_cast("double")) for c in numeric
    }
    casts["Date"] = parse_date_multi(F.col("Date"))
    return nan_to_null(raw.withColumns(casts))


def read_meets(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Meet results CSV; every column is read as text and then coerced.

    ``columns`` is the header of the file in order; without it the header line
    decides.
    """
    reader = spark.read.option("header", True)
    if columns is not None:
        reader = reader.schema(
            T.StructType([T.StructField(c, T.StringType()) for c in columns])
        )
    return coerce_meets(reader.csv(path))
