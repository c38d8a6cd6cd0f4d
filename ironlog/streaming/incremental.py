"""Ingest of newly dropped grids only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ironlog.operators.normalize import SHEET
from ironlog.plans.ingest import RAW, VALIDATED, ingest_grids
from ironlog.sources import schemas

#: Which sheets a batch holds; written last, it makes the batch visible.
RECORD = "workout_log_sheets_"
_BATCH = "batch="


def incremental_ingest(
    spark: SparkSession,
    drop_dir: str,
    out_dir: str,
    checkpoint: str,
    fmt: str = "parquet",
    apply_validation: bool = True,
    schema: StructType = schemas.CELLS,
    sheet: Sequence[str] = SHEET,
) -> StreamingQuery:
    """Start ingesting every grid file not seen by an earlier run, then stop.

    The checkpoint is the memory of the last sync.  All files present at the start form
    one batch, and a sheet must be whole within its batch.  A sheet that arrives again, in
    a later batch, is a corrected version: ``read_ingested`` returns the newest one only.

    A batch writes to folders named by its number and overwrites them, so that a batch
    repeated after a failure leaves one copy.  Last it writes the record of its sheets;
    without that, readers see neither its raw nor its validated table.
    """

    def load(batch: DataFrame, number: int) -> None:
        ingest_grids(
            batch,
            out_dir,
            run=f"{_BATCH}{number:08d}",
            apply_validation=apply_validation,
            sheet=sheet,
            mode="overwrite",
        )
        record = batch.select(*sheet).distinct()
        record.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{RECORD}{_BATCH}{number:08d}")

    source = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        source = source.option("header", True)
    return (
        source.load(drop_dir)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(
    spark: SparkSession,
    out_dir: str,
    validated: bool = True,
    sheet: Sequence[str] = SHEET,
) -> DataFrame:
    """The newest version of every sheet, from all batches that are complete.

    The records have one row per sheet and batch; log rows meet them by equality, so a
    corrected sheet hides all rows of older versions, even if it has no valid row itself.
    """
    base = out_dir.rstrip("/")

    def batches(prefix: str, files: str) -> DataFrame:
        rows = spark.read.option("basePath", base).parquet(f"{base}/{prefix}{_BATCH}*/{files}")
        return rows.withColumnRenamed(f"{prefix}batch", "_batch")

    newest = batches(RECORD, "*.parquet").groupBy(*sheet).agg(F.max("_batch").alias("_batch"))
    names = ["Block" if c == "block" else c for c in sheet]
    newest = newest.select(*(F.col(c).alias(f"_of_{n}") for c, n in zip(sheet, names, strict=True)), F.col("_batch").alias("_newest"))
    log = batches(VALIDATED if validated else RAW, "*/*.parquet")
    same = [log[n].eqNullSafe(newest[f"_of_{n}"]) for n in names]
    on = log["_batch"] == newest["_newest"]
    for part in same:
        on = on & part
    return log.join(newest, on, "left_semi").drop("_batch")
