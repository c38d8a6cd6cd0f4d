"""Grid to validated log in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ironlog.operators.normalize import SHEET, normalize
from ironlog.operators.quality import clean_dataset
from ironlog.sources.writers import write_log

RAW, VALIDATED = "workout_log_normalized_", "workout_log_validated_"


def ingest_grids(
    cells: DataFrame,
    out_dir: str,
    run: str,
    apply_validation: bool = True,
    output_suffix: str = "",
    sheet: Sequence[str] = SHEET,
    mode: str = "errorifexists",
) -> dict[str, str | int]:
    """Normalise, save raw, optionally validate and save; paths and row count.

    ``run`` stamps the output names.  The validated table is built from the
    saved raw one, so the grid is parsed once, and the counts ride along with
    the writes.
    """
    spark: SparkSession = cells.sparkSession
    raw_path = f"{out_dir.rstrip('/')}/{RAW}{run}{output_suffix}"
    seen = Observation("raw")
    raw = normalize(cells, sheet).observe(seen, F.count(F.lit(1)).alias("entries"))
    write_log(raw, raw_path, mode=mode)
    if not apply_validation:
        return {"raw": raw_path, "entries": seen.get["entries"]}

    validated_path = f"{out_dir.rstrip('/')}/{VALIDATED}{run}{output_suffix}"
    kept = Observation("validated")
    saved = spark.read.schema(raw.schema).parquet(raw_path)
    valid = clean_dataset(saved, remove_suspicious=True)
    valid = valid.observe(kept, F.count(F.lit(1)).alias("entries"))
    write_log(valid, validated_path, mode=mode)
    return {
        "raw": raw_path,
        "validated": validated_path,
        "entries": kept.get["entries"],
    }
