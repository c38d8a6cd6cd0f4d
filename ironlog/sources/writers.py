"""Sinks for normalised, cleaned and annotated tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Suffix of each kind of output.
SUFFIX = {"normalized": "_normalized", "clean": "_clean", "1rm": "_with_1rm"}


def output_path(base: str, kind: str) -> str:
    """Default output location next to ``base``."""
    stem = base[: -len(".csv")] if base.endswith(".csv") else base.rstrip("/")
    return stem + SUFFIX[kind]


def write_log(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = ("Lift_Type",),
) -> str:
    """Write a log table, by default partitioned so that lift filters prune."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # empty text is written as nothing and therefore read back as missing
        writer = writer.option("header", True).option("emptyValue", "")
    writer.format(fmt).save(path)
    return path
