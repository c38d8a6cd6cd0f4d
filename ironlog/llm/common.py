"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is ``spark.checkpoint.dir``.  Without that setting a temporary folder is used under a local
    master, where driver and executors are one process; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.ironlog.shared.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='ironlog-')}"
    spark.conf.set("spark.ironlog.shared.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{os.getpid()}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` has written and that nothing reads any more: their successors are written."""
    for df in tables:
        _remove(df.sparkSession, df._stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended; whoever owns the folder clears it
        return


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; whatever else the table holds is left behind before any work."""
    return df.select(*(df[n] for n in names))


#: Bytes of a batch that Python works on at a time: objects made from texts take many times the texts' own length.
SLICE = 1 << 19


def slices(batches: Iterator[pa.RecordBatch], at_most: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``at_most`` rows and about SLICE bytes; a larger row is never cut."""
    for batch in batches:
        step = min(at_most, max(1, batch.num_rows * SLICE // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
