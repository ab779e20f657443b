"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a fresh local one, which only a local master can share; elsewhere that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a shared folder")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-settle-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: columnar, with statistics, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def settled_columns(table: DataFrame, *names: str) -> DataFrame:
    """Some columns of a table made by settle(), read as a table of their own, which plans size by the whole file."""
    schema = StructType([table.schema[n] for n in names])
    return table.sparkSession.read.schema(schema).parquet(table._settled_at)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt to tasks so that equal values of `by` meet.

    By a hash of the columns: a repartition by the columns themselves is left out where both sides of a union are dealt
    by them already, though the sides may have been coalesced to different tasks since.
    """
    return rows.repartition(F.xxhash64(*by))


def unsettle(*tables: DataFrame) -> None:
    """Deletes tables made by settle() that no later plan reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
