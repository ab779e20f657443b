"""Snapshots of node tables: written whole, then named by a manifest row; read back through gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMA = "1.0"


def version_gate(version: Column, major: int = 1) -> Column:
    """accepted, unsupported or invalid, of a MAJOR.MINOR text."""
    good = F.coalesce(version.rlike(r"^\d+\.\d+$"), F.lit(False))
    return F.when(~good, "invalid").when(F.split(version, r"\.")[0].cast("int") > major, "unsupported").otherwise("accepted")


def publish(df: DataFrame, path: str, version: int) -> None:
    """Writes df with a digest of each row's text, then the manifest: readers only see versions that it names."""
    df.withColumn("sha256", F.sha2("text", 256)).withColumn("schema_version", F.lit(SCHEMA)).write.parquet(f"{path}/data/version={version}")
    df.sparkSession.createDataFrame([(version, SCHEMA)], "version int, schema_version string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The latest version's rows that pass schema and digest, and the others with a reason."""
    last = spark.read.parquet(f"{path}/manifest").agg(F.max("version").alias("v")).first().v
    rows = spark.read.parquet(f"{path}/data/version={last}")
    reason = F.when(version_gate(F.col("schema_version")) != "accepted", "SCHEMA").when(F.col("sha256") != F.sha2("text", 256), "CHECKSUM")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")
