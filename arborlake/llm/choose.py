"""Applying decisions about rows to the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import keep

NO_ID = -1 << 63


def _keys(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.col("tkey").alias("_t"))


def keep_chosen(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose (doc_id, tkey) is in chosen, whole and with all their columns, whatever their names.

    tkey is xxhash64 of the text, null as empty; null ids match null ids. Of rows
    alike in both, all stay, but of those in `once` any one. An empty table on
    either side gives an empty result.
    """
    plain = docs.select([F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = plain.withColumn("_t", F.xxhash64(F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")))).withColumn("_d", F.coalesce(F.col(at[id_col]).cast("long"), F.lit(NO_ID)))
    cols = list(at.values())
    met = plain.join(_keys(chosen), ["_d", "_t"], "left_semi")
    if once is not None:
        # Few rows are repeated, and most tables have none: texts are only grouped where they are.
        twice = plain.groupBy("_d", "_t").agg(F.count("*").alias("_n")).where("_n > 1").select("_d", "_t")
        twice = keep(twice.join(_keys(once), ["_d", "_t"], "left_semi"), "repeated-rows")
        if not twice.isEmpty():
            one = met.join(twice, ["_d", "_t"], "left_semi").groupBy("_d", "_t").agg(F.first(F.struct(*cols)).alias("_r")).select("_r.*")
            met = met.join(twice, ["_d", "_t"], "left_anti").select(cols).unionByName(one)
    return met.select([F.col(at[c]).alias(c) for c in docs.columns])
