"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, exact_dedup, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op2_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).drop("tkey")


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op4_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).drop("tkey")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_verified_links")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("tkey")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import passages

    return passages(_table(spark, sf_dir, "documents"))


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dialogues import repair_conversations

    return repair_conversations(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_block_naming, op3_redirect_equivalence, op4_deletion_neighbourhood, op5_source_mixing, op6_ngram_jaccard_join, op7_quality_classifier, op8_best_fit_packing, op9_nearest_neighbours, op10_collinear_chaining, op11_licence_scan, op12_collocations, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op2_block_naming": exact_dedup.ORACLE, "op3_redirect_equivalence": urlfilter.ORACLE, "op12_collocations": collocations.ORACLE}
