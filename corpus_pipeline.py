"""From raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir); all but the last return the
columns of documents. Its decisions take effect on the rows that the next stage
reads: rejected documents, later copies and near copies go; the mix repeats or
leaves out whole documents by source; the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.llm.choose import keep_chosen
from arborlake.llm.exact_dedup import exact_duplicates
from arborlake.llm.mixing import mix_documents
from arborlake.llm.ngram_join import ngram_components
from arborlake.llm.packing import pack_documents
from arborlake.llm.quality import judge
from arborlake.llm.scratch import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    Null and empty texts are judged as texts of no words; repeated rows are judged alike and all stay or go;
    without labels of both classes all stay; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_chosen(docs, judge(docs, labels).where("kept"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of texts that are equal without white space: the longest, then the smallest id, null last.

    Null and empty texts are one group; of repeated rows one stays; an empty table stays empty.
    """
    chosen = keep(exact_duplicates(docs).where("kept").select("doc_id", "tkey"), "chosen")
    return keep_chosen(docs, chosen, once=chosen)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, of repeated rows one.

    Texts without words all stay, as they are no copies; so do rows of groups in which no row has an id. An
    empty table stays empty.
    """
    found = keep(ngram_components(docs).select("doc_id", "tkey", "n_shingles", "component_id"), "components")
    best = F.struct(F.col("doc_id").isNull(), "doc_id", "tkey")
    one = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(best).alias("best"))
    chosen = one.where("component_id is not null").select(F.col("best.doc_id").alias("doc_id"), F.col("best.tkey").alias("tkey"))
    rest = found.where("n_shingles = 0 or component_id is null").select("doc_id", "tkey")
    return keep_chosen(docs, chosen.unionByName(rest), once=chosen)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out whole documents by the schedule's slots, so that sources come near their target weights.

    Null sources are a source; documents without words stay once; an empty table stays empty.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of all documents into sequences.

    Null and empty texts are the end token alone; repeated rows are packed each; an empty table gives no pieces.
    """
    return pack_documents(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", near_dedup), ("source_mixing", mixing), ("best_fit_packing", packing)]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
