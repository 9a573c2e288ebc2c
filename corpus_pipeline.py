"""A corpus pipeline: language ID, exact dedup, near dedup, decontamination, packing.

Each stage takes the documents that the one before it kept, applies one operator of blockloom.llm
to all of them and lets its decision take effect. A decision names documents by doc_id: rows without
one cannot be named and go in the first stage; rows that share one count as one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import language
from blockloom.llm.common import documents, folder_of, store, stored, sweep
from blockloom.llm.decontaminate import contamination
from blockloom.llm.exact_dedup import exact_dedup
from blockloom.llm.jaccard_join import jaccard_components
from blockloom.llm.packing import pack


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for the doc_ids in dropped. The ids are written first, so that their true size picks the join."""
    ids = store(dropped.select(F.col("doc_id").alias("dropped_id")).distinct(), "dropped")
    return docs.join(ids, docs["doc_id"] == ids["dropped_id"], "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null or empty text, or no letter in it) go, and rows without a doc_id.

    Texts are read whole, however long; rows that share a doc_id go together if one of them goes; other columns pass
    through. Empty table: empty result.
    """
    found = language.predict_language(docs, language.train(docs))
    return without(docs.filter("doc_id IS NOT NULL"), found.filter(F.col("lang_pred") == language.UNKNOWN))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, one document stays: the longest with them, then the smallest doc_id.

    Null and empty texts are equal. Of rows that share a doc_id of which one stays, the one with the longest text stays (of
    equally long ones the largest by text, then by the other columns in order). Empty table: empty result.
    """
    rows = store(exact_dedup(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "kept")
    repeated = rows.filter("kept AND n > 1")
    if not repeated.limit(1).count():
        return without(docs, rows.filter("NOT kept"))
    again = repeated.select(F.col("doc_id").alias("repeated_id"))
    own = docs.join(again, docs["doc_id"] == again["repeated_id"], "left_semi")
    best = F.max(F.struct(F.length("text").alias("points"), "text", F.struct(*docs.columns).alias("row"))).alias("best")
    once = own.groupBy("doc_id").agg(best).select("best.row.*")
    return without(docs, rows.filter("NOT kept OR n > 1")).union(once)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five words, 0.8) the one with the smallest doc_id stays.

    Texts without a word link to nothing and stay; other columns pass through. Empty table: empty result.
    """
    groups = jaccard_components(docs, words=5, percent=80)
    return without(docs, groups.filter("component_id <> doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none. Empty table: empty result."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.filter(F.size("spans") > 0))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, as pieces in sequences of at most 2048 tokens: the columns of packing.pack().

    Null and empty texts are an end token; a document of any length is cut into pieces. Empty table: empty result.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("best_fit_packing", pack_documents),
]

#: SQL can express neither a trained classifier nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rest of the documents. Once a stage's result is written, what it was made from is deleted."""
    docs, outside = documents(spark, sf_dir), stored()
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
        sweep(spark, outside | {folder_of(docs)})
    return docs
