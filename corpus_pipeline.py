"""Training-data pipeline: quality rules, near-dedup, decontamination, pseudonyms, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and gives it, read again, to the
next one.  All but the last stage return the columns of their input documents,
whatever their names (those that begin with two underscores are reserved).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm import bpe, decontaminate, near_dedup, pii, quality
from carrisk.llm.common import ship, table, written

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that no rule rejects (null and empty texts go)."""
    ship(spark)
    judged = quality.apply_rules(docs, keep=docs.columns, with_base=False, kept_col="__kept", failed_col="__failed")
    return judged.where("__kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies: the one with the least id.

    Rows of one id and different texts are documents of their own, in the order of the texts' hashes;
    rows of one id and text are one document; rows with a null id stay, as no class can name them.
    """
    ship(spark)
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")))
    keyed = docs.withColumn("__key", key)
    classes = near_dedup.near_duplicates(keyed.select("__key", "text"), id_col="__key")
    kept = classes.where("__key is not null and class_id = __key").select("__key").distinct()
    first = keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"])
    return first.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no item of the benchmark.

    A text is judged by itself, under its digest: rows of one id, or without an id, go or stay each by their text.
    """
    ship(spark)
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    found = decontaminate.contaminated(docs.select(digest.alias("__digest"), "text"), table(spark, sf_dir, "benchmark"), id_col="__digest")
    return docs.join(found.select(F.col("__digest").alias("__found")).distinct(), digest == F.col("__found"), "left_anti")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text with its personal numbers, dates and addresses replaced."""
    ship(spark)
    return pii.pseudonymise(docs, pii.session_key(spark), found_col="__found").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding: (doc_id, n_tokens, token_ids, decoded_sha256)."""
    ship(spark)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = bpe.round_trip(texts, public_tokenizers.path(VOCABULARY))
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_sha256")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated),
          ("pseudonyms", pseudonyms), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: No SQL: near-dedup, latent retrieval and BPE are not expressible; tests hold the rows against plain versions.
ORACLE_SQL = None
