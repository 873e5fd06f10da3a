"""From raw documents to token ids: toxic documents go, repeated lines go, one of each near-duplicate group stays, sources
are mixed to their weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``documents``; ``n_chars`` follows the text. A document whose lines are all copies of others is dropped by line dedup;
a document that came in empty stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.llm import bpe, lines, mixing, simhash, toxicity
from codelode.llm.queries import tokenizer_file
from codelode.session import configure, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return toxicity.reject_toxic(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    found = lines.dedup_lines(docs, carry=("lang", "source", "n_chars"))
    changed = F.col("n_kept") < F.col("n_lines")
    found = found.where(~changed | (F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) != ""))
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    kept = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.take_mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return bpe.encode_documents(docs, tokenizer_file(), keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: SQL can't express the learned toxicity score, XXH64 fingerprints or BPE; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
