"""A training corpus from ``documents``: quality rules, near duplicates, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), with ``docs`` what the
stage before it kept, and all but the last return the columns of ``documents``. ``run`` writes each
result as Parquet in the shared folder and rereads it, so a lost executor costs a stage at most.

* quality: documents that the base rules or the line field reject go.
* near_duplicates: of each group of documents that share 0.8 or more of their five-word shingles,
  directly or over others, the one with the smallest id stays; rows without an id stay. A document is
  an id with a text: two texts under one id stay or go on their own.
* secrets: every span of a secret is replaced by a mask; ``n_chars`` follows.
* packing: the pieces of all documents, packed into sequences of 4096 tokens.

Null and empty texts fail the quality rules. Empty tables give empty results. Columns of
``documents`` beyond id and text pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.bpe import default_path
from codeloom.llm.common import discard, stash
from codeloom.llm.op5_packing import pack_documents
from codeloom.llm.op7_secrets import redact
from codeloom.llm.op8_quality import fit_field, keep_good
from codeloom.llm.op9_minhash import without_near_duplicates as first_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", without_near_duplicates), ("secrets", without_secrets), ("packing", packed)]

#: Encoding and line labelling cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
