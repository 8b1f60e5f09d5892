"""Exact length histogram of encoded documents.

Documents are encoded, and counted by their exact length in tokens with a map-side combine, so one
row for each length and task is shuffled. Suffix sums over the lengths then answer, for every
context limit, how many documents and tokens fit whole, are cut and are lost. The histogram has at
most as many rows as the longest document has tokens; only it, never the documents, passes through
the ordered window.

Edge cases: null and empty texts have length 0; repeated rows count each time; an empty table gives
an empty histogram, for which totals are 0 and quantiles null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_encoder, default_path
from .common import map_rows


def lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, length``: the number of ids of every row's whole text."""

    def run(ids, texts):
        enc = byte_encoder(path)
        return {"doc_id": ids, "length": [len(enc.encode(t)) // 4 for t in texts]}

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), "doc_id long, length long", run)


def histogram(counted: DataFrame) -> DataFrame:
    """``length, n_docs``, exact."""
    return counted.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(hist: DataFrame) -> DataFrame:
    """For each length as context limit: documents and tokens of just that length, documents that
    are longer, tokens kept when longer ones are cut there, tokens lost, and the share of documents
    that fit whole."""
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("length") * F.col("n_docs")
    x = hist.select(
        "length", "n_docs", tokens.alias("n_tokens"),
        F.coalesce(F.sum("n_docs").over(after), F.lit(0)).cast("long").alias("docs_longer"),
        F.coalesce(F.sum(tokens).over(after), F.lit(0)).cast("long").alias("tokens_longer"),
        F.sum("n_docs").over(up).cast("long").alias("docs_whole"),
        F.sum(tokens).over(up).cast("long").alias("tokens_whole"),
    )
    kept = F.col("tokens_whole") + F.col("length") * F.col("docs_longer")
    return x.select(
        F.col("length").alias("context_limit"), "n_docs", "n_tokens", "docs_whole", "docs_longer", kept.alias("tokens_kept"),
        (F.col("tokens_longer") - F.col("length") * F.col("docs_longer")).alias("tokens_lost"),
        (F.col("docs_whole") / (F.col("docs_whole") + F.col("docs_longer"))).alias("share_whole"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row ``total``: tokens left when every document is cut at ``limit``."""
    return hist.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).cast("long").alias("total"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """One row ``length``: the smallest context limit at which at least the share ``q`` fits whole."""
    return table.filter(F.col("share_whole") >= q).agg(F.min("context_limit").alias("length"))


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return context_table(histogram(lengths(docs, default_path("byte_bpe_50k.json"))))
