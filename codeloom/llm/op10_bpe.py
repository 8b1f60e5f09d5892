"""BPE encoding and decoding by forced-boundary splitting.

Byte pairs that occur inside no vocabulary token mark certain cuts; the fragments between them are
encoded independently, each distinct one once per worker, and their ids concatenated
(:mod:`codeloom.llm.bpe`). A map over rows without any shuffle: time and memory do not depend on
how rows are spread, and a lost executor costs its running tasks alone.

Edge cases: null text counts as empty and gives no ids and an empty decoded text; repeated rows and
null ids give a row each; columns other than the two named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_encoder, default_path
from .common import map_rows


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids array<int>`` of every row."""

    def run(ids, texts):
        enc = byte_encoder(path)
        got = [enc.encode(t) for t in texts]
        sizes = [len(x) // 4 for x in got]
        flat = pa.array(np.frombuffer(b"".join(got), dtype="<i4"))
        return {"doc_id": ids, "n_tokens": sizes, "ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)}

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), "doc_id long, n_tokens long, ids array<int>", run)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded`` of rows ``doc_id, ids``; null ids decode to the empty text."""

    def run(ids, lists):
        enc = byte_encoder(path)
        return {"doc_id": ids, "decoded": [enc.decode(np.asarray(x or [], dtype="<u4").tobytes()) for x in lists]}

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, decoded string", run)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_text, decoded``: the ids in decimal, joined by commas, and the text
    that they decode to, in one pass."""

    def run(ids, texts):
        enc = byte_encoder(path)
        got = [enc.encode(t) for t in texts]
        return {"doc_id": ids, "n_tokens": [len(x) // 4 for x in got], "ids_text": [enc.decimals(x).decode() for x in got], "decoded": [enc.decode(x) for x in got]}

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), "doc_id long, n_tokens long, ids_text string, decoded string", run, rows=200)


def op10_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
