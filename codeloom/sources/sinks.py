"""Sinks: referential filters, incremental writes, upserts, precedence, log lines.

Tables are immutable Parquet folders. A write goes to a new version folder that readers switch to, so a
reader never sees half a write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def known_refs(refs: DataFrame, symbols: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """References whose target is known and whose enclosing symbol (one of ``scopes``, if given) is known or
    missing; empty enclosing ids and contexts become null."""
    ids = symbols.select("id")
    inside = ids if scopes is None else scopes.select("id")
    x = refs.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("enclosing_id", "ast_ctx")})
    x = x.join(ids.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_semi")
    bare = x.filter("enclosing_id is null")
    held = x.filter("enclosing_id is not null").join(inside.withColumnRenamed("id", "enclosing_id"), "enclosing_id", "left_semi")
    return held.select(refs.columns).unionByName(bare.select(refs.columns))


def known_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with both ends known."""
    for end in ("caller_id", "callee_id"):
        edges = edges.join(symbols.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in their place; the keys of ``new`` are unique."""
    return old.join(new.select(*key), key, "left_anti").select(new.columns).unionByName(new)


def replace_files(old: DataFrame, new: DataFrame, gone: DataFrame, path: str = "file_path") -> DataFrame:
    """``old`` without the rows of changed or deleted files, with the new rows."""
    hit = gone.select(F.col("path").alias(path)).unionByName(new.select(path)).distinct()
    return old.join(hit, path, "left_anti").select(new.columns).unionByName(new)


def with_orphans_swept(refs: DataFrame, edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    return known_refs(refs, symbols), known_edges(edges, symbols)


def orphan_count(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    return refs.join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))


def preserved(children: DataFrame, symbols: DataFrame, key: str = "symbol_id") -> DataFrame:
    """Embeddings or purposes whose symbol survives a rewrite."""
    return children.join(symbols.select(F.col("id").alias(key)), key, "left_semi")


def by_precedence(rows: DataFrame, key: list[str], source: str, order: list[str]) -> DataFrame:
    """One row for each key, from the source that comes first in the order."""
    place = F.lit(len(order))
    for k in reversed(range(len(order))):
        place = F.when(F.col(source) == order[k], k).otherwise(place)
    return rows.withColumn("_p", place).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_p", source))).filter("_n = 1").drop("_p", "_n")


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Writes a new version folder below ``root`` and gives its path."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def append_log(df: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    df.write.mode("append").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """One column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def bundle_hash(files: DataFrame) -> DataFrame:
    """One row: a hash over the hashes of ``(path, hash)``, by path."""
    each = files.select(F.sha2(F.concat_ws(":", "path", "hash"), 256).alias("h"))
    # hashes add up in any order, so no task holds all paths
    word = lambda k: F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    return each.agg(*(F.coalesce(F.sum(word(k)), F.lit(0)).cast("string").alias(f"w{k}") for k in range(8))).select(F.sha2(F.concat_ws(":", *(f"w{k}" for k in range(8))), 256).alias("bundle"))


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two schema versions in one; missing columns are null."""
    return old.unionByName(new, allowMissingColumns=True)


def as_yaml(df: DataFrame) -> DataFrame:
    """One column ``yaml``: each row as an item of a list, a line for each column that is not null. Values are written
    as JSON, which YAML reads."""
    line = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.expr(f"regexp_extract(to_json(named_struct('v', `{c}`)), '(?s)^.\"v\":(.*).$', 1)")))
    return df.select(F.concat(F.lit("- "), F.array_join(F.array_compact(F.array(*(line(c) for c in df.columns))), "\n  ")).alias("yaml"))


def as_text(df: DataFrame, separator: str = "\t") -> DataFrame:
    """One column ``text``: the columns of each row, nulls as empty; separators and line feeds inside become spaces."""
    plain = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), f"[{separator}\n]", " ") for c in df.columns]
    return df.select(F.concat_ws(separator, *plain).alias("text"))
