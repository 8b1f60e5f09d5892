"""Search and extraction over source text: hits with their place and context, schemas, references to goroutines and channels.

Lines are rows ``(path, line, text)``, files rows ``(root, path, text)``; each operator works on many
trees at once. Matching is by expressions inside the scan's stage; only context lines and scopes shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import code_text as T
from codeloom.operators.relations import overlapping

#: Folders that a search passes over.
SEARCH_EXCLUDES = ["vendor", "node_modules", ".git", "testdata"]
#: Where schemas are looked for, in this order.
MIGRATIONS = ["migrations", "db/migrations", "sql/migrations"]
SCHEMAS = ["schema.sql", "db/schema.sql", "sql/schema.sql"]
#: Statements that make a text a schema.
DDL = r"(?i)\bCREATE\s+(TABLE|INDEX|UNIQUE\s+INDEX|VIEW|TRIGGER)\b"


def search(lines: DataFrame, pattern: str, globs: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """``path, line, col, end_col, name, match``: a row for each match on each line of the selected paths; columns
    count bytes from 1, ``match`` is the line without spaces around. Paths in excluded folders stay out, others
    go by ``globs`` (all without any). A null text has no match."""
    chosen = T.selected(F.col("path"), ["!" + e for e in (SEARCH_EXCLUDES if excludes is None else excludes)])
    if globs:
        chosen = chosen & T.selected(F.col("path"), globs)
    x = lines.filter(chosen & F.col("text").rlike(pattern)).select("path", "line", "text", F.explode(T.matches(F.col("text"), pattern)).alias("m"))
    col = F.octet_length(F.substring(F.col("text"), F.lit(1), F.col("m.start") - 1)) + 1
    return x.select("path", "line", col.alias("col"), (col + F.octet_length("m.name")).alias("end_col"), F.col("m.name").alias("name"), F.trim("text").alias("match"))


def with_context(lines: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """``path, block, line, text, is_match``: the lines of hits with ``n`` lines before and after, each line once;
    hits whose contexts touch share a block, named by its first line."""
    spots = hits.select("path", "line").distinct()
    around = spots.select("path", F.col("line").alias("at"), F.explode(F.sequence(F.col("line") - n, F.col("line") + n)).alias("line"))
    near = around.groupBy("path", "line").agg(F.bool_or(F.col("line") == F.col("at")).alias("is_match"))
    x = lines.join(near, ["path", "line"])
    place = Window.partitionBy("path").orderBy("line")
    begins = F.coalesce(F.col("line") - F.lag("line").over(place) > 1, F.lit(True))
    block = F.last(F.when(F.col("begins"), F.col("line")), ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("begins", begins).select("path", block.alias("block"), "line", "text", "is_match")


def schemas(files: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """``root, source, name, ddl``: the schemas of each tree. The first migrations folder whose files hold a
    statement gives one, its files joined by name; only without one does the first schema file; and every
    source file outside of tests gives one with the raw strings that hold statements."""
    kept = files.filter(F.col("text").isNotNull() & T.selected(F.col("path"), [f"!{s}" for s in skip or SEARCH_EXCLUDES]))
    base = F.element_at(F.split("path", "/"), -1)
    rank = lambda names, value: F.coalesce(*(F.when(value == v, k) for k, v in enumerate(names)))

    folder = F.regexp_extract("path", "^(.*)/[^/]+$", 1)
    sql = kept.filter(F.lower("path").endswith(".sql")).withColumn("r", rank(MIGRATIONS, folder)).filter("r is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(base.alias("b"), F.col("text").alias("t")))), lambda x: F.concat(F.lit("-- "), x["b"], F.lit("\n"), x["t"])), "\n\n")
    moves = sql.groupBy("root", "r", folder.alias("source")).agg(joined.alias("ddl")).filter(F.col("ddl").rlike(DDL))
    first = lambda x: x.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("r"))).filter("n = 1")
    moves = first(moves).select("root", "source", F.lit("migrations").alias("name"), "ddl")

    whole = kept.withColumn("r", rank(SCHEMAS, F.col("path"))).filter(F.col("r").isNotNull() & F.col("text").rlike(DDL))
    tops = first(whole).join(moves.select("root"), "root", "left_anti").select("root", F.col("path").alias("source"), F.lit("schema").alias("name"), F.col("text").alias("ddl"))

    inside = F.filter(T.raw_strings(F.col("text")), lambda x: x.rlike(DDL))
    code = kept.filter(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go") & F.col("text").rlike(DDL)).withColumn("parts", inside).filter(F.size("parts") > 0)
    parent = F.when(F.col("path").contains("/"), F.element_at(F.split("path", "/"), -2)).otherwise(".")
    embedded = code.select("root", F.col("path").alias("source"), parent.alias("name"), F.array_join("parts", "\n\n").alias("ddl"))
    return moves.unionByName(tops).unionByName(embedded)


#: A goroutine's start, and a send or receive; channel types are none.
_GO, _ARROW = r"\bgo\b(?=\s+[\p{L}_(])", r"(?<!\bchan)(?<!\bchan )<-(?!\s*chan\b)"


def concurrency_refs(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """``id, symbol_id, file_path, line, col, enclosing_id, snippet, ast_ctx``: a reference of a function to itself for
    each goroutine that it starts (``go``) and each send and receive (``chan``), in the smallest function or
    method around the line; those outside of any stay out. Comments and strings that end on their line are
    passed over. Columns count code points from 1."""
    code = lines.withColumn("code", T.blanked(F.col("text")))
    found = lambda ctx, kind, pattern: F.transform(T.matches(F.col("code"), pattern), lambda m: F.struct(m["start"].alias("col"), F.lit(ctx).alias("ast_ctx"), F.lit(kind).alias("kind")))
    x = code.filter(F.col("code").rlike(f"{_GO}|{_ARROW}")).select(F.col("path").alias("file_path"), "line", F.trim("text").alias("snippet"), F.explode(F.concat(found("go", "goref", _GO), found("chan", "chanref", _ARROW))).alias("m"))
    x = x.select("file_path", "line", "snippet", "m.*")
    spots = x.select("file_path", "line").distinct()
    scopes = symbols.filter(F.col("kind").isin("func", "method")).select("file_path", F.col("id").alias("enclosing_id"), "line_start", "line_end")
    around = overlapping(spots.withColumn("to", F.col("line")), scopes, ["file_path"], ("line", "to"), ("line_start", "line_end"), width=64)
    size = F.col("line_end") - F.col("line_start")
    near = around.groupBy("file_path", "line").agg(F.min_by("enclosing_id", F.struct(size, "line_start", "enclosing_id")).alias("enclosing_id"))
    y = x.join(near, ["file_path", "line"])
    return y.select(F.sha2(F.concat_ws(":", "file_path", "line", "col", "kind"), 256).alias("id"), F.col("enclosing_id").alias("symbol_id"), "file_path", "line", "col", "enclosing_id", "snippet", "ast_ctx")
