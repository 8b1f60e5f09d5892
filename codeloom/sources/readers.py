"""Sources: code-index tables, files, text lines, event logs, commit logs, diffs, rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.literals import literal_rows
from codeloom.schemas import schema


def index_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A code-index table, by its fixed schema, so no file is read to infer it."""
    return spark.read.schema(schema(table)).parquet(f"{root}/{table}")


def file_snapshot(spark: SparkSession, root: str, glob: str = "*.go", exclude: tuple[str, ...] = ("vendor", "testdata", "node_modules")) -> DataFrame:
    """``path, mtime, hash, lines, header`` of the files of a tree; hidden and excluded directories are
    skipped. An unterminated last line counts; the header is the leading comment, at most 200 characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    text = F.decode("content", "UTF-8")
    n = F.regexp_count(text, F.lit("\n")) + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)
    header = F.regexp_replace(F.regexp_extract(text, r"\A((?://[^\n]*\n?)+)", 1), r"(?m)^//\s?", "")
    return raw.filter(~F.substring_index("path", root.rstrip("/"), -1).rlike(_skipped(exclude))).select(
        "path", F.unix_timestamp("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), n.cast("int").alias("lines"), F.substring(F.trim(F.regexp_replace(header, r"\s+", " ")), 1, 200).alias("header"),
    )


def _skipped(exclude: tuple[str, ...]) -> str:
    return "/(" + "|".join([r"\.[^/]*", *(re.escape(e) for e in exclude)]) + ")/"


def walked(paths: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    """Rows whose ``path``, relative to its root, is in no hidden and no excluded directory."""
    return paths.filter(~F.concat(F.lit("/"), "path").rlike(_skipped(exclude)))


def text_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, line_no, line`` of text files."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", F.posexplode(F.split("value", "\n")).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")


def event_log(spark: SparkSession, path: str, table: str = "usage") -> DataFrame:
    """An append-only log of JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema(table)).option("mode", "DROPMALFORMED").json(path)


def log_rows(lines: DataFrame, line: str, ddl: str) -> DataFrame:
    """``lines`` with the fields of the JSON object of each; malformed lines are skipped."""
    x = lines.withColumn("_row", F.from_json(line, f"{ddl}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return x.filter("_row is not null and _row._bad is null").select(*lines.columns, "_row.*").drop("_bad")


def commit_files(log: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``commit, author, at, types, path`` from log lines ``(n, line)``: headers ``commit|author|time|types``
    begin with ``@``, each other line is a path of the commit before it. The commit is carried along
    within each log ``log_id``, so logs are independent."""
    w = Window.partitionBy("log_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").startswith("@"), F.col("line"))
    x = log.withColumn("_head", F.last(head, ignorenulls=True).over(w)).filter((F.trim("line") != "") & ~F.col("line").startswith("@") & F.col("_head").isNotNull())
    part = F.split(F.substring("_head", 2, 1 << 20), r"\|")
    types = F.filter(F.split(F.coalesce(F.get(part, 3), F.lit("")), ","), lambda t: t != "")
    return x.select(*(keep or []), part[0].alias("commit"), part[1].alias("author"), F.get(part, 2).try_cast("timestamp").alias("at"), types.alias("types"), F.col("line").alias("path"))


def diff_ranges(diff: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``path, line_start, line_end`` of the head side from lines ``(diff_id, n, line)`` of a diff
    without context; pure deletions give nothing."""
    w = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.+?)\s*$", 1))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    x = diff.withColumn("path", F.last(named, ignorenulls=True).over(w)).filter(F.col("line").rlike(hunk) & (F.col("path") != "/dev/null"))
    start, size = F.regexp_extract("line", hunk, 1).cast("int"), F.regexp_extract("line", hunk, 2)
    n = F.when(size == "", 1).otherwise(size.try_cast("int"))
    own = keep or []
    return x.select(*own, "path", start.alias("line_start"), n.alias("n")).filter("n > 0").select(*own, "path", "line_start", (F.col("line_start") + F.col("n") - 1).cast("int").alias("line_end"))


def working_tree_changes(ranges: DataFrame, untracked: DataFrame) -> DataFrame:
    """Changed ranges, and untracked files ``(path, lines)`` as whole-file ranges."""
    return ranges.unionByName(untracked.select("path", F.lit(1).alias("line_start"), F.col("lines").cast("int").alias("line_end")))


def changed_lines(numstat: DataFrame) -> DataFrame:
    """One row ``added, deleted`` over rows ``(added, deleted, path)`` of text; binary marks count as 0,
    tests are left out."""
    x = numstat.filter(~F.col("path").endswith("_test.go"))
    zero = F.lit(0).cast("long")
    return x.agg(F.coalesce(F.sum(F.col("added").try_cast("long")), zero).alias("added"), F.coalesce(F.sum(F.col("deleted").try_cast("long")), zero).alias("deleted"))


def ddl_statements(files: DataFrame) -> DataFrame:
    """``path, kind, name`` of the tables, indexes, views and triggers that texts ``(path, text)`` create."""
    pattern = r"(?i)\bcreate\s+(table|index|unique\s+index|view|trigger)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([A-Za-z_][A-Za-z0-9_.]*)"
    part = lambda k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))
    x = files.select("path", F.explode(F.arrays_zip(part(1).alias("kind"), part(2).alias("name"))).alias("s"))
    return x.select("path", F.regexp_replace(F.lower("s.kind"), r"\s+", " ").alias("kind"), "s.name").distinct()


def literals(lines: DataFrame) -> DataFrame:
    """``path, line_no, kind, value`` of literals in lines: environment reads, then named string constants,
    then fixture paths; the first rule that matches a value claims it."""
    env = F.regexp_extract("line", r'(?:Getenv|LookupEnv)\("([^"]+)"\)', 1)
    const = F.regexp_extract("line", r'^\s*(?:const\s+)?[A-Z][A-Za-z0-9_]*\s*(?:string\s*)?=\s*"([^"]+)"', 1)
    fixture = F.regexp_extract("line", r'"([^"]*(?:testdata/|\.golden)[^"]*)"', 1)
    kind = F.when(env != "", "env").when(const != "", "const").when(fixture != "", "fixture")
    value = F.when(env != "", env).when(const != "", const).otherwise(fixture)
    return lines.select("path", "line_no", kind.alias("kind"), value.alias("value")).filter("kind is not null")


def rules(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Boundary rules ``rule, from_grp, to_grp`` from a parsed manifest, a short list."""
    return literal_rows(spark, rows, "rule string, from_grp string, to_grp string")


def manifest_rules(files: DataFrame) -> DataFrame:
    """``path, place, rule, from_grp, to_grp, kinds, allow, include_tests`` of the items of the list ``rules`` in YAML manifests
    ``(path, text)``: plain and quoted values, lists in brackets or in lines of their own, comments from a ``#`` that stands
    alone. Items without both ends stay out; places count from 1; a manifest without rules, or null, has none."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", ""), r"(?m)(^|[ \t])#[^\n]*", "")
    section = F.regexp_extract(text, r"(?ms)^rules:[ \t]*\n(.*?)(?=^[^\s-]|\z)", 1)
    items = F.slice(F.split(section, r"(?m)^[ \t]*-[ \t]+(?=\w+:)"), 2, 1 << 30)
    item = F.col("item")
    bare = lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2")
    value = lambda key: bare(F.regexp_extract(item, rf"(?m)^[ \t]*{key}:[ \t]*([^\n\[]*)$", 1))

    def values(key: str) -> Column:
        row = F.split(F.regexp_extract(item, rf"(?m)^[ \t]*{key}:[ \t]*\[([^\]]*)\]", 1), ",")
        lines = F.regexp_extract_all(F.regexp_extract(item, rf"(?m)^[ \t]*{key}:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|\z))*)", 1), F.lit(r"(?m)^[ \t]*-[ \t]*([^\n]*)$"), 1)
        return F.filter(F.transform(F.concat(row, lines), bare), lambda x: x != "")

    x = files.select("path", F.posexplode(items).alias("place", "item"))
    x = x.select("path", (F.col("place") + 1).alias("place"), value("name").alias("rule"), value("from").alias("from_grp"), value("to").alias("to_grp"), values("kinds").alias("kinds"), values("allow").alias("allow"), (value("include_tests") == "true").alias("include_tests"))
    return x.filter("from_grp <> '' and to_grp <> ''")
