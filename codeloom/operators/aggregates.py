"""Counts, rollups, churn, conventions, metric tables. Partial aggregation precedes each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.exprs import age_days, confidence, decay, log_share, saturating
from codeloom.lineage import cut
from codeloom.operators.ranks import numbered


def use_counts(items: DataFrame, uses: DataFrame, item_key: str, use_key: str, name: str = "n_uses") -> DataFrame:
    """Items with the count of their uses; unused ones have 0."""
    n = uses.groupBy(F.col(use_key).alias(item_key)).agg(F.count(F.lit(1)).alias(name))
    return items.join(n, item_key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def reference_counts(refs: DataFrame) -> DataFrame:
    """References of each symbol, without the synthetic ones of concurrency."""
    return refs.filter(~F.coalesce(F.col("ast_ctx").isin("go", "chan"), F.lit(False))).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_refs"))


def usage_rank(items: DataFrame, key: str, counts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Items ranked by the sum of several counts, each aggregated before its join."""
    out = items
    for name, df in counts:
        out = out.join(df.withColumnRenamed("n", name), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out.withColumn("usage", sum((F.col(n) for n, _ in counts), F.lit(0)).cast("long"))


def dependency_edges(links: DataFrame, src: str, dst: str, unit: str) -> DataFrame:
    """Edges between different groups with the number of distinct units that make them."""
    return links.filter(F.col(src) != F.col(dst)).groupBy(src, dst).agg(F.countDistinct(unit).alias("n_units"))


def fan_in(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct other sources of each target."""
    return edges.filter(F.col(src) != F.col(dst)).groupBy(dst).agg(F.countDistinct(src).alias("fan_in"))


def values_at_ranks(rows: DataFrame, group: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """``group..., rank, value``: the values at places ``ranks (group..., rank)``, from 0, of each group's
    values in rising order; nulls do not count. Equal values are counted as one row, which are dealt to ranges of
    (group, value), so neither a large group nor an outlier puts more than a range into a task; then
    ranges are counted, and those with a wanted place looked through."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    dealt = cut(counted.repartitionByRange(*group, value).withColumn("_b", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group, "_b").agg(F.sum("_c").alias("_n"))  # a row for each range and group in it
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before(Window.partitionBy(*group).orderBy("_b"))), F.lit(0)))
    hit = ranks.join(sizes, group).filter("rank >= _before and rank < _before + _n").select(*group, "rank", "_b", (F.col("rank") - F.col("_before")).alias("_k"))
    inside = dealt.join(hit.select(*group, "_b").distinct(), [*group, "_b"], "left_semi")
    inside = inside.withColumn("_below", F.coalesce(F.sum("_c").over(before(Window.partitionBy(*group, "_b").orderBy(value))), F.lit(0)))
    return hit.join(inside, [*group, "_b"]).filter("_k >= _below and _k < _below + _c").select(*group, "rank", value)


def rollup(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Sum, 95th percentile (linear interpolation) and maximum."""
    x = rows.groupBy(*group).agg(F.sum(value).alias("total"), F.max(value).alias("largest"), F.count(F.lit(1)).alias("n"), F.count(value).alias("_v"))
    at = 0.95 * (F.col("_v") - 1)
    ranks = x.filter("_v > 0").select(*group, F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
    found = values_at_ranks(rows, group, value, ranks).groupBy(*group).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    p95 = F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))
    return x.join(found, group, "left").select(*group, "total", p95.alias("p95"), "largest", "n")


def abstractness(rows: DataFrame, group: list[str], abstract: Column, counted: Column) -> DataFrame:
    """Share of abstract rows among the counted ones; groups without a counted row are left out."""
    x = rows.groupBy(*group).agg(F.sum(F.when(abstract & counted, 1).otherwise(0)).alias("n_abstract"), F.sum(F.when(counted, 1).otherwise(0)).alias("n_counted"))
    return x.filter("n_counted > 0").withColumn("abstractness", F.col("n_abstract") / F.col("n_counted"))


def distance(metrics: DataFrame) -> DataFrame:
    """Distance from the main sequence |A + I - 1|; a missing instability counts as 0."""
    d = F.abs(F.col("abstractness") + F.coalesce("instability", F.lit(0.0)) - 1)
    return metrics.withColumn("distance", d).withColumn("flagged", d > 0.7)


def churn(rows: DataFrame, path: str, at: str, author: str, kind: str, half_life_days: float, kinds: list[str]) -> DataFrame:
    """Per path: commits, authors, first and last date, decayed score, a count for each kind. Ages
    count from the latest time in the table."""
    last = rows.agg(F.max(at).alias("_now"))  # one row
    x = rows.crossJoin(F.broadcast(last)).withColumn("_w", decay(age_days(F.col(at), F.col("_now")), half_life_days))
    return x.groupBy(path).agg(
        F.count(F.lit(1)).alias("commits"), F.countDistinct(author).alias("authors"), F.min(at).cast("date").alias("first_seen"), F.max(at).cast("date").alias("last_changed"),
        F.sum("_w").alias("score"), *(F.sum(F.when(F.col(kind) == k, 1).otherwise(0)).alias(f"{k}_commits") for k in kinds),
    )


def usage_report(log: DataFrame) -> DataFrame:
    """Per command: calls, errors, share of errors in percent, median latency (the upper one: the value at
    half the count, not interpolated)."""
    errors = F.sum(F.when(F.col("outcome") == "error", 1).otherwise(0))
    x = log.groupBy("cmd").agg(F.count(F.lit(1)).alias("calls"), errors.alias("errors"), (errors * 100.0 / F.count(F.lit(1))).alias("error_percent"), F.count("ms").alias("_v"))
    middle = values_at_ranks(log.select("cmd", "ms"), ["cmd"], "ms", x.filter("_v > 0").select("cmd", F.expr("_v div 2").alias("rank")))
    return x.join(middle.select("cmd", F.col("ms").alias("p50_ms")), "cmd", "left").drop("_v")


def conventions(rows: DataFrame, name: str, follows: Column) -> DataFrame:
    """For each convention: how many of its rows follow it and do not, the share of the majority form and
    the confidence; all conventions in one pass."""
    x = rows.groupBy(name).agg(F.sum(F.when(follows, 1).otherwise(0)).cast("long").alias("n_yes"), F.sum(F.when(~follows, 1).otherwise(0)).cast("long").alias("n_no"))
    n = F.col("n_yes") + F.col("n_no")
    ratio = F.when(n > 0, F.greatest("n_yes", "n_no") / n).otherwise(0.0)
    return x.select(name, "n_yes", "n_no", ratio.alias("ratio"), confidence(ratio, n).alias("confidence"))


def hotspots(complexity: DataFrame, churned: DataFrame, key: str) -> DataFrame:
    """Score of items with both: complexity over its largest, times ln(1 + churn) over its largest."""
    return scored_hotspots(complexity.join(churned, key))


def scored_hotspots(items: DataFrame) -> DataFrame:
    """``items`` with ``complexity`` and ``churn``, scored; the maxima are one row that is broadcast."""
    top = items.agg(F.max("complexity").alias("_x"), F.max("churn").alias("_n"))
    score = F.when(F.col("_x") > 0, F.col("complexity") / F.col("_x")).otherwise(0.0) * log_share(F.col("churn"), F.col("_n"))
    return items.crossJoin(F.broadcast(top)).withColumn("score", score).drop("_x", "_n")


def ranked_metric(values: DataFrame, kind: str, metric: str) -> DataFrame:
    """Long-format rows with rank 1..N by falling value, then node."""
    x = values.select(F.lit(kind).alias("graph_kind"), F.col("node").cast("string").alias("node_id"), F.lit(metric).alias("metric"), F.col("value").cast("double").alias("value"))
    return numbered(x, [F.col("value").desc(), "node_id"]).withColumn("rank", F.col("rank").cast("int"))


def pivoted(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A column for each metric; missing ones are 0. Sorted by the first metric, then node."""
    x = metrics.groupBy("node_id").pivot("metric", names).agg(F.first("value")).fillna(0.0, subset=names)
    return x.orderBy(F.col(names[0]).desc(), "node_id")


def with_delta(rows: DataFrame, value: str, order: list[str], rise: float = 15.0) -> DataFrame:
    """Change to the row before: ``down`` if lower, ``up`` if more than ``rise`` percent higher."""
    before = F.lag(value).over(Window.orderBy(*order))
    change = F.when(before.isNull(), "").when(F.col(value) < before, "down").when(F.col(value) > before * (1 + rise / 100), "up").otherwise("")
    return rows.withColumn("previous", before).withColumn("delta", change)


def risk_factors(row: dict[str, tuple[Column, float]]) -> list[Column]:
    """Factors 0..1 from raw measures with their midpoints."""
    return [saturating(value, mid).alias(name) for name, (value, mid) in row.items()]


def exports_by_file(symbols: DataFrame) -> DataFrame:
    """Sorted distinct exported names of each file and the smallest doc; files without are left out."""
    x = symbols.filter(F.col("name").rlike("^[A-Z]")).groupBy("file_path").agg(F.array_sort(F.collect_set("name")).alias("exports"), F.min("doc").alias("doc"))
    return x.filter(F.size("exports") > 0)


def digest(metrics: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per package: exported symbols and the pivoted metrics."""
    exports = symbols.filter(F.col("name").rlike("^[A-Z]")).groupBy("pkg_path").agg(F.count(F.lit(1)).alias("exports"))
    names = ["ca", "ce", "instability", "lcom4", "cyclo_max"]
    return exports.join(pivoted(metrics, names).withColumnRenamed("node_id", "pkg_path"), "pkg_path", "left")


def reach(calls: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """For each of ``files (file_path, pkg_path)``: distinct callers of what it declares, their files, and the
    most importers that a package of it has. ``calls`` is (caller_id, _from, file_path of the callee)."""
    called = calls.groupBy("file_path").agg(F.countDistinct("caller_id").alias("n_callers"), F.countDistinct("_from").alias("n_caller_files"))
    used = imports.groupBy("pkg_path").agg(F.countDistinct("importer_pkg").alias("_n"))
    most = files.join(used, "pkg_path", "left").groupBy("file_path").agg(F.coalesce(F.max("_n"), F.lit(0)).cast("long").alias("n_importers"))
    return most.join(called, "file_path", "left").fillna(0, ["n_callers", "n_caller_files"]).select("file_path", "n_callers", "n_caller_files", "n_importers")


def summary(rows: DataFrame, kind: str, path: str) -> DataFrame:
    """One row: ``total, n_files, kinds`` with the count of each kind, by kind."""
    each = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind, "n"))), lambda x: F.concat_ws("=", x[kind], x["n"].cast("string"))), ",")
    return each.agg(F.sum("n").alias("total"), kinds.alias("kinds")).crossJoin(rows.agg(F.countDistinct(path).alias("n_files"))).select("total", "n_files", "kinds")
