"""Names as they are typed to what the index holds: packages, import paths, workspaces, traced literals; and maps built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.exprs import receiver_type, significance, suffixes
from codeloom.operators import classify as K
from codeloom.operators import relations as R

#: The order of roles in a lifecycle.
ROLE_ORDER = ("create", "read", "mutate", "delete", "type-use")


def full_paths(asked: DataFrame, imports: DataFrame, module: str) -> DataFrame:
    """``query, pkg_path`` of ``asked (query)``: the path itself if imports know it on either side, else the one below
    the module if they know that, else as it was."""
    known = imports.select(F.col("pkg_path").alias("_p")).unionByName(imports.select(F.col("importer_pkg").alias("_p"))).distinct()
    both = asked.distinct().select("query", F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.col("query").alias("_p")), F.struct(F.lit(2).alias("tier"), F.concat(F.lit(f"{module}/"), "query").alias("_p")))).alias("c")).select("query", "c.*")
    found = both.join(known, "_p", "left_semi").groupBy("query").agg(F.min_by("_p", "tier").alias("_p"))
    return asked.distinct().join(found, "query", "left").select("query", F.coalesce("_p", "query").alias("pkg_path"))


def packages_named(asked: DataFrame, symbols: DataFrame, folder: Column) -> DataFrame:
    """``asked (query, ...)`` with ``pkg_path``: ``main`` is the shortest package, ``.`` the one of ``folder`` below it (empty at
    the root), a short name the shortest package that ends in it; all else, and what is not found, stays as it was."""
    packages = symbols.filter(F.col("pkg_path").isNotNull()).select("pkg_path").distinct()
    root = packages.agg(F.min(F.struct(F.length("pkg_path").alias("n"), F.col("pkg_path").alias("p"))).getField("p").alias("_root"))  # one row
    place = F.struct(F.length("pkg_path").alias("n"), F.col("pkg_path").alias("p"))
    ends = packages.select("pkg_path", F.explode(suffixes(F.col("pkg_path"))).alias("query")).filter("query <> pkg_path").join(asked.select("query").distinct(), "query", "left_semi")
    short = ends.groupBy("query").agg(F.min(place).getField("p").alias("_short"))
    q = F.col("query")
    x = asked.withColumn("_at", folder).join(short, "query", "left").join(F.broadcast(root))
    below = F.when(F.coalesce("_at", F.lit("")) == "", F.col("_root")).otherwise(F.concat_ws("/", "_root", "_at"))
    name = F.when(q == "main", F.col("_root")).when(q == ".", below).when(~q.contains("/") & ~q.contains("."), F.col("_short"))
    return x.select(*asked.columns, F.coalesce(name, q).alias("pkg_path"))


def workspace_patterns(roots: DataFrame) -> DataFrame:
    """``root, pattern`` of ``roots (root, text)``, the text of a workspace file or null: a pattern for each module that it
    uses, alone or in a block; without any, all packages."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"//[^\n]*", "")
    blocks = F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*use[ \t]*\(([^)]*)\)"), 1), "\n")
    alone = F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*use[ \t]+("[^"\n]+"|[^\s("]+)'), 1)
    paths = F.transform(F.concat(F.regexp_extract_all(blocks, F.lit(r'("[^"\n]+"|[^\s"]+)'), 1), alone), lambda p: F.concat(F.replace(p, F.lit('"'), F.lit("")), F.lit("/...")))
    return roots.select("root", F.explode(F.when(F.size(paths) > 0, paths).otherwise(F.array(F.lit("./...")))).alias("pattern"))


def datastore_rows(stores: DataFrame, generic: str = "SQL") -> DataFrame:
    """``pkg_path, technology`` of ``stores (technology, importers)``: a row for each package that is no test package; a
    package of several drivers goes by a specific one before the generic one, then by the alphabet."""
    x = stores.select("technology", F.explode("importers").alias("pkg_path")).filter(~F.col("pkg_path").endswith("_test"))
    return x.groupBy("pkg_path").agg(F.min(F.struct((F.col("technology") == generic).alias("g"), "technology")).getField("technology").alias("technology"))


def traced(asked: DataFrame, literals: DataFrame, symbols: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """``query, id, tier, enclosing_name, callers``: the literals of each value (tier 1), only without one those that contain it
    (tier 2), with the symbol around them and its first ``n`` callers by name. ``asked (query)`` is a short list."""
    exact = literals.join(asked, F.col("value") == F.col("query")).withColumn("tier", F.lit(1))
    rest = asked.join(exact.select("query").distinct(), "query", "left_anti")
    near = literals.join(F.broadcast(rest), F.col("value").contains(F.col("query"))).withColumn("tier", F.lit(2))
    return R.traced_literals(exact.unionByName(near), symbols, edges, n).select("query", "id", "tier", "enclosing_name", "callers")


def lifecycle_groups(lifecycles: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol_id, grp, place, count, names`` of what ``type_lifecycles`` gives: a type's functions by role, in the order of
    the roles, tests and generated files apart as ``Tests``; names in order, references outside of functions as such."""
    named = symbols.select(F.col("id").alias("enclosing_id"), F.col("name").alias("_fn"))
    x = lifecycles.join(named, "enclosing_id", "left").withColumn("grp", F.when(F.col("is_test"), "Tests").otherwise(F.col("role")))
    place = F.coalesce(*(F.when(F.col("grp") == r, k + 1) for k, r in enumerate(ROLE_ORDER)), F.lit(len(ROLE_ORDER) + 1))
    counted = x.groupBy("symbol_id", "grp", F.coalesce("_fn", F.lit("(file-scope)")).alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    return counted.groupBy("symbol_id", "grp").agg(F.sum("_c").alias("count"), F.array_sort(F.collect_list("_n")).alias("names")).withColumn("place", place)


def entry_details(symbols: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """``id, name, priority, doc, callees``: entry points with their doc and the ``n`` callees that tell most, methods by type."""
    shown = F.when(F.coalesce("receiver", F.lit("")) != "", F.concat_ws(".", receiver_type(F.col("receiver")), "name")).otherwise(F.col("name"))
    starts = K.entry_points(symbols).select("id", "name", "priority", "doc")
    called = edges.select(F.col("caller_id").alias("id"), "callee_id").join(starts.select("id"), "id", "left_semi").join(symbols.select(F.col("id").alias("callee_id"), shown.alias("_shown")), "callee_id").select("id", "_shown").distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy(significance(F.col("_shown")).desc(), "_shown"))
    top = called.withColumn("_p", place).filter(F.col("_p") <= n).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_p", "_shown"))).alias("_l"))
    return starts.join(top, "id", "left").select("id", "name", "priority", "doc", F.transform(F.coalesce("_l", F.array().cast("array<struct<_p: int, _shown: string>>")), lambda x: x["_shown"]).alias("callees"))


def interface_map(interfaces: DataFrame, needed: DataFrame, implementers: DataFrame, limit: int = 15) -> DataFrame:
    """``interface_id, name, n_methods, n_impl``: interfaces with an implementer and two methods or two implementers at least, the
    first ``limit`` by name, then id. ``needed`` and ``implementers`` have a row for each method and type."""
    i = implementers.select("interface_id", "type_id").distinct().groupBy("interface_id").agg(F.count(F.lit(1)).alias("n_impl"))
    return interface_map_of_counts(interfaces, needed, i, limit)


def interface_map_of_counts(interfaces: DataFrame, needed: DataFrame, i: DataFrame, limit: int = 15) -> DataFrame:
    """``interface_map`` of implementers that are counted: ``i (interface_id, n_impl)``."""
    m = needed.select("interface_id", F.col("name").alias("_m")).distinct().groupBy("interface_id").agg(F.count(F.lit(1)).alias("n_methods"))
    x = interfaces.select(F.col("id").alias("interface_id"), "name").join(i, "interface_id").join(m, "interface_id", "left").na.fill(0, ["n_methods"])
    return x.filter("n_methods >= 2 or n_impl >= 2").orderBy("name", "interface_id").limit(limit)


def baseline(runs: DataFrame) -> DataFrame:
    """``metric, n_runs, mean, share`` of ``runs (metric, run, value)``: the mean of each metric over its runs, a run's values
    summed first, and its percentage of all means. Nulls do not count."""
    each = runs.filter("value is not null").groupBy("metric", "run").agg(F.sum("value").alias("value"))
    means = each.groupBy("metric").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("value").alias("mean"))
    total = means.agg(F.sum("mean").alias("_total"))  # one row
    return means.join(F.broadcast(total)).select("metric", "n_runs", "mean", F.when(F.col("_total") != 0, 100 * F.col("mean") / F.col("_total")).alias("share"))
