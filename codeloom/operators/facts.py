"""Facts of an architecture: drivers and hosts of imports, flows, purposes, build targets, test plans.

Null paths and texts match nothing. Orders end in unique keys. What a function takes as a list is a short
list of rules; all else are DataFrames that may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import exprs as E
from codeloom.operators import relations as R
from codeloom.operators.lookup import top_per_group

#: Hosts whose modules are named by three segments.
CODE_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")


# imports


def driver_of(package: Column, drivers: list[tuple[str, str]]) -> Column:
    """The technology of the first driver ``(path, technology)`` whose segments occur in a row in the package."""
    framed = F.concat(F.lit("/"), package, F.lit("/"))
    return F.coalesce(*(F.when(framed.contains(f"/{path}/"), technology) for path, technology in drivers), F.lit(None).cast("string"))


def datastores(imports: DataFrame, drivers: list[tuple[str, str]]) -> DataFrame:
    """``technology, importers, evidence``: sorted importing packages, tests left out, and the earliest place."""
    x = imports.withColumn("technology", driver_of(F.col("pkg_path"), drivers)).filter("technology is not null and not endswith(importer_pkg, '_test')")
    return x.groupBy("technology").agg(F.array_sort(F.collect_set("importer_pkg")).alias("importers"), F.min(F.struct("file_path", "line")).alias("evidence"))


def host_root(package: Column) -> Column:
    """The module of a path that begins with a host: three segments on code hosts, else two; null without a host."""
    segments = F.split(package, "/")
    n = F.when(segments[0].isin(*CODE_HOSTS), 3).otherwise(2)
    return F.when(segments[0].contains("."), F.array_join(F.slice(segments, F.lit(1), n), "/"))


def outside_imports(imports: DataFrame, module: str, drivers: list[tuple[str, str]], ignored: list[str]) -> DataFrame:
    """``imports`` of other hosts' modules with their ``root``; drivers, the own module and ``ignored`` paths are
    left out."""
    p = F.col("pkg_path")
    skip = p.startswith(module)
    for path in ignored:
        skip = skip | (p == path) | p.startswith(path + "/")
    return imports.withColumn("root", host_root(p)).filter(F.col("root").isNotNull() & driver_of(p, drivers).isNull() & ~skip)


def import_systems(outside: DataFrame) -> DataFrame:
    """``system, file_path, line``: modules that not only tests import, with the earliest place."""
    x = outside.groupBy(F.col("root").alias("system")).agg(F.min(F.struct("file_path", "line")).alias("at"), F.bool_and(E.is_test_file(F.col("file_path"))).alias("tests"))
    return x.filter("not tests").select("system", "at.file_path", "at.line")


def flows(imports: DataFrame, outside: DataFrame, drivers: list[tuple[str, str]], systems: DataFrame) -> DataFrame:
    """``src, dst, kind, file_path, line``: importing packages to datastores and to ``systems (system, file_path,
    line)``, each at its earliest place; a system that nothing imports has a null source."""
    stores = imports.withColumn("dst", driver_of(F.col("pkg_path"), drivers)).filter("dst is not null and not endswith(importer_pkg, '_test')")
    stores = stores.groupBy(F.col("importer_pkg").alias("src"), "dst").agg(F.min(F.struct("file_path", "line")).alias("at"))
    users = outside.groupBy(F.col("importer_pkg").alias("src"), F.col("root").alias("system")).agg(F.min(F.struct("file_path", "line")).alias("_at"))
    known = systems.select("system", F.struct("file_path", "line").alias("_own")).join(users, "system", "left")
    parts = [stores.select("src", "dst", F.lit("datastore").alias("kind"), "at"), known.select("src", F.col("system").alias("dst"), F.lit("external").alias("kind"), F.coalesce("_at", "_own").alias("at"))]
    return parts[0].unionByName(parts[1]).select("src", "dst", "kind", "at.file_path", "at.line")


def with_schema(schemas: DataFrame, packages: DataFrame, module: str) -> DataFrame:
    """``schemas (source)`` with the first package whose directory below the module holds it, null if none does."""
    below = F.regexp_replace(F.when(F.col("pkg_path").startswith(module), F.substring("pkg_path", len(module) + 1, 1 << 20)).otherwise(F.col("pkg_path")), "^/", "")
    homes = packages.select(below.alias("_dir"), "pkg_path").filter("_dir <> ''").groupBy("_dir").agg(F.min("pkg_path").alias("pkg_path"))
    return schemas.withColumn("_dir", F.regexp_extract("source", "^(.*)/[^/]*$", 1)).join(homes, "_dir", "left").drop("_dir")


# packages and files


def file_packages(files: DataFrame, symbols: DataFrame, fallback: DataFrame) -> DataFrame:
    """``file_path, pkg_path`` of files: the first package of their symbols, else that of the fallback table."""
    own = symbols.filter("pkg_path <> ''").groupBy("file_path").agg(F.min("pkg_path").alias("_own"))
    other = fallback.groupBy("file_path").agg(F.min("pkg_path").alias("_other"))
    return files.select("file_path").distinct().join(own, "file_path", "left").join(other, "file_path", "left").select("file_path", F.coalesce("_own", "_other").alias("pkg_path"))


def module_path(meta: DataFrame, manifest: DataFrame, packages: DataFrame) -> DataFrame:
    """One row ``module``: that of ``meta (value)``, else of ``manifest (line)``, else the shortest package outside
    ``internal`` and ``cmd``."""
    first = meta.filter("value <> ''").agg(F.min("value").alias("a"))
    second = manifest.agg(F.min(F.nullif(F.regexp_extract("line", r"^module\s+(\S+)", 1), F.lit(""))).alias("b"))
    plain = packages.filter(~F.col("pkg_path").contains("/internal/") & ~F.col("pkg_path").contains("/cmd/"))
    third = plain.agg(F.min(F.struct(F.length("pkg_path").alias("n"), "pkg_path")).alias("c"))
    return first.crossJoin(second).crossJoin(third).select(F.coalesce("a", "b", "c.pkg_path").alias("module"))  # one row each


def purposes(packages: DataFrame, names: list[tuple[str, str]], segments: list[tuple[str, str]], otherwise: str = "Application logic") -> DataFrame:
    """``name, purpose`` of ``packages (name, doc)``: the first sentence of the doc, else by exact name, else by the
    longest prefix, else by the last segment, else ``otherwise``; names that end in ``_test`` are left out."""
    name = F.col("name")
    by = lambda rules, test: [F.when(test(key), purpose) for key, purpose in rules]
    longest = sorted(names, key=lambda r: (-len(r[0]), r[0]))
    told = F.nullif(E.first_sentence(F.col("doc")), F.lit(""))
    rules = by(names, lambda k: name == k) + by(longest, lambda k: name.startswith(k)) + by(segments, lambda k: E.short_package(name) == k)
    return packages.filter("name <> '' and not endswith(name, '_test')").select("name", F.coalesce(told, *rules, F.lit(otherwise)).alias("purpose"))


# lines


def embeds(snippet: Column, type_name: Column) -> Column:
    """Whether a snippet is one token, comments aside, that names the type: an embedded field."""
    tokens = F.split(F.trim(F.regexp_replace(snippet, r"(\s+//\S*)+\s*$", "")), r"\s+")
    token = F.regexp_replace(F.regexp_replace(tokens[0], r"^\*", ""), r"[`{]+$", "")
    return (F.size(tokens) == 1) & (F.element_at(F.split(token, r"\."), -1) == type_name)


def interface_methods(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``interface_id, name``: capitalised names before a bracket on the lines inside the spans ``(interface_id,
    file_path, line_start, line_end)``; comments do not match."""
    inside = lines.join(spans, "file_path").filter("line_no > line_start and line_no < line_end")
    name = F.regexp_extract("line", r"^\s+([A-Z]\w*)\s*\(", 1)
    return inside.select("interface_id", name.alias("name")).filter("name <> ''").distinct()


def build_targets(lines: DataFrame, n: int = 6) -> DataFrame:
    """``path, target, place``: the first ``n`` documented targets of each build file ``(path, line_no, line)``, or
    its phony ones where none is documented."""
    valid = (F.col("target") != "") & (F.length("target") <= 64) & ~F.col("target").rlike(r"""[\s$()\\^\[\]{}|*+?%"']|^[/.]""")
    rest = F.regexp_extract("line", r"^\.PHONY:(.*)$", 1)
    documented = lines.filter(~F.col("line").startswith(".PHONY:") & F.col("line").contains(":") & F.col("line").contains("##"))
    documented = documented.select("path", F.lit(0).alias("tier"), "line_no", F.lit(0).alias("at"), F.trim(F.substring_index("line", ":", 1)).alias("target")).filter(valid)
    phony = lines.filter(F.col("line").startswith(".PHONY:")).select("path", "line_no", F.posexplode(F.split(F.trim(rest), r"\s+")).alias("at", "target")).filter(valid)
    phony = phony.groupBy("path", "target").agg(F.min(F.struct("line_no", "at")).alias("p")).select("path", F.lit(1).alias("tier"), "p.line_no", "p.at", "target")
    every = documented.unionByName(phony)
    best = every.groupBy("path").agg(F.min("tier").alias("tier"))
    return top_per_group(every.join(best, ["path", "tier"]), ["path"], ["line_no", "at", "target"], n).select("path", "target", F.col("rank").cast("int").alias("place"))


def with_body(results: DataFrame, lines: DataFrame, context: int = 0) -> DataFrame:
    """``results (id, file_path, line_start, line_end)`` with the text of their lines, ``context`` more on either side."""
    inside = lines.join(results.select("id", "file_path", "line_start", "line_end"), "file_path").filter(F.col("line_no").between(F.col("line_start") - context, F.col("line_end") + context))
    text = inside.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return results.join(text.select("id", F.array_join("l.line", "\n").alias("body")), "id", "left")


def fixture_literals(literals: DataFrame, owners: DataFrame, n: int) -> DataFrame:
    """``owner, value, place, n_more``: the first ``n`` distinct fixture paths of the files ``(owner, file_path)`` by
    value, with the number left out."""
    value = F.col("value")
    each = literals.filter(value.contains("testdata/") | value.endswith(".golden")).join(owners.distinct(), "file_path").select("owner", "value").distinct()
    more = each.groupBy("owner").agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).cast("long").alias("n_more"))
    return top_per_group(each, ["owner"], ["value"], n).join(more, "owner").select("owner", "value", F.col("rank").cast("int").alias("place"), "n_more")


# change


def run_plan(symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``directory, n_tests, pattern``: tests that cover the changed functions, or are changed themselves, by
    directory, as an anchored pattern."""
    tests, seeds = _changed_functions(symbols, changed)
    found = R.covering_tests(edges, symbols, seeds.select(F.col("id").alias("seed"))).select("name", "file_path").unionByName(tests.select("name", "file_path"))
    directory = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("directory")
    names = found.select(directory, "name").distinct().groupBy("directory").agg(F.array_sort(F.collect_list("name")).alias("l"))
    return names.select("directory", F.size("l").cast("long").alias("n_tests"), F.concat(F.lit("^("), F.array_join("l", "|"), F.lit(")$")).alias("pattern"))


def uncovered(symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed functions that no test reaches in two calls."""
    _, seeds = _changed_functions(symbols, changed)
    hit = R.covering_tests(edges, symbols, seeds.select(F.col("id").alias("seed"))).select(F.col("seed").alias("id"))
    return seeds.join(hit, "id", "left_anti")


def ripple(symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``id, n_outside``: changed functions with callers, in two calls, outside the changed files. Ids are integers, and
    ``edges`` is a stored table, as for ``reach_counts``."""
    _, seeds = _changed_functions(symbols, changed)
    outside = symbols.join(changed.select("file_path").distinct(), "file_path", "left_anti")
    return R.reach_counts(edges, seeds, symbols, outside).select(F.col("seed").alias("id"), F.col("n_nodes").alias("n_outside"))


def triage(files: DataFrame, scores: DataFrame, packages: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``files (file_path)`` with their row of ``scores``, package, and whether a test reaches a symbol of theirs."""
    own = symbols.join(files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("seed"), F.col("file_path").alias("_file"))
    hit = R.covering_tests(edges, symbols, own.select("seed")).select("seed").distinct().join(own, "seed").select(F.col("_file").alias("file_path")).distinct().withColumn("has_tests", F.lit(True))
    x = files.select("file_path").distinct().join(scores, "file_path", "left").join(packages, "file_path", "left").join(hit, "file_path", "left")
    return x.fillna(False, ["has_tests"])


def _changed_functions(symbols: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed tests, and changed functions outside test files."""
    x = symbols.filter(F.col("kind").isin("func", "method")).join(changed.select("file_path").distinct(), "file_path", "left_semi")
    test = E.is_test_file(F.col("file_path"))
    return x.filter(test & E.is_test_name(F.col("name"))), x.filter(~test)


# index


def needs_backfill(meta: DataFrame, version: str, key: str = "metrics_version") -> DataFrame:
    """One row ``backfill``: whether ``meta (key, value)`` lacks the present generation."""
    return meta.filter(F.col("key") == key).agg(F.coalesce(~F.bool_or(F.col("value") == version), F.lit(True)).alias("backfill"))


def should_heal(n_changed: Column, same_settings: Column, at_most: int = 20) -> Column:
    """Small drift under unchanged settings is mended before a query; more is left to a run of its own."""
    return F.coalesce(same_settings & (n_changed > 0) & (n_changed <= at_most), F.lit(False))


def pruned(old: DataFrame, new: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """``old`` with ``new`` in its place, without keys that are no longer ``present``."""
    both = old.join(new.select(key), key, "left_anti").select(new.columns).unionByName(new)
    return both.join(present.select(key).distinct(), key, "left_semi").select(new.columns)


def pending(texts: DataFrame, done: DataFrame, settings: str, key: str = "symbol_id", text: str = "text") -> DataFrame:
    """``texts`` with the fingerprint of settings and text, without those of ``done (key, fingerprint)``: what a job
    that was broken off has still to do. Running it twice adds nothing."""
    marked = texts.withColumn("fingerprint", F.sha2(F.concat_ws("\n", F.lit(settings), F.coalesce(F.col(text), F.lit(""))), 256))
    return marked.join(done.select(key, "fingerprint").distinct(), [key, "fingerprint"], "left_anti")
