"""Commands over a code index: each is one plan that composes operators.

``Index`` holds the tables as DataFrames; a command takes its inputs as values or small DataFrames and
gives a DataFrame, so that Catalyst sees the whole of it.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import exprs as E
from codeloom.literals import literal_rows
from codeloom.operators import aggregates as A
from codeloom.operators import classify as K
from codeloom.operators import facts as X
from codeloom.operators import graph as G
from codeloom.operators import lookup as L
from codeloom.operators import relations as R
from codeloom.operators import vectors as V
from codeloom.schemas import DDL, schema
from codeloom.sources.readers import index_table


class Index:
    """Code-index tables by name; missing ones are empty."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None, root: str | None = None):
        self.spark, self._tables, self._root = spark, dict(tables or {}), root

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DDL:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = index_table(self.spark, self._root, name) if self._root else self.spark.createDataFrame([], schema(name))
        return self._tables[name]

    @cached_property
    def calls(self) -> DataFrame:
        return G.call_edges(self.call_graph, self.symbols)

    def _ids(self, ids: list[str], name: str) -> DataFrame:
        return literal_rows(self.spark, [(i,) for i in ids], f"{name} string")

    # navigation

    def definition(self, names: list[str]) -> DataFrame:
        """def: symbols by name, ordered fallbacks, best score first."""
        found = L.by_name(self._ids(names, "query"), self.symbols)
        score = E.relevance(F.col("name"), "", F.col("kind"), F.col("file_path"))
        return found.withColumn("score", score).orderBy("query", F.col("score").desc(), "file_path", "name", "id")

    def at(self, points: DataFrame) -> DataFrame:
        """def by position."""
        return R.resolve_position(points, self.symbols, self.refs)

    def refs_of(self, ids: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
        x = R.references(self.refs, self.symbols, self.files).filter(F.col("symbol_id").isin(ids))
        return L.page(x, ["symbol_id", "place", "file_path", "line", "col", "id"], limit, offset)

    def callers_of(self, ids: list[str]) -> DataFrame:
        return R.calls(self.call_graph, self.symbols, "id", ["name", "pkg_path", "file_path"], "caller_id", "callee_id").filter(F.col("callee_id").isin(ids))

    def callees_of(self, ids: list[str]) -> DataFrame:
        return R.calls(self.call_graph, self.symbols, "id", ["name", "pkg_path", "file_path"], "caller_id", "callee_id").filter(F.col("caller_id").isin(ids))

    def implementers_of(self, interface_methods: DataFrame) -> DataFrame:
        return R.implementers(self.symbols, interface_methods)

    def tests_of(self, ids: list[str]) -> DataFrame:
        return R.covering_tests(self.call_graph, self.symbols, self._ids(ids, "seed"))

    # change

    def impact(self, ids: list[str]) -> DataFrame:
        """Callers in two hops, referring symbols and tests, merged by id."""
        hops = R.two_hops(self.call_graph, self._ids(ids, "seed"), "caller_id", "callee_id")
        uses = R.impacted_by_reference(self.refs.filter(F.col("symbol_id").isin(ids)), self.symbols).select(F.col("enclosing_id").alias("node"))
        phases = [("caller", hops.filter("hop = 1")), ("transitive", hops.filter("hop = 2")), ("reference", uses), ("test", self.tests_of(ids))]
        return R.merge_phases(phases, "node").join(self.symbols.select(F.col("id").alias("node"), "name", "file_path"), "node", "left")

    def change_plan(self, ids: list[str], cap: int = 50) -> DataFrame:
        """Call sites to look at, production before tests, capped apart with the remainder as ``n_more``."""
        sites = R.call_sites(self.refs.filter(F.col("symbol_id").isin(ids)), self.symbols)
        ranked = L.top_per_group(sites, ["is_test"], ["file_path", "line", "col", "id"], cap)
        more = sites.groupBy("is_test").agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("n_more"))
        return ranked.join(more, "is_test")

    def touched(self, changes: DataFrame, stale: DataFrame | None = None) -> DataFrame:
        return R.touched_symbols(self.symbols, changes, stale if stale is not None else changes.select("path").limit(0))

    def verify(self, changes: DataFrame) -> DataFrame:
        """Touched symbols with their tests and the callers outside the changed files."""
        hit = self.touched(changes).select("id", "name", "pkg_path", "file_path")
        seeds = hit.select(F.col("id").alias("seed"))
        tests = R.covering_tests(self.call_graph, self.symbols, seeds).groupBy(F.col("seed").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tests"))
        outside = self.call_graph.join(changes.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")
        ripple = outside.groupBy(F.col("callee_id").alias("id")).agg(F.count(F.lit(1)).alias("n_outside"))
        x = hit.join(tests, "id", "left").join(ripple, "id", "left")
        pattern = F.concat(F.lit("^("), F.array_join("tests", "|"), F.lit(")$"))
        return x.select("id", "name", "pkg_path", F.col("tests").isNotNull().alias("covered"), pattern.alias("run_pattern"), F.coalesce("n_outside", F.lit(0)).alias("n_outside"))

    def risk(self, changes: DataFrame) -> DataFrame:
        """One row: measures, factors and score of a change; degraded, with a null score, if it touches no symbol outside of
        tests. Complexity is not in the index, so there is no difficulty."""
        kinds = F.col("kind").isin("func", "method", "struct", "interface", "type")
        hit = self.touched(changes).filter(kinds & ~E.is_test_file(F.col("file_path")))
        hit = self.symbols.join(hit.select("id").distinct(), "id", "left_semi")
        seeds = hit.select(F.col("id").alias("seed"))
        near = R.two_hops(self.call_graph, seeds, "caller_id", "callee_id").select(F.col("node").alias("id")).distinct()
        callers = self.symbols.join(near, "id", "left_semi").filter(~E.is_test_file(F.col("file_path"))).agg(F.count(F.lit(1)).alias("callers"))
        packages = hit.select("pkg_path").distinct()
        outside = self.imports.filter("importer_pkg <> pkg_path").join(packages, "pkg_path", "left_semi").groupBy("pkg_path").agg(F.countDistinct("importer_pkg").alias("n"))
        ranked = self.graph_metrics.filter("graph_kind = 'imports' and metric = 'pagerank'")
        rank = ranked.join(packages.withColumnRenamed("pkg_path", "node_id"), "node_id", "left_semi").agg(F.min("rank").alias("pkg_rank"))
        past = self.file_churn.join(changes.select("path").distinct(), "path", "left_semi").agg(F.max("bug_commits").alias("bug_commits"), F.max("score").alias("churn"))
        functions = hit.filter(F.col("kind").isin("func", "method"))
        roles = K.roles(K.call_facts(self.symbols, self.call_graph)).select("id", "role").unionByName(K.type_roles(self.symbols).select("id", "role"))
        flags = K.risk_flags(functions, self.refs, self.imports).agg(F.coalesce(F.sum(F.col("concurrency").cast("int") + F.col("security_boundary").cast("int")), F.lit(0)).alias("flags"))
        told = hit.select("id", "name").join(roles, "id", "left").agg(F.count(F.when(F.col("role") != "internal", 1)).alias("roles"), F.count(F.when(E.is_exported(F.col("name")), 1)).alias("exported"), F.count(F.lit(1)).alias("n_symbols"))
        tested = R.covering_tests(self.call_graph, self.symbols, functions.select(F.col("id").alias("seed"))).select("seed").distinct()
        tests = functions.select(F.col("id").alias("seed")).join(tested.withColumn("_t", F.lit(True)), "seed", "left").agg(F.count(F.lit(1)).alias("changed_funcs"), F.count(F.when(F.col("_t").isNull(), 1)).alias("untested"))
        x = told
        for one in (callers, outside.agg(F.coalesce(F.max("n"), F.lit(0)).alias("importers")), rank, ranked.agg(F.count(F.lit(1)).alias("pkg_count")), past, flags, tests):
            x = x.crossJoin(one)  # one row each
        x = x.withColumns({"cyclo": F.lit(None).cast("int"), "cognitive": F.lit(None).cast("int"), "degraded": F.when(F.col("n_symbols") == 0, "no changed symbols")})
        return K.assessed(x)

    def hotspots(self, complexity: DataFrame) -> DataFrame:
        """``complexity (path, complexity)`` with churn, fan-in and sensitive zones."""
        ends = self.call_graph.join(self.symbols.select(F.col("id").alias("callee_id"), F.col("file_path").alias("path")), "callee_id").select(F.col("file_path").alias("src"), F.col("path").alias("dst"))
        x = A.hotspots(complexity, self.file_churn.select("path", F.col("commits").alias("churn")), "path")
        x = x.join(A.fan_in(ends).withColumnRenamed("dst", "path"), "path", "left").fillna(0, ["fan_in"]).withColumn("zones", K.zones(F.col("path")))
        return x.orderBy(F.col("score").desc(), "path")

    # search

    def search(self, lines: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
        """Lines ``(file_path, line_no, line)`` that match, with the enclosing symbol, best first; without any
        hit, symbols whose name contains the pattern."""
        hits = lines.filter(F.col("line").rlike(pattern)).withColumn("point_id", F.concat_ws(":", "file_path", F.col("line_no").cast("string")))
        around = R.enclosing_or_next(hits.select("point_id", "file_path", F.col("line_no").alias("line")), self.symbols).select("point_id", F.col("name").alias("symbol"))
        text = hits.join(around, "point_id", "left").select(F.lit(1).alias("source"), "file_path", F.col("line_no").alias("line"), F.coalesce("symbol", F.lit("")).alias("name"), F.col("line").alias("text"))
        names = self.symbols.filter(F.lower("name").contains(pattern.lower())).select(F.lit(2).alias("source"), "file_path", F.col("line_start").alias("line"), "name", F.coalesce("signature", F.lit("")).alias("text"))
        both = L.cascade(text.unionByName(names).withColumn("q", F.lit(0)), [F.col("source") == 1, F.lit(True)], ["q"]).drop("q")
        score = E.relevance(F.col("name"), pattern, path=F.col("file_path"))
        return both.withColumn("score", score).orderBy(F.col("score").desc(), "file_path", "line", "name").limit(limit)

    def semantic(self, queries: DataFrame, k: int = 10, threshold: float = 0.3) -> DataFrame:
        """Symbols nearest to query vectors ``(query_id, query_vec)``."""
        near = V.nearest(queries, V.checked(self.embeddings.select("symbol_id", "embedding")), k, threshold, vec_id="symbol_id")
        return near.join(self.symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "file_path"), "symbol_id")

    def trace(self, value: str) -> DataFrame:
        """Literals equal to a value, else containing it, with their function and callers."""
        x = L.cascade(self.string_refs.withColumn("q", F.lit(value)), [F.col("value") == value, F.col("value").contains(value)], ["q"]).drop("q")
        return R.traced_literals(x, self.symbols, self.call_graph)

    def similar(self, threshold: float = 0.9) -> DataFrame:
        """Similar symbols inside a package, with the number of callees they share."""
        e = self.embeddings.join(self.symbols.select(F.col("id").alias("symbol_id"), "pkg_path"), "symbol_id")
        pairs = V.similar_pairs(e, "pkg_path", threshold, vec_id="symbol_id")
        return V.shared_count(pairs, self.call_graph, "caller_id", "callee_id")

    # architecture

    def dependencies(self, module: str) -> DataFrame:
        inside = self.imports.filter((F.col("pkg_path") == module) | F.col("pkg_path").startswith(module + "/"))
        return A.dependency_edges(inside, "importer_pkg", "pkg_path", "file_path")

    def importers(self, directory: str) -> DataFrame:
        x = self.imports.filter(E.in_directory(F.col("pkg_path"), directory) & ~E.is_build_cache(F.col("file_path")))
        return L.first_per_key(x, ["importer_pkg"], ["file_path", "line"])

    def layers(self, groups: DataFrame) -> DataFrame:
        """Crossings between layers ``(node, grp)`` of packages."""
        return R.layer_matrix(R.crossings(G.simple_edges(self.imports, "importer_pkg", "pkg_path"), groups), ["from_grp", "to_grp"])

    def guard(self, groups: DataFrame, rules: DataFrame) -> DataFrame:
        return R.violations(R.crossings(G.simple_edges(self.imports, "importer_pkg", "pkg_path"), groups), rules)

    def package_metrics(self, module: str) -> DataFrame:
        """Coupling, abstractness, distance of each package."""
        c = G.coupling(G.import_edges(self.imports, module)).withColumnRenamed("node", "pkg_path")
        kinds = F.col("kind").isin("interface", "struct", "type")
        a = A.abstractness(self.symbols.filter(E.is_exported(F.col("name"))), ["pkg_path"], F.col("kind") == "interface", kinds)
        return A.distance(a.join(c, "pkg_path", "left"))

    def metrics(self, kind: str, edges: DataFrame) -> DataFrame:
        """Long-format metrics of a graph, ranked."""
        d = G.degrees(edges)
        parts = [("in_degree", d.select("node", F.col("in_degree").alias("value"))), ("out_degree", d.select("node", F.col("out_degree").alias("value"))), ("pagerank", G.pagerank(edges)), ("betweenness", G.betweenness(edges))]
        h = G.hits(edges)
        parts += [("authority", h.select("node", F.col("authority").alias("value"))), ("hub", h.select("node", F.col("hub").alias("value"))), ("eigenvector", G.eigenvector(edges))]
        out = None
        for name, values in parts:
            x = A.ranked_metric(values, kind, name)
            out = x if out is None else out.unionByName(x)
        return out

    def dead(self, include_tests: bool = False) -> DataFrame:
        return R.dead_exports(self.symbols, self.refs, include_tests).orderBy("pkg_path", "file_path", "name", "id")

    def seams(self, interface_methods: DataFrame) -> DataFrame:
        """Interfaces by twice the packages that refer to them plus their implementers; those with an
        implementer and references from two files or more."""
        x = R.seam_scores(R.implementers(self.symbols, interface_methods), self.refs, self.symbols)
        return x.orderBy(F.col("score").desc(), "interface_id")

    def datastores(self, drivers: list[tuple[str, str]]) -> DataFrame:
        """Technologies by imports of their drivers ``(path, technology)``, the first of the list that matches on
        segments: sorted importers and the earliest place."""
        return X.datastores(self.imports, drivers)

    def external_systems(self) -> DataFrame:
        """Systems by environment variables with a telling suffix, grouped by what is before it."""
        suffix = "_(API_KEY|TOKEN|SECRET|URL|MODEL)$"
        x = self.string_refs.filter((F.col("kind") == "env") & F.col("value").rlike(suffix))
        return x.groupBy(F.lower(F.regexp_replace("value", suffix, "")).alias("system")).agg(F.array_sort(F.collect_set("value")).alias("variables"), F.min(F.struct("file_path", "line")).alias("evidence"))

    def system_map(self, module: str) -> DataFrame:
        """Edges between subsystems with their weight."""
        e = G.import_edges(self.imports, module)
        x = e.select(E.layer_of(F.col("src"), module).alias("a"), E.layer_of(F.col("dst"), module).alias("b"))
        return x.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))

    # explanation

    def type_members(self, name: str) -> DataFrame:
        """Methods of a type, and fields declared inside it."""
        methods = self.symbols.filter(F.col("receiver").isin(f"({name})", f"(*{name})")).withColumn("member", F.lit("method"))
        span = self.symbols.filter(F.col("kind").isin("type", "struct") & (F.col("name") == name)).select("file_path", F.col("line_start").alias("s"), F.col("line_end").alias("e"))
        fields = self.symbols.filter("kind = 'field'").join(span, "file_path").filter("line_start between s and e").drop("s", "e").withColumn("member", F.lit("field"))
        return methods.unionByName(fields).orderBy("member", "line_start", "name")

    def package_digest(self) -> DataFrame:
        return A.digest(self.graph_metrics, self.symbols)

    def roles(self) -> DataFrame:
        return K.roles(K.call_facts(self.symbols, self.call_graph))

    def context(self, limit: int = 50) -> DataFrame:
        """Symbols by (ln(refs + 1) + 1) times the weight of their role and risk; three of each directory,
        those at risk exempt."""
        flags = K.risk_flags(self.symbols, self.refs, self.imports)
        x = self.roles().join(flags, "id", "left").fillna(False, ["concurrency", "security_boundary"])
        x = A.use_counts(x, self.refs, "id", "symbol_id", "n_refs")
        weight = K.weight(F.col("role"), F.col("concurrency"), F.col("security_boundary"))
        x = x.withColumn("priority", E.usage_priority(F.col("n_refs"), weight)).withColumn("dir", F.regexp_extract("file_path", "^(.*)/[^/]*$", 1))
        x = L.capped_with_exempt(x, ["dir"], [F.col("priority").desc(), "id"], F.col("concurrency") | F.col("security_boundary"), 3)
        return x.orderBy(F.col("priority").desc(), "id").limit(limit)

    def lifecycle(self, type_name: str) -> DataFrame:
        types = self.symbols.filter(F.col("kind").isin("type", "struct", "interface") & (F.col("name") == type_name)).select(F.col("id").alias("symbol_id"), F.col("name").alias("type_name"))
        x = K.type_lifecycles(self.refs, self.symbols, types)
        return x.join(self.symbols.select(F.col("id").alias("enclosing_id"), F.col("name").alias("fn")), "enclosing_id", "left")

    def usage_report(self) -> DataFrame:
        return A.usage_report(self.usage)

    def sensitive(self) -> DataFrame:
        return self.files.withColumn("zones", K.zones(F.col("path"))).filter(F.size("zones") > 0).select("path", "zones")
