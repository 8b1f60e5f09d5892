"""Schemas of the code-index tables, and bindings of operator roles to columns of any table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

#: DDL of each table; all columns are nullable, keys are in ``KEYS``.
DDL = {
    "symbols": "id string, name string, kind string, file_path string, file_path_rel string, pkg_path string, line_start int, col_start int, line_end int, col_end int, name_line int, name_col int, signature string, doc string, receiver string",
    "refs": "id string, symbol_id string, file_path string, file_path_rel string, line int, col int, enclosing_id string, snippet string, ast_ctx string",
    "call_graph": "caller_id string, callee_id string, file_path string, line int, col int",
    "imports": "file_path string, pkg_path string, name string, line int, col int, importer_pkg string",
    "files": "path string, mtime bigint, hash string, header string, lines int",
    "string_refs": "id string, value string, name string, kind string, file_path string, file_path_rel string, line int, col int, enclosing_id string, snippet string",
    "embeddings": "symbol_id string, embedding array<float>, model string, created_at timestamp",
    "symbol_purposes": "symbol_id string, purpose string, content_hash string, model string, generated_at timestamp",
    "package_docs": "pkg_path string, doc string, indexed_at timestamp",
    "file_churn": "path string, commits int, authors int, first_seen date, last_changed date, score double, bug_commits int, feature_commits int, chore_commits int, other_commits int, untyped_commits int",
    "graph_metrics": "graph_kind string, node_id string, metric string, value double, rank int",
    "graph_sccs": "graph_kind string, node_id string, scc_id int, scc_size int",
    "file_packages": "file_path_rel string, pkg_path string, source string",
    "changes": "path string, line_start int, line_end int",
    "usage": "ts timestamp, cmd string, outcome string, ms bigint, arg string, rung string, candidate_count int, index_state string, session_key string, tried_rungs array<string>, candidate_kinds map<string,int>, error string",
    "meta": "key string, value string",
}

#: Key columns of each table that has a key.
KEYS = {
    "symbols": ["id"],
    "refs": ["id"],
    "call_graph": ["caller_id", "callee_id", "line", "col"],
    "files": ["path"],
    "string_refs": ["id"],
    "embeddings": ["symbol_id"],
    "symbol_purposes": ["symbol_id"],
    "package_docs": ["pkg_path"],
    "file_churn": ["path"],
    "graph_metrics": ["graph_kind", "node_id", "metric"],
    "graph_sccs": ["graph_kind", "node_id"],
    "file_packages": ["file_path_rel"],
    "meta": ["key"],
}

#: Kinds of symbols.
KINDS = ("func", "method", "type", "interface", "struct", "var", "const", "field")


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


@dataclass(frozen=True)
class Edges:
    """Which columns of a table are the ends of a directed edge."""

    src: str = "src"
    dst: str = "dst"


@dataclass(frozen=True)
class Intervals:
    """Which columns are the equality key, the two inclusive ends and the unique id of an interval."""

    key: str = "file_path"
    start: str = "line_start"
    end: str = "line_end"
    id: str = "id"


#: Edge bindings of the code-index tables.
CALLS, IMPORTS = Edges("caller_id", "callee_id"), Edges("importer_pkg", "pkg_path")
