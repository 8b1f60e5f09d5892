"""Several tables written as one: staged in new folders, published by one manifest.

A store is a folder. Each commit writes every table that it brings to a folder of its own and then
puts down one small manifest, ``manifests/<number>``, that names the folder of every table: the
switch. Readers take the newest whole manifest, so they see all tables of a commit or none, and keep
what they have opened while newer commits come. A commit that fails on the way leaves its staged
folders and nothing else; ``sweep`` deletes what no kept manifest names.

A manifest is created only if its number is free, so of two commits upon the same snapshot one fails
(``Conflict``) and none is lost. It ends with a line of its own; one without it (a writer lost while
writing) counts as not there. Tables that a commit does not bring are carried over, as folders. The
files of the store lie in a folder that driver and executors share; manifests have a line for each table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from codeloom.sources import sinks

END = "end"
#: Tables whose rows belong to a symbol and outlive a rewrite with it.
CHILDREN = {"embeddings": "symbol_id", "symbol_purposes": "symbol_id"}


class Conflict(RuntimeError):
    """Another commit has come upon the same snapshot."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/manifests")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, root: str, number: int) -> dict[str, dict] | None:
    """The tables that a manifest names; None if it is not whole."""
    fs, p = _fs(spark, f"{root}/manifests/{number:012d}")
    stream = fs.open(p)
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()
    if len(lines) < 2 or lines[-2] != END:
        return None
    return {t["name"]: t for t in map(json.loads, lines[:-2])}


def latest(spark: SparkSession, root: str) -> tuple[int, dict[str, dict]]:
    """Number and tables of the newest whole manifest; 0 and none in a new store."""
    for number in reversed(_numbers(spark, root)):
        found = _manifest(spark, root, number)
        if found is not None:
            return number, found
    return 0, {}


def _open(spark: SparkSession, root: str, tables: dict[str, dict]) -> dict[str, DataFrame]:
    return {n: spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{root}/{t['folder']}") for n, t in tables.items()}


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a commit, of the newest one if no number is given."""
    if number is None:
        return _open(spark, root, latest(spark, root)[1])
    found = _manifest(spark, root, number) if number in _numbers(spark, root) else None
    if found is None:
        raise ValueError(f"no snapshot {number}")
    return _open(spark, root, found)


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], drop: tuple[str, ...] = (), base: int | None = None) -> int:
    """Publishes ``tables`` in place of those of the same names; all others but ``drop`` stay. ``base`` is the
    snapshot that they were made from, the newest one if not given. Gives the new snapshot's number."""
    number, held = latest(spark, root)
    if base is not None and base != number:
        raise Conflict(f"made from snapshot {base}, but {number} has come")
    following = max([number, *_numbers(spark, root)]) + 1
    now = {n: t for n, t in held.items() if n not in drop}
    for name, df in tables.items():
        folder = f"tables/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folder}")
        now[name] = {"name": name, "folder": folder, "schema": df.schema.jsonValue()}
    _publish(spark, root, following, now)
    return following


def _publish(spark: SparkSession, root: str, number: int, tables: dict[str, dict]) -> None:
    fs, p = _fs(spark, f"{root}/manifests/{number:012d}")
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            raise Conflict(f"snapshot {number} has come") from e
        raise
    try:
        out.write(bytearray("".join(json.dumps(tables[n]) + "\n" for n in sorted(tables)) + f"{END}\n", "utf-8"))
    finally:
        out.close()


def commit_index(spark: SparkSession, root: str, symbols: DataFrame, refs: DataFrame, edges: DataFrame, extra: dict[str, DataFrame] | None = None) -> int:
    """A full write of an index: references and calls with unknown ends stay out, embeddings and purposes of
    symbols that survive are carried over, and what is not brought (imports, say) stays as it is."""
    number, _ = latest(spark, root)
    before = snapshot(spark, root, number) if number else {}
    kept = {n: sinks.preserved(before[n], symbols, key) for n, key in CHILDREN.items() if n in before and n not in (extra or {})}
    return commit(spark, root, {"symbols": symbols, "refs": sinks.known_refs(refs, symbols), "call_graph": sinks.known_edges(edges, symbols), **kept, **(extra or {})}, base=number)


def sweep(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes what the last ``keep`` whole snapshots do not name: older snapshots and what broken commits have
    staged. Not to be run beside a commit. Gives the number of deleted folders."""
    whole = [(n, t) for n in _numbers(spark, root) if (t := _manifest(spark, root, n)) is not None]
    stay = {t["folder"] for _, tables in whole[-keep:] for t in tables.values()}
    least, gone = whole[-keep:][0][0] if whole else 0, 0
    for n in _numbers(spark, root):
        if n < least:
            fs, p = _fs(spark, f"{root}/manifests/{n:012d}")
            fs.delete(p, False)
    fs, top = _fs(spark, f"{root}/tables")
    for table in fs.listStatus(top) if fs.exists(top) else ():
        for f in fs.listStatus(table.getPath()):
            if f"tables/{table.getPath().getName()}/{f.getPath().getName()}" not in stay:
                fs.delete(f.getPath(), True)
                gone += 1
    return gone
