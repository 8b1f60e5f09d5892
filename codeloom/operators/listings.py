"""Members of types, references by filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.exprs import receiver_type
from codeloom.lineage import cut
from codeloom.operators.facts import embeds
from codeloom.operators.relations import LINES, overlapping


#: Rows from which on the types or methods of one name are dealt to several blocks; most blocks of a name, and most partitions
#: that pairs of blocks are dealt to.
BLOCK, BLOCKS, PARTS = 1024, 32, 2048


def type_members(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """``type_id, member, name, line``: the methods of each type by the name of their receiver, whatever their package, the
    fields declared inside it, and the types that it embeds, by references inside it whose line names just a type."""
    types = _types(symbols)
    methods = symbols.filter("kind = 'method'").select(receiver_type(F.col("receiver")).alias("_t"), F.col("id").alias("_id"), "name", F.col("line_start").alias("line"))
    of_methods = _with_methods(types.select("type_id", "_t"), methods)
    fields = _inside(types.select("type_id", "file_path", "line_start", "line_end"), _fields(symbols))
    held = _inside(types.select("type_id", "file_path", "line_start", "line_end"), _embedded(symbols, refs))
    row = lambda x, member: x.select("type_id", F.lit(member).alias("member"), "name", "line")
    return row(of_methods, "method").unionByName(row(fields, "field")).unionByName(row(held, "embed"))


def _with_methods(types: DataFrame, methods: DataFrame) -> DataFrame:
    """``type_id, name, line``: each of ``types (type_id, _t)`` with each of ``methods (_t, _id, name, line)`` of its name. The pairs
    are the result; both sides of a name are dealt to blocks by their number, and each pair of blocks is a key of its own, so
    a common name is spread over tasks, which stream one block past another."""
    blocks = lambda x, name: x.groupBy("_t").agg(F.least(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(BLOCKS)).cast("int").alias(name))
    met = cut(blocks(types, "_types").join(blocks(methods, "_methods").hint("shuffle_hash"), "_t"))  # a row for each name
    n = min(PARTS, 4 * (met.agg(F.sum(F.col("_types") * F.col("_methods"))).first()[0] or 1))
    at = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    x = types.join(met.hint("shuffle_hash"), "_t").select("type_id", "_t", at("type_id", "_types").alias("_a"), each("_methods").alias("_b"))
    y = methods.join(met.hint("shuffle_hash"), "_t").select("name", "line", "_t", each("_types").alias("_a"), at("_id", "_methods").alias("_b"))
    key = ["_t", "_a", "_b"]
    return x.repartition(n, *key).join(y.repartition(n, *key).hint("merge"), key).select("type_id", "name", "line")


def type_richness(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """``type_id, richness``: the ``richness`` of ``type_members``, without its rows: names are counted once for each name of a
    receiver and for each distinct range of lines, then met with the types that have these. Ids of types are unique."""
    types = _types(symbols)
    methods = symbols.filter("kind = 'method'").select(receiver_type(F.col("receiver")).alias("_t"), "name").distinct().groupBy("_t").agg(F.count(F.lit(1)).alias("_m"))
    place = ["file_path", "line_start", "line_end"]
    rows = _fields(symbols).distinct().withColumn("_member", F.lit(1)).unionByName(_embedded(symbols, refs).distinct().withColumn("_member", F.lit(2)))
    held = _inside(types.select(*place).distinct(), rows).select(*place, "_member", "name").distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("_h"))
    x = types.join(methods, "_t", "left").join(held, place, "left").select("type_id", (F.coalesce("_m", F.lit(0)) + F.coalesce("_h", F.lit(0))).cast("long").alias("richness"))
    return x.filter("richness > 0")


def _types(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("kind").isin("struct", "type")).select(F.col("id").alias("type_id"), F.col("name").alias("_t"), "file_path", "line_start", "line_end")


def _fields(symbols: DataFrame) -> DataFrame:
    return symbols.filter("kind = 'field'").select("file_path", "name", F.col("line_start").alias("line"))


def _embedded(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    named = symbols.filter(F.col("kind").isin("struct", "type", "interface")).select(F.col("id").alias("symbol_id"), "name")
    return refs.join(named.hint("shuffle_hash"), "symbol_id").filter(embeds(F.col("snippet"), F.col("name"))).select("file_path", "name", "line")


def _inside(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    return overlapping(ranges.hint("merge"), rows.withColumn("_to", F.col("line")), ["file_path"], ("line_start", "line_end"), ("line", "_to"), LINES)


def richness(members: DataFrame) -> DataFrame:
    """``type_id, richness``: members of all three kinds, each name once."""
    return members.select("type_id", "member", "name").distinct().groupBy("type_id").agg(F.count(F.lit(1)).alias("richness"))


def filtered_references(refs: DataFrame, symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """``query, id``: references that meet each of ``asked (query, name, kind, file, package)``: those of symbols of a name, of a kind,
    in a file whose path holds a part, inside a package or one below it; a null filter passes all but the name. A
    short list is asked."""
    target = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("_name"), F.col("kind").alias("_kind"))
    inside = symbols.select(F.col("id").alias("enclosing_id"), F.col("pkg_path").alias("_pkg"))
    x = refs.select("id", "symbol_id", "enclosing_id", "file_path").join(target.join(F.broadcast(asked), F.col("_name") == F.col("name")), "symbol_id").join(inside, "enclosing_id", "left")
    open_or = lambda column, rule: F.col(column).isNull() | F.coalesce(rule, F.lit(False))
    below = (F.col("_pkg") == F.col("package")) | F.col("_pkg").startswith(F.concat("package", F.lit("/")))
    kept = x.filter(open_or("kind", F.col("_kind") == F.col("kind")) & open_or("file", F.col("file_path").contains(F.col("file"))) & open_or("package", below))
    return kept.select("query", "id")
