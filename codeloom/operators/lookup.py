"""Point lookups, ordered fallbacks, paging, relevance, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.exprs import edit_distance, max_distance, suffix_match
from codeloom.lineage import cut


#: So many names are sent to every task.
FEW = 256


def cascade(candidates: DataFrame, tiers: list[Column], key: list[str]) -> DataFrame:
    """Rows of the strictest tier that has any, for each key, with the number of the tier as ``tier``.

    One plan answers "try the strict predicate, then looser ones": a row's tier is the first
    predicate that it meets, and only the smallest tier of its key stays. Rows that meet none go.
    """
    tier = F.lit(None).cast("int")
    for k in reversed(range(len(tiers))):
        tier = F.when(tiers[k], k + 1).otherwise(tier)
    ranked = candidates.withColumn("tier", tier).filter("tier is not null")
    return ranked.withColumn("_best", F.min("tier").over(Window.partitionBy(*key))).filter("tier = _best").drop("_best")


def by_name(inputs: DataFrame, symbols: DataFrame, name: str = "name", query: str = "query") -> DataFrame:
    """Symbols for each input name: equal, else equal but for case, else containing it.

    Equal names are found with equality joins on the folded name, once; containment is tried only for
    inputs that found nothing, if there are any: up to ``FEW`` of them, by their count, are sent to all names,
    more are joined on their first three characters (fewer, if they are shorter), which a name that
    contains them has somewhere. An empty input finds nothing.
    """
    folded = symbols.withColumn("_low", F.lower(F.col(name)))
    equal = inputs.join(folded, F.lower(F.col(query)) == F.col("_low"))
    hit = cut(cascade(equal, [F.col(name) == F.col(query), F.lit(True)], [query]))
    missed = cut(inputs.join(hit.select(query).distinct(), query, "left_anti").filter(F.col(query) != ""))
    n = missed.limit(FEW + 1).count()
    if n == 0:
        return hit.drop("_low")
    low = F.lower(F.col(query))
    if n <= FEW:
        inside = folded.join(F.broadcast(missed), F.col("_low").contains(low))
    else:
        grams = F.expr("array_distinct(flatten(transform(sequence(1, 3), n -> transform(sequence(1, greatest(char_length(_low), 1)), i -> substring(_low, i, n)))))")
        inside = missed.withColumn("_gram", F.substring(low, 1, 3)).join(folded.withColumn("_gram", F.explode(grams)), "_gram").filter(F.col("_low").contains(low)).drop("_gram")
    return hit.unionByName(inside.withColumn("tier", F.lit(3))).drop("_low")


def routed(inputs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols for inputs ``query``, by the form of each: ``T.M`` with a capital before the last dot is a
    method by its receiver, ``p.N`` a name in a package (exact, else after a slash), all else a name
    (equal, else equal but for case). One plan: each row's tier is that of its form."""
    q = inputs.withColumn("_left", F.regexp_extract("query", r"^\(?\*?(.*?)\)?\.([^.]*)$", 1)).withColumn("_right", F.regexp_extract("query", r"\.([^.]*)$", 1))
    q = q.withColumn("_form", F.when(F.col("_left") == "", "name").when(F.col("_left").rlike("^[A-Z]"), "method").otherwise("package")).withColumn("_key", F.lower(F.when(F.col("_form") == "name", F.col("query")).otherwise(F.col("_right"))))
    both = q.join(symbols.withColumn("_key", F.lower("name")), "_key")
    exact = F.col("name") == F.when(F.col("_form") == "name", F.col("query")).otherwise(F.col("_right"))
    held = F.concat(F.lit("("), "_left", F.lit(")")), F.concat(F.lit("(*"), "_left", F.lit(")"))
    method = (F.col("_form") == "method") & exact & ((F.col("receiver") == held[0]) | (F.col("receiver") == held[1]))
    package = (F.col("_form") == "package") & exact
    tiers = [method | (package & (F.col("pkg_path") == F.col("_left"))) | ((F.col("_form") == "name") & exact), (package & suffix_match(F.col("pkg_path"), F.col("_left"))) | (F.col("_form") == "name")]
    return cascade(both, tiers, ["query"]).withColumnRenamed("_form", "form").drop("_left", "_right", "_key")


def selected(rows: DataFrame, key: list[str], score: str, order: list[str], n: int) -> DataFrame:
    """The n best of each key, and whether the choice is ambiguous: another row has the best score too."""
    w = Window.partitionBy(*key)
    marked = rows.withColumn("_best", F.max(score).over(w)).withColumn("ambiguous", F.sum(F.when(F.col(score) == F.col("_best"), 1).otherwise(0)).over(w) > 1).drop("_best")
    return top_per_group(marked, key, [F.col(score).desc(), *order], n)


def package_matches(packages: DataFrame, patterns: list[str], package: str = "pkg_path") -> DataFrame:
    """Distinct packages that meet a pattern: equal to it or ending in it after a slash; one that ends in
    ``/...`` also takes everything below."""
    hit = F.lit(False)
    for p in patterns:
        base = p.removesuffix("/...")
        hit = hit | suffix_match(F.col(package), F.lit(base))
        if p.endswith("/..."):
            hit = hit | F.col(package).contains(f"/{base}/")
    return packages.filter(hit).select(package).distinct()


def qualified(inputs: DataFrame, symbols: DataFrame, name: str = "name", package: str = "pkg_path") -> DataFrame:
    """Symbols for inputs (``query_pkg, query_name``): the exact package, else one that ends in it."""
    joined = inputs.join(symbols, F.col(name) == F.col("query_name"))
    return cascade(joined, [F.col(package) == F.col("query_pkg"), suffix_match(F.col(package), F.col("query_pkg"))], ["query_pkg", "query_name"])


def method_of(symbols: DataFrame, receiver: str, name: str) -> DataFrame:
    """Methods of a type by value or pointer receiver."""
    return symbols.filter(F.col("receiver").isin(f"({receiver})", f"(*{receiver})") & (F.col("name") == name))


def substring_ranked(symbols: DataFrame, pattern: str, name: str, order: list[str], limit: int) -> DataFrame:
    """Names that contain the pattern, case aside, shortest first."""
    return symbols.filter(F.lower(F.col(name)).contains(pattern.lower())).orderBy(F.length(name), *order).limit(limit)


def page(rows: DataFrame, order: list[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """A page under a total order; the last key must be unique."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def batch_lookup(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of the table for distinct ids."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def fuzzy(inputs: DataFrame, names: DataFrame, name: str = "name", query: str = "query", k: int = 5) -> DataFrame:
    """The k nearest names by edit distance, beyond 0 and up to a bound by the query's length.

    The lengths of two names within the bound differ by at most the bound, so candidates are joined
    on equal lengths, from four shorter to four longer, not with all names.
    """
    spread = inputs.withColumn("_bound", max_distance(F.col(query)))
    spread = spread.withColumn("_len", F.explode(F.sequence(F.length(query) - F.col("_bound"), F.length(query) + F.col("_bound"))))
    pairs = spread.join(names.select(name).distinct().withColumn("_len", F.length(name)), "_len")
    near = pairs.withColumn("distance", edit_distance(F.col(query), F.col(name))).filter("distance > 0 and distance <= _bound")
    rank = F.row_number().over(Window.partitionBy(query).orderBy("distance", F.length(name), name))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select(query, name, "distance", "rank")


def token_budget(rows: DataFrame, tokens: Column, budget: int, order: list[Column | str], group: list[str]) -> DataFrame:
    """The longest prefix of each group whose tokens fit the budget, with ``tokens`` and their sum so far
    (``running``); the first row always stays. Tokens are not negative, missing ones count as none; the order
    ends in a unique key; null groups are a group.

    Rows are dealt to ranges of group and order, so a hot group spreads over tasks. The sums of a group's
    ranges, a row for each, tell which of them the budget can reach; only those are read on."""
    dealt = cut(rows.withColumn("tokens", tokens).repartitionByRange(*group, *order).withColumn("_block", F.spark_partition_id()))
    blocks = Window.partitionBy(*group).orderBy("_block")
    sums = dealt.groupBy(*group, "_block").agg(F.sum("tokens").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = sums.select(*(F.col(g).alias(f"_group{k}") for k, g in enumerate(group)), F.col("_block").alias("_at"), before.alias("_before"), (F.row_number().over(blocks) == 1).alias("_head"))
    same = [F.col("_block") == F.col("_at"), *(F.col(g).eqNullSafe(F.col(f"_group{k}")) for k, g in enumerate(group))]
    x = dealt.join(reached.filter((F.col("_before") <= budget) | F.col("_head")), same)
    w = Window.partitionBy(*group, "_block").orderBy(*order)
    x = x.withColumn("running", F.col("_before") + F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).withColumn("_n", F.row_number().over(w))
    return x.filter((F.col("running") <= budget) | (F.col("_head") & (F.col("_n") == 1))).select(*(c for c in dealt.columns if c != "_block"), "running")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, numbered as ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def capped_with_exempt(rows: DataFrame, group: list[str], order: list[Column | str], exempt: Column, n: int) -> DataFrame:
    """The first n rows of each group that are not exempt, and all exempt ones, which are not shuffled; a null
    ``exempt`` is none. The rank's limit is taken before the shuffle too, so a hot group sends few rows."""
    free = F.coalesce(exempt, F.lit(False))
    return top_per_group(rows.filter(~free), group, order, n).drop("rank").unionByName(rows.filter(free))


def first_per_key(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return top_per_group(rows, key, order, 1).drop("rank")


def text_hits(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each line that matches the pattern, with its number (from 1), the column of the first
    match and the number of matches."""
    lines = docs.filter(F.col(text_col).rlike(pattern)).select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))
    return lines.filter(F.col("line").rlike(pattern)).select(
        id_col, (F.col("n") + 1).alias("line_no"), F.regexp_instr("line", F.lit(pattern)).alias("col_no"), F.size(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("n_matches"), "line",
    )
