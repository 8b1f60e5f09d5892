"""Column expressions: names, paths, scores, dates, hashes and labels. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# names and paths


def symbol_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def is_exported(name: Column) -> Column:
    """Begins with an ASCII capital."""
    return name.rlike("^[A-Z]")


def is_test_file(path: Column) -> Column:
    return path.endswith("_test.go")


def is_test_name(name: Column) -> Column:
    return name.rlike("^(Test|Benchmark|Fuzz|Example)")


def suffix_match(path: Column, wanted: Column) -> Column:
    """The path is the wanted one, or ends with it after a slash; wildcards are literal."""
    return (path == wanted) | path.endswith(F.concat(F.lit("/"), wanted))


def suffixes(path: Column) -> Column:
    """A path and all that it ends in, from one segment on: what ``suffix_match`` finds, for a join on equality."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def in_directory(path: Column, directory: str) -> Column:
    """The directory occurs in the path as whole segments."""
    d = directory.strip("/")
    return (path == d) | path.endswith("/" + d) | path.contains(f"/{d}/") | path.startswith(d + "/")


def directly_under(path: Column, directory: str) -> Column:
    d = directory.strip("/") + "/"
    return path.startswith(d) & ~F.substring(path, len(d) + 1, 1 << 20).contains("/")


def short_package(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def layer_of(path: Column, module: str) -> Column:
    """First segment below the module, with the next one added below ``internal``."""
    below = F.when(path.startswith(module + "/"), F.substring(path, len(module) + 2, 1 << 20)).otherwise(path)
    parts = F.split(below, "/")
    return F.when((parts[0] == "internal") & (F.size(parts) > 1), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def relative_path(rel: Column, absolute: Column) -> Column:
    return F.coalesce(F.nullif(rel, F.lit("")), absolute)


def is_build_cache(path: Column) -> Column:
    return path.contains("/go-build/") | path.contains("/.cache/")


def receiver_type(receiver: Column) -> Column:
    """``T`` of ``(T)`` or ``(*T)``."""
    return F.regexp_extract(receiver, r"^\(+\*?([^()*]+)\)+$", 1)


def camel_words(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(spaced, "_+", " ")))


def first_sentence(doc: Column) -> Column:
    one_line = F.trim(F.regexp_replace(doc, r"\s+", " "))
    return F.rtrim(F.regexp_extract(one_line, r"^.*?[.!?](?: |$)|^.*$", 0))


def truncated(doc: Column, limit: int) -> Column:
    return F.when(F.length(doc) > limit, F.concat(F.rtrim(F.substring(doc, 1, limit)), F.lit("..."))).otherwise(doc)


def parse_position(text: Column) -> Column:
    """Struct of file, line and column of ``file:line[:col]``; null fields where missing."""
    pattern = r"^(.+?):(\d+)(?::(\d+))?$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.struct(part(1).alias("file"), part(2).try_cast("int").alias("line"), part(3).try_cast("int").alias("col"))


# signatures


def flat_parameters(signature: Column) -> Column:
    """Parameters of a signature without nested parentheses."""
    inner = F.trim(F.regexp_extract(signature, r"\(([^()]*)\)", 1))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"\s*,\s*"))


def is_variadic(signature: Column) -> Column:
    return signature.contains("...")


def related_types(signature: Column) -> Column:
    """Distinct capitalised names in a signature, in order."""
    return F.array_distinct(F.regexp_extract_all(signature, F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), F.lit(1)))


# scores


def relevance(name: Column, query: str, kind: Column | None = None, path: Column | None = None) -> Column:
    """100 for equality, 50 for a prefix, 25 for containment; plus 30 for definitions, 20 for exported
    names and up to 10 for short paths."""
    low, q = F.lower(name), query.lower()
    score = F.when(low == q, 100.0).when(low.startswith(q), 50.0).when(low.contains(q), 25.0).otherwise(0.0)
    if kind is not None:
        score = score + F.when(kind.isin("func", "method", "type", "interface", "struct"), 30.0).otherwise(0.0)
    score = score + F.when(is_exported(name), 20.0).otherwise(0.0)
    if path is not None:
        score = score + 10.0 * (1 - F.least(F.length(path), F.lit(100)) / 100.0)
    return score


def kind_priority(kind: Column, order: list[str]) -> Column:
    """Place of the kind in the order; unknown kinds come last."""
    out = F.lit(len(order))
    for k in reversed(range(len(order))):
        out = F.when(kind == order[k], k).otherwise(out)
    return out


def usage_priority(refs: Column, weight: Column) -> Column:
    return (F.log1p(refs.cast("double")) + 1) * weight


def log_share(value: Column, largest: Column) -> Column:
    """ln(1 + value) over its largest, 0 where the largest is 0."""
    return F.when(largest > 0, F.log1p(value) / F.log1p(largest)).otherwise(0.0)


def saturating(value: Column, mid: float) -> Column:
    """x / (x + mid), 0 from 0 down."""
    return F.when(value > 0, value / (value + mid)).when(value <= 0, 0.0)


def decay(age_days: Column, half_life: float = 180.0) -> Column:
    return F.pow(F.lit(2.0), -age_days / half_life)


def age_days(at: Column, reference: Column) -> Column:
    """Age in days with fractions."""
    return (reference.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")) / 86400.0


def mean_of_present(*factors: Column) -> Column:
    """Mean of the factors that are not null, to 3 decimals; null without any."""
    present = F.filter(F.array(*factors), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(present) > 0, F.round(total / F.size(present), 3))


def percent_change(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / before * 100.0)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4.0)


def confidence(ratio: Column, n: Column) -> Column:
    return F.when((ratio >= 0.8) & (n >= 3), "high").when((ratio >= 0.6) & (n >= 3), "medium").otherwise("low")


# fuzzy names


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def max_distance(name: Column) -> Column:
    n = F.length(name)
    return F.when(n <= 3, 1).when(n <= 6, 2).when(n <= 12, 3).otherwise(4)


#: Suffixes that a stem loses, in the order in which they are tried.
STEM_SUFFIXES = ("ing", "tion", "ed", "er", "es", "s")


def stem(word: Column) -> Column:
    """The first matching suffix goes if more than three characters remain."""
    out = word
    for s in reversed(STEM_SUFFIXES):
        out = F.when(word.endswith(s) & (F.length(word) - len(s) > 3), word.substr(F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


# labels

#: Commit types from the weightiest on.
COMMIT_TYPES = ("bug", "feature", "chore", "other", "untyped")


def commit_type(types: Column) -> Column:
    """The weightiest of an array of trailer types; ``untyped`` without any."""
    out = F.lit("untyped")
    for t in reversed(COMMIT_TYPES[:-1]):
        known = F.array_contains(types, t) if t != "other" else F.exists(types, lambda x: ~x.isin("bug", "feature", "chore"))
        out = F.when(known, t).otherwise(out)
    return F.when(types.isNull() | (F.size(types) == 0), "untyped").otherwise(out)


def hints(doc: Column, receiver: Column, name: Column, refs: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.lower(doc).contains("deprecated"), "deprecated"),
        F.when(receiver.startswith("(*"), "pointer receiver"),
        F.when(is_exported(name) & (refs == 0), "exported and unused"),
    ))


#: Verbs of callees by their whole name, then by how it begins, in this order.
VERBS = {
    "Open": "opens", "Close": "closes", "Read": "reads", "Write": "writes", "Get": "retrieves", "Set": "updates", "Save": "persists", "Store": "persists", "Load": "loads",
    "Parse": "parses", "Format": "formats", "Validate": "validates", "Check": "validates", "Execute": "executes", "Run": "executes", "Start": "starts", "Stop": "stops",
    "Init": "initializes", "Create": "creates", "Delete": "deletes", "Remove": "removes", "Add": "adds", "Append": "appends", "Insert": "inserts", "Update": "updates",
    "Find": "finds", "Search": "searches", "Query": "queries", "Fetch": "fetches", "Send": "sends", "Receive": "receives", "Encode": "encodes", "Decode": "decodes",
    "Marshal": "serializes", "Unmarshal": "deserializes",
}
VERB_PREFIXES = {
    "Is": "validates", "Has": "validates", "Check": "validates", "New": "creates", "Make": "creates", "Get": "retrieves", "Set": "updates", "Save": "persists", "Load": "loads",
    "Parse": "parses", "Format": "formats",
}


def action_verb(name: Column) -> Column:
    """The verb of a whole name, else of its beginning, else ``calls``."""
    out = F.lit("calls")
    for prefix, verb in reversed(VERB_PREFIXES.items()):
        out = F.when(name.startswith(prefix), verb).otherwise(out)
    known = F.create_map(*(F.lit(x) for pair in VERBS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, name), out)


#: Names of callees that end a flow without telling what it is for.
TERMINALS = ("DB", "Close", "String", "Error", "Err", "Bytes", "Len", "Reset")


def significance(name: Column) -> Column:
    """Weight of a callee in a flow: 5, less 4 for a terminal name, 3 more for a dotted and 2 more for an exported
    one, less 2 for one that begins with is or has, case aside."""
    bare = F.element_at(F.split(name, r"\."), -1)
    part = lambda c, n: F.when(c, n).otherwise(0)
    return F.lit(5) - part(bare.isin(*TERMINALS), 4) + part(name.contains("."), 3) + part(bare.rlike("^[A-Z]"), 2) - part(F.lower(bare).rlike("^(is|has)"), 2)


def callee_note(name: Column) -> Column:
    """A note on what a callee is for; null for most."""
    low = F.lower(name)
    return (
        F.when(low.contains("context"), "context propagation").when(low.contains("error"), "error handling")
        .when(name.rlike("^(Lock|Unlock)"), "synchronization").when(name.rlike("^(Close|Release)"), "resource cleanup")
    )


def verdict(change: Column, threshold: float = 15.0, lower_is_better: bool = True) -> Column:
    """pass, warn beyond half the threshold, fail beyond it; without a reference value, pass."""
    worse = change if lower_is_better else -change
    return F.when(worse > threshold, "fail").when(worse > threshold / 2, "warn").otherwise("pass")
