"""Column expressions over source text: signatures with nested types, offsets of matches, text without strings and comments."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _after(text: Column, place: Column) -> Column:
    """What stands behind a place (from 1)."""
    return F.substring(text, place + 1, F.char_length(text))


def closing(text: Column, opening: Column) -> Column:
    """The place (from 1) of the round bracket that closes the one at ``opening``; 0 if none does, or none opens there."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"))

    def step(s: Column, i: Column, chars: Column) -> Column:
        c = F.element_at(chars, i)
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.when(s["at"] > 0, s).otherwise(F.struct(depth.alias("depth"), F.when((c == ")") & (depth == 0), i).otherwise(0).alias("at")))

    n = F.char_length(text)
    walk = lambda chars: F.aggregate(F.sequence(opening, n), start, lambda s, i: step(s, i, chars))["at"]
    return F.when((opening >= 1) & (opening <= n) & (F.substring(text, opening, F.lit(1)) == "("), _let(F.split(text, ""), walk)).otherwise(0)


def list_items(text: Column) -> Column:
    """The items of a list, cut at commas outside of all brackets, without spaces around them; none of a blank one."""
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit(0)).alias("cuts"))

    def step(s: Column, i: Column, chars: Column) -> Column:
        c = F.element_at(chars, i)
        depth = s["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when((c == ",") & (depth == 0), F.array_append(s["cuts"], i)).otherwise(s["cuts"]).alias("cuts"))

    n = F.char_length(text)
    cuts = _let(F.split(text, ""), lambda chars: F.aggregate(F.sequence(F.lit(1), n), start, lambda s, i: step(s, i, chars))["cuts"])
    cut = lambda found: F.transform(found, lambda x, k: F.trim(F.substring(text, x + 1, F.coalesce(F.get(found, k + 1), n + 1) - x - 1)))
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(_let(cuts, cut))


def signature_parts(signature: Column) -> Column:
    """``struct<params array<string>, results array<string>, variadic boolean>`` of a function's signature. After the
    word ``func`` a first bracket is the receiver; parameters stand in the next one, to the bracket that closes
    it, and results behind, in brackets or alone. Function types, maps and type arguments stay whole. Without
    a closed list of parameters, and for null, all is empty."""
    none = F.array().cast("array<string>")
    text = F.trim(F.regexp_replace(F.trim(F.coalesce(signature, F.lit(""))), "^func", ""))

    def without_receiver(s: Column) -> Column:
        return _let(closing(s, F.lit(1)), lambda end: F.when(end > 1, F.trim(_after(s, end))).otherwise(s))

    def parts(s: Column) -> Column:
        return _let(F.instr(s, "("), lambda begin: _let(closing(s, begin), lambda end: found(s, begin, end)))

    def found(s: Column, begin: Column, end: Column) -> Column:
        inside = F.substring(s, begin + 1, end - begin - 1)
        return F.when(end > 0, F.struct(list_items(inside).alias("params"), _let(F.trim(_after(s, end)), results).alias("results"), inside.contains("...").alias("variadic"))).otherwise(F.struct(none.alias("params"), none.alias("results"), F.lit(False).alias("variadic")))

    def results(rest: Column) -> Column:
        many = _let(closing(rest, F.lit(1)), lambda end: F.when(end > 1, list_items(F.substring(rest, F.lit(2), end - 2))).otherwise(none))
        return F.when(rest == "", none).when(rest.startswith("("), many).otherwise(F.array(rest))

    return _let(_let(text, without_receiver), parts)


def _matches_nothing(pattern: str) -> bool:
    """Whether a pattern matches the empty string, as far as it can be told here: forms that only Java has pass."""
    try:
        return re.search(pattern, "") is not None
    except re.error:
        return False


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start int, name string>>``: all matches of a regular expression (Java's), left to right, with the
    place (code points from 1). No match may be empty. Null text has none."""
    if _matches_nothing(pattern):
        raise ValueError("the pattern matches the empty string")
    text = F.coalesce(text, F.lit(""))
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    length = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + F.char_length(x))
    return _let(pair, lambda p: F.transform(p["hits"], lambda x, k: F.struct((length(p["gaps"], k + 1) + length(p["hits"], k) + 1).alias("start"), x.alias("name"))))


#: A comment, or a string, a rune or a raw string, closed or not, of source text; the first that begins takes all it spans.
TOKENS = r"""//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+(?:["\n]|\\?\z)|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+(?:['\n]|\\?\z)|`[^`]*+(?:`|\z)"""


def blanked(text: Column) -> Column:
    """Source text with spaces in place of comments and strings, so that all else keeps its place."""
    text = F.coalesce(text, F.lit(""))
    pair = F.struct(F.regexp_extract_all(text, F.lit(TOKENS), 0).alias("hits"), F.split(text, TOKENS, -1).alias("gaps"))
    spaces = lambda x: F.regexp_replace(x, "[^\n]", " ")
    return _let(pair, lambda p: F.array_join(F.transform(p["gaps"], lambda g, k: F.concat(g, spaces(F.coalesce(F.get(p["hits"], k), F.lit(""))))), ""))


def raw_strings(text: Column) -> Column:
    """The contents of the closed raw strings of source text; back quotes in comments and other strings open none."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), 0), lambda x: x.startswith("`") & x.endswith("`") & (F.char_length(x) > 1))
    return F.transform(found, lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob over a whole relative path. ``*`` and ``?`` stay within a segment, ``**``
    spans segments. One without a slash names a file or folder anywhere, one with a slash starts at the root;
    what is inside a named folder matches too."""
    anchored = "/" in glob.rstrip("/")
    body, i, g = "", 0, glob.strip("/")
    while i < len(g):
        if g.startswith("**/", i):
            body, i = body + "(?:[^/]+/)*", i + 3
        elif g.startswith("**", i):
            body, i = body + ".*", i + 2
        elif g[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif g[i] == "?":
            body, i = body + "[^/]", i + 1
        elif g[i] == "[" and "]" in g[i + 2 :]:
            end = g.index("]", i + 2)
            inside = g[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            body, i = body + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        elif g[i] == "{" and "}" in g[i:]:
            end = g.index("}", i)
            body, i = body + "(?:" + "|".join(map(re.escape, g[i + 1 : end].split(","))) + ")", end + 1
        else:
            body, i = body + re.escape(g[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if glob.endswith('/') else '(?:/.*)?'}$"


def selected(path: Column, globs: list[str]) -> Column:
    """Whether globs select a path: the last one that matches decides, one with ``!`` in front leaves out; a path
    that none matches is selected if all leave out."""
    out = F.lit(all(g.startswith("!") for g in globs))
    for g in globs:
        out = F.when(path.rlike(glob_pattern(g.removeprefix("!"))), not g.startswith("!")).otherwise(out)
    return out
