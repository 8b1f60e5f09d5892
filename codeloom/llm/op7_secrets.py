"""Secret scan: patterns, and a battery of randomness tests with false-discovery control.

DataFrame operations alone. Matches are found with ``regexp_extract_all`` and placed by the lengths
of the pieces that ``split`` leaves between them, so starts and ends count code points and are exact.

Candidates of the battery are the runs of 20 or more characters of the encodings below. What a pattern's
span covers is taken out of a run, and the rest is cut at each ``=`` that is not padding at its end; a
piece that no alphabet holds ('+' or '/' beside '-' or '_') gives its longest sub-runs in each alphabet,
which may overlap. The encoding is
the smallest alphabet that holds a piece, padding aside: hex, base32, lower-case letters and digits,
letters and digits, base64, base64url. Letters alone and digits alone are no encoding.

Two questions are asked of a run.

* Can it be random? Tests against random characters of the alphabet: chi-squared uniformity over its
  characters, and over digits, lower and upper case; the number of runs above and below the middle of
  the alphabet; the serial correlation of neighbours. The smallest p-value, times the number of tests,
  rejects under any dependence; below ``NOT_RANDOM`` a run is no secret.
* Can it be ordinary? The null hypothesis of the false-discovery control is that a run is an ordinary
  name, path or word: its kinds of characters (vowels, consonants, capitals, digits, signs) follow each
  other as ``ORDINARY`` tells. The likelihood of the kinds under random characters over that under the
  ordinary chain is at least x with a probability of 1 / x at most, so its inverse is a p-value, whatever
  the length. The Benjamini-Hochberg rule over the whole corpus, apart in each class of length, since
  short runs give weak evidence, decides from which p-value on runs are reported: of those that are, at
  most ``FALSE_DISCOVERY`` are expected to be ordinary.

P-values are counted in steps of a tenth of a power of two, rounded up, so the counts
that reach the driver are bounded (classes times steps) and exact. What is reported is marked ``random``
unless it lies inside another such span.

Everything is a projection of rows, but for the bounded counts: no key is shuffled.

Edge cases: null text counts as empty and has no spans; overlapping spans all
stay; an empty table gives no rows; repeated rows count as often as they occur; a very long run is
looked at whole, in time and memory in proportion to it; columns other than those named are not read,
and names like those used here do not clash, as all work is done on renamed columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stash

#: Kinds in the order in which they are listed. Patterns; the group whose length counts; the least.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
RANDOM = "random"
#: Runs that the battery looks at.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Expected share of ordinary runs among those reported, at most.
FALSE_DISCOVERY = 0.05
#: Step of the battery's p-value (0.001) from which on a run is not random.
NOT_RANDOM = 100
#: Kinds of characters, and how they follow each other in ordinary runs: a row for each kind before.
KINDS_OF_CHARS = "vcuds"
ORDINARY = (
    (0.15, 0.70, 0.08, 0.03, 0.04),  # vowel
    (0.43, 0.42, 0.08, 0.03, 0.04),  # consonant
    (0.40, 0.43, 0.12, 0.03, 0.02),  # capital
    (0.04, 0.08, 0.08, 0.70, 0.10),  # digit
    (0.30, 0.40, 0.10, 0.15, 0.05),  # sign
)
#: Upper ends of the classes of length.
LENGTH_CLASSES = (31, 47, 79)
TESTS = 4
_DIGIT, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, what the run matches, alphabet in the order of its values.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGIT + "abcdef"),
    ("base32", "^[A-Z2-7]+$", _UP + "234567"),
    ("base36", "^[a-z0-9]+$", _DIGIT + _LOW),
    ("base62", "^[A-Za-z0-9]+$", _DIGIT + _UP + _LOW),
    ("base64", "^[A-Za-z0-9+/]+$", _UP + _LOW + _DIGIT + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _UP + _LOW + _DIGIT + "-_"),
)
#: What a run is cut into, and a piece that no alphabet holds.
PIECE = "[A-Za-z0-9+/_-]{20,}(=+$)?"
SUB_RUNS = tuple(f"[{c}]{{20,}}(=+$)?" for c in ("0-9a-f", "0-9A-F", "A-Z2-7", "a-z0-9", "A-Za-z0-9", "A-Za-z0-9+/", "A-Za-z0-9_-"))
_SPANS = "array<struct<s:int,k:int,e:int>>"
_PLACES = "array<struct<s:int,e:int>>"


def _hits(text: Column, pattern: str, group: int) -> Column:
    """Per match: the piece before it, the match, the group. Null without any match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole).alias("part"))
    return F.when(text.rlike(pattern), zipped)


def _placed(zipped: str, kind: int, least: int) -> str:
    """SQL for the spans of the matches whose group is long enough."""
    return f"""coalesce(aggregate({zipped}, named_struct('at', 0, 'out', cast(array() as {_SPANS})), (a, x) -> named_struct(
        'at', a.at + char_length(x.gap) + coalesce(char_length(x.hit), 0),
        'out', if(char_length(x.part) >= {least}, concat(a.out, array(named_struct('s', a.at + char_length(x.gap), 'k', {kind}, 'e', a.at + char_length(x.gap) + char_length(x.hit)))), a.out)),
        a -> a.out), cast(array() as {_SPANS}))"""


def _tail(z: str) -> str:
    """SQL for the upper tail of the normal distribution (rational approximation), z >= 0 or not."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    q = f"(0.3989422804014327D * exp(-({z}) * ({z}) / 2) * {t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))"
    return f"if({z} >= 0, {q}, 1 - {q})"


def _chi_tail(x: str, df: str) -> str:
    """SQL for the upper tail of chi-squared, by the cube-root transform."""
    return _tail(f"((pow({x} / {df}, 1 / 3D) - (1 - 2 / (9D * {df}))) / sqrt(2 / (9D * {df})))")


def _lets(value: str, **steps: str) -> str:
    """SQL that computes ``value`` after naming steps; a step may use those before it as ``v.name``."""
    *_, last = steps
    done: list[str] = []
    inner = "named_struct('_', 0)"
    for name, sql in steps.items():
        kept = ", ".join(f"'{d}', v.{d}" for d in done)
        inner = f"transform(array({inner}), v -> named_struct({kept}{', ' if kept else ''}'{name}', {sql}))[0]"
        done.append(name)
    return f"transform(array({inner}), v -> {value})[0]"


def _p_value(run: str, name: str, alphabet: str) -> str:
    """SQL for the combined p-value of a run (padding and case of hex already dealt with)."""
    k, half = len(alphabet), len(alphabet) // 2
    fold = f"translate({run}, '{alphabet}', '{'a' * half}{'b' * (k - half)}')"
    count = lambda chars: f"({run_len} - char_length(translate({run}, '{chars}', '')))"
    run_len = f"char_length({run})"
    groups = [g for g in (_DIGIT, _LOW, _UP) if set(g) & set(alphabet)]
    shares = [sum(c in alphabet for c in g) / k for g in groups]
    rest = 1 - sum(shares)
    cells = [(count("".join(c for c in g if c in alphabet)), s) for g, s in zip(groups, shares, strict=True)]
    if rest > 1e-9:
        cells.append((count("".join(c for c in alphabet if not c.isalnum())), rest))
    by_class = " + ".join(f"pow({c} - v.n * {s!r}D, 2) / (v.n * {s!r}D)" for c, s in cells)
    return _lets(
        f"least(1D, {TESTS} * least(v.p_chi, v.p_class, v.p_runs, v.p_serial))",
        n=f"cast({run_len} as double)",
        x=f"transform(split({run}, ''), c -> cast(locate(c, '{alphabet}') as double))",
        squares=f"aggregate(split('{alphabet}', ''), 0D, (a, c) -> a + pow(cast({run_len} - char_length(replace({run}, c, '')) as double), 2))",
        p_chi=_chi_tail(f"greatest({k} * v.squares / v.n - v.n, 0D)", f"{k - 1}D"),
        p_class=_chi_tail(f"({by_class})", f"{len(cells) - 1}D"),
        folded=fold,
        above="cast(char_length(replace(v.folded, 'a', '')) as double)",
        runs="cast(char_length(regexp_replace(regexp_replace(v.folded, 'a+', 'a'), 'b+', 'b')) as double)",
        mid="1 + 2 * v.above * (v.n - v.above) / v.n",
        p_runs=f"if(v.above = 0 or v.above = v.n, pow(2D, 1 - v.n), least(1D, 2 * {_tail('(abs(v.runs - v.mid) / sqrt(greatest((v.mid - 1) * (v.mid - 2) / (v.n - 1), 1e-9D)))')}))",
        mean="aggregate(v.x, 0D, (a, c) -> a + c) / v.n",
        spread="aggregate(v.x, 0D, (a, c) -> a + (c - v.mean) * (c - v.mean))",
        along="aggregate(zip_with(slice(v.x, 1, size(v.x) - 1), slice(v.x, 2, size(v.x) - 1), (p, q) -> (p - v.mean) * (q - v.mean)), 0D, (a, c) -> a + c)",
        p_serial=f"if(v.spread = 0, 0D, least(1D, 2 * {_tail('abs((v.along / nullif(v.spread, 0D) + 1 / v.n) * sqrt(v.n))')}))",
    )


def _rest(run: str) -> str:
    """SQL for what the patterns' spans leave of a run: an array of (s, e)."""
    return f"""aggregate(filter(__cl_base, b -> b.s < {run}.e and {run}.s < b.e), named_struct('at', {run}.s, 'out', cast(array() as {_PLACES})), (a, b) -> named_struct(
        'at', greatest(a.at, b.e), 'out', if(b.s > a.at, concat(a.out, array(named_struct('s', a.at, 'e', b.s))), a.out)),
        a -> if(a.at < {run}.e, concat(a.out, array(named_struct('s', a.at, 'e', {run}.e))), a.out))"""


def _cut(text: str, place: str, pattern: str) -> str:
    """SQL for the matches of a pattern inside the (s, e) of a text: an array of (s, e)."""
    part = f"substring({text}, {place}.s + 1, {place}.e - {place}.s)"
    return f"""aggregate(zip_with(split({part}, '{pattern}', -1), regexp_extract_all({part}, '{pattern}', 0), (g, h) -> named_struct('gap', char_length(g), 'hit', char_length(h))),
        named_struct('at', {place}.s, 'out', cast(array() as {_PLACES})), (a, x) -> named_struct('at', a.at + x.gap + coalesce(x.hit, 0),
        'out', if(x.hit is null, a.out, concat(a.out, array(named_struct('s', a.at + x.gap, 'e', a.at + x.gap + x.hit))))), a -> a.out)"""


def _pieces(text: str, found: str) -> str:
    """SQL for the candidates in runs: an array of (s, e)."""
    part = f"substring({text}, p.s + 1, p.e - p.s)"
    pieces = f"flatten(transform(filter(flatten(transform({found}, r -> {_rest('r')})), q -> q.e - q.s >= 20), q -> {_cut(text, 'q', PIECE)}))"
    sub_runs = ", ".join(_cut(text, "p", c) for c in SUB_RUNS)
    return f"flatten(transform({pieces}, p -> if({part} rlike '[+/]' and {part} rlike '[_-]', array_distinct(concat({sub_runs})), array(p))))"


def _bare(run: str) -> str:
    return f"regexp_replace({run}, '=+$', '')"


def _encoding(bare: str) -> str:
    """SQL for the number of the inferred encoding, null if none."""
    tests = " ".join(f"when {bare} rlike '{p}' then {k}" for k, (_, p, _) in enumerate(ENCODINGS))
    return f"case when not ({bare} rlike '[0-9]' and {bare} rlike '[A-Za-z]') then null {tests} end"


def _step(bare: str, enc: str) -> str:
    """SQL for the p-value in tenths of a power of two, rounded up to the next step."""
    by = " ".join(f"when {k} then {_p_value(f'lower({bare})' if name == 'hex' else bare, name, alphabet)}" for k, (name, _, alphabet) in enumerate(ENCODINGS))
    return f"cast(floor(-10 * log2(greatest(case {enc} {by} end, 1e-30D))) as int)"


def _kind(char: str, one_case: bool) -> int:
    """Place of a character's kind; in runs of one case capitals are letters like others."""
    char = char.lower() if one_case else char
    return 3 if char in _DIGIT else 2 if char in _UP else 0 if char in "aeiou" else 1 if char in _LOW else 4


def evidence_table(alphabet: str, one_case: bool) -> list[float]:
    """For each kind before and each kind after (``KINDS_OF_CHARS``): the logarithm of its share among
    random characters of the alphabet over its share in ordinary runs."""
    n = [sum(_kind(c, one_case) == k for c in alphabet) for k in range(5)]
    return [math.log(n[k] / len(alphabet) / after[k]) if n[k] else 0.0 for after in ORDINARY for k in range(5)]


def _evidence(bare: str, enc: str) -> str:
    """SQL for the p-value under ordinary runs in tenths of a power of two, rounded up."""
    one_case = f"not ({bare} rlike '[a-z]' and {bare} rlike '[A-Z]')"
    array = lambda alphabet, fold: "array({})".format(", ".join(f"{x!r}D" for x in evidence_table(alphabet, fold)))
    cases = " ".join(f"when {k} then if({one_case}, {array(a, True)}, {array(a, False)})" for k, (_, _, a) in enumerate(ENCODINGS))
    every = _LOW + _UP + _DIGIT + "+/-_"
    kinds = f"translate(if({one_case}, lower({bare}), {bare}), '{every}', '{''.join(KINDS_OF_CHARS[_kind(c, False)] for c in every)}')"
    total = f"""aggregate(filter(split(v.kinds, ''), c -> c <> ''), named_struct('p', 0, 'x', 0D), (a, c) -> named_struct('p', locate(c, '{KINDS_OF_CHARS}'),
        'x', a.x + if(a.p = 0, 0D, element_at(v.tab, 5 * (a.p - 1) + locate(c, '{KINDS_OF_CHARS}')))), a -> a.x)"""
    return _lets("cast(least(1000D, greatest(0D, floor(10 * v.total / ln(2D)))) as int)", tab=f"case {enc} {cases} end", kinds=kinds, total=total)


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__cl_base`` (spans of the patterns) and ``__cl_runs`` (candidates of the battery: span,
    class of length ``c``, steps of the p-values under random ``p`` and under ordinary runs ``o``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({f"__cl_h{k}": _hits(text, p, g) for k, (p, g, _) in enumerate(KINDS.values())} | {"__cl_h9": _hits(text, CANDIDATE, 0)})
    base = "concat({})".format(", ".join(_placed(f"__cl_h{k}", k, least) for k, (_, _, least) in enumerate(KINDS.values())))
    out = out.withColumns({"__cl_base": F.expr(f"array_sort({base})"), "__cl_found": F.expr(_placed("__cl_h9", 9, 20))})
    raw = f"coalesce({text_col}, '')"
    place = f"transform({_pieces(raw, '__cl_found')}, r -> named_struct('s', r.s, 'e', r.e, 'b', {_bare(f'substring({raw}, r.s + 1, r.e - r.s)')}))"
    named = out.withColumn("__cl_found", F.expr(place)).withColumn("__cl_found", F.expr(f"filter(transform(__cl_found, r -> named_struct('s', r.s, 'e', r.e, 'b', r.b, 'n', {_encoding('r.b')})), r -> r.n is not null and char_length(r.b) >= 20)"))
    cls = "case " + " ".join(f"when char_length(r.b) <= {n} then {k}" for k, n in enumerate(LENGTH_CLASSES)) + f" else {len(LENGTH_CLASSES)} end"
    runs = F.expr(f"transform(__cl_found, r -> named_struct('s', r.s, 'e', r.e, 'c', {cls}, 'p', {_step('r.b', 'r.n')}, 'o', {_evidence('r.b', 'r.n')}))")
    return named.withColumn("__cl_runs", runs).drop("__cl_found", "__cl_h9", *(f"__cl_h{k}" for k in range(len(KINDS))))


def accepted(counts: list[tuple[int, int]], rate: float) -> int | None:
    """The least step from which on runs are reported, by the Benjamini-Hochberg rule over (step, number of
    runs); None if none are."""
    total, above, least = sum(n for _, n in counts), 0, None
    for step, n in sorted(counts, reverse=True):
        above += n
        if step > 0 and 2.0 ** (-step / 10) <= rate * above / total:
            least = step
    return least


def thresholds(found: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Per class of length the step of the p-value under ordinary runs from which on they are reported;
    classes without any are missing. Runs that cannot be random count as ordinary."""
    step = F.when(F.col("r.p") < NOT_RANDOM, F.col("r.o")).otherwise(0).alias("o")
    rows = found.select(F.explode("__cl_runs").alias("r")).groupBy("r.c", step).agg(F.count(F.lit(1)).alias("n")).collect()  # classes times steps at most
    limits = {c: accepted([(r.o, r.n) for r in rows if r.c == c], rate) for c in {r.c for r in rows}}
    return {c: x for c, x in limits.items() if x is not None}


def with_spans(found: DataFrame, limits: dict[int, int]) -> DataFrame:
    """``found`` with ``__cl_spans``: the patterns' spans and the ``random`` ones, by start and kind."""
    limit = "case r.c " + " ".join(f"when {c} then {o}" for c, o in sorted(limits.items())) + " else 1000000 end" if limits else "1000000"
    left = f"array_sort(transform(filter(__cl_runs, r -> r.p < {NOT_RANDOM} and r.o >= {limit}), r -> named_struct('s', r.s, 'b', -r.e)))"
    kept = f"""aggregate({left}, named_struct('to', -1, 'out', cast(array() as {_SPANS})), (a, r) -> named_struct('to', greatest(a.to, -r.b),
        'out', if(-r.b > a.to, concat(a.out, array(named_struct('s', r.s, 'k', {len(KINDS)}, 'e', -r.b))), a.out)), a -> a.out)"""
    spans = f"array_sort(concat(__cl_base, {kept}))"
    return found.withColumn("__cl_spans", F.expr(spans)).drop("__cl_runs")


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in (*KINDS, RANDOM))
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans``: arrays of (s, k, e) with start, number of the kind, end."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stash(find_spans(rows).drop("text"), "found")
    return with_spans(found, thresholds(found)).select("doc_id", F.col("__cl_base").alias("base"), F.col("__cl_spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask``; spans that overlap or touch become one."""
    quoted = lambda c: F.col("`{}`".format(c.replace("`", "``")))
    found = stash(find_spans(docs.select(quoted(text_col).alias("text"))).select("__cl_runs"), "runs")
    limits = thresholds(found)
    discard(found)
    # the caller's columns travel as they are, under names of their own
    own = docs.select(quoted(text_col).alias("text"), *(quoted(c).alias(f"__cl_own{k}") for k, c in enumerate(docs.columns) if c != text_col))
    marked = with_spans(find_spans(own), limits)
    cut = f"""aggregate(__cl_spans, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', greatest(a.at, x.e), 'out',
        if(x.s > a.at or a.at = 0, concat(a.out, substring(text, a.at + 1, x.s - a.at), '{mask}'), a.out)),
        a -> concat(a.out, substring(text, a.at + 1)))"""
    clean = F.when(F.size("__cl_spans") > 0, F.expr(cut)).otherwise(F.col("text"))
    return marked.select(*(clean.alias(c) if c == text_col else F.col(f"__cl_own{k}").alias(c) for k, c in enumerate(docs.columns)))


def op7_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(base, b -> b.k = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return x.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
