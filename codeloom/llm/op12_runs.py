"""Runs (maximal periodic stretches) of a text's words in linear time, without suffix structures or hashes.

Words are an ordered alphabet: any fixed total order of the distinct words will do, here that of
arrival. For an order and its reverse one pass from left to right finds for each place the next place
whose suffix is smaller; the stretch between them is the longest Lyndon word that starts there. Every
run has such a word as its period in one of the two orders, so what each of these words matches to its
right, and to its left, gives all runs.

Suffixes are compared by what has been matched before. A comparison knows how far the two agree from
the two comparisons that led to it, and stops there where they differ. Where it goes on inside the
stretch that was matched furthest so far, the answer is read off the stretch's earlier copy; symbols
are compared only beyond the furthest place that any comparison has reached. Tests count symbol
comparisons: fewer than three for each word and order, also on periodic, Fibonacci and random texts.

Words that occur fewer than three times in a text belong to no run of the wanted exponent, as such a
run holds each of its words three times or more; the text is cut there, exactly, and stretches
shorter than the least run are passed.

Documents are a map over rows without any shuffle: hot keys do not matter, and a lost executor costs
its running tasks alone. A very long text is held alone, with some 200 bytes for each word.

Edge cases: null and blank texts have no words, no runs, nulls for the greatest run and the checksum of
the empty string; equal exponents go by start, then period; repeated rows give a row each; an empty
table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows

#: A run has so many words and so many periods at least.
MIN_WORDS, MIN_PERIODS = 24, 3


def _match(a: int, b: int, prior: list[int], shared: list[int], below: list[int], same: list[int]) -> int:
    """How many symbols the suffixes at a < b share, if the comparisons made tell; else -1. Suffixes grow along
    the chain of previous smaller ones, so two of a chain share the least that its neighbours do."""
    if below[a] == b:
        return same[a]
    least = shared[b]
    b = prior[b]
    while b > a:
        least = min(least, shared[b])
        b = prior[b]
    return least if b == a else -1


def lyndon_matches(s: list[int], order: int = 1, counted: list[int] | None = None) -> tuple[list[int], list[int]]:
    """For each place the next place with a smaller suffix (the length of ``s`` if there is none), and how
    many symbols the two suffixes share. ``order`` -1 reverses the order of the symbols; a text's end is the
    smallest in both. ``counted[0]`` gets the number of symbol comparisons."""
    n = len(s)
    below, same, prior, shared = [n] * n, [0] * n, [-1] * n, [0] * n  # next smaller suffix, previous smaller suffix
    left = right = reach = looked = 0  # s[left : left + reach - right] equals s[right:reach], the furthest match
    for r in range(1, n):
        at_r, at, k, sure = s[r], r - 1, 0, False  # sure: at and r share exactly k symbols, else at least k
        while at >= 0:
            if not sure:
                if k == 0 and s[at] != at_r:
                    looked += 1
                else:
                    if right <= r and r + k < reach:  # inside the furthest match: its earlier copy tells
                        a, b = (at - right + left if at >= right else at), r - right + left
                        found = reach if a == b else _match(min(a, b), max(a, b), prior, shared, below, same)
                        if found >= 0:
                            sure = r + found < reach
                            k = found if sure else reach - r
                    if not sure:
                        begun = k
                        while r + k < n and s[at + k] == s[r + k]:
                            k += 1
                        looked += k - begun + 1
                        if r + k > reach:
                            left, right, reach = at, r, r + k
            if r + k < n and (s[at + k] < s[r + k] if order > 0 else s[at + k] > s[r + k]):
                prior[r], shared[r] = at, k
                break
            below[at], same[at] = r, k
            sure = k != shared[at]
            k = min(k, shared[at])
            at = prior[at]
    if counted is not None:
        counted[0] += looked
    return below, same


def runs_of(s: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of at least so many symbols and periods (two or more), by start, then period."""
    out = set()
    for order in (1, -1):
        below, same = lyndon_matches(s, order)
        for i, end in enumerate(below):
            p, m = end - i, same[i]
            if m < (min_periods - 2) * p or m + 2 * p <= min_words:
                continue
            k = 0
            while k < p and k < i and s[i - 1 - k] == s[end - 1 - k]:
                k += 1
            # matched over a whole period: the same word stands before, and has found this run
            if k < p and k + p + m >= max(min_words, min_periods * p):
                out.add((i - k, k + p + m, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_runs(words: list, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """The runs of a text's words, which are cut at words too rare for a run."""
    often = {w: k for k, (w, n) in enumerate(Counter(words).items()) if n >= min_periods}
    out, begun = [], 0
    s = [often.get(w, -1) for w in words]
    s.append(-1)
    while begun < len(words):
        end = s.index(-1, begun)
        if end - begun >= min_words:
            out += [(begun + a, n, p) for a, n, p in runs_of(s[begun:end], min_words, min_periods)]
        begun = end + 1
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    steps = [0] * (len(words) + 1)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    out, inside = [], 0
    for w, step in zip(words, steps):
        inside += step
        if not inside:
            out.append(w)
    return out


_RUN = "struct<start: bigint, length: bigint, period: bigint>"


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, rewrite: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs, greatest, collapsed``: a text's runs of words by start and period, the one of the
    greatest exponent, and the text without the words that repeat a period. ``rewrite`` takes an id and its
    words (UTF-8) and gives other words in their place."""

    def run(ids, texts):
        found, greatest, rest = [], [], []
        for i, text in zip(ids, texts, strict=True):
            words = (text or "").encode().split()
            if rewrite:
                words = rewrite(i, words)
            runs = word_runs(words, min_words, min_periods)
            best = None
            for r in runs:
                if best is None or r[1] * best[2] > best[1] * r[2]:
                    best = r
            found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            greatest.append(best and dict(zip(("start", "length", "period"), best)))
            rest.append(b" ".join(collapsed(words, runs) if runs else words).decode())
        return {"doc_id": ids, "runs": found, "greatest": greatest, "collapsed": rest}

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return map_rows(rows, f"doc_id long, runs array<{_RUN}>, greatest {_RUN}, collapsed string", run, rows=100)


def with_tail(doc_id: int | None, words: list) -> list:
    """The words of one document in ten, chosen by its id, repeat from a place on."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=with_tail)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    g = F.col("greatest")
    return x.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), g["start"].alias("start"), g["length"].alias("length"), g["period"].alias("period"),
        F.call_function("div", 1000 * g["length"], g["period"]).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
