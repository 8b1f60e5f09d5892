"""Operator 12 against brute force: Lyndon words, runs, the cut at rare words, and the query's digests."""

import hashlib
import os
import random
import zlib

import pytest

from codeloom.llm.op12_runs import collapsed, lyndon_matches, op12_periodic_runs, periodic_runs, runs_of, with_tail, word_runs

DATA = "/root/testdata/sf0.001"


def brute(s, least=24, periods=3):
    """Every period on its own: stretches of places equal to the one a period later, without a smaller period."""
    out, n = [], len(s)
    for p in range(1, n // periods + 1):
        at = 0
        while at + p < n:
            end = at
            while end + p < n and s[end] == s[end + p]:
                end += 1
            part = s[at : end + p]
            if end > at and len(part) >= max(least, periods * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((at, len(part), p))
            at = max(end, at + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def pieces(rng, n):
    """Copies of earlier pieces, repeated: many runs inside each other."""
    s = [0]
    while len(s) < n:
        if rng.random() < 0.6:
            size = rng.randint(1, len(s))
            at = rng.randrange(len(s) - size + 1)
            s += s[at : at + size] * rng.randint(1, 4)
        else:
            s.append(rng.randrange(3))
    return s[:n]


def cases():
    rng = random.Random(5)
    for t in range(600):
        n, k = rng.randint(0, 60), rng.randint(1, 4)
        s = [rng.randrange(k) for _ in range(n)]
        yield s if t % 3 else pieces(rng, n) if n else s
    yield from ([0] * 70, [0, 1] * 40, fibonacci(90), [0] * 24, [0] * 23, [1, 0, 0] * 8 + [1], [2] + [0, 1] * 12 + [2])


def test_next_smaller_suffixes_and_matches():
    for s in cases():
        for order in (1, -1):
            below, same = lyndon_matches(s, order)
            ends = [[order * x for x in s[i:]] for i in range(len(s))]
            for i in range(len(s)):
                j = next((j for j in range(i + 1, len(s)) if ends[j] < ends[i]), len(s))
                k = 0
                while j + k < len(s) and s[i + k] == s[j + k]:
                    k += 1
                assert (below[i], same[i]) == (j, k)


def test_runs_equal_brute_force():
    for s in cases():
        for least, periods in ((1, 2), (6, 3), (24, 3)):
            assert runs_of(s, least, periods) == brute(s, least, periods)
            assert word_runs(s, least, periods) == brute(s, least, periods)


def test_symbol_comparisons_are_linear():
    rng = random.Random(11)
    texts = [[0] * 3000, [0, 1] * 1500, fibonacci(3000), [bin(i).count("1") & 1 for i in range(3000)], [rng.randrange(2) for _ in range(3000)], ([0] * 99 + [1]) * 30, [x for i in range(80) for x in [0] * i + [1]]]
    texts += [x[::-1] for x in texts] + [pieces(rng, 3000) for _ in range(200)]
    for s in texts:
        for order in (1, -1):
            counted = [0]
            lyndon_matches(s, order, counted)
            assert counted[0] < 4 * len(s)


def test_collapsed_text_keeps_one_period():
    words = "x".split() + "a b c".split() * 8 + "y".split()
    runs = word_runs(words)
    assert runs == [(1, 24, 3)]
    assert collapsed(words, runs) == "x a b c y".split()
    assert word_runs("a b c".split() * 7 + ["a", "b"]) == []


def expected(i, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str("" if i is None else i).encode())
    if h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {k for a, n, p in runs for k in range(a + p, a + n)}
    text = b" ".join(w for k, w in enumerate(words) if k not in gone)
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    return (i, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op12_periodic_runs(spark, DATA).collect()))
    assert got == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] for r in got) > 5


def test_edges(spark, docs, rows, empty):
    got = {}
    for r in periodic_runs(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got[300][0].runs == [] and got[300][0].greatest is None and got[300][0].collapsed == ""
    assert got[302][0].collapsed == ""
    assert [tuple(r) for r in got[311][0].runs] == [(0, 25, 5)] and len(got[311][0].collapsed.split()) == 5
    many = spark.createDataFrame([(1, "w " * 100_000), (1, "w " * 100_000), (2, "a b " * 12 + "c d " * 12)], "doc_id long, text string")
    rows = sorted((r.doc_id, [tuple(x) for x in r.runs], tuple(r.greatest), r.collapsed) for r in periodic_runs(many).collect())
    assert rows[0] == rows[1] == (1, [(0, 100_000, 1)], (0, 100_000, 1), "w")
    assert rows[2] == (2, [(0, 24, 2), (24, 24, 2)], (0, 24, 2), "a b c d")  # a tie goes to the smaller start
    assert periodic_runs(empty).collect() == []
    assert with_tail(None, []) == []
