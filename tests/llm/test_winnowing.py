"""Operator 13 against winnowing by the book, its guarantee, and the query's neighbours."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from codeloom.llm.op13_winnowing import BASE, JOIN, LARGE, PRIME, fingerprint, fingerprints, op13_winnowing, successive

DATA = "/root/testdata/sf0.001"


def book(text, k=16, window=49):
    """Hashes of all grams on their own, the least of each window, the rightmost of equals."""
    if not text:
        return []
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))]
    values = []
    for g in grams:
        g, at = "\0" * (k - len(g)) + g, k // 2 if k % 2 == 0 else k - 1
        parts = [0, 0]
        for j, c in enumerate(g):
            parts[j >= at] = (parts[j >= at] * BASE + ord(c)) % PRIME
        values.append((parts[0] * JOIN + parts[1]) % LARGE)
    out = set()
    for at in range(max(1, len(values) - window + 1)):
        out.add(min((v, -(at + j)) for j, v in enumerate(values[at : at + window])))
    return sorted(((h, -p) for h, p in out), key=lambda x: x[1])


def like(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x or y else 1.0


def texts():
    rng = random.Random(3)
    out = ["", "a", "abc" * 5, "x" * 16, "x" * 17, "x" * 5000, "ab" * 700, "\n\n \t", "😀é́ﬁΣ" * 200, "a\r\nb" * 100]
    for n in (63, 64, 65, 127, 128, 129, 1022, 1023, 1024, 1025, 1039, 1040, 1072, 1073, 1087, 1088, 1089, 2047, 2048, 2049, 2112, 2113, 2063, 2064, 2096, 2097, 2111, 4095, 4096, 4097, 5000, 20000):
        out.append("".join(rng.choice("abcdefgh é漢😀\n") for _ in range(n)))
    return out + ["".join(rng.choice("ab") for _ in range(n)) for n in range(40, 140)]


def written(prints):
    return ",".join(f"{h:x}:{p}" for h, p in prints)


def test_equals_winnowing_by_the_book(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.fingerprint] for r in fingerprints(df).collect()}
    for i, t in enumerate(texts()):
        assert got[i] == book(t), t[:40]


def test_other_sizes(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "text string")
    for r in df.select("text", fingerprint(F.col("text"), 5, 7).alias("p")).collect():
        assert [tuple(x) for x in r.p] == book(r.text, 5, 7)
    with pytest.raises(ValueError):
        fingerprint(F.lit("x"), 2000, 100)


def test_any_shared_passage_of_64_gives_a_common_print(spark):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    pairs = []
    for _ in range(60):
        passage = make(64)
        pairs.append((make(rng.randrange(600)) + passage + make(rng.randrange(600)), make(rng.randrange(600)) + passage + make(rng.randrange(600)), passage))
    df = spark.createDataFrame(pairs, "a string, b string, passage string")
    for r in df.select("a", "b", "passage", fingerprint(F.col("a")).alias("x"), fingerprint(F.col("b")).alias("y")).collect():
        at, to = r.a.index(r.passage), r.b.index(r.passage)
        x, y = {(h, p - at) for h, p in r.x}, {(h, p - to) for h, p in r.y}
        assert any(0 <= p <= 48 for _, p in x & y)  # a print inside the passage, at its place in both


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e = book(text), book(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(e), like(a, e), like(a, book(after))))
    return sorted(out)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r[c] for c in COLUMNS) for r in op13_winnowing(spark, DATA).collect())
    assert got == expected([(r.doc_id, r.text) for r in docs])


def test_spliced_prints_equal_those_of_the_edited_text(spark):
    """Neighbours of all lengths: halves shorter and longer than a window, ends that are missing, ties over the seam."""
    rows = list(enumerate(texts()))
    random.Random(6).shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, written(r.fingerprint), written(r.edited_fingerprint), r.near_edited, r.near_next) for r in successive(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == expected(rows)


def test_neighbours_over_buckets_gaps_and_nulls(spark, docs, rows, empty):
    sparse = [(7, "seven " * 30), (300, None), (5000, "far " * 40), (1 << 50, "farther " * 20), (-3, "below zero"), (-900, "")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in sparse], "doc_id long, text string, bucket int, after string, place int").repartition(4)
    plan = successive(df)
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, written(r.fingerprint), written(r.edited_fingerprint), r.near_edited, r.near_next) for r in plan.collect())
    assert got == expected(sparse)
    one = successive(spark.createDataFrame([(None, "alone " * 20)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    twice = successive(spark.createDataFrame([(1, "same text " * 9)] * 2 + [(2, "other words " * 8)], "doc_id long, text string")).collect()
    assert len(twice) == 3 and len({str(r.fingerprint) for r in twice if r.doc_id == 1}) == 1
    every = successive(docs).collect()
    assert len(every) == len(rows) and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in every)
    assert successive(empty).collect() == []
