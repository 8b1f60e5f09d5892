"""Operator 11 against brute force, with sorts of every size, ties, nulls and groups without terms."""

import random
import re
from collections import Counter
from itertools import product

import pytest

from codeloom.llm import op11_divergence
from codeloom.llm.op11_divergence import source_divergence, term_counts, terms_of


def brute(rows, min_docs, top):
    """The definition, term by term and pair by pair, in Python's integers."""
    rows = [(lang or "", source or "", terms_of(text)) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, Counter(t)) for l, s, t in rows if l == lang]
        df = Counter(w for _, c in own for w in c)
        kept = [w for w, n in df.items() if n >= min_docs]
        v, sources = len(kept), {s for s, _ in own}
        count = {s: Counter() for s in sources}
        for s, c in own:
            count[s].update({w: n for w, n in c.items() if df[w] >= min_docs})
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * v)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            items = {"pair": [(o, sum(f(share(count[s], w), share(count[o], w)) for w in kept)) for o in sources if o != s], "term": []}
            for w in kept:
                if count[s][w] and share(count[s], w) > share(whole, w):
                    items["term"].append((w.decode(), f(share(count[s], w), share(whole, w))))
            for part, found in items.items():
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def made(seed, n=160):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "été", "É", "ß1x", "a-b", "naïve", "z", "中文", "ﬁn"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.choice([0, 1, 5, 40])))
        rows.append((rng.choice(["en", "de", None]), "hot" if rng.random() < 0.4 else rng.choice(["s1", "s10", "s2", None]), i if i % 11 else None, text if i % 13 else None))
    rows += [("xx", "lone", 900, "only here"), ("en", "bare", 901, "123 !!"), ("yy", "a", 902, "rare"), ("yy", "b", 903, "")]
    return rows + rows[:5]


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, "k", "c") for r in rows], "lang string, source string, doc_id long, text string, n int, term string, value string").repartition(parts)


@pytest.mark.parametrize(("records", "min_docs", "top"), [(2_000_000, 10, 10), (7, 10, 3), (1, 1, 2), (40, 1000, 10)])
def test_equals_brute_force(spark, monkeypatch, records, min_docs, top):
    monkeypatch.setattr(op11_divergence, "RECORDS", records)
    rows = made(records % 97)
    got = sorted(map(tuple, source_divergence(table(spark, rows), min_docs, top).collect()))
    assert got == brute([(l, s, t) for l, s, _, t in rows], min_docs, top)
    assert {r[2] for r in got} == ({"pair"} if min_docs == 1000 else {"pair", "term"})


def test_runs_of_a_key_over_many_ranges(spark):
    """One word in all documents of one source, sorted over many ranges: counts meet in one row."""
    rows = [("en", "s", k, "the the word%d" % (k % 50)) for k in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.term: (r.df, r.n) for r in term_counts(table(spark, rows, 60)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {"the": (3000, 6000), "word": (3000, 3000)}


def test_terms():
    pattern = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rng = random.Random(4)
    for text in ["", "A-Z_a", "É\x00é\x7fx", "1a2", "İß"] + ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x3000)])) for _ in range(50)) for _ in range(200)]:
        lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
        assert [w.decode() for w in terms_of(text)] == [lower(w) for w in pattern.findall(text)]
    assert terms_of(None) == []


def test_empty_and_very_long(spark):
    none = spark.createDataFrame([], "lang string, source string, doc_id long, text string")
    assert source_divergence(none).collect() == []
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60_000))
    rows = [("en", s, k, long) for k, s in product(range(6), ("a", "b"))]
    got = source_divergence(table(spark, rows)).collect()
    assert [(r.source, r.item, r.value, r.rank) for r in sorted(got) if r.part == "pair"] == [("a", "b", 0, 1), ("b", "a", 0, 1)]
    assert sorted(r["rank"] for r in got if r.part == "term") == sorted([*range(1, 11)] * 2)


def test_runs_are_sorted_by_terms_first(spark, monkeypatch):
    """Sorts compare the first bytes of their first column: languages are few, so all their rows would tie there."""
    plans, stash = {}, op11_divergence.stash
    monkeypatch.setattr(op11_divergence, "stash", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or stash(df, name))
    rows = [(lang, s, k, "commonest commonplace") for k, (lang, s) in enumerate(product(["a", "b"], "xy"))]
    got = {(r.lang, r.source, r.term): (r.df, r.n) for r in term_counts(table(spark, rows, 4)).collect()}
    assert got == {(lang, s, t): (1, 1) for lang, s, t in product("ab", "xy", ["commonest", "commonplace"])}
    assert re.search(r"Sort \[(\w+)#", plans["scanned"])[1] == "term"
