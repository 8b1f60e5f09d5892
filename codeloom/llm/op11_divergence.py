"""Source divergence audit: how far the word use of each source is from that of its language and of each other source.

Terms are counted by sorting. A map task splits whole texts into terms and sorts its records by
(lang, term, source, document); a run-length scan gives each run's documents and occurrences, and
only runs leave the task. They are dealt to ranges of (term, lang, source, first document) and
sorted again, terms first, as Spark compares the first bytes of the first column before all else; a second scan joins the runs of a key. As a key fills neighbouring ranges, only the
first and the last run of a range can go on elsewhere: these partial runs are merged by key, all
others are final. So a word of every document is split over ranges, between its runs.

Terms in fewer than ``min_docs`` documents of their language go. The rest are dealt by (lang, term),
at most one row for each source, and sorted by source; a scan over each term's run emits partial
sums for the pairs of sources that share it. What a term adds where one or both sources lack it
depends on the one count alone, and is added from histograms of counts and from the totals, so no
row is made for a term that a source lacks. The pairs of sources of a language are the result's own
size; all arithmetic is exact, in 64-bit integers (up to 9e15 occurrences in a language).

Edge cases: null text, language and source count as empty strings; a row is a document, so repeated
rows count each; null ids sort first; a group without kept terms has its pairs, with shares from
counts of 0, and no term rows; without kept terms in a language all its pairs have the value 0; a
language of one source has no pairs; equal values rank by the bytes of the item; a very long text is
held alone, with its distinct terms; an empty table gives no rows. Columns other than the four named
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stash

#: Shares are in parts of this; a count has ``PRIOR`` added.
SCALE, PRIOR = 1_000_000_000, 2
#: Records and distinct terms that a map task sorts at a time; they bound its memory, not the results.
RECORDS, TERMS = 2_000_000, 400_000
#: Letters stay, A-Z lower-cased, bytes beyond ASCII stay; all else separates terms.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RUNS = "lang string, term string, source string, document long, df long, n long"
_COUNTS = "lang string, term string, source string, df long, n long, open boolean"
_PAIRS = "lang string, a string, b string, value long"


class _Places(dict):
    """A number for each key, in order of arrival."""

    def __missing__(self, key):
        self[key] = out = len(self)
        return out


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _ranks(keys: pa.Array) -> np.ndarray:
    out = np.empty(len(keys), dtype=np.int64)
    out[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    return out


def _sorted_runs(langs: _Places, sources: _Places, terms: _Places, rows: list, found: list) -> Iterator[pa.RecordBatch]:
    """The records of one sort: ``rows`` are (lang, source, document, records) of each text, ``found`` its terms and counts."""
    each = np.array([r[3] for r in rows])
    names = [pa.array(list(langs), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(list(sources), pa.string())]
    lang, source = (np.repeat([r[k] for r in rows], each) for k in (0, 1))
    missing = np.repeat([r[2] is None for r in rows], each)
    doc = np.repeat(np.array([r[2] or 0 for r in rows], dtype=np.int64), each)
    term, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    key = (_ranks(names[0])[lang] * len(terms) + _ranks(names[1])[term]) * len(sources) + _ranks(names[2])[source]
    order = np.lexsort((doc, ~missing, key))
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    first = order[starts]
    df, count = np.diff(starts, append=len(order)), np.add.reduceat(n[order], starts)
    cols = [names[0].take(pa.array(lang[first])), names[1].take(pa.array(term[first])), names[2].take(pa.array(source[first])), pa.array(doc[first], mask=missing[first]), pa.array(df.astype(np.int64)), pa.array(count)]
    out = pa.RecordBatch.from_arrays(cols, names=["lang", "term", "source", "document", "df", "n"])
    for at in range(0, len(starts), 20_000):
        yield out.slice(at, 20_000)


def _local_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs, sources, terms, rows, found, held = _Places(), _Places(), _Places(), [], [], 0
    for batch in batches:
        for lang, source, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = Counter(terms_of(text))
            if not counts:
                continue
            size = len(counts)
            found.append((np.fromiter(map(terms.__getitem__, counts), np.int32, size), np.fromiter(counts.values(), np.int64, size)))
            rows.append((langs[lang], sources[source], doc, size))
            held += size
            if held >= RECORDS or len(terms) >= TERMS:
                yield from _sorted_runs(langs, sources, terms, rows, found)
                langs, sources, terms, rows, found, held = _Places(), _Places(), _Places(), [], [], 0
    if rows:
        yield from _sorted_runs(langs, sources, terms, rows, found)


def _changes(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    """Rows that differ from the one before in a column; the first one does."""
    out = np.ones(batch.num_rows, dtype=bool)
    if batch.num_rows > 1:
        out[1:] = False
        for name in names:
            col = batch.column(name)
            out[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    return out


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of a sorted range, with its documents and occurrences; the first and the last are open."""
    keys, carry, begun = ["lang", "term", "source"], None, False
    names = [*keys, "df", "n", "open"]

    def made(part: pa.Table, starts: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
        sums = [pa.array(np.add.reduceat(part.column(c).to_numpy(), starts)) for c in ("df", "n")]
        heads = part.select(keys).take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(heads.column(c).combine_chunks() for c in keys), *sums, pa.array(opened)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch]).select([*keys, "df", "n"])
        if carry is not None:
            part = pa.concat_tables([carry, part]).combine_chunks()
        starts = np.flatnonzero(_changes(part, keys))
        if len(starts) > 1:
            opened = np.zeros(len(starts) - 1, dtype=bool)
            opened[0] = not begun
            begun = True
            yield made(part.slice(0, starts[-1]), starts[:-1], opened)
        last = part.slice(starts[-1])
        sums = [pa.array([pc.sum(last.column(c)).as_py()], pa.int64()) for c in ("df", "n")]
        carry = pa.table([*(last.column(c).slice(0, 1) for c in keys), *sums], names=[*keys, "df", "n"])
    if carry is not None:
        yield made(carry, np.array([0]), np.array([True]))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pair_sums(part: pa.Table) -> Iterator[pa.RecordBatch]:
    run = np.cumsum(_changes(part, ["lang", "term"]))
    langs, sources = (part.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    lang, source = (x.indices.to_numpy() for x in (langs, sources))
    p, p0, step, keys, values = part.column("p").to_numpy(), part.column("p0").to_numpy(), 1, [], []
    while step < len(run):
        a = np.flatnonzero(run[step:] == run[:-step])
        if not len(a):
            break
        b = a + step
        values.append(divergence(p[a], p[b]) - divergence(p[a], p0[b]) - divergence(p0[a], p[b]) + divergence(p0[a], p0[b]))
        keys.append((lang[a].astype(np.int64) * len(sources.dictionary) + source[a]) * len(sources.dictionary) + source[b])
        step += 1
    if keys:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), dtype=np.int64)
        np.add.at(total, at, np.concatenate(values))
        key, b = np.divmod(key, len(sources.dictionary))
        lang_at, a = np.divmod(key, len(sources.dictionary))
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang_at)), sources.dictionary.take(pa.array(a)), sources.dictionary.take(pa.array(b)), pa.array(total)], names=["lang", "a", "b", "value"])


def _scan_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums for the pairs of sources that share terms, over runs of rows sorted by (term, lang, source)."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        if carry is not None:
            part = pa.concat_tables([carry, part]).combine_chunks()
        last = int(np.flatnonzero(_changes(part, ["lang", "term"]))[-1])
        if last:
            yield from _pair_sums(part.slice(0, last))
        carry = part.slice(last)
    if carry is not None:
        yield from _pair_sums(carry)


def _share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), by three digits at a time, so that nothing overflows.
    Null where nothing is kept."""
    n, total, kept = (F.col(x) if isinstance(x, str) else x for x in (n, total, kept))
    size = F.nullif(total + PRIOR * kept, F.lit(0).cast("long"))
    out, rest = F.lit(0).cast("long"), n + PRIOR
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, size), rest % size
    return out + 1


def _divergence(p: Column | str, q: Column | str) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(rows: DataFrame) -> DataFrame:
    """``lang, term, source, df, n`` of ``rows (lang, source, doc_id, text)``, by sorted runs."""
    runs = stash(rows.select("lang", "source", "doc_id", "text").mapInArrow(_local_runs, _RUNS), "runs")
    order = ["term", "lang", "source", "document"]
    scanned = stash(runs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan_runs, _COUNTS), "scanned")
    discard(runs)
    merged = scanned.filter("open").groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    return scanned.filter("not open").drop("open").unionByName(merged)


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language every other source by
    divergence (``pair``), and the ``top`` terms that it has more of than its language (``term``)."""
    blank = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col), blank).alias("lang"), F.coalesce(F.col(source_col), blank).alias("source"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    groups = rows.select("lang", "source").distinct()
    counts = term_counts(rows)
    terms = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n")).filter(F.col("df") >= min_docs).drop("df")
    kept = stash(counts.join(terms, ["lang", "term"]).select("lang", "term", "source", "n", "lang_n"), "kept")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = groups.join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    totals = totals.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "v", "lang_total")))
    none = F.lit(0).cast("long")
    totals = stash(totals.withColumn("p0", _share(none, "total", "v")), "totals")
    shares = kept.join(totals, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))

    above = shares.withColumn("q", _share("lang_n", "lang_total", "v")).filter("p > q")
    of_terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence("p", "q").alias("value"))

    # pairs: all terms as if neither source had them, then those that one has, then those that both have
    a, b = totals.select("lang", F.col("source").alias("a"), F.col("p0").alias("pa0"), "v"), totals.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb0"))
    base = a.join(b, "lang").filter("a < b").select("lang", "a", "b", F.coalesce(F.col("v") * _divergence("pa0", "pb0"), none).alias("value"))
    held = shares.groupBy("lang", F.col("source").alias("a"), "p", F.col("p0").alias("pa0")).agg(F.count(F.lit(1)).alias("terms"))
    one = held.join(b, "lang").filter("a <> b").select("lang", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("b"), (F.col("terms") * (_divergence("p", "pb0") - _divergence("pa0", "pb0"))).alias("value"))
    one = one.select("lang", F.col("x").alias("a"), "b", "value")
    runs = shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    both = runs.mapInArrow(_scan_pairs, _PAIRS)
    pairs = base.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    of_pairs = pairs.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = of_terms.withColumn("rank", place).filter(F.col("rank") <= top).unionByName(of_pairs.withColumn("rank", place))
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
