"""Exact top-k search: per-shard inverted indexes, block-max WAND, merged with global statistics.

Every input partition is indexed where it is read, in shards of at most ``SHARD`` documents and
``SHARD_TERMS`` postings (a longer document is a shard of its own), without any shuffle. Inside a shard,
documents whose commonest term is the same stand together, the shorter before the longer, so that
neighbours are alike and maxima are tight. Document frequencies, the number of documents and their mean
length are summed over all shards before any score is computed, so scores do not depend on how
documents are dealt.

Every list has its maxima over windows (``WINDOWS`` aligned stretches of a shard's documents), and a
pointer to where each window's postings begin; lists that hold a sixth of the documents or more also
have them over blocks of ``BLOCK`` documents. A query is answered by pivots, set at a time:

* Windows: the maxima of all the query's lists are summed. Where the sum does not reach the k-th score
  so far, no document can, and every list moves past the window: its postings there are not read.
* Documents of the other windows: the short lists are read there, and the long ones, which hold most
  postings, are bounded by the maxima of their blocks. The documents whose sum reaches the k-th score are
  the pivots; only they are looked up in the long lists, the likeliest first, which raises the k-th score
  for the rest. A long list is a row of places, one for each document, so a look-up is one step.

The k-th score does not start at zero: each query is first run against the largest shard, and its k-th
score there, which the final one cannot be below, is the floor for all shards. The k best of each shard
are merged by score, to six decimals, then by id, so ties have one order.

A task loads one shard, once, and streams the files of the queries by it. Index and queries are files in the
shared folder; the driver learns the number of shards, of documents and of terms. Steps are vectorised
over a query's postings, as cursors that advance one posting at a time are slow in Python.

BM25 with k1 = 1.2, b = 0.75 and idf = ln(1 + (N - df + 0.5) / (df + 0.5)), over the distinct terms of
the query. Terms are the runs between white space, A-Z lower-cased, without ASCII punctuation at either
end; they are identified by 64-bit hashes.

Edge cases: null or blank text has no terms: as a document it is found by nothing, as a query it
finds nothing; a query finds fewer than k rows where fewer share a term with it; rows with a null id are
neither indexed nor counted; repeated rows are found each, in the same place; of queries with one id the
least text is asked; a very long text is indexed and asked whole; empty tables give no rows. Columns
other than the two named are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, arrow_rows, claim, fresh_path, map_rows, stash
from .op4_records import filesystem

#: Documents and postings in a shard, queries in a file, at most.
SHARD, SHARD_TERMS, QUERIES = 16384, 6_000_000, 256
#: Windows of a shard; documents in a block; a list is long if it holds this part of the documents (1 / LONG).
WINDOWS, BLOCK, LONG = 16, 8, 6
#: What bounds are raised by for errors of rounding; what two equal scores of six decimals differ by before, at most.
SLACK, HALF = 1 + 1e-5, 1e-6
K1, B = 1.2, 0.75
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _term_hash(word: bytes) -> int:
    import xxhash

    bare = word.strip(_PUNCT)
    return xxhash.xxh64_intdigest(bare) if bare else 0


#: Hashes of words, in each Python worker.
_TERMS = Store(_term_hash, 12 << 20)


def term_hashes(text: str | None) -> np.ndarray:
    """The 64-bit hashes of all terms of a whole text, in order."""
    claim(_TERMS)
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(_TERMS.__getitem__, words), dtype=np.uint64, count=len(words))
    return h[h != 0]


def _save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    with fs.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(buf.getbuffer())
    fs.move(tmp, path)


def _load(uri: str) -> dict[str, np.ndarray]:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        with np.load(io.BytesIO(f.read())) as z:
            return {k: z[k] for k in z.files}


def _alike(names: int, doc: np.ndarray, term: np.ndarray, freq: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order of the documents of a shard: by the commonest of its 32 most widespread terms, then by length,
    then by id."""
    df = np.bincount(term, minlength=names)
    wide = np.argsort(-df, kind="stable")[:32]
    column = np.full(names, -1)
    column[wide] = np.arange(len(wide))
    counts = np.zeros((len(lengths), 33), dtype=np.int64)
    at = column[term]
    counts[doc[at >= 0], at[at >= 0]] = freq[at >= 0]
    lead = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), 32)
    return np.lexsort((ids, lengths, lead))


def build_shard(ids: list[int], texts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """``ids, lengths``; sorted ``terms``, where each one's postings begin (``begins``), and the
    postings ``docs`` (places in ``ids``) with ``freqs``."""
    lengths, ids = np.array([len(t) for t in texts], dtype=np.int64), np.array(ids, dtype=np.int64)
    n = max(len(ids), 1)
    terms = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    names, number = np.unique(terms, return_inverse=True)
    key, freq = np.unique(number.astype(np.int64) * n + np.repeat(np.arange(len(ids), dtype=np.int64), lengths), return_counts=True)
    order = _alike(len(names), key % n, key // n, freq, lengths, ids)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    key = key // n * n + place[key % n] if len(key) else key
    turn = np.argsort(key)
    key, freq = key[turn], freq[turn]
    return {
        "ids": ids[order], "lengths": lengths[order], "terms": names, "begins": np.searchsorted(key // n, np.arange(len(names) + 1)).astype(np.int64),
        "docs": (key % n).astype(np.uint16 if len(ids) <= 65536 else np.uint32), "freqs": np.minimum(freq, 4_000_000_000).astype(np.uint32 if freq.size and freq.max() > 65535 else np.uint16),
    }


class Shard:
    """A shard ready for search under the global mean length. Weights of terms are global, so a list is
    weighed once, when a query first asks for it."""

    def __init__(self, arrays: dict[str, np.ndarray], mean_length: float):
        self.ids, self.terms, self.begins = arrays["ids"], arrays["terms"], arrays["begins"]
        self.docs = arrays["docs"].astype(np.int32)
        n, n_terms = len(self.ids), len(self.terms)
        tf = arrays["freqs"].astype(np.float64)
        self.part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * arrays["lengths"][self.docs] / mean_length))
        # all lists: where their windows begin, and the maxima of these
        self.width = BLOCK * max(1, -(-n // (WINDOWS * BLOCK)))
        self.n_windows = max(1, -(-n // self.width))
        cell = np.repeat(np.arange(n_terms, dtype=np.int64), np.diff(self.begins)) * self.n_windows + self.docs // self.width
        self.window_begins = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=n_terms * self.n_windows))]).astype(np.int32)
        self.window_peaks = np.zeros(n_terms * self.n_windows, dtype=np.float32)
        if len(cell):
            heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            self.window_peaks[cell[heads]] = np.maximum.reduceat(self.part, heads)
        self.window_peaks = self.window_peaks.reshape(n_terms, self.n_windows)
        # long lists: a row of places, and the maxima of their blocks
        long = np.flatnonzero(np.diff(self.begins) * LONG >= max(n, 1))
        self.row_of = np.full(n_terms, -1, dtype=np.int64)
        self.row_of[long] = np.arange(len(long))
        self.n_blocks = -(-n // BLOCK)
        self.rows = np.zeros((len(long), self.n_blocks * BLOCK))
        posts = _ranges(self.begins[long], self.begins[long + 1])
        self.rows[np.repeat(np.arange(len(long)), np.diff(self.begins)[long]), self.docs[posts]] = self.part[posts]
        self.peaks = self.rows.reshape(len(long), self.n_blocks, BLOCK).max(axis=2)
        self.weighed = np.zeros(n_terms, dtype=bool)
        #: What searches have met so far: postings of their lists and those read, windows and those passed, documents scored.
        self.seen = {"postings": 0, "read": 0, "windows": 0, "passed": 0, "scored": 0}

    def _weigh(self, at: np.ndarray, idf: np.ndarray) -> None:
        new = ~self.weighed[at]
        for t, w in zip(at[new].tolist(), idf[new].tolist(), strict=True):
            self.window_peaks[t] *= w
            if (row := self.row_of[t]) >= 0:
                self.rows[row] *= w
                self.peaks[row] *= w
            else:
                self.part[self.begins[t] : self.begins[t + 1]] *= w
        self.weighed[at] = True

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of those that reach ``floor``, by falling score, then by rising id;
        ``terms`` are sorted."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        here = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.empty(0, np.int64)
        if not len(here):
            return np.empty(0, np.int64), np.empty(0)
        at, n = at[here], len(self.ids)
        self._weigh(at, idf[here])
        lists = self.row_of[at]
        long, short = lists[lists >= 0], at[lists < 0] * self.n_windows
        least = floor - HALF
        # pivot windows: all others are passed by every list
        reach = self.window_peaks[at].sum(axis=0, dtype=np.float64) * SLACK
        alive = np.r_[False, (reach >= least) & (reach > 0), False]
        lo, hi = np.flatnonzero(alive[1:] & ~alive[:-1]), np.flatnonzero(alive[:-1] & ~alive[1:])
        # short lists are read there; long ones are bounded by their blocks
        posts = _ranges(self.window_begins[short[:, None] + lo].ravel(), self.window_begins[short[:, None] + hi].ravel())
        read = np.bincount(self.docs[posts], weights=self.part[posts], minlength=n)
        bound = (read + np.repeat(self.peaks[long].sum(axis=0), BLOCK)[:n]) * SLACK
        # pivot documents: the likeliest first; a better k-th score leaves fewer for the next step
        rest = np.flatnonzero((bound >= least) & (bound > 0))
        rest = rest[alive[1 + rest // self.width]]
        known, scores, size = np.empty(0, np.int64), np.empty(0), 4 * k + 8
        while len(rest):
            later = rest[:0]
            if len(rest) > size:
                some = np.argpartition(-bound[rest], size - 1)
                rest, later = rest[some[:size]], rest[some[size:]]
            full = read[rest] + self.rows[long[:, None], rest].sum(axis=0)
            known, scores, size = np.concatenate([known, rest]), np.concatenate([scores, full]), 8 * size
            if len(scores) >= k:
                least = max(least, float(np.partition(scores, -k)[-k]) - HALF)
            rest = later[bound[later] >= least]
        for name, x in (("postings", (self.begins[at + 1] - self.begins[at]).sum()), ("read", len(posts)), ("windows", self.n_windows), ("passed", self.n_windows - (hi - lo).sum()), ("scored", len(known))):
            self.seen[name] += int(x)
        scores = np.round(scores, 6)
        best = np.flatnonzero((scores > 0) & (scores >= floor))
        best = best[np.lexsort((self.ids[known[best]], -scores[best]))][:k]
        return self.ids[known[best]], scores[best]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    size = ends - starts
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(starts - before, size)


def build_index(docs: DataFrame, dest: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes index shards under ``dest``; ``file, n_docs, n_terms`` of each shard, and a row
    ``term, df`` for each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, 0
        ids, texts = [], []

        def flush() -> Iterator[pa.RecordBatch]:
            file = f"{dest}/{part:06d}-{n:06d}.npz"
            _save(file, made := build_shard(ids, texts))
            yield batch([file], [len(ids)], [int(made["lengths"].sum())], [None], [None])
            df = np.diff(made["begins"])
            for at in range(0, len(df), 50_000):
                t = made["terms"][at : at + 50_000].view(np.int64)
                yield batch([None] * len(t), [None] * len(t), [None] * len(t), t, df[at : at + 50_000])

        for b in batches:
            for doc_id, text in zip(*b.columns, strict=True):
                if doc_id.is_valid:
                    found = term_hashes(text.as_py())
                    if ids and (len(ids) == SHARD or held + len(found) > SHARD_TERMS):
                        yield from flush()
                        ids, texts, n, held = [], [], n + 1, 0
                    ids.append(doc_id.as_py())
                    texts.append(found)
                    held += len(found)
        if ids:
            yield from flush()

    def batch(*cols):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "n_docs", "n_terms", "term", "df"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "file string, n_docs long, n_terms long, term long, df long")


def _query(terms: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order, and their weights."""
    x = terms.values.flatten()
    t, w = x[0].to_numpy().view(np.uint64), x[1].to_numpy()
    order = np.argsort(t)
    return t[order], w[order]


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``query_id, rank, doc_id, score`` for ``queries (query_id, text)`` against all of ``docs``."""
    spark = docs.sparkSession
    built = stash(build_index(docs, fresh_path(spark, "index"), id_col, text_col), "built")
    shards = built.filter("file is not null").select("file", "n_docs", "n_terms")
    n_shards, n_docs, n_terms = shards.agg(F.count(F.lit(1)), F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_terms:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    mean, largest = n_terms / n_docs, shards.orderBy(F.col("n_docs").desc(), "file").first()["file"]

    def ask(ids, texts):
        return {"query_id": ids, "terms": pa.array([np.unique(term_hashes(t)).view(np.int64) for t in texts], pa.list_(pa.int64()))}

    least = queries.select(F.col("query_id").cast("long").alias("query_id"), "text").groupBy("query_id").agg(F.min("text").alias("text"))
    asked = stash(map_rows(least, "query_id long, terms array<long>", ask), "asked")
    df = built.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.select("query_id", F.explode("terms").alias("term")).join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("terms"))

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            floors = []
            for terms in b.column(1):
                shard = shard or Shard(_load(largest), mean)
                scores = shard.search(*_query(terms), k)[1]
                floors.append(float(scores[-1]) if len(scores) == k else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors, pa.float64())], schema=b.schema.append(pa.field("floor", pa.float64())))

    dealt = weighed.repartition(max(1, -(-asked.count() // QUERIES)), "query_id").mapInArrow(first_scores, "query_id long, terms array<struct<term: long, idf: double>>, floor double")
    folder = fresh_path(spark, "queries")
    with arrow_rows(spark, 64):
        dealt.write.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        for b in batches:
            for file in b.column(0).to_pylist():
                shard = Shard(_load(file), mean)
                fs, at = filesystem(folder)
                for asks in sorted(f.path for f in fs.get_file_info(FileSelector(at)) if f.base_name.endswith(".parquet")):
                    out = ([], [], [])
                    with fs.open_input_file(asks) as source:
                        for rows in pq.ParquetFile(source).iter_batches(batch_size=64):
                            for q, terms, floor in zip(*rows.columns, strict=True):
                                ids, scores = shard.search(*_query(terms), k, floor.as_py())
                                out[0].extend([q.as_py()] * len(ids)), out[1].extend(ids.tolist()), out[2].extend(scores.tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "doc_id", "score"])

    # a stated query set in files against all shards: a task for each shard
    found = shards.select("file").repartitionByRange(n_shards, "file").mapInArrow(run, "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op2_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return top_k(docs, docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))
