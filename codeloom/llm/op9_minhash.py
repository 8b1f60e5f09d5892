"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set holds the hashes (64 bits) of its distinct word shingles. A first permutation takes
each hash into a universe of 2^32 places; a second one, circularly shifted by 1, 2, 3, ... places,
gives all signature coordinates, so two permutations replace one for each coordinate. Signatures are
cut into bands; documents that agree in a band are candidates. At the threshold 0.8 the default of
32 bands of 4 misses a pair with probability (1 - 0.8^4)^32 = 5e-8.

Documents with equal sets are one class, and only its representative (the smallest id) is compared.
Bands are not expanded into all pairs. In each star round every bucket has one centre, and the
members that are not yet linked with it, directly or not, are verified against it on full sets;
several rounds with other centres link nearly all. What is still apart inside a bucket is then
verified pair by pair, so no link that joins two groups is left out. Two necessary conditions thin
the pairs before: set sizes (exact), and the Hamming distance of one-bit sketches of the signature
(at a similarity of 0.8 a pair is beyond the limit with a probability under 1e-9). Pair by pair, a
third one applies: the parity sketches of two sets differ in no more places than the sets have
elements that are not shared, so a pair whose sketches differ in too many places has too little in
common (exact, and nearly as sharp as the full sets while these are small).

Buckets and groups are joined on their keys, never gathered: a hot bucket is split by the adaptive
skew join, and counts are combined before the shuffle. Intermediate tables are written to the shared
folder, so an executor that is lost costs a stage, not the run.

Edge cases: null or blank text has an empty set, is linked with nothing and kept; with fewer words
than a shingle has, the whole sequence is the one shingle; rows with a null id are linked with
nothing: their component is null and they are kept; a document is an id with a text, so texts under one
id are linked by what they share alone, each with its own component, the smallest id it reaches; of
equal members a bucket's centre is the one whose id hashes lowest; an empty table gives no rows; a very
long text is held alone, with its set. Columns other than the two named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, claim, columns_of, discard, map_rows, stash

BANDS, ROWS_PER_BAND = 32, 4
#: Signature coordinates whose lowest bits may differ in a candidate pair; 12.8 +- 3.4 do at 0.8.
SKETCH_BITS, SKETCH_LIMIT = 128, 36
#: Places of the parity sketch: whether an odd number of a set's hashes fall there.
PARITY_BITS = 2048
STAR_ROUNDS = 2
#: Rows to leave out, of 17 bytes each, that are sent to all tasks.
FEW_MARKS = 500_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _permute32(x: np.ndarray) -> np.ndarray:
    """The second permutation of the 2^32 places, in place."""
    y = x >> np.uint32(16)
    x ^= y
    x *= np.uint32(0x85EBCA6B)
    np.right_shift(x, np.uint32(13), out=y)
    x ^= y
    x *= np.uint32(0xC2B2AE35)
    return x


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


#: Hashes of words, in each Python worker.
_WORDS = Store(_word_hash, 12 << 20)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z are lower-cased first."""
    parts = (text or "").encode().lower().split()  # bytes: just A-Z, and just the white space of ASCII
    if not parts:
        return np.empty(0, dtype=np.uint64)
    claim(_WORDS)
    h = np.fromiter(map(_WORDS.__getitem__, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(h))
    acc = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        acc = _mix64(acc * _MULT + h[j : len(h) - size + 1 + j])
    return np.unique(acc)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` circulant MinHash coordinates of a set that is not empty."""
    places = (shingles >> np.uint64(32)).astype(np.uint32)  # the first permutation: mixed hashes
    shifts = np.arange(1, n + 1, dtype=np.uint32)
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(places), 512):
        np.minimum(out, _permute32(places[at : at + 512, None] + shifts).min(axis=0), out=out)
    return out


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, the hash ``th`` of the text, ``n_shingles``, the set's digest ``d1, d2``, the sketch
    ``s1, s2`` and the band keys."""
    import xxhash

    def run(ids, texts, hashes):
        n_sh, d1, d2, s1, s2, keys = [], [], [], [], [], []
        for text in texts:
            s = shingle_set(text, words)
            n_sh.append(len(s))
            if not len(s):
                d1.append(None), d2.append(None), s1.append(None), s2.append(None), keys.append(None)
                continue
            digest = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), dtype=np.int64)
            sig = signature(s, max(bands * rows, SKETCH_BITS))
            low = np.packbits((sig[:SKETCH_BITS] >> 9 & 1).astype(np.uint8)).view(np.int64)
            k = np.arange(bands, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for j in range(rows):
                    k = _mix64(k * _MULT + sig[: bands * rows].reshape(bands, rows)[:, j])
            d1.append(int(digest[0])), d2.append(int(digest[1])), s1.append(int(low[0])), s2.append(int(low[1])), keys.append(k.view(np.int64))
        return {"doc_id": ids, "th": hashes, "n_shingles": n_sh, "d1": d1, "d2": d2, "s1": s1, "s2": s2, "keys": pa.array(keys, pa.list_(pa.int64()))}

    return map_rows(docs.select("doc_id", "text", F.xxhash64("text")), "doc_id long, th long, n_shingles long, d1 long, d2 long, s1 long, s2 long, keys array<long>", run)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``rep, items, parity``: the full sets of the classes ``wanted (rep, doc_id, th, d1, d2)``, and their
    parity sketches. One text is chosen for each before anything is made of it."""
    import xxhash

    def run(ids, texts, firsts, seconds):
        reps, items, parity = [], [], []
        for i, text, d1, d2 in zip(ids, texts, firsts, seconds, strict=True):
            found = shingle_set(text, words)
            raw = found.tobytes()
            if tuple(np.frombuffer(xxhash.xxh128_digest(raw), dtype=np.int64)) == (d1, d2):
                odd = np.bincount((found % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
                reps.append(i), items.append(raw), parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        return {"rep": reps, "items": items, "parity": pa.array(parity, pa.list_(pa.int64()))}

    own = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    texts = own.join(wanted, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    return map_rows(texts.select("rep", "text", "d1", "d2"), "rep long, items binary, parity array<long>", run, rows=200)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets have 100 * intersection >= percent * union."""

    def run(a, b, x, y):
        keep_a, keep_b = [], []
        for i, j, p, q in zip(a, b, x, y, strict=True):
            p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            if 100 * both >= percent * (len(p) + len(q) - both):
                keep_a.append(i), keep_b.append(j)
        return {"a": keep_a, "b": keep_b}

    left, right = sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    return map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), "a long, b long", run)


def components(edges: DataFrame, prefix: str = "labels") -> DataFrame:
    """``rep, comp``: the smallest vertex that each vertex of ``edges (a, b)`` reaches. Each round
    takes the smallest label of the neighbours, then the label of the label."""
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    labels = stash(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), prefix)
    while True:
        near = both.join(labels.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "rep").select("rep", "comp", F.least("comp", "near").alias("now"))
        jump = labels.select(F.col("rep").alias("now"), F.col("comp").alias("next"))
        new = stash(lower.join(jump, "now", "left").select("rep", F.col("comp").alias("was"), F.least("now", F.coalesce("next", "now")).alias("comp")), prefix)
        done = new.filter("was <> comp").isEmpty()
        discard(labels)
        labels = columns_of(new, "rep", "comp")
        if done:
            discard(both)
            return labels


def with_links(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels (rep, comp)`` after the links ``(a, b)``: only the components that the links join are
    worked on, not the links of rounds before."""
    if labels is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        known = labels.select(F.col("rep").alias(end), F.col("comp").alias(f"c{end}"))
        ends = ends.join(known, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    ends = stash(ends, "ends")
    merged = components(ends.filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    every = labels.union(ends.select("a", "ca")).union(ends.select("b", "cb")).distinct()
    now = merged.select(F.col("rep").alias("comp"), F.col("comp").alias("now"))
    out = stash(every.join(now, "comp", "left").select("rep", F.coalesce("now", "comp").alias("comp")), "labels")
    discard(ends, labels, merged)
    return out


def _members(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS_PER_BAND, star_rounds: int = STAR_ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, n_shingles, comp, component_id`` of every row: ``th`` is the hash of its text, ``comp`` its
    component and ``component_id`` the smallest id in it, which components of one id's texts may share. Both
    are null for rows without an id, and may be for those that are linked with nothing."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stash(_signed(docs, words, bands, rows), "signed")
    usable = signed.filter("doc_id is not null and n_shingles > 0")
    meta = F.struct("th", "n_shingles", "s1", "s2", "keys")
    classes = stash(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("copies"), F.min_by(meta, F.struct("doc_id", "th")).alias("m")), "classes")
    # a class goes by its smallest id; where texts under one id are the first of several classes, the others go by their digest
    several = stash(classes.groupBy("own").agg(F.count(F.lit(1)).alias("classes"), F.min(F.struct("d1", "d2")).alias("head")).filter("classes > 1").drop("classes"), "several")
    unique = several.isEmpty()
    if unique:
        classes = classes.withColumn("rep", F.col("own"))
    else:
        other = F.col("head").isNotNull() & (F.col("head") != F.struct("d1", "d2"))
        classes = stash(classes.join(several, "own", "left").withColumn("rep", F.when(other, -1 - F.shiftrightunsigned(F.xxhash64("d1", "d2"), 1)).otherwise(F.col("own"))).drop("head"), "classes")

    spread = classes.select("rep", F.explode("m.keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("key")
    sizes = classes.select("rep", F.col("m.n_shingles").alias("n"), F.col("m.s1").alias("s1"), F.col("m.s2").alias("s2"))
    buckets = stash(spread.join(shared, "key").join(sizes, "rep"), "buckets")
    wanted = classes.select("rep", F.col("own").alias("doc_id"), F.col("m.th").alias("th"), "d1", "d2").join(buckets.select("rep").distinct(), "rep", "left_semi")
    sets = stash(_sets(docs, wanted, words), "sets")

    labels = None
    for turn in range(star_rounds + 1):
        now = buckets.withColumn("comp", F.col("rep")) if labels is None else buckets.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        me = F.struct("rep", "comp", "n", "s1", "s2")
        apart = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(me, F.xxhash64("rep", F.lit(turn))).alias("c")).filter("lo < hi")
        if turn < star_rounds:
            other = apart.select("key", "c.*")
        else:
            now = now.join(apart.select("key"), "key", "left_semi").join(sets.select("rep", "parity"), "rep")
            other = now
        other = other.select("key", *(F.col(x).alias(f"{x}_c") for x in other.columns if x != "key"))
        differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_c"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("s2_c")))
        fits = (100 * F.least("n", "n_c") >= percent * F.greatest("n", "n_c")) & (differ <= SKETCH_LIMIT)
        order = F.col("comp") != F.col("comp_c") if turn < star_rounds else F.col("comp_c") < F.col("comp")
        if turn == star_rounds:
            apart_in = F.aggregate(F.zip_with("parity", "parity_c", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
            fits = fits & (apart_in * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("n_c")))
        pairs = now.join(other, (now["key"] == other["key"]) & order & fits).select(F.least("rep", "rep_c").alias("a"), F.greatest("rep", "rep_c").alias("b")).distinct()
        new = stash(_verified(pairs, sets, percent), "edges", rows=64)
        if not new.isEmpty():
            labels = with_links(labels, new)
        discard(new)
    discard(buckets, sets)

    grouped = classes.withColumn("comp", F.lit(None).cast("long")) if labels is None else classes.join(labels, "rep", "left")
    grouped = grouped.filter("copies > 1 or comp is not null").select("d1", "d2", F.coalesce("comp", "rep").alias("comp"), F.coalesce("comp", "rep").alias("component_id"), "own")
    if not unique:
        smallest = grouped.groupBy("comp").agg(F.min("own").alias("least"))
        grouped = grouped.drop("component_id").join(smallest.withColumnRenamed("least", "component_id"), "comp")
    grouped = grouped.select("d1", "d2", "comp", "component_id")
    out = signed.select("doc_id", "th", "n_shingles", "d1", "d2").join(grouped, ["d1", "d2"], "left")
    return out.select("doc_id", "th", "n_shingles", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("comp", "component_id")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS_PER_BAND, star_rounds: int = STAR_ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row. Rows are linked from a Jaccard
    similarity of ``percent`` / 100 of their sets of shingles of ``words`` words on."""
    whole = F.coalesce("component_id", "doc_id")
    out = _members(docs, words, percent, bands, rows, star_rounds, id_col, text_col)
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS_PER_BAND, star_rounds: int = STAR_ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of linked documents the one row
    with the smallest id (then text by hash; of rows equal in both, any one), and all rows linked with
    nothing. Rows go by id and text together, so a text never goes with another one's id."""
    members = stash(_members(docs, words, percent, bands, rows, star_rounds, id_col, text_col).filter("component_id is not null"), "members")
    keys = members.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "comp").agg(F.count(F.lit(1)).alias("copies"))
    heads = members.groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("head"))
    stays = F.struct(F.col("_id").alias("doc_id"), F.col("_th").alias("th")) == F.col("head")
    marks = stash(keys.join(heads, "comp").select("_id", "_th", stays.alias("_stays"), "copies").filter("not _stays or copies > 1").drop("copies"), "marks")
    same = lambda m: (docs[id_col].cast("long") == m["_id"]) & (F.xxhash64(docs[text_col]) == m["_th"])
    # few marks, by their count, go to the texts; for more both are dealt by id and text
    few = marks.limit(FEW_MARKS + 1).count() <= FEW_MARKS
    out = docs.join(F.broadcast(marks) if few else marks.hint("merge"), same(marks), "left_anti")
    repeated = stash(marks.filter("_stays"), "repeated")
    if repeated.isEmpty():
        return out
    again = docs.join(repeated, same(repeated)).withColumn("_turn", F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id")))
    return out.unionByName(again.filter("_turn = 1").select(*docs.columns))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, percent=80)
