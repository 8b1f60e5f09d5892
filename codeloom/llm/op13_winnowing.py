"""Fingerprints of documents by winnowing, in DataFrame expressions alone.

A hash after Karp and Rabin rolls over the code points of a text: the polynomial of each gram follows
from those of its two halves, theirs from their halves, so a k-gram costs log k steps wherever it
stands. (A fold that takes one code point in and one out at a time gives the same polynomials; as an
expression over arrays it takes twice as long.) Of each window of ``WINDOW`` consecutive k-grams the least value
is kept, the rightmost one of equal values, with its place. So any passage of K + WINDOW - 1 = 64
code points that two texts share gives them a common fingerprint, wherever it stands, and nothing
shorter than a k-gram does.

A text is cut into pieces by one pass of a pattern; each piece is hashed with the code points that
its last window needs of the next piece. Where a text is put together from parts of two others, only
the windows over the seam are hashed, as all others are windows of the parts. So the work is linear in the text's length, and the arrays
of a row in hand are those of a piece; a row holds its text and its fingerprint, about one value for
25 code points. Hashes have 51 bits; two texts are compared by the Jaccard similarity of their hashes.

``successive`` compares each document with the next one in descending order of ids. Documents are
dealt to ranges of the order in buckets of ``2 ** BUCKET_BITS`` ids, so one shuffle of the texts brings the
neighbours together; the last document of a bucket meets the first of the next bucket in a join of
those alone. Bucket numbers are placed by ranges too, so no task sees the whole order.

Edge cases: null text is empty, with an empty fingerprint; a text shorter than a k-gram is one gram,
and fewer grams than a window are one window; two empty fingerprints have the likeness 1, an empty
one and another 0; null ids come last, among themselves by a hash of their text, then the text;
documents with equal ids follow by text, so repeated rows are next to each other; a single document
is its own next; an empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, stash

#: Code points of a gram, and grams of a window.
K, WINDOW = 16, 49
#: Hashes of parts of a gram are polynomials in ``BASE`` modulo ``PRIME``; those of grams join two parts modulo ``LARGE``.
PRIME, BASE, LARGE, JOIN = (1 << 31) - 1, 1_000_003, (1 << 51) - 129, 1_640_531_527
#: Code points of a piece, bits of a place within a piece beside its value.
PIECE, PLACE_BITS = 1024, 11
#: A bucket has 2 ** this many ids.
BUCKET_BITS = 8


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _hashes(codes: Column, n: int) -> Column:
    """The hashes of all n-grams of some code points, each from those of two shorter ones; places without a whole
    gram are null."""
    if n == 1:
        return codes
    left, right = (n // 2, n // 2) if n % 2 == 0 else (n - 1, 1)
    times = pow(BASE, right, PRIME)
    rest = (lambda known: known) if left == right else (lambda known: codes)
    return _let(_hashes(codes, left), lambda known: F.transform(known, lambda x, i: (x * times + F.get(rest(known), i + left)) % PRIME))


def _grams(codes: Column, k: int) -> Column:
    """The values of all k-grams, each beside its place from the end of a piece. The last step joins the hashes of
    both parts in a larger field. Fewer code points than k count as if zeros stood before them."""
    left, right = (k // 2, k // 2) if k % 2 == 0 else (k - 1, 1)

    def joined(padded: Column) -> Column:
        rest = (lambda known: known) if left == right else (lambda known: padded)
        mask = (1 << PLACE_BITS) - 1
        return _let(_hashes(padded, left), lambda known: F.transform(known, lambda x, i: (x * JOIN + F.get(rest(known), i + left)) % LARGE * (mask + 1) + (F.lit(mask) - i)))

    short = F.size(codes) < k
    return _let(F.when(short, F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(k) - F.size(codes)), codes)).otherwise(codes), joined)


def _minima(values: Column, window: int) -> Column:
    """Of some values, each beside its place from the end, the least of each window, without repeats."""
    def place(v: Column) -> Column:
        return F.lit(1 << PLACE_BITS) - v.bitwiseAND((1 << PLACE_BITS) - 1)

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        gone = place(v) - place(last) >= window  # the least value has left the window: look through it
        return F.when(v < last, F.array_append(acc, v)).when(gone, F.array_append(acc, F.array_min(F.slice(values, (place(v) - window + 1).cast("int"), window)))).otherwise(acc)

    return F.aggregate(F.slice(values, window + 1, PIECE), F.array(F.array_min(F.slice(values, 1, window))), step)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """``array<struct<hash: bigint, place: bigint>>``: the fingerprint of a text that is not null, by place (code
    points from 0). ``k + window`` is at most ``PIECE``."""
    if k + window > PIECE:
        raise ValueError("a window must fit into a piece")
    mask = (1 << PLACE_BITS) - 1
    none = F.expr("cast(array() as array<struct<hash: bigint, place: bigint>>)")

    def of_piece(pieces: Column, piece: Column, j: Column) -> Column:
        over = F.substring(F.coalesce(F.get(pieces, j + 1), F.lit("")), 1, window + k - 2)

        def of_codes(codes: Column) -> Column:
            grams = F.when(j == 0, F.greatest(F.size(codes) - (k - 1), F.lit(1))).otherwise(F.size(codes) - (k - 1))
            has = (j == 0) | (grams >= window)
            packed = F.slice(_grams(codes, k), F.lit(1), F.greatest(F.least(grams, F.lit(PIECE + window - 1)), F.lit(0)))
            least = _let(packed, lambda values: _minima(values, window))
            named = F.transform(least, lambda v: F.struct(F.shiftright(v, PLACE_BITS).alias("hash"), (j.cast("long") * PIECE + mask - v.bitwiseAND(mask)).alias("place")))
            return F.when(has, named).otherwise(none)

        return _let(F.transform(F.split(F.concat(piece, over), ""), lambda c: F.ascii(c).cast("long")), of_codes)

    whole = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0), lambda pieces: F.flatten(F.transform(pieces, lambda piece, j: of_piece(pieces, piece, j))))
    # the last minimum of a piece may be the first one of the next
    return _let(whole, lambda found: F.filter(found, lambda x, i: (i == 0) | (F.get(found, i - 1)["place"] != x["place"])))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.coalesce(F.col(text_col), F.lit(""))).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""
    x, y = a["hash"], b["hash"]
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def _within(prints: Column, windows: Column, window: int) -> Column:
    """The part of a fingerprint that comes from its text's first so many windows. A print is first chosen by the
    window that it enters last, if no greater than the one before it, else by the window that the latter has left."""

    def first(x: Column, i: Column) -> Column:
        before = F.get(prints, i - 1)
        return F.when(i == 0, F.lit(0).cast("long")).when(x["hash"] <= before["hash"], x["place"] - (window - 1)).otherwise(before["place"] + 1)

    return F.filter(prints, lambda x, i: first(x, i) < windows)


def _moved(prints: Column, by: Column) -> Column:
    return F.transform(prints, lambda x: F.struct(x["hash"].alias("hash"), (x["place"] + by).alias("place")))


def spliced(text: Column, prints: Column, after: Column, after_prints: Column, cut: Column, head: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint of the first ``cut`` code points of a text with the first ``head`` of another behind
    them, from both fingerprints: only the windows over the seam are hashed again."""
    reach = k + window - 1  # code points of a window
    none = F.expr("cast(array() as array<struct<hash: bigint, place: bigint>>)")

    def joined(at: Column) -> Column:
        cut, head = at["cut"], at["head"]
        begin = F.greatest(cut - (reach - 1), F.lit(0))
        seam = F.concat(F.substring(text, begin + 1, cut - begin), F.substring(after, F.lit(1), F.least(head, F.lit(reach - 1))))
        # behind a start that is left out, only whole windows count
        over = _let(seam, lambda x: F.when((begin > 0) & (F.char_length(x) < reach), none).otherwise(_moved(fingerprint(x, k, window), begin.cast("long"))))
        return F.concat(_within(prints, cut - (reach - 1), window), over, _moved(_within(after_prints, head - (reach - 1), window), cut.cast("long")))

    parts = _let(F.struct(cut.alias("cut"), head.alias("head")), joined)
    return _let(parts, lambda found: F.filter(found, lambda x, i: (i == 0) | (F.get(found, i - 1)["place"] != x["place"])))


def _beside(rows: DataFrame) -> DataFrame:
    """``edited_sha256, edited_fingerprint, near_next`` from ``text, fingerprint, after, after_print``. The last half
    of the code points, rounded down, makes way for the first as many of the next text."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    cut, head = F.char_length("text") - half, F.least(half, F.char_length("after"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), cut), F.substring(F.col("after"), F.lit(1), half))
    prints = spliced(F.col("text"), F.col("fingerprint"), F.col("after"), F.col("after_print"), cut, head)
    return rows.withColumns({"edited_sha256": F.sha2(edited, 256), "edited_fingerprint": prints, "near_next": likeness(F.col("fingerprint"), F.col("after_print"))})


def successive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_next, near_edited`` of every
    row: its fingerprint beside the next document's, in descending order of ids (after the last the first
    follows), and beside that of its text with the last half replaced by the start of the next one."""
    text, number = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    rows = docs.select(number.alias("doc_id"), text.alias("text"))
    # ids in buckets; those without one come last, spread by their text
    bucket = F.coalesce(F.shiftright("doc_id", BUCKET_BITS), F.lit(-(1 << 62)))
    rows = rows.withColumn("bucket", bucket).withColumn("sub", F.when(F.col("doc_id").isNull(), F.shiftright(F.xxhash64("text"), 40)).otherwise(F.lit(0).cast("long")))
    dealt = rows.repartitionByRange(F.col("bucket").desc(), F.col("sub"))
    order = Window.partitionBy("bucket", "sub").orderBy(F.col("doc_id").desc(), "text")
    own = dealt.withColumn("fingerprint", fingerprint(F.col("text")))
    beside = own.withColumns({"after": F.lead("text").over(order), "after_print": F.lead("fingerprint").over(order), "first": F.row_number().over(order) == 1})
    beside = beside.withColumn("last", F.col("after").isNull()).withColumn("n_chars", F.char_length("text").cast("long"))
    columns = ["doc_id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_next"]
    found = _beside(beside).select(*columns, "bucket", "sub", "first", "last", F.when(F.col("first") | F.col("last"), F.col("text")).alias("text"))
    found = stash(found, "found")

    # the last row of a bucket and the first of the next one
    places = numbered(found.filter("first").select("bucket", "sub", F.col("text").alias("after"), F.col("fingerprint").alias("after_print")), [F.col("bucket").desc(), F.col("sub")], "place")
    count = places.agg(F.count(F.lit(1)).alias("buckets"))
    lasts = found.filter("last").select("doc_id", "n_chars", "fingerprint", "bucket", "sub", "text").join(places.select("bucket", "sub", "place"), ["bucket", "sub"])
    lasts = lasts.join(F.broadcast(count)).withColumn("place", F.col("place") % F.col("buckets") + 1)  # one row
    lasts = _beside(lasts.join(places.select("place", "after", "after_print"), "place")).select(columns)
    every = found.filter("not last").select(columns).unionByName(lasts)
    return every.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))


def _written(prints: Column) -> Column:
    """hash:place of each, joined by commas; hashes in lowercase hex."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["place"].cast("string"))), ",")


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = successive(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return x.select("doc_id", "n_chars", "edited_sha256", _written(F.col("fingerprint")).alias("fingerprint"), _written(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
