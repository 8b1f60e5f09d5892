"""Length-delimited binary token records with a separate offset index.

A data file is a run of frames: payload length (u64), masked checksum of those eight bytes (u32),
payload, masked checksum of the payload (u32), all little-endian. The checksum is CRC-32, turned
right by 15 bits and raised by a constant, so that a checksum stored inside a payload is not mistaken
for its own. A payload is one byte that says whether the document has an id, one
with the bytes of a token id (2 where the vocabulary allows it, else 4), the document's id (i64), and the token ids. The index file of a data file holds offset and length (u64 each) of each
frame's payload, so that any record is read with one seek, in any order.

Rows are range-partitioned and sorted by document id, into partitions of ``PART_MB`` MB by the counted
bytes of the texts; each is encoded as it streams by and becomes one file: neither a partition nor a
file is ever held in memory, of a text that is very long only the text itself with its ids. A file gets
its final name only when it is whole, and its content depends on the data alone, so a retried or
speculative task leaves the same file. The manifest, one row per file, is a table as well: its running
sums go over blocks of ``NEAR`` files and then over the blocks, and readers get its rows by a shuffle;
the driver learns the number of files alone.

Edge cases: null text counts as empty (its record holds the end id alone); null document ids come
first; rows of one document id are ordered by a hash of their text, then by the text; rows repeated
under one id and text give a record each, all in one file; an empty table gives no files and no
records; columns other than the two named are not read.
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, word_encoder
from .common import fresh_path, parts_for, stash

#: MB of text in a partition; files whose running sums one task makes.
PART_MB, NEAR = 24, 1024
#: Added to the turned checksum.
MASK_DELTA = 0xA282EAD8
_HEAD, _CRC, _INDEX = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<QQ")
_ID = struct.Struct("<BBq")
#: Sizes of the frame's parts around a payload.
BEFORE, AFTER = _HEAD.size + _CRC.size, _CRC.size


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CRC.pack(masked(head)), payload, _CRC.pack(masked(payload))))


def payload_of(doc_id: int | None, ids: bytes, width: int = 4) -> bytes:
    """``ids``: little-endian u32 each."""
    body = ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()
    return _ID.pack(doc_id is not None, width, doc_id or 0) + body


def parse(payload: bytes) -> tuple[int | None, bytes]:
    has_id, width, doc_id = _ID.unpack_from(payload)
    body = payload[_ID.size :]
    return (doc_id if has_id else None), body if width == 4 else np.frombuffer(body, dtype="<u2").astype("<u4").tobytes()


def filesystem(uri: str):
    """(file system, path) of a file or object-store address, as executors open it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_file(uri: str, records: Iterable[tuple[int | None, bytes]], width: int = 4) -> tuple[int, int]:
    """Writes a data file and its index; (records, tokens)."""
    fs, path = filesystem(uri)
    tmp, n, tokens, at = f"{path}.{uuid.uuid4().hex}", 0, 0, 0
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{tmp}.rec") as data, fs.open_output_stream(f"{tmp}.idx") as index:
        for doc_id, ids in records:
            framed = frame(payload := payload_of(doc_id, ids, width))
            data.write(framed)
            index.write(_INDEX.pack(at + BEFORE, len(payload)))
            at, n, tokens = at + len(framed), n + 1, tokens + len(ids) // 4
    for end in ("rec", "idx"):
        fs.move(f"{tmp}.{end}", f"{path}.{end}")
    return n, tokens


class CorruptRecord(ValueError):
    """A length or payload does not match its checksum."""


def read_file(uri: str) -> Iterator[tuple[int | None, bytes]]:
    """All records of a data file in order, each checksum verified."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(f"{path}.rec", buffer_size=1 << 20) as data:
        while head := data.read(BEFORE):
            if len(head) < BEFORE or masked(head[: _HEAD.size]) != _CRC.unpack_from(head, _HEAD.size)[0]:
                raise CorruptRecord(f"length in {uri}")
            size = _HEAD.unpack_from(head)[0]
            payload, crc = data.read(size), data.read(AFTER)
            if len(payload) < size or len(crc) < AFTER or masked(payload) != _CRC.unpack(crc)[0]:
                raise CorruptRecord(f"payload in {uri}")
            yield parse(payload)


def read_index(uri: str) -> list[tuple[int, int]]:
    """(offset, length) of each payload."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(f"{path}.idx") as f:
        return list(_INDEX.iter_unpack(f.read()))


def shuffled(uri: str, seed: int) -> Iterator[tuple[int | None, bytes]]:
    """All records of a data file in an order drawn from ``seed``, each by one seek."""
    places = read_index(uri)
    random.Random(seed).shuffle(places)
    fs, path = filesystem(uri)
    with fs.open_input_file(f"{path}.rec") as data:
        for at, size in places:
            data.seek(at - BEFORE)
            got = data.read(BEFORE + size + AFTER)
            if got != frame(payload := got[BEFORE : BEFORE + size]):
                raise CorruptRecord(f"record at {at} in {uri}")
            yield parse(payload)


def write_records(docs: DataFrame, dest: str, path: str, end_id: int, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends ``end_id``, and writes records in ascending id order under
    ``dest``. Gives the manifest: ``shard, file, n_records, n_tokens, start`` where ``start`` counts
    the tokens of all files before."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = ["doc_id", F.xxhash64("text"), "text"]
    n = partitions or parts_for(rows, "text", PART_MB)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()

        def records():
            enc = word_encoder(path)
            for b in batches:
                for doc_id, text in zip(*b.columns, strict=True):
                    yield doc_id.as_py(), enc.encode(text.as_py()) + end

        file = f"{dest}/shard-{shard:06d}"
        width = 2 if max(word_encoder(path).tok.get_vocab_size(with_added_tokens=True), end_id) < 1 << 16 else 4
        made, tokens = write_file(file, records(), width)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [file], "n_records": [made], "n_tokens": [tokens]})

    made = rows.repartitionByRange(n, *keys[:2]).sortWithinPartitions(*keys).mapInArrow(run, "shard int, file string, n_records long, n_tokens long")
    made = stash(made, "manifest").withColumn("_far", F.expr(f"shard div {NEAR}"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = made.groupBy("_far").agg(F.sum("n_tokens").alias("t")).withColumn("_base", F.sum("t").over(before(Window.orderBy("_far")))).drop("t")
    inside = F.sum("n_tokens").over(before(Window.partitionBy("_far").orderBy("shard")))
    start = F.coalesce("_base", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return made.withColumn("_inside", inside).join(blocks, "_far").select("shard", "file", "n_records", "n_tokens", start.alias("start"))


def read_records(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids binary`` (little-endian u32) of all records of a manifest, one file per
    task, checksums verified; ``start`` counts the tokens of all records before."""
    places = manifest.filter("n_records > 0").select("shard", "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, file, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, at, held = [], start, 0
                for doc_id, ids in read_file(file):
                    rows.append((doc_id, at, ids))
                    at, held = at + len(ids) // 4, held + len(ids)
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows):
        d, s, i = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.binary())], ["doc_id", "start", "ids"])

    # a file per task, dealt by the files' own numbers
    return places.repartitionByRange(max(1, places.count()), "shard").mapInArrow(run, "doc_id long, start long, ids binary")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_records(docs, fresh_path(spark, "records"), default_path("word_bpe_49k.json"), end_id=2)
    x = read_records(manifest)
    return x.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
