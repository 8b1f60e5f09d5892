"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Documents are encoded in one pass that keeps only lengths and checksums; longer ones are cut into
pieces of the capacity. The pieces are written to the shared folder, each with a running number, and
then, when they are counted and fixed, dealt in turn to groups of bounded size: a long document's pieces
and rows that are alike spread over all groups, and a task that is run again deals as before. Each group is
packed best-fit decreasing; then pieces are moved, or exchanged one-for-one or two-for-one, between
underfull bins whenever that raises the sum of squared fills, until the emptiest bins are empty, no
exchange helps, or the number of bins is the least possible. What room a group leaves is gathered in its
emptiest bin, so the pieces of these bins, one bin per group, are packed again together in groups of
groups.

Edge cases: null text counts as empty (its end id alone is one piece); repeated rows and null ids
are pieces of their own; an empty table gives no rows; pieces of the full capacity take a sequence
each; ties in length are packed in the order of id, piece and checksum; of a very long text its ids are
held once. Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, word_encoder
from .common import discard, stash

#: Pieces in a group that one task packs.
GROUP = 16384
#: Groups whose emptiest bins are packed again by one task.
MERGED = 256
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, turn``: the pieces of every whole text, numbered in
    turn within a task, from the task's own number on."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, turn = word_encoder(path), TaskContext.get().partitionId()
        for b in batches:
            out = []
            for doc_id, text in zip(*b.columns, strict=True):
                ids = enc.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part), turn))
                    turn += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], ["doc_id", "piece", "start", "length", "ids_crc32", "turn"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"{_PIECE}, turn long")


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each piece, best-fit decreasing: the fullest bin that still has room, else a new one."""
    bin_of, open_bins, mask, n = [0] * len(lengths), {}, 0, 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bin_of[i] = b
        if left := room - size:
            open_bins.setdefault(left, []).append(b)
            mask |= 1 << left
    return bin_of


def local_search(lengths: np.ndarray, bin_of: np.ndarray, capacity: int) -> np.ndarray:
    """Moves, one-for-one and two-for-one exchanges between underfull bins. Each raises the sum of
    squared fills, so the search ends; it stops early at the least possible number of bins."""
    bin_of = bin_of.copy()
    n = int(bin_of.max()) + 1 if len(bin_of) else 0
    fill = np.bincount(bin_of, weights=lengths, minlength=n).astype(np.int64)
    least, used = -(-int(lengths.sum()) // capacity), n
    under = np.flatnonzero(fill < capacity)
    items = np.flatnonzero(np.isin(bin_of, under))
    size = lengths[items]

    def improve(donor: int) -> bool:
        """One best step that takes load out of ``donor``; False if none."""
        mine = items[bin_of[items] == donor]
        other = np.flatnonzero(bin_of[items] != donor)
        if not len(mine) or not len(other):
            return False
        room = capacity - fill
        targets = under[(under != donor) & (fill[under] > 0)]
        for i in sorted(mine, key=lambda i: -lengths[i]):  # a move: into the fullest bin that takes it
            x = lengths[i]
            fit = targets[(room[targets] >= x) & (fill[targets] + x > fill[donor])]
            if len(fit):
                b = int(fit[np.argmax(fill[fit])])
                fill[b] += x
                fill[donor] -= x
                bin_of[i] = b
                return True
        b_of, y = bin_of[items[other]], size[other]
        free, gap = room[b_of], fill[b_of] - fill[donor]
        each = {int(lengths[i]): (int(i),) for i in mine}
        two = {}
        for k, i in enumerate(mine):
            for j in mine[k + 1 :]:
                two.setdefault(int(lengths[i] + lengths[j]), (int(i), int(j)))
        for offers in (each, two):  # an exchange: what fills the other bin most
            for x in sorted(offers, reverse=True):
                more = x - y
                good = np.flatnonzero((more > 0) & (more <= free) & (gap + more > 0))
                if len(good):
                    k = good[np.argmin(free[good] - more[good])]
                    j, b, d = int(items[other[k]]), int(b_of[k]), int(more[k])
                    fill[b] += d
                    fill[donor] -= d
                    bin_of[j] = donor
                    for i in offers[x]:
                        bin_of[i] = b
                    return True
        return False

    changed = True
    while changed and used > least:
        changed = False
        for donor in under[np.argsort(fill[under], kind="stable")]:
            while fill[donor] and used > least and improve(int(donor)):
                changed = True
            if not fill[donor]:
                used = int((fill > 0).sum())
            if used <= least:
                break
    return bin_of


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece."""
    bins = np.asarray(best_fit(lengths.tolist(), capacity), dtype=np.int64)
    return local_search(lengths, bins, capacity)


def _pack_groups(pieces: DataFrame, capacity: int, first_id: int) -> DataFrame:
    """Packs each ``grp`` by itself; adds ``sequence_id, offset`` and ``open``, which marks the emptiest
    bin if it is not full."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "start")])
        lengths = table["length"].to_numpy().astype(np.int64)
        bins = pack(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        heads = np.searchsorted(bins[order], bins[order], side="left")
        offset = np.empty_like(lengths)
        offset[order] = before - before[heads]
        fill = np.bincount(bins, weights=lengths)
        fill[fill == 0] = capacity  # bins that the search has emptied
        emptiest = int(np.argmin(fill))
        group = table["grp"][0].as_py()
        for name, col in (("sequence_id", first_id + (group << 32) + bins), ("offset", offset), ("open", (bins == emptiest) & (fill[emptiest] < capacity))):
            table = table.append_column(name, pa.array(col))
        return table

    return pieces.groupBy("grp").applyInArrow(run, f"{_PIECE}, grp long, sequence_id long, offset long, open boolean")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    pieces = stash(cut_pieces(docs, path, end_id, capacity, id_col, text_col), "pieces")
    groups = max(1, -(-pieces.count() // group))
    packed = stash(_pack_groups(pieces.withColumn("grp", F.expr(f"turn % {groups}")).drop("turn"), capacity, 0), "packed")
    discard(pieces)
    if groups > 1:
        left = packed.filter("open").drop("sequence_id", "offset", "open")
        again = left.withColumn("grp", F.expr(f"grp div {MERGED}"))
        packed = packed.filter("not open").unionByName(_pack_groups(again, capacity, 1 << 61))
    return packed.drop("grp", "open")


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("word_bpe_49k.json"))
