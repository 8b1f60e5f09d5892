"""Minimax contiguous partition of ordered atomic groups into shards, by bytes.

DataFrame operations alone; the search itself is arithmetic on a bounded number of sums. Rows with
equal texts are one atomic group. Groups are ordered by their smallest id (then by hash), cut
into ranges, and given exact prefix sums. The smallest capacity with which a greedy walk needs no
more than the wanted number of shards is found by binary search. The driver first brackets it with the
sums of at most ``BLOCKS`` ranges; the few stretches in which a cut may then fall are refined by
further sums, until their groups are at most ``FETCH``, whose prefix sums are read. So the answer is
exact whatever the number of groups. Shards are cut where the greedy walk with that capacity cuts.

The hot group's rows meet its one row in a join that the adaptive planner splits. Slots follow the ids:
rows are dealt to ranges of (shard, id) and numbered in each after the sizes of the ranges before, at
every size, so no task handles a whole shard.

Edge cases: null text counts as empty, with size 1 and checksum 0; null ids order first; repeated
rows are rows of one group; a group larger than the even share sets the capacity; fewer groups than
shards leave shards empty; an empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, numbered, stash

BLOCKS, FETCH = 2048, 200_000


def greedy_cuts(known: list[int], capacity: int) -> list[int]:
    """Ends of the shards when each takes as many groups as fit; ``known`` are sorted prefix sums from
    0 to the total. A step that cannot advance ends the walk early."""
    ends, at = [], 0
    while at < known[-1]:
        nxt = known[bisect_right(known, at + capacity) - 1]
        if nxt <= at:
            break
        ends.append(nxt)
        at = nxt
    return ends


def smallest_capacity(known: list[int], shards: int, low: int, high: int) -> int:
    """The smallest capacity in ``low..high`` with which the greedy walk needs at most ``shards``."""
    while low < high:
        mid = (low + high) // 2
        ends = greedy_cuts(known, mid)
        if ends and ends[-1] == known[-1] and len(ends) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def bracket(known: list[int], shards: int, largest: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Bounds of the capacity from some of the prefix sums, and the stretches ``(from, to]`` of
    prefix sums in which cuts may fall at any capacity within the bounds."""
    total = known[-1]
    low, high = max(largest, -(-total // shards)), total
    sure = smallest_capacity(known, shards, low, high)  # with fewer places to cut it is feasible all the same
    stretches, at_low, at_high = [], 0, 0
    for _ in range(shards - 1):
        # the earliest cut: at the lower bound, and no further back than a group; the latest: at the upper
        at_low = max(known[bisect_right(known, at_low + low) - 1], at_low + low - largest)
        at_high = min(at_high + sure, total)
        if at_low >= total:
            break
        stretches.append((known[max(bisect_right(known, at_low) - 1, 0)], known[min(bisect_right(known, at_high), len(known) - 1)]))
    merged: list[tuple[int, int]] = []
    for lo, hi in stretches:
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return low, sure, merged


def minimax_cuts(groups: DataFrame, starts: list[int], shards: int, largest: int, total: int) -> list[int]:
    """Ends of the shards. ``groups`` has ``cum``, the sum up to and with each group; ``starts`` are
    known prefix sums."""
    known = sorted({0, total, *starts})
    while True:
        low, high, stretches = bracket(known, shards, largest)
        if not stretches or low == high and greedy_cuts(known, low)[-1:] == [total] and len(greedy_cuts(known, low)) <= shards:
            break
        inside = F.lit(False)
        for lo, hi in stretches:
            inside = inside | ((F.col("cum") > lo) & (F.col("cum") <= hi))
        part = groups.filter(inside)
        n = part.count()
        if n <= FETCH:
            known = sorted({*known, *(r.cum for r in part.select("cum").distinct().collect())})
            low, high, _ = bracket(known, shards, largest) if n else (low, high, [])
            break
        width = max(1, sum(hi - lo for lo, hi in stretches) // BLOCKS)
        more = part.groupBy(F.expr(f"cum div {width}L").alias("w")).agg(F.max("cum").alias("cum")).collect()
        known = sorted({*known, *(r.cum for r in more)})
    return greedy_cuts(known, smallest_capacity(known, shards, low, high))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"),
    )
    rows = stash(rows, "rows")
    groups = rows.groupBy("g1", "g2").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    order = ["first", "g1", "g2"]
    n_rows = rows.count()
    blocks = max(1, min(BLOCKS, n_rows // 4000))
    placed = stash(groups.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()), "groups")
    sums = placed.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))  # a row for each range
    so_far = F.sum("bytes").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("block", "largest", "bytes", F.coalesce(so_far, F.lit(0)).alias("before"))
    found = offsets.collect()
    if not found:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    starts, total = [r.before for r in found], sum(r.bytes for r in found)
    cum = F.col("before") + F.sum("bytes").over(Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = stash(placed.join(F.broadcast(offsets.select("block", "before")), "block").select("g1", "g2", "bytes", cum.alias("cum")), "summed")
    discard(placed)
    ends = minimax_cuts(summed, starts, shards, max(r.largest for r in found), total)
    shard = sum((F.when(F.col("cum") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    dealt = stash(rows.join(summed.select("g1", "g2", shard.alias("shard")), ["g1", "g2"]).drop("g2"), "dealt")
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))  # a row for each shard
    firsts = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_place"))
    placed = numbered(dealt, ["shard", "doc_id", "g1"], "place").join(F.broadcast(firsts), "shard")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place") - 1).cast("long").alias("slot"))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return x.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
