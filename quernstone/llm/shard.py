"""Sharding into equal bytes by a minimax contiguous partition (operator 6, DataFrame functions only).

Rows with equal texts form one atomic group (null is a group of its own).  Groups
stand in the order of a 64-bit hash of the text.  The smallest capacity for which
a greedy walk over the group sizes needs no more than the wanted shards is found
by binary search, and the walk with that capacity sets the cuts.

The walk never sees all groups.  The first 14 bits of the hash make at most
16,384 ranges whose sums the driver holds; capacities for whole ranges bound the
optimum from above, total and largest group from below.  Only ranges in which a
cut can fall between the bounds are opened to their groups, by more hash bits at
a time, so the driver holds a bounded table at any size of the input.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

SHARDS = 24
RANGE_BITS = 14
CELLS = 256


def greedy(sizes: list[int], ends: list[int], capacity: int, most: int) -> list[int] | None:
    """Cuts (first item of each shard but the first) of the greedy walk, None if it needs more than most shards."""
    cuts, at, used = [], 0, 0
    while at < len(sizes):
        nxt = bisect_right(ends, used + capacity)
        if nxt == at or len(cuts) == most:
            return None
        cuts.append(at)
        at, used = nxt, ends[nxt - 1]
    return cuts[1:]


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that holds ordered atomic sizes in so many contiguous shards, and its cuts."""
    if not sizes:
        return 0, []
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy(sizes, ends, low, shards)


def _between(sizes: list[int], ends: list[int], low: int, high: int, largest: int, shards: int) -> set[int]:
    """Spans in which a greedy cut can fall for a capacity from low to high.

    Greedy cuts never move back when the capacity grows.  Whole spans within low
    bound them from below, sums of high from above.
    """
    found: set[int] = set()
    least = most = 0
    for _ in range(shards):
        i = bisect_right(ends, least + low)
        least = max(ends[i - 1] if i else 0, least + low - largest, least)
        most += high
        if least >= ends[-1]:
            break
        i = bisect_right(ends, least)
        while i < len(ends) and (ends[i - 1] if i else 0) <= most:
            found.add(i)
            i += 1
    return found


def _cuts(groups: DataFrame, shards: int, bits: int = RANGE_BITS, most_rows: int = 1 << 20) -> list[int]:
    """The hash that each shard but the first begins with. groups: (h, size), one row each."""

    def spans_of(rows: DataFrame, free: int) -> list[tuple[int, int, int]]:
        """(first hash, free bits, bytes) of ranges of hashes; a range of one group has no free bits."""
        found = rows.groupBy(F.shiftright("h", free).alias("r")).agg(F.sum("size"), F.count("*"), F.min("h")).collect()
        return [(r[3], 0, r[1]) if r[2] == 1 else (r[0] << free, free, r[1]) for r in found]

    spans = sorted(spans_of(groups, 64 - bits))
    largest = groups.agg(F.max("size")).first()[0] or 0
    while spans:
        sizes = [s for *_, s in spans]
        ends = list(accumulate(sizes))
        high, cuts = minimax(sizes, shards)
        low = max(largest, -(-ends[-1] // shards))
        open_ = {i for i in _between(sizes, ends, low, high, largest, shards) if spans[i][1]} if high > low else set()
        if not open_:
            return [spans[i][0] for i in cuts]
        step = bits
        while step > 1 and len(open_) << step > most_rows:
            step -= 1
        parts = []
        for free in {spans[i][1] for i in open_}:
            inside = groups.where(F.shiftright("h", free).isin([spans[i][0] >> free for i in open_ if spans[i][1] == free]))
            parts += spans_of(inside, max(0, free - step))
        spans = sorted([x for i, x in enumerate(spans) if i not in open_] + parts)
    return []


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    size is the text's UTF-8 bytes (null: none) plus 8.  slot counts from 0
    without gaps inside a shard, by cells of the id's hash and then by id, so that
    no task sorts a whole shard; ties of repeated ids are broken by size and crc.
    An empty table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col)
    slim = c.settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        )
    )
    groups = slim.groupBy("h").agg(F.sum("size").alias("size"))
    cuts = _cuts(groups, shards)
    shard: Column = F.lit(0)
    for x in cuts:
        shard = shard + (F.col("h") >= F.lit(x)).cast("int")
    placed = slim.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x cells rows, so it is broadcast
    offsets = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("offset") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(c.table(spark, sf_dir, "documents"))
