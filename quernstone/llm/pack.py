"""Sequence packing: shortest-pack-first over the length histogram (operator 5).

Documents are cut into pieces of the sequence length and one shorter rest.  The
histogram of piece lengths (at most 1,024 rows) decides everything: lengths are
placed longest first, each into the pack that is shortest so far and has room,
and only counts of packing patterns are kept.  Patterns come back to documents
by rank: the n-th piece of a length takes the n-th place that the patterns hold
for that length.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c
from .bpe import SPLIT, byte_alphabet

LENGTH = 1024
#: Pieces of one length that are ranked in one task.
BUCKET_ROWS = 1 << 17
PIECE = "id long, start long, length int, ids_crc32 long, doc_tokens long"


def spfhp(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packing patterns.

    Lengths go longest first; each goes into the shortest pack with room, that is the
    one with most room left, as often as it fits there, and a pattern's count is split
    where it is not used up.  Copies that no pack has room for open new packs, again
    with as many as fit, so that a length which most pieces have fills its packs.  A
    step adds at most three patterns.
    """
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []  # as a heap, most room first
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        fresh: list[tuple[int, list]] = []
        while left and rooms and -rooms[0] >= length:
            room = -rooms[0]
            held = by_room[room]
            count, pattern = held.pop()
            copies = min(room // length, left)
            used = min(count, left // copies)
            left -= used * copies
            if count > used:
                held.append([count - used, pattern])
            if not held:
                heapq.heappop(rooms)
                del by_room[room]
            fresh.append((room - length * copies, [used, (*pattern, *(length,) * copies)]))
        copies = capacity // length
        if left >= copies:
            fresh.append((capacity - length * copies, [left // copies, (length,) * copies]))
            left %= copies
        if left:
            fresh.append((capacity - length * left, [1, (length,) * left]))
        for room, x in fresh:
            if room not in by_room:
                by_room[room] = []
                heapq.heappush(rooms, -room)
            by_room[room].append(x)
    return sorted(((n, p) for held in by_room.values() for n, p in held), key=lambda x: x[1], reverse=True)


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) of each run of places that the patterns hold."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            rows.append((length, rank, count, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return rows


def place_ranked(pieces: DataFrame, capacity: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add sequence_id and offset to pieces with columns id, start, length, ids_crc32 and doc_tokens.

    Ranks are made of counts per (length, bucket of the id's hash) and row numbers
    inside; a length has as many buckets as its count needs.  The driver holds the
    histogram (capacity rows), one row a bucket (the pieces over bucket_rows, and
    capacity) and the places of the patterns, of which there are at most three for
    each length (some thousands of places on real lengths); these are what is
    broadcast.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    buckets = spark.createDataFrame([(k, -(-n // bucket_rows)) for k, n in histogram.items()], "length int, buckets long")
    keyed = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.col("buckets"))).drop("buckets")
    cells = sorted((r[0], r[1], r[2]) for r in keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect())
    taken: dict[int, int] = {}
    offsets = []
    for length, bucket, n in cells:
        offsets.append((length, bucket, taken.get(length, 0)))
        taken[length] = taken.get(length, 0) + n
    runs: dict[int, list] = {}
    for length, rank, n, sequence, offset in places(spfhp(histogram, capacity)):
        runs.setdefault(length, []).append((rank, sequence, offset))
    first = spark.createDataFrame(offsets, "length int, bucket long, before long")
    run_type = "struct<rank:bigint,sequence:bigint,offset:bigint>"
    table = spark.createDataFrame([(k, [dict(zip(("rank", "sequence", "offset"), x)) for x in sorted(v)]) for k, v in runs.items()], f"length int, runs array<{run_type}>")
    inside = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32")
    ranked = keyed.withColumn("rn", F.row_number().over(inside) - 1).join(F.broadcast(first), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("rn"))

    def last_run(runs):
        return F.element_at(F.filter(runs, lambda x: x["rank"] <= F.col("rank")), -1)

    placed = ranked.join(F.broadcast(table), "length").withColumn("run", last_run(F.col("runs")))
    return placed.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("run.sequence") + F.col("rank") - F.col("run.rank")).alias("sequence_id"), F.col("run.offset").alias("offset"))


_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """A fast merge-rank encoder made from the vocabulary file; gives the ids of the file's own library."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[x] for x in t): i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {k: v for k, v in ranks.items() if v not in special.values()}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def cut(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids followed by end_id: full pieces, then one rest."""
    c.ship(docs.sparkSession)

    def run(batches):
        enc, tail = _encoder(tokenizer), end_id.to_bytes(4, "little")
        for b in c.slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packed = enc.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes() + tail
                n = len(packed) // 4
                for start in range(0, n, capacity):
                    piece = packed[4 * start : 4 * (start + capacity)]
                    for col, v in zip(out, (i, start, len(piece) // 4, zlib.crc32(piece), n)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def pack(docs: DataFrame, tokenizer: str, capacity: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and has the end id alone.  Repeated rows are
    packed each; an empty table gives an empty result.  The pieces are written
    once to the shared folder, so that texts are encoded a single time.  A single
    text is encoded whole, in memory of some ten times its size.
    """
    pieces = c.settle(cut(docs, tokenizer, capacity))
    return place_ranked(pieces, capacity).select(F.col("id").alias("doc_id"), "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(c.table(spark, sf_dir, "documents"), c.default_tokenizer())
