"""Removal of long repeated byte strings from all documents (operator 1).

A byte goes if some string of LENGTH bytes that covers it also starts elsewhere.

Suffixes are brought together by content: of the 16-byte grams inside a string of
LENGTH bytes the one with the smallest hash is its anchor, so equal strings have
the same anchor at the same place.  Consecutive starts with one anchor form a
context.  A context travels under the hash of the half string that all its
strings contain on one side of the anchor.  The distinct contexts of a key, told
apart by 128-bit hashes, are the text whose suffixes are sorted, blockwise and with
a difference-cover sample; equal neighbours in the order repeat.  A context that
occurs several times repeats as a whole, and enters the sort once, for the others;
where a key has no other context there is nothing to sort.

No block of the sort grows with the corpus.  A key under which more than HOT
different contexts meet is split by more of its bytes: its contexts are cut into
runs of 32 starts at fixed distances from the anchor, which travel under the hash
of the 369 bytes that their strings share, and where that is not enough into single
starts under the whole string.  Runs are settled and sorted as contexts are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from .suffix import V, repeated
from .words import _BASE, mix, powers, text_bytes

LENGTH = 400
GRAM = 16
HOT = 1024
#: Starts in a run of a split context, at each level.
WIDTHS = (32, 1)
CHUNK_BYTES = 1 << 20
#: Bytes of text that are hashed at a time; their hashes take some sixty times as much.
TEXT_BYTES = 1 << 20
_U = np.uint64
_VALUE = np.random.default_rng(20240602).integers(1, 1 << 63, 256, dtype=np.uint64)
_INVERSE = pow(_BASE, -1, 1 << 64)
_inverse_powers = np.ones(1, np.uint64)


def _inverse(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        steps = np.full(n, _INVERSE, np.uint64)
        steps[0] = 1
        _inverse_powers = np.multiply.accumulate(steps)
    return _inverse_powers[:n]


class Hashes:
    """Hashes of any substring of a byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers(len(data)), out=self.sums[1:])
        self.back = _inverse(len(data) + 1)

    def of(self, at: np.ndarray, n) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.back[at], 11)


def contexts(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, first start, number of starts, key, place of the first start) of the contexts of texts that lie end to end."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    sizes = np.diff(at)
    mask = np.zeros(len(data) + 1, np.int8)
    long_ = sizes >= length
    if not long_.any():
        return none
    np.add.at(mask, at[:-1][long_], 1)
    np.add.at(mask, (at[1:] - length + 1)[long_], -1)
    starts = np.flatnonzero(np.cumsum(mask[:-1]))
    h = Hashes(data)
    value, low = _gram_order(h)
    width, window = 1, length - GRAM + 1
    while 2 * width <= window:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    rest = window - width
    anchor = (np.minimum(value[starts], value[starts + rest]) & low).astype(np.int64)
    side = (length - GRAM) // 2
    left = starts + side < anchor  # the half string lies before the anchor, and else behind it
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    lo, where, left = starts[first], anchor[first], left[first]
    key = mix(h.of(where - np.where(left, side, 0), side + GRAM) + left.astype(np.uint64), 13)
    text = np.searchsorted(at, lo, "right") - 1
    return text, lo - at[text], count, key, lo


def _gram_order(h: Hashes) -> tuple[np.ndarray, np.uint64]:
    """For each gram its hash with its place in the low bits, and the mask of these."""
    n = len(h.sums) - GRAM
    low = _U((1 << n.bit_length()) - 1)
    return mix((h.sums[GRAM:] - h.sums[:-GRAM]) * h.back[:n], 12) & ~low | np.arange(n, dtype=np.uint64), low


def runs_of(data: np.ndarray, h: Hashes, order: tuple[np.ndarray, np.uint64], lo: int, n: int, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, key) of the runs into which a context is cut at fixed distances from its anchor."""
    value, low = order
    anchor = int(value[lo : lo + length - GRAM + 1].min() & low)
    number = np.arange((lo - anchor) // width, (lo + n - 1 - anchor) // width + 1)
    first = np.maximum(lo, anchor + number * width)
    count = np.minimum(lo + n, anchor + (number + 1) * width) - first
    shared = anchor + (number + 1) * width - 1  # the last start that a whole run has
    return first, count, mix(h.of(shared, length - width + 1) + number.astype(np.uint64) * _U(2) + _U(1), 15 + width)


def whole_hashes(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a 128-bit hash of each stretch."""
    view = memoryview(np.ascontiguousarray(data))
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(view[a:b]) for a, b in zip(lo.tolist(), (lo + size).tolist())])
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


REPEAT, SINGLE, MANY, COMPARE, SPLIT = range(5)
ROW = "key long, whole long, more long, rid long, lo int, n int, kind int"
_NAMES = ["key", "whole", "more", "rid", "lo", "n", "kind"]


def _rows(key, whole, more, rid, lo, n, kind) -> pa.RecordBatch:
    kinds = (np.int64,) * 4 + (np.int32,) * 3
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t, copy=False)) for x, t in zip((key, whole, more, rid, lo, n, kind), kinds)], _NAMES)


def _groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted rows."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = False
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _witnesses(key, whole, more, rid, lo, n):
    """Of contexts that are equal within this part all are settled, and one goes on as a witness."""
    order = np.lexsort((more, whole, key))
    key, whole, more, rid, lo, n = (x[order] for x in (key, whole, more, rid, lo, n))
    new = _groups(key, whole, more)
    many = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1] > 1
    if many.any():
        yield _rows(rid[many], whole[many], more[many], rid[many], lo[many], n[many], np.full(many.sum(), REPEAT))
    yield _rows(key[new], whole[new], more[new], rid[new], lo[new], n[new], np.where(many[new], MANY, SINGLE))


def _emit(length: int):
    def run(batches):
        for b in c.slices(batches, "text", TEXT_BYTES):
            data, at = text_bytes(b.column(1))
            text, lo, n, key, place = contexts(data, at, length)
            if len(text):
                rid = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)[text]
                yield from _witnesses(key.view(np.int64), *whole_hashes(data, place, n + length - 1), rid, lo, n)

    return run


def _split(length: int, width: int):
    """The runs of the contexts under keys that are split."""

    def run(batches):
        for b in c.slices(batches, "text", TEXT_BYTES):
            out: list[tuple] = []
            for rid, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                h = Hashes(data)
                order = _gram_order(h)
                lo, n, key = (np.concatenate(x) for x in zip(*(runs_of(data, h, order, w["lo"], w["n"], length, width) for w in wanted)))
                out.append((key.view(np.int64), *whole_hashes(data, lo, n + length - 1), np.full(len(lo), rid), lo, n))
            if out:
                yield from _witnesses(*(np.concatenate(x) for x in zip(*out)))

    return run


def _meet(hot: int | None):
    """Settle equal contexts of a partition; contexts that differ under one key go on to be compared, or split if they are many."""

    @c.giving_back
    def run(batches):
        parts = []
        for b in batches:
            pick = pa.compute.not_equal(b.column(6), REPEAT)
            done = b.filter(pa.compute.invert(pick))
            if done.num_rows:
                yield done
            parts.append([x.to_numpy() for x in b.filter(pick).columns])
        if not parts:
            return
        key, whole, more, rid, lo, n, kind = (np.concatenate(x) for x in zip(*parts))
        del parts
        if not len(key):
            return
        order = np.lexsort((kind == SINGLE, more, whole, key))
        key, whole, more, rid, lo, n, kind = (x[order] for x in (key, whole, more, rid, lo, n, kind))
        new = _groups(key, whole, more)
        number = np.cumsum(new) - 1
        twice = np.bincount(number)[number] > 1
        out = twice & (kind == SINGLE)
        if out.any():
            yield _rows(key[out], whole[out], more[out], rid[out], lo[out], n[out], np.full(out.sum(), REPEAT))
        key, whole, more, rid, lo, n = (x[new] for x in (key, whole, more, rid, lo, n))
        head = _groups(key)
        number = np.cumsum(head) - 1
        different = np.bincount(number)[number]
        out = different > 1
        if out.any():
            yield _rows(key[out], whole[out], more[out], rid[out], lo[out], n[out], np.where(different[out] > hot, SPLIT, COMPARE) if hot else np.full(out.sum(), COMPARE))

    return run


PIECE = "key long, rid long, lo int, n int, bytes binary"


def _fetch(length: int):
    """Bytes of the contexts to compare."""

    def run(batches):
        for b in c.slices(batches, "text", TEXT_BYTES):
            out: tuple[list, ...] = ([], [], [], [], [])
            for rid, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (text or "").encode()
                for w in wanted:
                    lo, n = w["lo"], w["n"]
                    for col, v in zip(out, (w["key"], rid, lo, n, raw[lo : lo + n + length - 1])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["key", "rid", "lo", "n", "bytes"])

    return run


def _runs(rid: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """(rid, lo, n) of runs of starts."""
    order = np.lexsort((at, rid))
    rid, at = rid[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (at[1:] != at[:-1] + 1) & (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return pa.RecordBatch.from_arrays([pa.array(rid[first]), pa.array(at[first].astype(np.int32)), pa.array((at[last] - at[first] + 1).astype(np.int32))], ["rid", "lo", "n"])


def _sort(length: int, chunk: int):
    """Repeated starts of a partition's contexts, sorted by key: whole keys are put together to blocks of text."""

    def block(_, rids, los, ns, raws):
        n = np.array(ns)
        rid, lo = np.array(rids, np.int64), np.array(los, np.int64)
        if len(raws) > 1:
            size = np.array([len(r) for r in raws])
            at = np.concatenate([[0], np.cumsum(-(-size // V) * V)])
            text = np.zeros(at[-1], np.uint8)
            for r, a in zip(raws, at):
                text[a : a + len(r)] = np.frombuffer(r, np.uint8)
            own = np.repeat(np.arange(len(raws)), n)
            inner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            found = repeated(text, at[own] + inner, length)
            if found.any():
                yield _runs(rid[own[found]], lo[own[found]] + inner[found])

    @c.giving_back
    def run(batches):
        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns)):
                if held[0] and row[0] != held[0][-1] and size > chunk:
                    yield from block(*held)
                    held, size = ([], [], [], [], []), 0
                for col, v in zip(held, row):
                    col.append(v)
                size += len(row[4])
        if held[0]:
            yield from block(*held)

    return run


def long_runs(found: list, raw: bytes, length: int, words: int) -> list[dict]:
    """Runs of consecutive starts that cover LENGTH bytes, or so many whole words, or more."""
    runs: list[list[int]] = []
    for lo, n in sorted((x["lo"], x["n"]) for x in found or []):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], lo + n)
        else:
            runs.append([lo, lo + n])
    out = []
    for lo, to in runs:
        end = to - 1 + length
        cut = raw[max(0, lo - 1) : lo + 1], raw[end - 1 : end + 1]  # a word across an end is not whole
        if end - lo >= LENGTH or len(raw[lo:end].split()) - sum(len(x) == 2 and x.split() == [x] for x in cut) >= words:
            out.append({"lo": lo, "n": to - lo})
    return out


def spans(found: list, size: int, length: int) -> list[list[int]]:
    """Maximal covered runs [from, to) from (lo, n) runs of starts."""
    out: list[list[int]] = []
    for lo, n in sorted((x["lo"], x["n"]) for x in found or []):
        end = min(size, lo + n - 1 + length)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return out


def find_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(rid, text, spans array<struct<lo,n>>, other columns): every row with its repeated starts."""
    c.ship(docs.sparkSession)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_text = docs.select("rid", "text")

    def wanted(met, kind, *columns):
        return met.where(F.col("kind") == kind).groupBy("rid").agg(F.collect_list(F.struct(*columns)).alias("wanted"))

    # repeated rows have one rid and equal texts: one of them is enough wherever texts are fetched again
    met = c.settle(id_text.mapInArrow(_emit(length), ROW).repartition(parts, "key").mapInArrow(_meet(hot), ROW), ["kind"])
    all_met = met
    for width in WIDTHS:
        if not met.where(F.col("kind") == SPLIT).limit(1).count():
            break
        runs = id_text.join(wanted(met, SPLIT, "lo", "n").hint("merge"), "rid").select("rid", "text", "wanted").mapInArrow(_split(length, width), ROW)
        met = c.settle(runs.repartition(parts, "key").mapInArrow(_meet(hot if width > 1 else None), ROW), ["kind"])
        all_met = all_met.unionByName(met)
    pieces = id_text.join(wanted(all_met, COMPARE, "key", "lo", "n").hint("merge"), "rid").select("rid", "text", "wanted").mapInArrow(_fetch(length), PIECE)
    sorted_ = c.settle(pieces.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sort(length, chunk), "rid long, lo int, n int"))
    starts = all_met.where(F.col("kind") == REPEAT).select("rid", "lo", "n").unionByName(sorted_)
    runs = starts.groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    return docs.join(runs.hint("merge"), "rid", "left")


def with_rid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a row name made of id and text; equal rows share it."""
    return docs.withColumn("rid", F.xxhash64(F.col(id_col), F.col(text_col)))


def strip_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """docs with text cut down to the bytes that stay, and columns removed_spans and removed_bytes, which displace columns of these names.

    Where words are given, a run of text whose every string of length bytes also
    starts elsewhere goes only if it holds so many whole words or LENGTH bytes.
    Bytes are removed, so a cut can fall inside a character; what is left of it is
    dropped from the text.  Null texts stay null; other columns stay.
    """
    docs = docs.drop("removed_spans", "removed_bytes")
    schema = docs.schema
    apart = docs.toDF(*(n if n in ("doc_id", "text") else f"__c{i}" for i, n in enumerate(docs.columns)))  # no name of the work's own
    found = find_repeats(with_rid(apart), length).select(*apart.columns, "runs")

    def run(batches):
        for b in c.slices(batches):
            k = b.schema.get_field_index("text")
            out, n_spans, n_bytes = [], [], []
            for text, runs in zip(b.column(k).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                raw = (text or "").encode()
                cut = spans(long_runs(runs, raw, length, words) if words else runs, len(raw), length)
                n_spans.append(len(cut))
                n_bytes.append(sum(e - s for s, e in cut))
                out.append(text if not cut else _left(raw, cut).decode("utf-8", "ignore"))
            cols = [pa.array(out, pa.string()) if i == k else x for i, x in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_spans, pa.int64()), pa.array(n_bytes, pa.int64())], [*schema.names, "removed_spans", "removed_bytes"])

    from pyspark.sql import types as T

    return found.mapInArrow(run, T.StructType([*schema.fields, T.StructField("removed_spans", T.LongType()), T.StructField("removed_bytes", T.LongType())]))


def _left(raw: bytes, cut: list[list[int]]) -> bytes:
    ends = [0, *(x for s in cut for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Null and empty texts have no bytes; texts shorter than length keep all.  Rows
    may repeat, and then all of their long strings do; ids may repeat or be null;
    every occurrence goes, so there are no ties.  An empty table gives an empty
    result; other columns are ignored.  A text is worked on whole, in memory of some
    sixty times its size.
    """
    found = find_repeats(with_rid(docs.select("doc_id", "text")), length).select("doc_id", "text", "runs")

    def run(batches):
        for b in c.slices(batches):
            rows: tuple[list, ...] = ([], [], [], [])
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (text or "").encode()
                cut = spans(runs, len(raw), length)
                for col, v in zip(rows, (len(raw), sum(e - s for s, e in cut), len(cut), hashlib.sha256(_left(raw, cut)).hexdigest())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(c.table(spark, sf_dir, "documents"))
