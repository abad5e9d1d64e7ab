"""Stupid-backoff language model scores, computed relationally (operator 7).

Words are what lies between white space, in lower case.  The n-grams of all texts
up to ORDER words are counted.  A word scores by the count of the longest n-gram
that ends at it over the count of that n-gram's context, if the n-gram was seen
MIN_COUNT times; else by ALPHA times its score with one word of context less, down
to its share of all words.

An n-gram that a text alone holds once says nothing about it, so MIN_COUNT is 2 unless
told otherwise; with 1, as in the plain definition, every n-gram of a scored corpus is
seen and nothing backs off.

The relation (slice, n-gram, count) is kept packed, as one row an n-gram would take
some fifteen times the input in the shuffle: a slice is a few MB of texts,
whose n-grams are counted before they are shuffled, so a frequent one is sent once
a slice.  It is dealt out by ranges of the n-gram's 64-bit hash; each bucket is one
part of the count table and is joined there with the n-grams that ask for it.  The
joined counts go back to the slice and are summed to scores by document.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

ALPHA = 0.4
MIN_COUNT = 2
ORDER = 3
#: Bytes of text whose n-grams are counted together before they are sent.
SLICE_BYTES = 4 << 20
#: Bytes of text for each part of the count table.
BUCKET_BYTES = 16 << 20


class Level(NamedTuple):
    """The distinct n-grams of one length in a slice, and which of them ends at each word (-1: none)."""

    hashes: np.ndarray
    counts: np.ndarray
    context: np.ndarray
    shorter: np.ndarray
    at: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def ngrams(words: list[bytes], sizes: np.ndarray, order: int) -> tuple[list[Level], np.ndarray]:
    """The levels of a slice, and how many words of the same document stand before each word."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    own = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    before = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    none = np.zeros(len(own), np.int64)
    levels = [Level(own, np.bincount(ids, minlength=len(own)), none, none, ids)]
    for k in range(1, order):
        last, ends = levels[-1], np.flatnonzero(before >= k)
        codes, first, which, counts = np.unique(last.at[ends - 1] * len(own) + ids[ends], return_index=True, return_inverse=True, return_counts=True)
        context, word = np.divmod(codes, max(1, len(own)))
        at = np.full(len(ids), -1)
        at[ends] = which
        hashes = _mix(last.hashes[context] * np.uint64(0x9E3779B97F4A7C15) + own[word] + np.uint64(k))
        levels.append(Level(hashes, counts, context, last.at[ends[first]], at))
    return levels, before


def _split(body: bytes) -> list[bytes]:
    return body.split(b" ") if body else []


def cut(batches):
    """(slice, ids, sizes, body) of each slice: its rows' ids, their numbers of words, and all words with single spaces."""
    n, ids, sizes, bodies, room = TaskContext.get().partitionId() << 32, [], [], [], SLICE_BYTES
    for b in c.slices(batches, "text", SLICE_BYTES):
        at = 0
        for i, text in enumerate(b.column(1)):
            words = text.as_py().encode().split()
            bodies.append(b" ".join(words))
            sizes.append(len(words))
            room -= len(bodies[-1])
            if room <= 0:
                ids.append(b.column(0).slice(at, i + 1 - at))
                yield n, pa.concat_arrays(ids), sizes, b" ".join([x for x in bodies if x])
                n, ids, sizes, bodies, room, at = n + 1, [], [], [], SLICE_BYTES, i + 1
        if at < len(b):
            ids.append(b.column(0).slice(at))
    if sizes:
        yield n, pa.concat_arrays(ids), sizes, b" ".join([x for x in bodies if x])


def measure(rows: DataFrame) -> tuple[int, int]:
    """How many words all texts have, and how many bytes."""

    def run(batches):
        for _, _, sizes, body in cut(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sum(sizes)]), pa.array([len(body)])], ["words", "bytes"])

    sums = rows.mapInArrow(run, "words long, bytes long").agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes")).first()
    return sums["words"] or 0, sums["bytes"] or 0


def keep(rows: DataFrame) -> DataFrame:
    """(slice, ids, sizes, body): the slices with their words compressed."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for n, ids, sizes, body in cut(batches):
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([sizes], pa.list_(pa.int64())), pa.array([zstandard.compress(body, 9)], pa.binary())], ["slice", "ids", "sizes", "body"])

    return rows.mapInArrow(run, f"slice long, ids array<{kind}>, sizes array<long>, body binary")


def ask(rows: DataFrame, buckets: int, order: int) -> DataFrame:
    """(slice, bucket, hashes, counts): the distinct n-grams of each slice by ranges of their hash, ascending."""

    def run(batches):
        for n, _, sizes, body in cut(batches):
            levels, _ = ngrams(_split(body), np.array(sizes, np.int64), order)
            hashes = np.concatenate([x.hashes for x in levels])
            turn = np.argsort(hashes)
            hashes, counts = hashes[turn], np.concatenate([x.counts for x in levels])[turn]
            del levels, turn
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            cuts = list(zip(starts, [*starts[1:], len(bucket)]))
            for i in range(0, len(cuts), 1024):
                spans = cuts[i : i + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(spans)), pa.array([bucket[s] for s, _ in spans], pa.int64()), pa.array([c.pack_numbers(c.steps(hashes[s:e])) for s, e in spans], pa.binary()), pa.array([c.pack_numbers(counts[s:e]) for s, e in spans], pa.binary())],
                    ["slice", "bucket", "hashes", "counts"],
                )

    return rows.mapInArrow(run, "slice long, bucket long, hashes binary, counts binary")


def answer(asked: DataFrame) -> DataFrame:
    """(slice, bucket, counts): the counts over all slices of the n-grams that were asked for, in the same order."""

    def run(t: pa.Table) -> pa.Table:
        parts = [np.cumsum(c.numbers(x), dtype=np.uint64) for x in t.column("hashes").to_pylist()]
        _, which = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.concatenate([c.numbers(x) for x in t.column("counts").to_pylist()])
        sums = np.bincount(which, weights=counts).astype(np.int64)[which]
        back = np.split(sums, np.cumsum([len(x) for x in parts])[:-1])
        return pa.table({"slice": t.column("slice"), "bucket": t.column("bucket"), "counts": pa.array([c.pack_numbers(x) for x in back], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "slice long, bucket long, counts binary")


def score(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, lm_score) of every row: the sum of log scores over its words.

    Null and empty texts have no words and score 0; repeated rows give repeated
    rows, each of which counts; an empty table gives none; other columns are
    ignored.  N-grams are told apart by 64-bit hashes.  docs is read three times and
    must give the same rows in the same partitions each time, as a table in files
    does; else write it first.  Slices that differ end the job with an error.  A text
    is worked on whole, in memory of some forty times its size.
    """
    c.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    total, size = measure(rows)
    buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // BUCKET_BYTES)
    counted = answer(ask(rows, buckets, order))
    less = math.log(alpha)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        levels, before = ngrams(_split(zstandard.decompress(row["body"])), np.array(row["sizes"], np.int64), order)
        turn = np.argsort(np.concatenate([x.hashes for x in levels]))
        counts = np.zeros(len(turn))
        if len(turn):
            counts[turn] = np.concatenate([c.numbers(x) for x in right.sort_by("bucket").column("counts").to_pylist()])
        values, at_word, done, base, value = counts[: len(levels[0].hashes)], np.zeros(len(before)), 0, None, None
        for k, x in enumerate(levels):
            values, done = counts[done : done + len(x.hashes)], done + len(x.hashes)
            if k:
                value = np.where(values >= min_count, np.log(values / base[x.context]), less + value[x.shorter])
            else:
                value = np.log(values / total)
            base, here = values, before >= k
            at_word[here] = value[x.at[here]]
        sizes = np.array(row["sizes"], np.int64)
        sums, some = np.zeros(len(sizes)), sizes > 0
        if some.any():
            sums[some] = np.add.reduceat(at_word, (np.cumsum(sizes) - sizes)[some])
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table({"doc_id": ids, "n_words": pa.array(sizes), "lm_score": pa.array(sums)})

    kind = docs.schema[id_col].dataType.simpleString()
    out = keep(rows).groupBy("slice").cogroup(counted.groupBy("slice")).applyInArrow(run, f"doc_id {kind}, n_words long, lm_score double")
    return out.withColumn("lm_score", F.round("lm_score", 4))


def score_by_rows(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same scores with one row an n-gram: exploded n-grams, a count table for each length, joins, and sums by document.

    It takes DataFrame functions only, and is what score() is tested against.  Its
    shuffles are many times the input (see README), so it is for small corpora.  n-grams
    are told apart by 64-bit hashes; ids must be unique, as sums go by id.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\s\x0B]+"), lambda x: x != "")
    texts = docs.select(F.col(id_col).alias("doc_id"), words.alias("w"))
    at = texts.select("doc_id", "w", F.posexplode("w").alias("i", "word")).drop("word")
    gram = lambda k: F.when(F.col("i") >= k, F.xxhash64(F.lit(k), F.slice("w", F.col("i") - k + 1, F.lit(k + 1))))
    held = lambda k: F.when(F.col("i") >= k, F.xxhash64(F.lit(k - 1), F.slice("w", F.col("i") - k + 1, F.lit(k))))
    grams = at.select("doc_id", "i", *(gram(k).alias(f"g{k}") for k in range(order)), *(held(k).alias(f"c{k}") for k in range(1, order)))
    total = grams.count()
    counts = [grams.where(f"g{k} is not null").groupBy(F.col(f"g{k}").alias("gram")).agg(F.count("*").alias("n")) for k in range(order)]
    told, score = grams, None
    for k, table in enumerate(counts):
        told = told.join(table.select(F.col("gram").alias(f"g{k}"), F.col("n").alias(f"n{k}")), f"g{k}", "left")
        if k:
            told = told.join(counts[k - 1].select(F.col("gram").alias(f"c{k}"), F.col("n").alias(f"m{k}")), f"c{k}", "left")
            longer = F.when(F.col(f"n{k}") >= min_count, F.log(F.col(f"n{k}") / F.col(f"m{k}"))).otherwise(F.lit(math.log(alpha)) + score)
            score = F.when(F.col("i") >= k, longer).otherwise(score)
        else:
            score = F.log(F.col("n0") / total)
    sums = told.groupBy("doc_id").agg(F.sum(score).alias("s"))
    return texts.join(sums, "doc_id", "left").select("doc_id", F.size("w").cast("long").alias("n_words"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("lm_score"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(c.table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[\\s]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(list_zip(list_concat([NULL, NULL], w[1:len(w)-2]), list_concat([NULL], w[1:len(w)-1]), w)) AS p FROM w
), g AS (SELECT doc_id, p[1] AS a, p[2] AS b, p[3] AS c FROM p WHERE p[3] IS NOT NULL),
n1 AS (SELECT c AS x, count(*) AS n FROM g GROUP BY 1),
n2 AS (SELECT b AS x, c AS y, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY 1, 2),
n3 AS (SELECT a AS x, b AS y, c AS z, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT sum(n) AS total FROM n1),
v AS (
  SELECT g.doc_id, ln(u.n / t.total) AS one,
    CASE WHEN bc.n >= 2 THEN ln(bc.n / ub.n) END AS two,
    CASE WHEN abc.n >= 2 THEN ln(abc.n / ab.n) END AS three, g.a, g.b
  FROM g JOIN n1 u ON g.c = u.x LEFT JOIN n1 ub ON g.b = ub.x LEFT JOIN n2 bc ON g.b = bc.x AND g.c = bc.y
    LEFT JOIN n2 ab ON g.a = ab.x AND g.b = ab.y LEFT JOIN n3 abc ON g.a = abc.x AND g.b = abc.y AND g.c = abc.z CROSS JOIN t
), s AS (
  SELECT doc_id, sum(CASE WHEN b IS NULL THEN one WHEN a IS NULL THEN coalesce(two, ln(0.4) + one) ELSE coalesce(three, ln(0.4) + coalesce(two, ln(0.4) + one)) END) AS s FROM v GROUP BY 1
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, round(coalesce(s.s, 0), 4) AS lm_score FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""
