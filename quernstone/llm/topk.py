"""Exact top-k inner product by a bit-sliced index (operator 9).

Blocks of rows hold each attribute as bitmaps, one for each bit of the quantised
value above the attribute's least.  The index is these blocks as a table, made once.
A query adds the slices of its attributes with bitmap arithmetic (full adders over
whole bitmaps; the bits of the query's weight shift a slice), which gives the bitmaps
of a sum per row without its lowest bits.  Top rows are selected from the most
significant slice downward; rows whose sum could reach the k-th one within the bits
left out are resolved exactly from their integers.

Queries go to the blocks by broadcast, so many bytes of them at a time as a documented
bound allows; the index is never shuffled or copied for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

BLOCK_ROWS = 32_768
#: Bytes of queries that are broadcast at a time.
QUERY_BYTES = 32 << 20
DROP_BITS = 1
K = 5


class BitSlices:
    """Bit-sliced index of an integer matrix; drop low bits are kept out of the slices."""

    def __init__(self, rows: np.ndarray, drop: int = DROP_BITS, packed: bytes | None = None):
        self.rows, self.drop, self.n = rows, drop, len(rows)
        low = rows.min(0, initial=np.iinfo(rows.dtype).max) if rows.size else np.zeros(rows.shape[1], rows.dtype)
        top = rows.max(0, initial=np.iinfo(rows.dtype).min) if rows.size else low
        self.bits = [max(1, (int(t) - int(x) >> drop).bit_length()) for x, t in zip(low, top)]
        self.words = -(-max(1, self.n) // 64)
        if packed is None:
            packed = b"".join(self._slice(rows[:, d].astype(np.int64) - int(low[d]), self.bits[d]) for d in range(rows.shape[1]))
        self.packed = packed
        flat = np.frombuffer(packed, np.uint64).reshape(-1, self.words)
        ends = np.cumsum([0, *self.bits])
        self.slices = [flat[a:b] for a, b in zip(ends, ends[1:])]
        flipped = ~flat
        self.flipped = [flipped[a:b] for a, b in zip(ends, ends[1:])]

    def _slice(self, column: np.ndarray, bits: int) -> bytes:
        shifted = column.astype(np.uint64) >> np.uint64(self.drop)
        out = np.zeros((bits, self.words * 8), np.uint8)
        for b in range(bits):
            own = np.packbits((shifted >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little")
            out[b, : len(own)] = own
        return out.tobytes()

    def add(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the weighted sum, least significant first; negative weights add complements."""
        at: list[list[np.ndarray]] = []
        for d, w in enumerate(query.tolist()):
            source = self.slices[d] if w >= 0 else self.flipped[d]
            w, j = abs(w), 0
            while w >> j:
                if w >> j & 1:
                    while len(at) < j + self.bits[d]:
                        at.append([])
                    for b in range(self.bits[d]):
                        at[j + b].append(source[b])
                j += 1
        out, p = [], 0
        while p < len(at):
            held = at[p]
            while len(held) > 1:
                if p + 1 == len(at):
                    at.append([])
                x, y = held.pop(), held.pop()
                half = x ^ y
                if held:
                    z = held.pop()
                    at[p + 1].append(x & y | half & z)
                    held.append(half ^ z)
                else:
                    at[p + 1].append(x & y)
                    held.append(half)
            out.append(held[0] if held else np.zeros(self.words, np.uint64))
            p += 1
        return out

    def at_least(self, sums: list[np.ndarray], alive: np.ndarray, least: int) -> np.ndarray:
        """Bitmap of the alive rows whose sum is least or more."""
        if least <= 0:
            return alive
        if least.bit_length() > len(sums):
            return alive & np.uint64(0)
        over, equal = alive & np.uint64(0), alive
        for i in range(len(sums) - 1, -1, -1):
            if least >> i & 1:
                equal = equal & sums[i]
            else:
                over |= equal & sums[i]
                equal = equal & ~sums[i]
        return over | equal

    def kth(self, sums: list[np.ndarray], alive: np.ndarray, k: int) -> int:
        """The k-th highest sum of the alive rows, found from the most significant slice down."""
        value, sure, maybe = 0, 0, alive
        for i in range(len(sums) - 1, -1, -1):
            ones = maybe & sums[i]
            n = int(np.bitwise_count(ones).sum())
            if sure + n >= k:
                maybe, value = ones, value | 1 << i
            else:
                sure += n
                maybe = maybe & ~sums[i]
        return value

    def top(self, query: np.ndarray, ids: np.ndarray, own: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k rows other than those with id own; ties go to smaller ids."""
        mask = np.zeros(self.words * 64, np.uint8)
        mask[: self.n] = ids != own
        alive = np.packbits(mask, bitorder="little").view(np.uint64)
        if int(mask.sum()) > k:
            sums = self.add(query)
            slack = -(-sum(map(abs, query.tolist())) * ((1 << self.drop) - 1) >> self.drop) + 1 if self.drop else 0
            alive = self.at_least(sums, alive, self.kth(sums, alive, k) - slack)
        found = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
        scores = inner(self.rows[found], query)
        best = np.lexsort((ids[found], -scores))[:k]
        return ids[found][best], scores[best]


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; one that does not fit fails, as the score is a long."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    large = max(abs(int(rows.min())), abs(int(rows.max())))
    if large * sum(map(abs, query.tolist())) < 1 << 63:
        return rows.astype(np.int64) @ query.astype(np.int64)
    sums = [sum(map(int.__mul__, r, query.tolist())) for r in rows.tolist()]
    if max(map(abs, sums)) >= 1 << 63:
        raise OverflowError("a score exceeds 64 bits")
    return np.array(sums, np.int64)


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, q array<bigint>) of the vectors without null or non-finite components; a null id takes no part.

    A component times 256 must fit 64 bits; a larger one fails the query.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fits = lambda x: F.when(F.abs(x) < float(1 << 55), F.floor(x * 256)).otherwise(F.raise_error(F.lit("a component exceeds 2^55")).cast("bigint"))
    good = F.col(id_col).isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(good).select("vec_id", F.transform("v", fits).alias("q"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of integers, in 32 bits where they fit; shorter vectors count as filled up with zeros."""
    dims = np.diff(lists.offsets.to_numpy())
    dim = int(dims.max(initial=0))
    flat, out = lists.flatten().to_numpy(), np.zeros((len(dims), dim), np.int64)
    out[np.arange(dim) < dims[:, None]] = flat
    return out.astype(np.int32) if not out.size or max(abs(int(out.min())), abs(int(out.max()))) < 1 << 31 else out


def _table(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(batches).combine_chunks()
    ids, rows = t.column("vec_id").to_numpy(), _matrix(t.column("q").combine_chunks())
    order = np.argsort(ids, kind="stable")
    return ids[order].astype(np.int64), rows[order]


def index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(ids, rows, width, dim, slices): the bit-sliced blocks of (vec_id, q) rows, written once to the shared folder."""

    def run(batches):
        held, count = [], 0

        def block():
            ids, rows = _table(held)
            return pa.RecordBatch.from_pylist([{"ids": ids.tobytes(), "rows": rows.tobytes(), "width": rows.dtype.itemsize, "dim": rows.shape[1], "slices": BitSlices(rows).packed}], schema)

        schema = pa.schema([("ids", pa.binary()), ("rows", pa.binary()), ("width", pa.int32()), ("dim", pa.int32()), ("slices", pa.binary())])
        for b in batches:
            at = 0
            while at < b.num_rows:
                own = b.slice(at, block_rows - count)
                held.append(own)
                count, at = count + own.num_rows, at + own.num_rows
                if count == block_rows:
                    yield block()
                    held, count = [], 0
        if count:
            yield block()

    parts = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // block_rows)))
    return c.settle(vectors.select("vec_id", "q").repartition(parts, F.xxhash64("vec_id")).mapInArrow(run, "ids binary, rows binary, width int, dim int, slices binary"))


def _parts(queries: DataFrame, most: int):
    """The queries on the driver, some bytes at a time."""
    size = queries.agg(F.sum(F.size("q") * 8 + 16)).first()[0] or 0
    n = max(1, -(-size // (most // 2)))  # parts are uneven
    for k in range(n):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == k).toArrow()
        if own.num_rows:
            if own.nbytes > 2 * most:
                raise RuntimeError("a part of the queries exceeds its bound")
            yield _table(own.to_batches())


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to smaller ids.

    Both take (vec_id, q).  Every part of the queries goes through all blocks; only k
    rows a query and block leave a task.  Vectors of other lengths count as filled up
    with zeros.  Rows may repeat, each counts as a candidate; a query's own id is none
    of its candidates; repeated queries are asked once.  An empty table gives an empty
    result.  Scores are exact; one beyond 64 bits fails.
    """
    spark = vectors.sparkSession
    c.ship(spark)
    blocks = index(vectors, block_rows)

    def near(part):
        shared = spark.sparkContext.broadcast(part)

        def run(batches):
            q_ids, q_rows = shared.value
            for b in batches:
                for r in b.to_pylist():
                    ids = np.frombuffer(r["ids"], np.int64)
                    rows = np.frombuffer(r["rows"], np.int32 if r["width"] == 4 else np.int64).reshape(len(ids), r["dim"])
                    own = BitSlices(rows, packed=r["slices"])
                    dim = min(r["dim"], q_rows.shape[1])
                    if dim < r["dim"]:
                        own = BitSlices(rows[:, :dim])
                    out: tuple[list, ...] = ([], [], [])
                    for q_id, q in zip(q_ids.tolist(), q_rows[:, :dim].astype(np.int64)):
                        found, scores = own.top(q, ids, q_id, k)
                        out[0].extend([q_id] * len(found))
                        out[1].extend(found.tolist())
                        out[2].extend(scores.tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

        return blocks.mapInArrow(run, "query_id long, vec_id long, score long")

    every = [near(part) for part in _parts(queries.dropDuplicates(["vec_id"]), query_bytes)]
    if not every:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = every[0]
    for more in every[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = c.settle(quantise(c.table(spark, sf_dir, "embeddings")))
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
