"""Exact Jaccard join of documents by parity sketches (operator 10).

Every distinct shingle flips one bit of its document's sketch.  A shingle that
two sets do not share flips one bit of one sketch, so the Hamming distance of two
sketches is at most the size of the sets' symmetric difference.  In a band of
sizes no linked pair differs in more than d shingles: sketches of d + 1 + e blocks
agree in at least 1 + e whole blocks, of which at most e are empty in a set that
has no more than e empty blocks.  Blocks that are not empty are joined by equality
(sets with more empty blocks join by those too), and candidates are verified.

The sketch is wide and sparse, 2^32 bits a block; a block is known by the
exclusive or of the scrambled places of its bits, in which even counts cancel as
they do in the sketch.

Nodes are distinct shingle sets, so copies cost nothing.  A map task sends a block
value once, however many sets have it, and keeps a star of the others around the
first; the reducer stars the firsts.  Values travel packed, by ranges of their
hash.  Pairs of a star whose narrow sketches (one to two bits a shingle) are too
far apart to be linked go; the others are verified on their texts.  Linked sets
become components, and in block values of three and more sets the members that
are still apart are compared by their narrow sketches, in chunks of bounded size,
and verified in turn.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from .graph import components
from .words import mix, shingle_sets

WORDS = 3
PERCENT = 90
CHUNK = 2048
#: Partners of a member of one block value that are verified at once; with more, the nearest comes first.
PARTNERS = 8
#: Parts that a member names, so that two members which share several are given out by the first of them.
NAMED = 8
TEXT_BYTES = 1 << 20  # of text worked on at a time; hashes take some twenty times as much
#: Bytes of all texts for each range of block values, and block values that a task gathers before it sends them.
RANGE_BYTES = 16 << 20
FLUSH = 1 << 20
_U = np.uint64


class Bands:
    """Size bands, and for each the most shingles in which a linked pair can differ."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]

    def _reach(self, n: int) -> None:
        ratio = max(1.4, 105 / self.percent)
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * ratio)))

    @lru_cache(None)  # noqa: B019
    def _empty(self, blocks: int, edge: int) -> int:
        """Spare blocks, so that at most one in a hundred of a band's smallest sets has more empty ones.

        Few empty blocks are bounded by the number of ways to choose them, many by
        their mean and three deviations.
        """
        for spare in range(2 * blocks):
            n, k = blocks + spare, spare + 1
            mean = n * math.exp(-edge / n)
            ways = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
            if mean + 3 * math.sqrt(mean) < k > 9 or k < n and ways + edge * math.log1p(-k / n) < math.log(0.01):
                return spare
        return 0

    @lru_cache(None)  # noqa: B019
    def groups(self, n: int) -> list[tuple[int, int, int]]:
        """(band, blocks, spare blocks) in which a set of n meets its partners: its own band, and the next one if a larger partner fits there."""
        self._reach(n)
        g = bisect_right(self.edges, n) - 1
        self._reach(self.edges[g + 1])
        out = []
        for x in [g] + [g + 1] * (100 * n >= self.percent * self.edges[g + 1]):
            d = 2 * (self.edges[x + 1] - 1) * (100 - self.percent) // (100 + self.percent)
            spare = max(0 if d < 5 else 1 if d < 20 else 2 + d // 64, self._empty(d + 1, self.edges[x]))
            out.append((x, d + 1 + spare, spare))
        return out


def block_values(flat: np.ndarray, sizes: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, block, value) of the blocks that are not empty, of the parity sketches of sets that lie end to end.

    A value is the exclusive or of the scrambled places of the block's bits.
    """
    h = mix(flat, 7)
    base = np.cumsum(blocks) - blocks
    place = ((h >> _U(32)) * np.repeat(blocks.astype(np.uint64), sizes) >> _U(32)).astype(np.int64) + np.repeat(base, sizes)
    order = np.argsort(place)
    place = place[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    value = np.bitwise_xor.reduceat(mix(h & _U(0xFFFFFFFF), 8)[order], first)
    own = place[first]
    number = np.searchsorted(base, own, "right") - 1
    full = value != 0
    return number[full], (own - base[number])[full], value[full]


def narrow(shingles: np.ndarray) -> bytes:
    """A parity sketch of one to two bits a shingle, a power of two."""
    m = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((mix(shingles, 9) & _U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    if not len(shingles):
        return 0
    total = np.add.reduce(mix(shingles, 3), keepdims=True) + _U(len(shingles))
    return int(mix(total, 4).view(np.int64)[0])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, first node), ascending, and (key, node, first node) of the others."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    if head.all():
        return keys, nodes, keys[:0], nodes[:0], nodes[:0]
    first = np.flatnonzero(head)
    least = np.minimum.reduceat(nodes, first)
    own = np.repeat(least, np.diff(np.append(first, len(keys))))
    rest = np.flatnonzero(nodes != own)
    k, n, f = keys[rest], nodes[rest], own[rest]
    order = np.lexsort((n, k))
    k, n, f = k[order], n[order], f[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
    return keys[head], least, k[new], n[new], f[new]


ROW = "kind int, key long, a long, b long, p binary, q binary"
FIRST, STAR, DOC = 0, 1, 2


def _rows(kind: int, key, a, b, p=None, q=None) -> pa.RecordBatch:
    n = len(key)
    cols = [pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(x).view(np.int64), pa.int64()) for x in (key, a, b)), *(pa.array(x, pa.binary()) if x is not None else pa.nulls(n, pa.binary()) for x in (p, q))]
    return pa.RecordBatch.from_arrays(cols, ["kind", "key", "a", "b", "p", "q"])


def _values(sets: list[np.ndarray], nodes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of the block values in which sets meet their partners."""
    keys, owners = [], []
    own = [i for i, s in enumerate(sets) if len(s)]
    groups = [bands.groups(len(sets[i])) for i in own]
    for turn in (0, 1):
        pick = [k for k, g in enumerate(groups) if len(g) > turn]
        if not pick:
            continue
        at = np.array([own[k] for k in pick])
        band, blocks, spare = (np.array([groups[k][turn][x] for k in pick], np.int64) for x in range(3))
        sizes = np.array([len(sets[i]) for i in at], np.int64)
        number, block, value = block_values(np.concatenate([sets[i] for i in at]), sizes, blocks)
        one = blocks[number] == 1  # no shingle may differ there
        value[one] = nodes[at][number[one]].view(np.uint64)
        few = np.flatnonzero(np.bincount(number, minlength=len(at)) < blocks - spare)
        if len(few):  # too many empty blocks to leave them out: they join as well
            have = set(zip(number.tolist(), block.tolist()))
            more = [(i, j) for i in few.tolist() for j in range(int(blocks[i])) if (i, j) not in have]
            number = np.concatenate([number, np.array([i for i, _ in more], np.int64)])
            block = np.concatenate([block, np.array([j for _, j in more], np.int64)])
            value = np.concatenate([value, np.zeros(len(more), np.uint64)])
        keys.append(mix(value ^ mix(block.astype(np.uint64) + (band[number] << 32).astype(np.uint64), 1000)))
        owners.append(nodes[at][number])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _send(keys: list[np.ndarray], nodes: list[np.ndarray], ranges: int):
    """Block values with their first nodes by ranges, packed; and the stars around those."""
    k, first, *star = _stars(np.concatenate(keys), np.concatenate(nodes))
    if len(star[0]):
        yield _rows(STAR, *star)
    number = ((k >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(number, prepend=-1))
    for i in range(0, len(at), 1024):
        cut = at[i : i + 1024]
        out: tuple[list, list] = ([], [])
        for a, b in zip(cut.tolist(), np.append(at, len(k))[i + 1 : i + 1025].tolist()):
            out[0].append(c.pack_numbers(c.steps(k[a:b] >> _U(8))))
            names, which = np.unique(first[a:b], return_inverse=True)
            out[1].append(len(names).to_bytes(4, "little") + names.tobytes() + c.pack_numbers(which.astype(np.uint64)))
        yield _rows(FIRST, number[cut], number[cut], number[cut], *out)


def _emit(percent: int, size: int, ranges: int):
    def run(batches):
        bands, keys, nodes, held = Bands(percent), [], [], 0
        for b in c.slices(batches, "text", TEXT_BYTES):
            sets = shingle_sets(b.column(1), size)
            own = np.array([node_of(s) for s in sets], np.int64)
            yield _rows(DOC, own, np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64), np.array(list(map(len, sets)), np.int64), [narrow(s) for s in sets])
            for k, n in [_values(sets, own, bands)]:
                keys.append(k)
                nodes.append(n)
                held += len(k)
            if held >= FLUSH:
                yield from _send(keys, nodes, ranges)
                keys, nodes, held = [], [], 0
        if held:
            yield from _send(keys, nodes, ranges)

    return run


@c.giving_back
def _meet(batches):
    """Stars of the firsts of one range of block values after another; other rows pass."""
    held: list = []  # range, then (keys, nodes) of it

    def done():
        keys, nodes = (np.concatenate(x) for x in zip(*held[1:]))
        *_, k, n, f = _stars(keys, nodes)
        if len(k):
            yield _rows(STAR, k, n, f)

    for b in batches:
        pick = b.column(0).to_numpy() == FIRST
        if not pick.all():
            yield b.filter(pa.array(~pick))
        rows = b.filter(pa.array(pick))
        for number, p, q in zip(rows.column(1).to_pylist(), rows.column(4).to_pylist(), rows.column(5).to_pylist()):
            if held and held[0] != number:
                yield from done()
                held = []
            held = held or [number]
            names = int.from_bytes(q[:4], "little")
            nodes = np.frombuffer(q, np.int64, names, 4)[c.numbers(q[4 + 8 * names :]).astype(np.int64)]
            held.append((np.cumsum(c.numbers(p), dtype=np.uint64) << _U(8), nodes))
    if held:
        yield from done()


def _pack(batches):
    """Texts for the shuffle, compressed."""
    z = zstandard.ZstdCompressor(level=1)
    for b in c.slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], ["id", "z"])


def _unpack(texts: list[bytes], size: int) -> list[np.ndarray]:
    d = zstandard.ZstdDecompressor()
    return shingle_sets(pa.array([d.decompress(z) for z in texts], pa.binary()), size)


def _texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, z): the compressed text of the wanted (id, node) rows."""

    def run(batches):
        for b in c.slices(batches, "z", TEXT_BYTES // 4):
            own = np.array([node_of(s) for s in _unpack(b.column(1).to_pylist(), size)], np.int64)
            right = pa.array(own == b.column(0).to_numpy())  # an id can have several texts
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["node", "z"]).filter(right)

    return c.settle(c.lookup(docs.mapInArrow(_pack, "id long, z binary"), wanted, "id", "z").select("node", "z").mapInArrow(run, "node long, z binary"))


def _verify(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The linked ones among distinct (a, b) rows; rows of a hot b are dealt over several tasks."""
    x, y = texts.select(F.col("node").alias("a"), F.col("z").alias("x")), texts.select(F.col("node").alias("b"), F.col("z").alias("y"))

    def run(batches):
        for b in c.slices(batches, "x", TEXT_BYTES // 4):
            left, right = _unpack(b.column(2).to_pylist(), size), _unpack(b.column(3).to_pylist(), size)
            ok = [linked(p, q, percent) for p, q in zip(left, right)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    hubs = y.join(pairs.select("b").distinct().hint("merge"), "b", "left_semi")
    return c.lookup(pairs, hubs, "b", "a").join(x.hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _folded(bits: list[bytes], words: int) -> np.ndarray:
    """Sketches as rows of so many words: those with more are halved, as often as needed, by the exclusive or of their halves."""
    out = np.empty((len(bits), words), np.uint64)
    size = np.array([len(x) // 8 for x in bits])
    for w in np.unique(size).tolist():
        own = np.flatnonzero(size == w)
        m = np.frombuffer(b"".join([bits[i] for i in own.tolist()]), np.uint64).reshape(-1, w)
        while m.shape[1] > words:
            half = m.shape[1] // 2
            m = m[:, :half] ^ m[:, half:]
        out[own] = m
    return out


def _apart(bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hamming distances of pairs of sketches, each at the width of the narrower one; no more than the sets' symmetric difference."""
    words = np.array([len(x) // 8 for x in bits])
    least = np.minimum(words[i], words[j])
    out = np.empty(len(i), np.int64)
    for w in np.unique(least).tolist():
        at = np.flatnonzero(least == w)
        step = max(1, (1 << 21) // w)
        for k in range(0, len(at), step):
            own = at[k : k + step]
            rows, which = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
            m = _folded([bits[r] for r in rows.tolist()], w)
            out[own] = np.bitwise_count(m[which[: len(own)]] ^ m[which[len(own) :]]).sum(1, dtype=np.int64)
    return out


def _near(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The (a, b) rows whose sizes and narrow sketches allow a link."""
    x, y = (known.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"z{k}")) for k in "ab")

    def run(batches):
        for b in c.slices(batches, "za", TEXT_BYTES):
            na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
            ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            bits = b.column(3).to_pylist() + b.column(5).to_pylist()
            i = np.flatnonzero(ok)
            ok[i] = (100 + percent) * _apart(bits, i, i + len(ok)) <= (100 - percent) * (na + nb)[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    hubs = y.join(pairs.select("b").distinct().hint("merge"), "b", "left_semi")
    return c.lookup(pairs, hubs, "b", "a").join(x.hint("merge"), "a").select("a", "b", "na", "za", "nb", "zb").mapInArrow(run, "a long, b long")


def _pairs_of(group: np.ndarray, label: np.ndarray, n: np.ndarray, percent: int):
    """Row numbers (i, j) of pairs within groups (sorted) that are apart and of fitting sizes, some at a time."""
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    size = np.diff(np.append(first, len(group)))

    def fitting(i, j):
        ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        return i[ok], j[ok]

    for s in np.unique(size).tolist():
        own = first[size == s]
        if s <= 64:
            left, right = np.triu_indices(s, 1)
            step = max(1, (1 << 18) // max(1, len(left)))
            for k in range(0, len(own), step):
                at = own[k : k + step, None]
                yield fitting((at + left).ravel(), (at + right).ravel())
        else:
            for at in own.tolist():
                step = max(1, (1 << 18) // s)
                for k in range(0, s, step):
                    i = np.repeat(np.arange(at + k, min(at + k + step, at + s)), s)
                    j = np.tile(np.arange(at, at + s), len(i) // s)
                    yield fitting(i[i < j], j[i < j])


def _compare(percent: int, most: int | None, rows: int = 1 << 14):
    """Pairs within sorted groups whose narrow sketches allow a link.

    Of a member with more than most such partners only the nearest one comes, and a
    row with a = b says that there are more.  A pair that meets in a group before
    this one, as the first groups of both say, is left to that.
    """

    def told(part: np.ndarray, low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 13):
            x, y = low[i[k : k + (1 << 13)]], low[j[k : k + (1 << 13)]]
            before = x < part[i[k : k + (1 << 13)], None]
            out[k : k + (1 << 13)] = ((x[:, :, None] == y[:, None, :]).any(2) & before).any(1)
        return out

    def block(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        group, node, label, n = (t.column(k).to_numpy() for k in range(4))
        bits, out = t.column(4).to_pylist(), []
        low = np.full((len(t), NAMED), np.iinfo(np.int64).max)
        for r, own in enumerate(t.column(5).to_pylist()):
            low[r, : len(own)] = own
        for i, j in _pairs_of(np.cumsum(np.diff(group, prepend=group[0] - 1) != 0), label, n, percent):
            apart = _apart(bits, i, j)
            near = (100 + percent) * apart <= (100 - percent) * (n[i] + n[j])
            i, j, apart = i[near], j[near], apart[near]
            new = ~told(group, low, i, j)
            i, j, apart = i[new], j[new], apart[new]
            if not len(i):
                continue
            order = np.lexsort((apart, i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            count = np.diff(np.append(first, len(i)))
            if most and (count > most).any():
                keep = np.repeat(count <= most, count)
                keep[first] = True
                i, j = i[keep], j[keep]
                out.append(np.zeros((2, 1), np.int64))
            out.append(np.unique(np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])]), axis=1))
        if out:
            a, b = np.unique(np.concatenate(out, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    @c.giving_back
    def run(batches):
        held, count = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            if count >= rows:  # what is held ends where its last group does
                group = b.column(0).to_numpy()
                same = int(np.searchsorted(group != held[-1].column(0)[-1].as_py(), True))
                if same:
                    held.append(b.slice(0, same))
                if same < b.num_rows:
                    yield from block(held)
                    held, count = [b.slice(same)], b.num_rows - same
                continue
            held.append(b)
            count += b.num_rows
        if held:
            yield from block(held)

    return run


def _rest(stars: DataFrame, labels: DataFrame, known: DataFrame, percent: int, chunk: int, most: int | None) -> DataFrame:
    """Pairs of members of a block value that stars have left apart and whose narrow sketches allow a link, each from the first part in which both lists of parts meet.

    The list of a node has a part for each chunk that it meets in each of its block values.
    """
    parts = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    label = labels.select(F.col("node").alias("x"), "label")

    def named(df, col, out, by):
        return c.lookup(df, label.select(F.col("x").alias(col), F.col("label").alias(out)), col, by, "left").withColumn(out, F.coalesce(out, col))

    apart = named(named(stars, "a", "la", "key"), "b", "lb", "key").where("la <> lb").select("key").distinct()
    member = stars.join(apart, "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
    # of block values with the same members one is enough; two members were compared
    same = member.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.min("node").alias("m")).where("n > 2")
    one = same.groupBy("n", "s", "m").agg(F.min("key").alias("key")).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    member = member.join(one.select("key", "chunks"), "key")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    spread = member.withColumn("own", own).select("*", other.alias("other")).select("node", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("part"))
    # what a node carries joins its list of parts once, and then goes to each of them
    listed = spread.groupBy("node").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    held = listed.join(label.withColumnRenamed("x", "node").hint("merge"), "node", "left").join(known.select("node", "n", "bits").hint("merge"), "node")
    near = held.select(F.explode("parts").alias("part"), "node", F.coalesce("label", "node").alias("label"), "n", "bits", F.slice("parts", 1, NAMED).alias("low"))
    return near.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_compare(percent, most), "a long, b long").distinct()


def join(docs: DataFrame, percent: int = PERCENT, size: int = WORDS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row per row of docs.

    Documents link when 100 times the shared shingles are percent times the union
    or more; component_id is the smallest id that links reach.  Null, empty and
    wordless texts have no shingles and stand alone; a null id stands for the
    smallest one in the work and stays null in the result.  Rows may repeat; an
    empty table gives an empty result; other columns are ignored.  A text is worked
    on whole, in memory of some twenty times its size.

    A block value that M sets share costs M rows, and M * M / 2 comparisons of narrow
    sketches for the members that are still apart, in tasks of two chunks.
    """
    c.ship(docs.sparkSession)
    none = -(1 << 63)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(n, total // RANGE_BYTES)
    sent = base.mapInArrow(_emit(percent, size, ranges), ROW).repartition(n, "key").sortWithinPartitions("kind", "key")
    rows = c.settle(sent.mapInArrow(_meet, ROW), ["kind"])
    docs_rows = rows.where(F.col("kind") == DOC).select(F.col("key").alias("node"), F.col("a").alias("id"), F.col("b").alias("n_shingles"), F.col("p").alias("bits"))
    stars = rows.where(F.col("kind") == STAR).select("key", "a", "b")
    pairs = c.settle(stars.select("a", "b").distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # copies are one node, which may stand for most rows: they are counted before they are joined
    each = docs_rows.groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    known = c.settle(each.join(nodes.hint("merge"), "node", "left_semi"))

    def verified(near: DataFrame) -> DataFrame:
        ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = _texts(base, known.join(ends, "node", "left_semi").select("node", "id"), size)
        found = c.settle(_verify(near, texts, percent, size))
        c.drop(texts)
        return found

    near = c.settle(_near(pairs, known, percent))
    links = verified(near)
    c.drop(near)
    labels = components(links)
    # where a member has many near partners, the nearest first: what they join needs no comparison in full
    for most in (PARTNERS, None):
        near = c.settle(_rest(stars, labels, known, percent, chunk, most).join(pairs, ["a", "b"], "left_anti"))
        again = near.where("a = b").limit(1).count()
        if near.where("a <> b").limit(1).count():
            more = verified(near.where("a <> b"))
            if more.limit(1).count():
                links = links.unionByName(more)
                labels = components(links)
        c.drop(near)
        if not again:
            break
    c.drop(pairs, known)
    low = c.lookup(docs_rows.select("node", "id", "n_shingles"), labels.select("node", "label"), "node", "id", "left").select("node", "id", "n_shingles", F.coalesce("label", "node").alias("label"))
    alone = F.col("n_shingles") == 0
    least = low.where(~alone).groupBy("label").agg(F.min("id").alias("least"))
    full = c.lookup(low, least, "label", "id", "left").select("id", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component_id"))

    def shown(x):
        return F.when(F.col(x) != none, F.col(x)).alias(x)

    return full.select(shown("id"), "n_shingles", shown("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(c.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
f AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
y AS (SELECT x.* FROM x JOIN f ON x.g = f.g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM y a JOIN y b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON p.a = na.doc_id JOIN n nb ON p.b = nb.doc_id WHERE 100 * p.c >= 90 * (na.n + nb.n - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1) m ON n.doc_id = m.doc_id
"""
