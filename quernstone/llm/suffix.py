"""Suffix sorting of a block of text with a difference-cover sample.

The suffixes of the wanted starts are sorted one bucket at a time; a bucket holds
the starts whose first eight bytes lie between two splitters.  Inside, suffixes
are compared by their first V bytes; longer ties are resolved by the ranks of the
cover sample: for any two places some shift below V takes both into the sample,
where their order is known.  Memory is the text, the sample's ranks and one bucket.
"""

from __future__ import annotations

from functools import cmp_to_key, lru_cache

import numpy as np

V = 32
BUCKET = 1 << 18
_U = np.uint64
_K = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def cover(v: int = V) -> tuple[int, ...]:
    """A small set of residues whose differences give every residue modulo v: greedy, then thinned."""
    chosen, missing = [0, 1], set(range(v)) - {0, 1, v - 1}
    while missing:
        best = max(range(v), key=lambda x: (len(({(x - y) % v for y in chosen} | {(y - x) % v for y in chosen}) & missing), -x))
        chosen.append(best)
        missing -= {(best - y) % v for y in chosen} | {(y - best) % v for y in chosen}
    for x in list(chosen):
        rest = [y for y in chosen if y != x]
        if {(a - b) % v for a in rest for b in rest} == set(range(v)):
            chosen = rest
    return tuple(sorted(chosen))


@lru_cache
def shifts(v: int = V) -> np.ndarray:
    """The smallest shift that takes two residues into the cover."""
    inside = set(cover(v))
    return np.array([[next(d for d in range(v) if (a + d) % v in inside and (b + d) % v in inside) for b in range(v)] for a in range(v)], np.int64)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian integer; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = padded[: len(text)].copy()
    for i in range(1, 8):
        out = out << _U(8) | padded[i : len(text) + i]
    return out


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks without gaps from a sorted order of keys."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class CoverRanks:
    """Ranks of the sampled suffixes to a depth, by doubling from V bytes on (V steps stay in the sample)."""

    def __init__(self, text: np.ndarray, depth: int, v: int = V):
        self.v, self.text = v, np.concatenate([text, np.zeros(depth + 2 * v + 8, np.uint8)])
        self.word = words_at(self.text)
        residues = np.array(cover(v), np.int64)
        rows = -(-(len(self.text) - v - 8) // v)
        self.slot = np.full(v, -1, np.int64)
        self.slot[residues] = np.arange(len(residues))
        places = (np.arange(rows, dtype=np.int64)[:, None] * v + residues).ravel()
        places = np.minimum(places, len(self.text) - v)
        keys = [self.word[np.minimum(places + i, len(self.word) - 1)] for i in range(0, v, 8)]
        order = np.lexsort(keys[::-1])
        rank, reach, each = _dense(order, *keys), v, len(residues)
        while reach < depth:
            ahead = np.zeros_like(rank)
            step = each * (reach // v)
            if step < len(rank):
                ahead[:-step] = rank[step:] + 1
            order = np.lexsort((ahead, rank))
            rank, reach = _dense(order, rank, ahead), 2 * reach
        self.rank, self.each = rank, each

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ranks of sampled places."""
        return self.rank[places // self.v * self.each + self.slot[places % self.v]]


def sorted_bucket(ranks: CoverRanks, starts: np.ndarray) -> np.ndarray:
    """The starts of one bucket in the order of their suffixes."""
    v, word = ranks.v, ranks.word
    keys = [word[starts + i] for i in range(0, v, 8)]
    order = np.lexsort(keys[::-1])
    tie = _dense(order, *keys)[order]
    own = starts[order]
    residue = own % v
    delta = np.diag(shifts(v))[residue]
    order = np.lexsort((ranks.at(own + delta), residue, tie))
    own, tie, residue = own[order], tie[order], residue[order]
    mixed = np.zeros(len(own), bool)
    mixed[1:] = (tie[1:] == tie[:-1]) & (residue[1:] != residue[:-1])
    if mixed.any():  # different residues meet: pairs are compared where the cover takes both
        table = shifts(v)

        def compare(i: int, j: int) -> int:
            d = int(table[i % v, j % v])
            x, y = ranks.rank[(i + d) // v * ranks.each + ranks.slot[(i + d) % v]], ranks.rank[(j + d) // v * ranks.each + ranks.slot[(j + d) % v]]
            return int(x > y) - int(x < y) or i - j

        for t in np.unique(tie[mixed]).tolist():
            a, b = np.searchsorted(tie, t, "left"), np.searchsorted(tie, t, "right")
            own[a:b] = sorted(own[a:b].tolist(), key=cmp_to_key(compare))
    return own


def suffix_blocks(ranks: CoverRanks, starts: np.ndarray, bucket: int = BUCKET):
    """The sorted starts, one bucket after another."""
    if not len(starts):
        return
    first = ranks.word[starts]
    splitters = np.unique(np.sort(first)[bucket::bucket])
    number = np.searchsorted(splitters, first, "right")
    for k in range(len(splitters) + 1):
        own = starts[number == k]
        if len(own):
            yield sorted_bucket(ranks, own)


def repeated(text: np.ndarray, starts: np.ndarray, length: int, bucket: int = BUCKET) -> np.ndarray:
    """For each start, whether its string of length bytes starts at another of the starts too."""
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    ranks = CoverRanks(text, length)
    top = int(starts.max()) + 1
    flag = np.zeros(top, bool)
    for own in suffix_blocks(ranks, starts, bucket):
        a, b = own[:-1], own[1:]
        same = ranks.word[a] == ranks.word[b]
        for i in (8, 16, length // 2 // 8 * 8, length - 8):
            same &= ranks.word[a + i] == ranks.word[b + i]
        at = np.flatnonzero(same)
        for i in range(24, length - 8, 8):  # neighbours in the order, byte for byte
            if not len(at):
                break
            at = at[ranks.word[a[at] + i] == ranks.word[b[at] + i]]
        flag[a[at]] = True
        flag[b[at]] = True
    return flag[starts]
