"""Byte-pair encoding by a depth-first walk over a trie of distinct words.

The distinct words of a batch are sorted, so that neighbours share their longest
common prefix: walking the sorted list *is* the depth-first traversal of their
trie.  A trie node (a prefix) carries one integer, the last token of the
prefix's own encoding.  It is found from its ancestors: it is the one vocabulary
token that ends here and forms an irreducible pair with the last token of the
prefix before it.  A word's ids are read by following last tokens back to the
root, so a prefix shared by many words is encoded once.

Special tokens that occur in a text are cut out first, as the public library
does; null texts count as empty.
"""

from __future__ import annotations

import json
import re
from array import array
from os.path import commonprefix

import ahocorasick
import regex

#: Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUN = re.compile(r"\s\s")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Kept(dict):
    """Packed ids by piece, in two generations."""

    older: dict = {}

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.older = dict(self)
            self.clear()


class TrieCodec:
    """Encoder and decoder for one vocabulary file.

    cache_words bounds each of the two generations of kept word encodings; a
    full generation displaces the older one, which costs time only.
    """

    def __init__(self, path: str, cache_words: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.bytes_of: dict[int, bytes] = {}
        self.id_of: dict[bytes, int] = {}
        for token, i in spec["model"]["vocab"].items():
            raw = bytes(alphabet[c] for c in token)
            self.bytes_of[i], self.id_of[raw] = raw, i
        vocab = spec["model"]["vocab"]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.merge[pair] = (rank, whole)
            self.split.setdefault(whole, pair)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self._special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._ends = ahocorasick.Automaton()  # tokens that end at a place, longest first
        for raw, i in self.id_of.items():
            self._ends.add_word(raw.decode("latin-1"), (len(raw), i))
        self._ends.make_automaton()
        self._words = regex.compile(SPLIT)
        self._good: set[int] = set()
        self._bad: set[int] = set()
        self._seam: dict[int, bool] = {}
        self._plain, self._spaced = Kept(), Kept()  # of pieces as they are, and of pieces after a space
        self._cache_words = cache_words

    # -- pairs of tokens ---------------------------------------------------
    def merged(self, raw: bytes) -> list[int]:
        """Plain merge loop, for checks of single tokens and for tests."""
        ids = [self.id_of[raw[i : i + 1]] for i in range(len(raw))]
        while len(ids) > 1:
            best = min((self.merge.get(p, (1 << 60, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
            if best[0] == 1 << 60:
                break
            ids[best[1] : best[1] + 2] = [self.merge[ids[best[1]], ids[best[1] + 1]][1]]
        return ids

    def _reachable(self, token: int) -> bool:
        """Whether the merge loop makes this token of its own bytes."""
        if token not in self._bad and self.merged(self.bytes_of[token]) == [token]:
            self._good.add(token)
            return True
        self._bad.add(token)
        return False

    def _irreducible(self, left: int, right: int) -> bool:
        """Whether the merge loop leaves left and right side by side.

        Merges are undone newest first on either side of the seam; a merge over
        the seam that is older than the last one undone would have come first.
        """
        rank, split = self.merge, self.split
        a, b, ceiling = left, right, 1 << 60
        born = self._born
        while True:
            over = rank.get((a, b))
            if over is not None and over[0] < ceiling:
                return False
            ra, rb = born(a), born(b)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                ceiling, a = ra, split[a][1]
            else:
                ceiling, b = rb + 1, split[b][0]

    def _born(self, token: int) -> int:
        pair = self.split.get(token)
        return -1 if pair is None else self.merge[pair][0]

    # -- the trie ------------------------------------------------------------
    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of each distinct word, by one depth-first pass over their trie."""
        out: dict[bytes, list[int]] = {}
        seam, own, good, ends = self._seam, self._reachable, self._good, self._ends.iter
        last: list[int] = [-1]  # last token of the prefix at each depth of the current path
        size: list[int] = [0]  # its length in bytes
        before = b""
        for word in sorted(set(words)):
            keep = len(commonprefix((before, word)))
            del last[keep + 1 :], size[keep + 1 :]
            done = keep
            for end, (n, token) in ends(word.decode("latin-1")):
                if end < done or token not in good and not own(token):
                    continue
                start = end + 1 - n
                if start:
                    key = last[start] << 20 | token
                    ok = seam.get(key)
                    if ok is None:
                        ok = seam[key] = self._irreducible(last[start], token)
                    if not ok:
                        continue
                last.append(token)
                size.append(n)
                done = end + 1
            ids, depth = [], len(word)
            while depth:
                ids.append(last[depth])
                depth -= size[depth]
            ids.reverse()
            out[word] = ids
            before = word
        if len(seam) > 2_000_000:
            seam.clear()
        return out

    # -- texts -----------------------------------------------------------------
    def _pack(self, text: str, missing: set[str]):
        """Pieces and the lookup for them: cut at single spaces between words, where the pattern always cuts."""
        if _RUN.search(text):
            pieces, cache = self._words.findall(text), self._plain
        else:
            pieces, cache = text.split(" "), self._spaced
            if pieces[0]:  # no space stands before the first
                return [(self._words.findall(pieces[0]), self._plain, missing[0]), (pieces[1:], cache, missing[1])]
            pieces = pieces[1:]
        return [(pieces, cache, missing[cache is self._spaced])]

    def pack_many(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for kept in (self._plain, self._spaced):
            kept.turn(self._cache_words)
        missing: tuple[set, set] = (set(), set())
        parts = []
        for text in texts:
            cut = self._special_re.split(text or "") if self._special_re else [text or ""]
            todo = [[(p, None, None)] if i % 2 else self._pack(p, missing) if p else [] for i, p in enumerate(cut)]
            todo = [x for y in todo for x in y]
            for pieces, cache, miss in todo:
                if cache is not None:
                    miss.update([p for p in pieces if p not in cache])
            parts.append(todo)
        split: list[dict[str, list[bytes]]] = [{}, {}]
        for i, (cache, miss) in enumerate(zip((self._plain, self._spaced), missing)):
            for p in miss:
                if (kept := cache.older.get(p)) is not None:
                    cache[p] = kept
                else:
                    whole = " " + p if i else p
                    split[i][p] = [whole.encode()] if i and p.isascii() and p.isalpha() else [w.encode() for w in self._words.findall(whole)]
        ids = self.encode_words([w for x in split for ws in x.values() for w in ws])
        for cache, x in zip((self._plain, self._spaced), split):
            for p, ws in x.items():
                cache[p] = array("I", ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]).tobytes()
        return [b"".join([array("I", [self.special[p]]).tobytes() if c is None else b"".join(map(c.__getitem__, p)) for p, c, _ in todo]) for todo in parts]

    def unpack(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I")))


_CODECS: dict[str, TrieCodec] = {}


def codec(path: str) -> TrieCodec:
    """One codec for each vocabulary and worker process."""
    if path not in _CODECS:
        _CODECS[path] = TrieCodec(path)
    return _CODECS[path]
