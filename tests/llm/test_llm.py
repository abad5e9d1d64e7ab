import hashlib
import math
import random
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import _common as c
from quernstone.llm import dedup, html, jaccard, langid, lm, mpeg, pack, shard, suffix, tokenize, topk
from quernstone.llm.bpe import codec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RND = random.Random(5)
VOCAB = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 7))) for _ in range(300)]


def words(n):
    return " ".join(RND.choice(VOCAB) for _ in range(n))


def _rows():
    base, shared = words(300), words(90)
    near = base.split(" ")
    near[7] = "zzz"
    texts = [base, base, " ".join(near), words(50) + " " + shared + " " + words(40), words(60) + shared + words(10), None, "", "   \n", "a", "a b", "A B", "é" * 500, "x" * 1200, "ab" * 700, words(2500), "<|endoftext|> a  b\n\n c"]
    return [(i, t, "en" if i % 2 else "fr", "s", 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0), (None, "lost id", None, None, None)]


ROWS = _rows()


def rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumnRenamed("source", "ids")


def test_suffix_blocks_match_brute_force():
    for text in (b"ab" * 300, b"x" * 500, bytes(RND.choice(b"ab") for _ in range(900)) * 2, words(200).encode()):
        data = np.frombuffer(text, np.uint8)
        starts = np.arange(len(data) - 64 + 1)
        want = [text[i : i + 64] for i in starts]
        ranks = suffix.CoverRanks(data, 64)
        order = np.concatenate(list(suffix.suffix_blocks(ranks, starts, 100)))
        assert [text[i : i + 64] for i in order] == sorted(want)
        got = suffix.repeated(data, starts, 64, 100)
        assert got.tolist() == [want.count(w) > 1 for w in want]
    assert {(a - b) % 32 for a in suffix.cover(32) for b in suffix.cover(32)} == set(range(32))


@pytest.mark.parametrize("hot", [1, 1024])
def test_dedup(spark, docs, monkeypatch, hot):
    length = 400
    found = dedup.find_repeats(dedup.with_rid(docs.select("doc_id", "text")), length, hot)
    got = {}
    for r in found.collect():
        raw = (r.text or "").encode()
        got.setdefault((r.doc_id, r.text), []).append([tuple(s) for s in dedup.spans(r.runs, len(raw), length)])
    texts = [(r[0], r[1], (r[1] or "").encode()) for r in rows()]
    seen = {}
    for _, _, t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    for i, text, t in texts:
        cut = []
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                if cut and k <= cut[-1][1]:
                    cut[-1][1] = k + length
                else:
                    cut.append([k, k + length])
        for one in got[(i, text)]:
            assert one == [tuple(x) for x in cut], i


def test_digest_goes_by_bytes_not_words(spark):
    """Passages of over 50 words stay below 400 bytes and go from there on; n_bytes is the text's size in both cases."""
    rnd = random.Random(6)
    long_ = " ".join("".join(rnd.choice("klmnopqrst") for _ in range(rnd.randint(2, 7))) for _ in range(300))
    below, at, whole = long_[:399], long_[400:800], "y" + long_[800:1200]
    assert len(below.split()) > 50 and len(at.split()) > 50
    texts = ["a" + below + "b", "c" + below + "d", "e" + at + "f", "g" + at + "h", whole, whole, None]
    kept = [*texts[:2], "ef", "gh", "", "", ""]
    got = dedup.digest(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    want = [(i, len(t or ""), len(t or "") - len(k), int(k != (t or "")), hashlib.sha256(k.encode()).hexdigest()) for i, (t, k) in enumerate(zip(texts, kept))]
    assert [tuple(r) for r in got] == want


def test_bpe_matches_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = c.default_tokenizer()
    t = Tokenizer.from_file(path)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokenize.roundtrip_digest(docs, path).collect()}
    want = set()
    for i, text, *_ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    enc = tokenize.encode(docs, path)
    assert sorted(r.text for r in tokenize.decode(enc, path).collect()) == sorted(r[1] or "" for r in rows())
    k = codec(path)
    for w in (b" hello", b"aaaaaaa", " été".encode()):
        assert k.encode_words([w])[w] == k.merged(w)


def test_media_round_trip(spark, docs):
    text = {(r[0], r[1]): mpeg.padded(r[1]) for r in ROWS}
    seen = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.n_samples) for r in mpeg.inspect(mpeg.media(docs)).collect())
    want = Counter()
    for i, t, *_ in ROWS:
        raw = text[i, t]
        stored = mpeg.store(raw)
        assert len(raw) % 576 == 0 and raw.startswith((t or "").encode()) and not raw[len((t or "").encode()) :].strip(b"\xff")
        want[i, len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), len(raw)] += 1
    assert seen == want
    held = bytes(RND.choice((255, 242, 224, 1)) for _ in range(576 * 9))
    data = mpeg.store(held)
    s = mpeg.load(data)
    assert mpeg.payload(data, s) == held and s.table["frames"] == 9 and len(s.table["toc"]) == 100 and s.tags["TSSE"] == "quernstone" and s.tags["title"] == "payload"
    junk = b"\xff\xf2\xd8\xc0" * 40
    more = data[: s.offsets[3]] + junk + data[s.offsets[3] :]
    assert mpeg.payload(more, mpeg.load(more)) == held
    broken = bytearray(data)
    broken[s.offsets[4] + 4] ^= 1
    assert len(mpeg.load(bytes(broken)).offsets) == 8
    for k, at in enumerate(s.offsets):
        assert s.seek(Fraction(576 * k + 5, s.rate)) == (at, 5) and abs(s.table_seek(Fraction(576 * k, s.rate)) - at) <= 720 + len(data) // 256  # a frame and a step of the table
    assert mpeg.load(b"").offsets == mpeg.load(b"\xff" * 5000).offsets == [] and mpeg.feature(mpeg.load(b"")).startswith("none")


def _crc_by_bits(bits):
    x = 0xFFFF
    for b in bits:
        x = ((x << 1) ^ (0x8005 if (x >> 15) ^ b else 0)) & 0xFFFF
    return x


def _bits(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


def _frame(version, layer, index, rate, mode, protected, extension=0, pad=0, body=None):
    """A frame made by hand: header, checksum over what its layer guards, and content."""
    code = {"1": 3, "2": 2, "2.5": 0}[version]
    head = bytes((0xFF, 0xE0 | code << 3 | 4 - layer << 1 | (not protected), index << 4 | rate << 2 | pad << 1, mode << 6 | extension << 4))
    h = mpeg.header(head)
    body = bytes(h.length - 4 - 2 * protected) if body is None else body.ljust(h.length - 4 - 2 * protected, b"\0")
    if not protected:
        return head + body
    stereo, bound = mode != 3, 4 * (extension + 1) if mode == 1 else 32
    own = _bits(body)
    if layer == 3:
        n = 8 * {("1", True): 32, ("1", False): 17}.get((version, stereo), 17 if stereo else 9)
    elif layer == 1:
        n = 4 * (2 * bound + 32 - bound) if stereo else 128
    else:
        widths = {("1", 128, True): [4] * 11 + [3] * 12 + [2] * 4, ("1", 192, False): [4] * 11 + [3] * 12 + [2] * 7, ("2", 64, True): [4] * 4 + [3] * 7 + [2] * 19}[version, h.kbps, stereo]
        n = used = 0
        for sb, w in enumerate(widths):
            for _ in range(2 if stereo and sb < bound else 1):
                if any(own[n : n + w]):
                    used += 2 if stereo and sb >= bound else 1
                n += w
        n += 2 * used
    return head + _crc_by_bits(_bits(head[2:]) + own[:n]).to_bytes(2, "big") + body


#: version, layer, bitrate index, rate index, mode, and the kbit/s, rate, length and samples that they mean.
KINDS = [
    ("1", 3, 9, 0, 0, 128, 44100, 417, 1152), ("1", 3, 14, 1, 1, 320, 48000, 960, 1152), ("1", 3, 5, 2, 3, 64, 32000, 288, 1152), ("2", 3, 8, 0, 0, 64, 22050, 208, 576), ("2.5", 3, 4, 0, 3, 32, 11025, 208, 576),
    ("1", 2, 8, 0, 0, 128, 44100, 417, 1152), ("1", 2, 10, 0, 3, 192, 44100, 626, 1152), ("1", 2, 8, 1, 1, 128, 48000, 384, 1152), ("2", 2, 8, 1, 0, 64, 24000, 384, 1152),
    ("1", 1, 4, 0, 0, 128, 44100, 136, 384), ("1", 1, 12, 1, 1, 384, 48000, 384, 384), ("2", 1, 3, 0, 3, 56, 22050, 120, 384),
]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("protected", [False, True])
def test_media_streams_made_by_hand(kind, protected):
    version, layer, index, rate, mode, kbps, hertz, length, samples = kind
    rng = np.random.default_rng(index)
    frames = [_frame(version, layer, index, rate, mode, protected, extension=1 if mode == 1 else 0, pad=k % 2, body=rng.integers(0, 200, 90, dtype=np.uint8).tobytes()) for k in range(5)]
    slot = 4 if layer == 1 else 1
    assert [len(x) for x in frames] == [length + slot * (k % 2) for k in range(5)]
    s = mpeg.load(b"junk" + b"".join(frames))
    at = np.cumsum([4, *map(len, frames)])[:5].tolist()
    assert s.offsets == at and s.skipped == 4 and s.bitrates == {kbps} and s.first.version == version and s.first.layer == layer
    assert s.duration == Fraction(5 * samples, hertz) and (s.checked, s.unchecked) == ((5, 0) if protected else (0, 5))
    assert [s.seek(Fraction(k * samples + 7, hertz)) for k in range(5)] == [(a, 7) for a in at]
    if protected:
        damaged = bytearray(b"".join(frames))
        damaged[len(frames[0]) + len(frames[1]) + 7] ^= 0x10
        assert len(mpeg.load(bytes(damaged)).offsets) == 4


def _tag2(major, frames, flags=0, extra=b""):
    return b"ID3" + bytes((major, 0, flags)) + mpeg._syncsafe(len(extra + frames)) + extra + frames


def test_media_tags_and_tables():
    sound = b"".join(_frame("1", 3, 9, 0, 0, False) for _ in range(6))
    long_ = b"\x03" + b"x" * 200
    tags = (
        _tag2(2, b"TT2\0\0\x04\0abc" + b"TP1\0\0\x02\0z"), _tag2(3, b"TIT2\0\0\0\x09\0\0\x01\xff\xfea\0b\0c\0" + b"TPE1\0\0\0\x02\0\0\0z"),
        _tag2(4, b"TIT2" + mpeg._syncsafe(4) + b"\0\0\x03abc" + b"TALB" + mpeg._syncsafe(len(long_)) + b"\0\0" + long_ + b"TPE1" + mpeg._syncsafe(2) + b"\0\0\x00z", 0x10) + b"3DI" + bytes(7),
        _tag2(3, b"TIT2\0\0\0\x04\0\0\0abc" + b"TPE1\0\0\0\x02\0\0\0z", 0x40, b"\0\0\0\x06" + bytes(6)),
    )
    for tag in tags:
        s = mpeg.load(tag + sound)
        assert (s.tags.get("TIT2") or s.tags.get("TT2")) == "abc" and (s.tags.get("TPE1") or s.tags.get("TP1")) == "z" and s.offsets[0] == len(tag) and s.skipped == 0
    assert mpeg.load(tags[2] + sound).tags["TALB"] == "x" * 200
    item = struct.pack("<II", 2, 0) + b"Artist\0me"
    ape = item + b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 0) + bytes(8)
    old = b"TAG" + b"song".ljust(30, b"\0") + b"me".ljust(30) + bytes(30) + b"1999" + bytes(28) + b"\0\x07" + b"\x01"
    s = mpeg.load(sound + ape + old)
    assert s.tags == {"title": "song", "artist": "me", "year": "1999", "track": "7", "ape:Artist": "me"} and len(s.offsets) == 6 and s.skipped == 0

    lame = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    for name, protected in ((b"Xing", False), (b"Info", False), (b"Xing", True)):
        info = _frame("1", 3, 9, 0, 0, protected, body=bytes(32) + name + struct.pack(">III", 7, 6, 2502) + bytes(range(0, 200, 2)) + lame)
        s = mpeg.load(info + sound)
        assert s.table["kind"] == name.decode() and s.table["frames"] == 6 and len(s.offsets) == 6 and (s.delay, s.trailing) == (576, 1000)
        assert s.duration == Fraction(6 * 1152 - 1576, 44100) and s.seek(0) == (s.offsets[0], 576) and s.table_seek(0) == 0
    vbri = _frame("1", 3, 9, 0, 0, False, body=bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 2502, 6, 3, 2, 2, 2) + struct.pack(">HHH", 417, 417, 417))
    s = mpeg.load(vbri + sound)
    assert s.table["kind"] == "VBRI" and s.table["toc"] == [834] * 3 and len(s.offsets) == 6 and s.table_seek(s.duration / 2) == 834
    free = [bytes((0xFF, 0xFB, pad << 1, 0)) + bytes(396 + pad) for pad in (0, 0, 1, 0, 0)]
    s = mpeg.load(b"".join(free))
    assert s.offsets == np.cumsum([0, *map(len, free)])[:5].tolist() and s.duration == Fraction(5 * 1152, 44100)


def test_html():
    page = '<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav><!-- c --><div class="ad">buy</div><article><h1>Head &amp; x</h1><p>One <b>two</b>\n three<div class="comments"><p>no</p></div><p>&#233;</article><footer>f</footer>'
    assert html.main_text(page) == "Head & x\nOne two three\né"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    plain = "<body><div><a href=1>home</a> <a href=2>news</a></div>" + "".join(f"<p>{words(30)}</p>" for _ in range(4)) + "<div><a href=3>imprint</a></div>"
    assert len(html.main_text(plain).split("\n")) == 4 and "home" not in html.main_text(plain)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = c.default_tokenizer()
    t = Tokenizer.from_file(path)
    out = pack.pack(docs, path, 128).collect()
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 128
    assert sorted(by_seq) == list(range(len(by_seq)))
    for i, text, *_ in rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i and r.doc_tokens == len(ids))
        want = [(a, len(ids[a : a + 128]), zlib.crc32(ids[a : a + 128].tobytes())) for a in range(0, len(ids), 128)]
        assert set(mine) == set(want)
    for hist, capacity, most in (({5: 7, 3: 11, 8: 2, 1: 4}, 8, 12), ({300: 10_000}, 1024, 3334), ({1: 5000}, 1024, 5), ({500: 101, 24: 10}, 1024, 51), ({400: 1000, 350: 900, 120: 4000, 1: 500}, 1024, 1280)):
        got = Counter()
        patterns = pack.spfhp(hist, capacity)
        for n, p in patterns:
            assert n > 0 and sum(p) <= capacity
            for x in p:
                got[x] += n
        assert got == hist and sum(n for n, _ in patterns) <= most
        spots = sorted((length, rank, n) for length, rank, n, *_ in pack.places(patterns))
        for length, total in hist.items():  # every rank of a length has one place
            at = 0
            for _, rank, n in (x for x in spots if x[0] == length):
                assert rank == at
                at += n
            assert at == total


def test_sharding(spark, docs):
    out = shard.shard_by_bytes(docs, 4).collect()
    assert len(out) == len(rows())
    for k in range(4):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    text = {}
    for r, row in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))):
        assert r.size == len((row[1] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((row[1] or "").encode())
        assert text.setdefault(row[1], r.shard) == r.shard
    sizes = [RND.randint(1, 50) for _ in range(40)]

    def least(k):
        cap = max(sizes)
        while True:
            n, used = 1, 0
            for s in sizes:
                n, used = (n + 1, s) if used + s > cap else (n, used + s)
            if n <= k:
                return cap
            cap += 1

    assert [shard.minimax(sizes, k)[0] for k in (1, 3, 7)] == [least(k) for k in (1, 3, 7)]
    groups = spark.createDataFrame([((i << 58) - (1 << 62) + RND.randint(0, 1 << 57), s) for i, s in enumerate(sizes)], "h long, size long")
    order = sorted((r.h, r.size) for r in groups.collect())
    assert shard._cuts(groups, 5, bits=2) == [order[i][0] for i in shard.minimax([s for _, s in order], 5)[1]]


def test_lm(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "a c"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.lm_score) for r in lm.score(df, order=2).collect()}
    ln = np.log
    assert got[3] == (0, 0.0)
    assert got[1] == (4, pytest.approx(ln(3 / 6) + ln(2 / 3) * 2 + ln(0.4 * 3 / 6), abs=1e-3))


@pytest.mark.parametrize(("order", "slice_bytes"), [(3, 8 << 20), (4, 700), (1, 700)])
def test_lm_against_counting(spark, docs, monkeypatch, order, slice_bytes):
    monkeypatch.setattr(lm, "SLICE_BYTES", slice_bytes)
    texts = [(i, (t or "").lower().encode().split()) for i, t, *_ in ROWS]
    seen = Counter(tuple(w[i : i + k]) for _, w in texts for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(len(w) for _, w in texts)

    def one(context, word):
        if not context:
            return math.log(seen[(word,)] / total)
        n = seen[(*context, word)]
        return math.log(n / seen[context]) if n >= lm.MIN_COUNT else math.log(lm.ALPHA) + one(context[1:], word)

    want = sorted((str(i), len(w), round(sum(one(tuple(w[max(0, j - order + 1) : j]), x) for j, x in enumerate(w)), 3)) for i, w in texts)
    got = sorted((str(r.doc_id), r.n_words, r.lm_score) for r in lm.score(docs, order=order).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-3)


@pytest.mark.parametrize("order", [1, 3])
def test_lm_packed_equals_rows(spark, docs, order):
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    a, b = ({r.doc_id: (r.n_words, r.lm_score) for r in run(own, order=order).collect()} for run in (lm.score, lm.score_by_rows))
    assert set(a) == set(b) and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=2e-3) for k in a)


def test_language(spark):
    df = spark.createDataFrame([(i, words(20) if i % 2 else words(20).translate(str.maketrans("abcde", "ßüökx")).upper(), "en" if i % 2 else "de") for i in range(80)] + [(900, None, "en"), (901, "12 !", "en"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df).collect()}
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und"
    held = [r for r in got.values() if r.held_out and r.doc_id < 80]
    assert held and all(r.lang_pred == ("en" if r.doc_id % 2 else "de") and 0 <= r.score <= 1 for r in held)
    assert all(r.lang_pred == "und" for r in langid.predict(df.limit(0)).collect())


def test_language_sets_against_all_sets():
    """The chosen set against every set, each fitted by many rounds."""
    rng = np.random.default_rng(12)
    from itertools import combinations

    for trial in range(40):
        p = rng.dirichlet(np.full(30, 0.4), 4) + 1e-4
        mix = rng.dirichlet(np.full(4, 0.5)) if trial % 2 else np.eye(4)[trial % 4]
        n = rng.multinomial(int(rng.integers(5, 400)), mix @ p / (mix @ p).sum())
        keep = n > 0
        q, n = p[:, keep], n[keep]
        cost = 3.0 * np.log(n.sum() + 1)
        every = {own: langid.mixture(q[list(own)], n, 400)[1] - cost * (len(own) - 1) for k in range(1, 5) for own in combinations(range(4), k)}
        own, share, value = langid.best_set(q, n, cost)
        assert max(every.values()) - every[own] < 0.05 and value == pytest.approx(every[own], abs=0.05) and share.sum() == pytest.approx(1, abs=1e-6)


def test_language_held_out(spark):
    """Accuracy on held-out texts of four toy languages of own letter statistics, and mixed texts by their larger part."""
    rng = np.random.default_rng(2)
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    weights = {x: rng.dirichlet(np.full(26, 0.3)) for x in ("aa", "bb", "cc", "dd")}
    say = lambda x, n: " ".join("".join(rng.choice(alphabet, rng.integers(2, 8), p=weights[x])) for _ in range(n))
    rows = [(i, say(x, int(rng.integers(8, 60))), x) for i, x in enumerate(list(weights) * 60)]
    mixed = [(1000 + i, say("aa", 90) + " " + say("bb", 30), None) for i in range(8)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")).collect()}
    held = [(got[i].lang_pred, x) for i, _, x in rows if got[i].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) >= 0.97
    assert all(got[i].lang_pred == "aa" and 0.55 < got[i].score < 0.95 and set(got[i].lang_set) >= {"aa", "bb"} for i, *_ in mixed)


def test_unlearnt_languages_are_not_known(spark):
    langs, logp = langid.train(spark.createDataFrame([(words(40), "en") for _ in range(50)], "text string, lang string"))
    assert langid.identify(words(3), langs, logp)[3] > 0.9 and langid.identify("Щедрик щедрик щедрівочка прилетіла ластівочка", langs, logp)[3] < 0.3


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-160, 160, (700, 16)).astype(np.int32)
    v[5] = v[6] = v[7]
    index, ids = topk.BitSlices(v, 2), np.arange(700, dtype=np.int64) * 10
    for q in range(0, 700, 50):
        found, scores = index.top(v[q], ids, int(ids[q]))
        want = sorted((-int(v[q] @ v[j]), int(ids[j])) for j in range(700) if j != q)[:5]
        assert list(zip((-scores).tolist(), found.tolist())) == want
    df = spark.createDataFrame([(i, [float(x) / 256 for x in row]) for i, row in enumerate(v.tolist())] + [(1000, None), (1050, [float("nan")] * 16), (1100, [None] * 16)], "vec_id long, embedding array<double>")
    q = topk.quantise(df)
    out = topk.search(q, q.where("vec_id % 50 = 0"), 5, 100, 900).collect()
    assert len(out) == 14 * 5
    for r in out:
        want = sorted((-int(v[r.query_id] @ v[j]), j) for j in range(700) if j != r.query_id)[r["rank"] - 1]
        assert (-r.score, r.vec_id) == want


def test_topk_large_components(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-100, 100, (60, 4)).astype(object)
    v[0] = [256 * 10**9, 0, 0, 0]
    v[7] = [-256 * 10**6, 5, 0, 1]
    more = [(60, [0.5, 0.25]), (61, []), (61, [])]
    rows = [(i, [x / 256 for x in row]) for i, row in enumerate(v.tolist())] + more
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("score", F.lit("y")).withColumn("ids", F.lit("z"))
    q = topk.quantise(df)
    out = {(r.query_id, r["rank"]): (-r.score, r.vec_id) for r in topk.search(q.where("vec_id <> 0"), q, 3, 16).collect()}
    ints = [(i, [int(x * 256 // 1) for x in e]) for i, e in rows]
    for i, a in ints:
        want = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in ints if j not in (0, i))[:3]
        assert [out[i, k + 1] for k in range(3)] == want
    with pytest.raises(OverflowError):
        topk.inner(np.array([[1 << 40]]), np.array([1 << 40]))
    assert topk.search(q.limit(0), q.limit(0)).collect() == topk.search(q.limit(0), q).collect() == []


@pytest.mark.parametrize(("percent", "size"), [(90, 3), (80, 5)])
def test_jaccard(spark, docs, percent, size):
    more = []
    base = words(120).split(" ")
    for i in range(40):  # a chain of near copies and a star around one
        near = list(base)
        for k in range(i % 7):
            near[RND.randrange(120)] = "q%d" % RND.randrange(9)
        more.append((100 + i, " ".join(near)))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {(r.id, r.n_shingles, r.component_id) for r in jaccard.join(df, percent, size, chunk=8).collect()}
    items = [(r[0], r[1]) for r in rows()] + more

    def shingles(t):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in items]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][1] and sets[b][1] and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), 1 << 60), -(1 << 63) if i is None else i)
    assert got == {(i, len(s), None if low[find(k)] == -(1 << 63) else low[find(k)]) for k, (i, s) in enumerate(sets)}


def test_very_long_text(spark):
    """One text of some 4 MB among short ones goes through every operator whole."""
    import corpus_pipeline as p

    long_ = " ".join("".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 7))) for _ in range(720_000))
    passage = words(120)
    rows = [(1, long_ + " " + passage, "en", "s", 0), (2, words(30) + " " + passage, "en", "s", 0), (3, words(50), "en", "s", 0)]
    df, path = spark.createDataFrame(rows, SCHEMA), c.default_tokenizer()
    text = {r[0]: r[1].encode() for r in rows}
    cut = {r.doc_id: r for r in dedup.digest(df).collect()}
    assert cut[1].n_bytes == len(text[1]) and cut[1].n_removed == cut[2].n_removed >= len(passage) and cut[3].n_removed == 0
    assert {r.doc_id: r.n_bytes for r in mpeg.inspect(mpeg.media(df)).collect()} == {i: len(t) for i, t in text.items()}
    n = {r.doc_id: r.n_tokens for r in tokenize.roundtrip_digest(df, path).collect()}
    pieces = pack.pack(df, path).collect()
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in text} == {i: n[i] + 1 for i in text}
    assert {r.doc_id: r.n_words for r in lm.score(df).collect()} == {i: len(t.split()) for i, t in text.items()}
    assert all(r.component_id == r.id and (r.id != 1 or r.n_shingles > 700_000) for r in jaccard.join(df).collect())
    assert {r.lang_pred for r in langid.predict(df.where("doc_id <> 2").union(df.where("doc_id = 2"))).collect()} == {"en"}
    out = {r.doc_id: r.text for r in p.repeated_passages(spark, df, "").collect()}
    assert passage[10:-10] not in out[1] and passage[10:-10] not in out[2]


def test_empty_tables(spark, docs):
    none, path = docs.limit(0), c.default_tokenizer()
    for out in (dedup.digest(none), tokenize.roundtrip_digest(none, path), mpeg.inspect(mpeg.media(none)), pack.pack(none, path), shard.shard_by_bytes(none), lm.score(none), jaccard.join(none)):
        assert out.collect() == []


def test_clashing_columns(spark, docs):
    import corpus_pipeline as p

    path = c.default_tokenizer()
    plain = docs.withColumnRenamed("ids", "source")
    names = "id ids rid node key a b kind label least first bucket length rank run runs rn start offset n n_shingles component_id size law shard slot lang_pred score lang_set removed_spans removed_bytes h hash part word".split()
    more = plain.select("*", *(F.lit("x").alias(n) for n in names))
    for run in (dedup.digest, lambda x: tokenize.roundtrip_digest(x, path), lambda x: mpeg.inspect(mpeg.media(x)), lambda x: pack.pack(x, path), shard.shard_by_bytes, lm.score, langid.predict, jaccard.join):
        assert Counter(map(str, run(plain).collect())) == Counter(map(str, run(more).collect()))
    for _, stage in p.STAGES[:-1]:
        a, b = stage(spark, plain, ""), stage(spark, more, "")
        assert b.columns == more.columns
        assert Counter(map(str, a.collect())) == Counter(map(str, b.select(*plain.columns).collect()))
        assert {r[n] for r in b.collect() for n in names} <= {"x"}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    df = spark.createDataFrame([(i, words(80), "en", "s", 0) for i in range(30)] + [(50, "12 34", "en", "s", 0)], SCHEMA)
    near = df.where("doc_id = 3").selectExpr("90L as doc_id", "concat(text, ' end') as text", "lang", "source", "n_chars")
    df.unionByName(near).write.parquet(str(tmp_path / "documents.parquet"))
    out = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(range(30))


def test_pipeline_stages_at_the_edges(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, words(60), "en", "s", 0) for i in range(12)]
    odd = [(20, None, "en", "s", 0), (21, "", "en", None, None), (22, "12 !", None, "s", 0), (23, "Щедрик щедрик щедрівочка прилетіла ластівочка стала собі щебетати", None, "s", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    assert {r.doc_id for r in p.language(spark, df, "").collect()} == set(range(12))
    twice = df.union(df)
    kept = Counter((r.doc_id, r.text) for r in p.near_copies(spark, twice, "").collect())
    assert kept == Counter([(i, t) for i, t, *_ in rows] + [(23, odd[3][1]), (22, "12 !"), *2 * [(20, None), (21, ""), (None, None)]])
    cut = {r.doc_id: r.text for r in p.repeated_passages(spark, twice.where("doc_id < 12 or doc_id > 19"), "").collect()}
    assert cut[20] is None and cut[21] == "" and cut[22] == "12 !" and all(cut[i] == "" for i in range(12))
    assert {r.doc_id for r in p.packing(spark, df, "").collect()} == {r[0] for r in rows + odd}
    for _, stage in p.STAGES:
        assert stage(spark, df.limit(0), "").collect() == []
    df.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []


def test_passages_by_words(spark):
    import corpus_pipeline as p

    texts, kept = [], []
    for n, letters in ((51, "abcde"), (51, "a"), (58, "abcd"), (65, "abcde"), (50, "abcde"), (20, "abcdefgh"), (2, "a" * 300)):
        passage = " ".join("".join(RND.choice("abcdefgh") for _ in letters) for _ in range(n))
        for _ in range(2):
            a, b = words(70), words(70)
            mark = chr(65 + len(texts))
            texts.append(f"{a} {mark} {passage} {mark} {b}")
            kept.append((passage, n not in (50, 20)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    out = {r.doc_id: r for r in p.repeated_passages(spark, df, "").collect()}
    for i, (passage, goes) in enumerate(kept):
        assert len(out[i].text) == out[i].n_chars
        if goes:  # the space on either side repeats too
            assert out[i].text == texts[i].replace(f" {passage} ", "")
        else:
            assert out[i].text == texts[i]


def test_runs_by_words():
    raw = b"xone two three four"
    run = lambda lo, to: [{"lo": lo, "n": to - lo - 9}]
    for lo, to, n in ((0, 14, 3), (0, 13, 2), (1, 14, 2), (0, 15, 3), (0, 19, 4), (4, 19, 3)):
        assert dedup.long_runs(run(lo, to), raw, 10, n) and not dedup.long_runs(run(lo, to), raw, 10, n + 1)
    split = [{"lo": 0, "n": 2}, {"lo": 2, "n": 3}]
    assert dedup.long_runs(split, raw, 10, 3) == [{"lo": 0, "n": 5}]
    assert not dedup.long_runs([{"lo": 0, "n": 1}, {"lo": 5, "n": 1}], raw, 10, 4)


def test_html_without_end_tags():
    body = "<p>One<p>Two<p>Three"
    for dropped in ('<p class="notice">Note', '<ul><li class="share">x<li>Item</ul>', '<dl><dt class="ad">x<dd>Item</dl>', '<table><tr><td class="ad">x<td>Item</table>', '<section><div class="ad">buy</section>', "<div><aside>x<p>y</div>", '<div class="ad"><p>x<ul><li>y</div>', '<p>Item <span class="share">x</p>', "<nav><ul><li>x<li>y</ul></nav>"):
        want = (["Item"] if "Item" in dropped else []) + ["One", "Two", "Three"]
        assert html.main_text(f"<body><article>{dropped}{body}</article></body>").split("\n") == want
    assert html.main_text(f"<head><title>t</title><body><aside>x<article>{body}</article></body>") == "One\nTwo\nThree"
    assert html.main_text(f'<article><div class="ad">x</b></p></div>{body}') == "One\nTwo\nThree"


def test_html_without_article():
    menu = "".join(f'<div><a href="{i}">page number {i} of many</a></div>' for i in range(5))
    long_ = ["x" * 90, "y" * 200, "z" * 70]
    for want in (["a rose", "is a rose", "is"], ["short"], ["Heading", "By someone", "Monday", *long_, "The end"], [*long_, "- A", "- B", "- C", "- D", *long_]):
        assert html.main_text(f"<body>{menu}{''.join(f'<p>{x}</p>' for x in want)}{menu}</body>").split("\n") == want
    linked = "<p><a href=x>all &amp; only link</a></p>"
    assert html.main_text(f"<body>{menu}<p>{long_[0]}</p>{linked}{linked}<p>{long_[1]}</p>{linked}{menu}").split("\n") == [long_[0], "all & only link", "all & only link", long_[1]]
    assert html.main_text(f"<body><p>slogan</p>{menu}<p>{long_[1]}</p>{menu}<p>imprint</p>") == long_[1]
    assert html.main_text(f"<body>{menu}</body>") == ""


def test_html_marks_are_evidence():
    want = ["Heading", "x" * 90, "y" * 200, "The end"]
    body = "".join(f"<p>{x}</p>" for x in want)
    links = "<ul>" + "".join(f"<li><a href={i}>page {i}</a></li>" for i in range(4)) + "</ul>"
    pages = (
        f"<body>{links}{body}{links}<article class='comment'><p>nice</article>",
        f"<body><p>slogan</p>{links}{body}{links}<article class=teaser>Read this next</article>",
        f"<body>{links}{body}{links}<article><p>Read this next</article>",
        f"<body><p>slogan</p><article class='has-sidebar'>{body}{links}</article><p>imprint</p>",
        f"<body><main id=main>{links}{body}</main><p>imprint</p>",
    )
    assert ["Read this next" not in html.main_text(p) for p in pages] == [True] * 5
    assert [html.main_text(p).split("\n") for p in pages] == [want] * 5
    assert html.main_text(f"<article><h1><a href=x>Linked</a></h1>{body}</article>").split("\n") == ["Linked", *want]


def test_html_names_are_evidence():
    assert html.main_text('<article><ul><li class="notice">x<li>kept one</ul><p>real text here</p></article>') == "kept one\nreal text here"
    assert html.main_text('<article><div class="notice-of-motion">We move</div><p>real text here</p></article>') == "We move\nreal text here"
    assert html.main_text('<article><div class="ad-slot-3">buy</div><p id="cookieBanner">x</p><p>real text here</p><div class="related main">more</div></article>') == "real text here"
    page = "".join(f"<p>{words(30)}</p>" for _ in range(4))
    assert html.main_text(f'<body><div class="widget">{page}</div><p>imprint</p>').count("\n") >= 3


def test_html_every_page_goes_through_the_windows(monkeypatch):
    seen, own = [], html._body
    monkeypatch.setattr(html, "_body", lambda *x: seen.append(1) or own(*x))
    for page in ("<article><p>a</article>", "<main><p>a</main>", "<p>a", "", None):
        html.main_text(page)
    assert len(seen) == 5


def _page(marked: bool, kind: int) -> tuple[str, list[str]]:
    """A page made of labelled blocks, and the text of those that belong to the article."""
    say = lambda n: words(n).capitalize() + "."
    body = [("h1", say(6))] + [("p", say(RND.randint(12, 60))) for _ in range(RND.randint(3, 9))]
    if kind % 3 == 0:
        body[2:2] = [("li", say(5)) for _ in range(4)]
    if kind % 4 == 0:
        body.insert(3, ("h2", say(3)))
    menu = "<ul>" + "".join(f"<li><a href=/{i}>{words(2)}</a></li>" for i in range(RND.randint(4, 9))) + "</ul>"
    inside = "".join(f"<{t}>{x}</{t}>" if kind % 2 else f"<{t}>{x}" for t, x in body)
    tag = "article" if marked else "div"
    advert, notice, comments = f'<div class="ad-box">{say(8)}</div>', f'<div class="cookie-notice"><p>{say(20)}</div>', f'<div id="comments"><p>{say(25)}<p>{say(30)}</div>'
    return f"<html><head><title>{say(4)}</title><style>p{{}}</style></head><body><header>{menu}</header>{notice}<nav>{menu}</nav>{advert}<{tag}>{inside}</{tag}>{comments}<aside>{menu}{say(9)}</aside><footer>{say(7)}</footer></body></html>", [x for _, x in body]


@pytest.mark.parametrize("marked", [True, False])
def test_html_labelled_pages(marked):
    right = found = wanted = 0
    for kind in range(60):
        page, want = _page(marked, kind)
        got = html.main_text(page).split("\n")
        both = Counter(got) & Counter(want)
        right, found, wanted = right + sum(both.values()), found + len(got), wanted + len(want)
    assert right / found >= 0.99 and right / wanted >= 0.99


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", "<p>" + "long " * 400_000, "z")], "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("x"))
    got = Counter((r.page_id, r.url, r.text[:9], r.n_chars) for r in html.extract(df).collect())
    assert got == Counter([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0), (3, "w", "long long", 1_999_999)])
    assert html.extract(df.limit(0)).collect() == []


def test_near_copies_with_repeated_ids(spark):
    import corpus_pipeline as p

    a, b, d, e = (words(120) for _ in range(4))
    texts = [(5, a), (5, a), (7, a + " end"), (None, b), (None, b), (8, b), (None, d), (7, e), (9, e + " end"), (5, e), (10, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    out = Counter((r.doc_id, r.text) for r in p.near_copies(spark, df, "").collect())
    assert out == Counter([(5, a), (None, b), (None, d), (5, e), (10, "")])


def test_batches_are_bounded(spark, monkeypatch):
    own = spark.conf.get(c._BATCH)
    df = spark.range(60, numPartitions=1).selectExpr("id as doc_id", "repeat('a', 250000) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    try:
        spark.conf.set(c._BATCH, "64m")
        c.ship(spark)
        assert max(r.n for r in df.mapInArrow(sizes, "n long").collect()) <= c.SLICE_BYTES + 300_000
        spark.conf.set(c._BATCH, "1m")
        c.ship(spark)
        assert spark.conf.get(c._BATCH) == "1m"
    finally:
        spark.conf.set(c._BATCH, own)

    calls = []
    monkeypatch.setattr(c, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["ab"] * 4)], ["text"])
    assert sum(b.num_rows for b in c.slices(iter([batch, batch]), size=2)) == 8 and calls == [1]
    assert list(c.giving_back(lambda batches: batches)([3])) == [3] and calls == [1, 1]
