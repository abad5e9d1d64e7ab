"""MPEG audio as a media column (operator 3).

The reader takes MPEG-1, 2 and 2.5 streams of Layers I to III in any channel mode.
It parses ID3v1, ID3v2.2 to 2.4 and APEv2 tags, finds frames by resynchronising on
headers that a second frame confirms, verifies checksums (Layer I: bit allocation,
II: allocation and scale factor selection, III: side information), parses the
variable-bitrate tables Xing, Info and VBRI with the encoder's delay and padding,
and gives exact durations (samples over rate), the byte offset of each frame, and
the frame that holds a sample.

The writer makes MPEG-2 Layer III streams of 576 samples a frame.  A payload travels
in the main data of the frames, 576 bytes in each, so that the samples of the stream
count the payload's bytes.  The reader takes nothing from the writer but the bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _common as c

UNIT = 576
# Fixed values of the format.
#: kbit/s by index for (MPEG-1 or not, layer); 0 is a free format.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Samples a second by index for MPEG-1; MPEG-2 has half and 2.5 a quarter of them.
RATES = (44100, 48000, 32000)
VERSIONS = {0: "2.5", 2: "2", 3: "1"}
#: Bits of Layer II allocation by subband, as runs of (subbands, bits), for the tables a to d and the one of low rates.
ALLOCATION = (((11, 4), (12, 3), (4, 2)), ((11, 4), (12, 3), (7, 2)), ((2, 4), (6, 3)), ((2, 4), (10, 3)), ((4, 4), (7, 3), (19, 2)))
MONO, JOINT = 3, 1
#: The writer's streams: MPEG-2 Layer III at 16 kHz, one channel, 144 or 160 kbit/s.
SIDE, RATE_INDEX = 9, 2
MAGIC = b"Xing"


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        table.append(x)
    return table


_CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of protected frames over the first bits of data."""
    bits = 8 * len(data) if bits is None else bits
    x = 0xFFFF
    for b in data[: bits // 8]:
        x = (x << 8 ^ _CRC[x >> 8 ^ b]) & 0xFFFF
    for k in range(bits % 8):
        top = (x >> 15 ^ data[bits // 8] >> 7 - k) & 1
        x = (x << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return x


class Header(NamedTuple):
    """What the four bytes of a frame's header say."""

    version: str
    layer: int
    protected: bool
    kbps: int  # 0: free format
    rate: int
    length: int  # 0 in a free format
    padding: int
    mode: int
    extension: int
    samples: int
    side: int  # bytes of side information, Layer III

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


_headers: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """The header in four bytes, if they are one."""
    if raw in _headers:
        return _headers[raw]
    out = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] >> 5 == 7:
        version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
        index, rate = raw[2] >> 4, raw[2] >> 2 & 3
        if version != 1 and layer < 4 and index < 15 and rate < 3 and raw[3] & 3 != 2:
            first = version == 3
            hertz = RATES[rate] >> (0 if first else 1 if version == 2 else 2)
            kbps, pad, mode = BITRATES[first, layer][index], raw[2] >> 1 & 1, raw[3] >> 6
            samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
            length = 0 if not kbps else (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
            side = ((17 if first else 9) if mode == MONO else (32 if first else 17)) if layer == 3 else 0
            out = Header(VERSIONS[version], layer, not raw[1] & 1, kbps, hertz, length, pad * (4 if layer == 1 else 1), mode, raw[3] >> 4 & 3, samples, side)
    if len(_headers) > 4096:
        _headers.clear()
    _headers[bytes(raw)] = out
    return out


def _guarded(h: Header, body: bytes) -> int:
    """How many bits behind the checksum it guards."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mode == MONO else 2
    bound = 4 * (h.extension + 1) if h.mode == JOINT else 32
    if h.layer == 1:
        return 4 * (bound * channels + (32 - bound))
    each = h.kbps / channels
    if h.version != "1":
        table = 4
    elif each >= 56 and (h.rate == 48000 or each <= 80):
        table = 0
    elif h.rate != 48000 and each >= 96:
        table = 1
    else:
        table = 2 if h.rate != 32000 and each <= 48 else 3
    bits = int.from_bytes(body[:64].ljust(64, b"\0"), "big")
    at, chosen = 0, 0
    widths = [w for n, w in ALLOCATION[table] for _ in range(n)]
    for subband, w in enumerate(widths):
        shared = subband >= bound
        for _ in range(1 if shared else channels):
            if bits >> 512 - at - w & (1 << w) - 1:
                chosen += channels if shared else 1
            at += w
    return at + 2 * chosen


def frame_length(bitrate_index: int, rate_index: int, padding: int) -> int:
    return 72 * BITRATES[False, 3][bitrate_index] * 1000 // (RATES[rate_index] >> 1) + padding


def _header(bitrate_index: int) -> bytes:
    # sync, MPEG-2, Layer III, protected; bitrate, rate, no padding; one channel
    return bytes((0xFF, 0xF2, bitrate_index << 4 | RATE_INDEX << 2, 0xC0))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _parts(bitrate_index: int) -> tuple[bytes, bytes]:
    head, side = _header(bitrate_index), bytes(SIDE)
    front = head + struct.pack(">H", crc16(head[2:] + side)) + side
    return front, bytes(frame_length(bitrate_index, RATE_INDEX, 0) - len(front) - UNIT)


_FRAMES = {i: _parts(i) for i in (13, 14)}  # 144 and 160 kbit/s


def store(payload: bytes) -> bytes:
    """A tagged stream with variable bitrate whose frames carry payload, 576 bytes each."""
    if len(payload) % UNIT or not payload:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    frames = []
    for i in range(0, len(payload), UNIT):
        front, rest = _FRAMES[13 + (payload[i] & 1)]
        frames.append(front + payload[i : i + UNIT] + rest)
    # the table's frame comes first and counts as no audio
    front, rest = _FRAMES[13]
    size = len(front) + UNIT + len(rest)
    ends, at = [], size
    for f in frames:
        ends.append(at)
        at += len(f)
    toc = bytes(min(255, ends[len(frames) * k // 100] * 256 // at) for k in range(100))
    table = MAGIC + struct.pack(">III", 7, len(frames), at) + toc
    first = front + table + bytes(size - len(front) - len(table))
    text = b"\x03quernstone"
    tag = b"TSSE" + struct.pack(">I", len(text)) + b"\0\0" + text
    id3 = b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag
    tail = b"TAG" + b"payload".ljust(30, b"\0") + bytes(94) + b"\xff"
    return id3 + first + b"".join(frames) + tail


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of audio frames
    starts: list[int] = field(default_factory=list)  # first sample of each
    tags: dict[str, str] = field(default_factory=dict)
    first: Header | None = None
    samples: int = 0
    delay: int = 0
    trailing: int = 0  # samples that the encoder padded at the end
    checked: int = 0  # frames whose checksum held
    unchecked: int = 0  # frames without one
    skipped: int = 0  # bytes passed over while looking for a frame
    table: dict | None = None
    bitrates: set[int] = field(default_factory=set)

    @property
    def rate(self) -> int:
        return self.first.rate if self.first else 0

    @property
    def duration(self) -> Fraction:
        """Seconds of audio without what the encoder added at its ends."""
        return Fraction(max(0, self.samples - self.delay - self.trailing), self.rate) if self.rate else Fraction(0)

    def seek(self, seconds: Fraction | float) -> tuple[int, int]:
        """(byte offset of the frame, samples to drop inside of it) for a time of the audio."""
        sample = min(max(0, int(Fraction(seconds) * self.rate)) + self.delay, max(0, self.samples - 1))
        k = bisect_right(self.starts, sample) - 1
        return (self.offsets[k], sample - self.starts[k]) if k >= 0 else (0, 0)

    def table_seek(self, seconds: Fraction | float) -> int | None:
        """The byte offset that the variable-bitrate table gives for a time, from the first frame on; it is near, not exact."""
        t = self.table or {}
        total = self.duration
        if not total or not t.get("toc") or not t.get("bytes"):
            return None
        share = min(Fraction(1), max(Fraction(0), Fraction(seconds) / total))
        if t["kind"] == "VBRI":
            return t["at"] + sum(t["toc"][: int(share * len(t["toc"]))])
        return t["at"] + t["toc"][min(99, int(share * 100))] * t["bytes"] // 256


def _text(raw: bytes) -> str:
    if not raw:
        return ""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0])
    return raw[1:].decode(kind, "replace").rstrip("\0") if kind else raw.decode("latin-1").rstrip("\0")


def _sync7(raw: bytes) -> int:
    return sum((x & 0x7F) << s for x, s in zip(raw, (21, 14, 7, 0)))


def _id3(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Read an ID3v2 tag at this place into tags; where it ends (at, if there is none)."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or data[at + 3] not in (2, 3, 4) or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return at
    major, flags, size = data[at + 3], data[at + 5], _sync7(data[at + 6 : at + 10])
    end = at + 10 + size + (10 if major == 4 and flags & 0x10 else 0)
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and major > 2 and len(body) >= 4:  # extended header
        p = _sync7(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    name, head = (3, 6) if major == 2 else (4, 10)
    while p + head <= len(body) and body[p]:
        key, raw = body[p : p + name].decode("latin-1"), body[p + name : p + 2 * name]
        n = _sync7(raw) if major == 4 else int.from_bytes(raw, "big")
        own = body[p + head : p + head + n]
        if major == 4:
            if body[p + 9] & 1:  # a length stands before the content
                own = own[4:]
            if body[p + 9] & 2 or flags & 0x80:
                own = own.replace(b"\xff\0", b"\xff")
        if key[:1] == "T" and key not in ("TXX", "TXXX"):
            tags[key] = _text(own)
        p += head + n
    return min(end, len(data))


def _id3v1(data: bytes, end: int, tags: dict[str, str]) -> int:
    if end < 128 or data[end - 128 : end - 125] != b"TAG":
        return end
    own = data[end - 128 : end]
    for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
        text = own[a:b].split(b"\0")[0].decode("latin-1").rstrip()
        if text:
            tags[name] = text
    if not own[125] and own[126]:
        tags["track"] = str(own[126])
    return end - 128


def _ape(data: bytes, end: int, tags: dict[str, str]) -> int:
    if end < 32 or data[end - 32 : end - 24] != b"APETAGEX":
        return end
    version, size, count, flags = struct.unpack("<IIII", data[end - 24 : end - 8])
    start = end - size
    if start < 0:
        return end
    p = start
    for _ in range(count):
        if p + 8 > end - 32:
            break
        n, kind = struct.unpack("<II", data[p : p + 8])
        z = data.find(b"\0", p + 8, end)
        if z < 0 or z + 1 + n > end:
            break
        if not kind & 6:
            tags["ape:" + data[p + 8 : z].decode("latin-1")] = data[z + 1 : z + 1 + n].decode("utf-8", "replace")
        p = z + 1 + n
    return max(0, start - (32 if version >= 2000 and flags & 1 << 31 else 0))


def _free_length(data: bytes, at: int, end: int, h: Header) -> int:
    """Length of a free-format frame: up to the next header of its kind that is free as well."""
    p = at + 24
    while 0 <= (p := data.find(b"\xff", p, min(end, at + 8192))):
        o = header(data[p : p + 4])
        if o and o.kind == h.kind and not o.kbps and o.mode == h.mode:
            return p - at
        p += 1
    return 0


_checks: dict[tuple, int] = {}


def _frame_at(data: bytes, at: int, end: int, kind: tuple | None, free: int = 0) -> tuple[int, Header | None]:
    """Length and header of a valid frame at this place, else 0: header fields, kind, room, and checksum must all hold."""
    h = header(data[at : at + 4])
    if h is None or kind and h.kind != kind:
        return 0, None
    n = h.length or (free + h.padding if free else _free_length(data, at, end, h))
    first = at + (6 if h.protected else 4)
    if at + n > end or n < first - at + h.side:
        return 0, None
    if h.protected:
        body = data[at + 2 : at + 4] + data[first : first + (h.side if h.layer == 3 else 64)]
        key = (h.layer, h.version, body)
        want = _checks.get(key)
        if want is None:
            if len(_checks) > 4096:
                _checks.clear()
            want = _checks[key] = crc16(body, min(8 * len(body), 16 + _guarded(h, body[2:])))
        if want != data[at + 4] << 8 | data[at + 5]:
            return 0, None
    return n, h


def _rate_table(data: bytes, at: int, n: int, h: Header) -> dict | None:
    """The variable-bitrate table in a frame of Layer III, if it holds one."""
    main = at + (6 if h.protected else 4) + h.side
    for p in {main, at + 4 + h.side}:
        if data[p : p + 4] in (b"Xing", b"Info"):
            out: dict = {"kind": data[p : p + 4].decode(), "at": at}
            flags, q = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], q = int.from_bytes(data[q : q + 4], "big"), q + 4
            if flags & 4:
                out["toc"], q = list(data[q : q + 100]), q + 100
            if flags & 8:
                q += 4
            if data[q : q + 4] in (b"LAME", b"Lavc", b"Lavf") and q + 24 <= at + n:
                both = int.from_bytes(data[q + 21 : q + 24], "big")
                out["delay"], out["padding"] = both >> 12, both & 0xFFF
            return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= at + n:
        _, delay, _, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", data[p + 4 : p + 26])
        q = p + 26
        if width not in (1, 2, 3, 4) or q + entries * width > at + n:
            return None
        toc = [scale * int.from_bytes(data[q + k * width : q + (k + 1) * width], "big") for k in range(entries)]
        return {"kind": "VBRI", "at": at, "frames": frames, "bytes": size, "toc": toc, "per_entry": each, "vbri_delay": delay}
    return None


def load(data: bytes) -> Stream:
    """Read a stream.  Damaged stretches are passed over to the next place where a
    valid frame is followed by another one of its kind, by a tag or by the end."""
    s, at, end = Stream(), 0, len(data)
    while (after := _id3(data, at, s.tags)) > at:
        at = after
    while (before := _ape(data, _id3v1(data, end, s.tags), s.tags)) < end:
        end = before
    synced, kind, free, begun = False, None, 0, False
    while at < end:
        n, h = _frame_at(data, at, end, kind, free)
        if n and not synced:  # a lone match may be payload: the next frame must follow
            synced = at + n >= end or _frame_at(data, at + n, end, h.kind, 0 if h.kbps else n - h.padding)[0] > 0
        if not n or not synced:
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            s.skipped += nxt - at
            at = nxt
            continue
        kind = h.kind
        if not h.kbps and not free:
            free = n - h.padding
        if not begun:
            begun, s.first = True, h
            s.table = _rate_table(data, at, n, h) if h.layer == 3 else None
            if s.table:
                s.delay, s.trailing = s.table.get("delay", 0), s.table.get("padding", 0)
                at += n
                continue
        s.offsets.append(at)
        s.starts.append(s.samples)
        s.samples += h.samples
        s.bitrates.add(h.kbps or free * 8 * h.rate // (h.samples * 1000))
        if h.protected:
            s.checked += 1
        else:
            s.unchecked += 1
        at += n
    return s


def payload(data: bytes, s: Stream) -> bytes:
    """The main data that the writer's frames carry."""
    if not s.first or (s.first.version, s.first.layer, s.first.mode) != ("2", 3, MONO):
        return b""
    first = 6 + SIDE if s.first.protected else 4 + SIDE
    return b"".join([data[at + first : at + first + UNIT] for at in s.offsets])


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def feature(s: Stream) -> str:
    """Exact duration as samples/rate, and what the reader found."""
    t = s.table or {}
    name = f"mpeg{s.first.version}-layer{s.first.layer}" if s.first else "none"
    return f"{name} frames={len(s.offsets)} duration={s.samples}/{s.rate} kbps={'+'.join(map(str, sorted(s.bitrates)))} crc={s.checked} skipped={s.skipped} table={t.get('frames', 0)}f{t.get('bytes', 0)}b last={s.offsets[-1] if s.offsets else -1}"


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): every whole text as a stored stream; null as empty. Other columns are ignored."""
    c.ship(docs.sparkSession)

    def run(batches):
        for b in c.slices(batches):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([store(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def inspect(stored: DataFrame) -> DataFrame:
    """Digests, features, duration and seek offsets of stored streams, from their bytes alone.

    A null or empty stream has no frames; repeated rows give repeated rows, and an
    empty table an empty result.  A stream is read whole, in memory of a few times
    its size.
    """

    def run(batches):
        for b in c.slices(batches, "media"):
            rows = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_samples", "sample_rate", "seek_offsets")}
            for data in b.column(2).to_pylist():
                data = data or b""
                s = load(data)
                held = payload(data, s)
                for k, v in zip(rows, (len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), s.samples, s.rate, s.offsets)):
                    rows[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(rows.values(), kinds))], ["doc_id", "n_bytes", *rows])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_samples long, sample_rate int, seek_offsets array<bigint>")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(media(c.table(spark, sf_dir, "documents")))
