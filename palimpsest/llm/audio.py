"""MPEG audio columns: texts stored in MPEG audio frames, and frames parsed back.

A stream is an ID3v2.3 tag, a frame with the variable-bitrate table, and layer III frames whose
granules are silent: the payload lies in the ancillary bytes behind the side information, in whole
units of 64 bytes, and players see a valid file. The header's CRC covers the side information.

``parse`` reads any MPEG 1, 2 and 2.5 audio stream of layers I to III: ID3v1 and ID3v2 tags, Xing,
Info and VBRI tables, frames found again after damage, CRCs of layers I and III (those of layer II
cover its bit allocation, which is not decoded: they count as unread), the exact duration as a
fraction, and the byte offset of every frame.

Null and empty texts give 64 zero bytes. Repeated rows give equal values each. A long text is one
stream, in a slice of its own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm import common

UNIT = 64

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG 1 or not, layer), Hz by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # the two bits: 3 is MPEG 1, 2 is MPEG 2, 0 is MPEG 2.5
    layer: int
    checked: bool
    kbps: int
    rate: int
    mono: bool
    length: int  # bytes of the frame
    samples: int
    side: int  # bytes of layer III side information


def header(four: bytes) -> Header | None:
    """What the four bytes of a frame header say; None if they are none (or of free format)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate_bits, kbps_bits, pad = four[2] >> 2 & 3, four[2] >> 4, four[2] >> 1 & 1
    if version == 1 or layer == 4 or rate_bits == 3 or kbps_bits in (0, 15) or four[3] & 3 == 2:
        return None
    first, mono = version == 3, four[3] >> 6 == 3
    kbps, rate = BITRATES[first, layer][kbps_bits], SAMPLE_RATES[version][rate_bits]
    samples = 384 if layer == 1 else 1152 if first or layer == 2 else 576
    length = (12_000 * kbps // rate + pad) * 4 if layer == 1 else samples * 125 * kbps // rate + pad
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(version, layer, not four[1] & 1, kbps, rate, mono, length, samples, side)


def crc16(data: bytes) -> int:
    """The frames' checksum: polynomial 0x8005, from all ones, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    crc_good: int = 0
    crc_bad: int = 0
    crc_unread: int = 0
    skipped: int = 0  # bytes passed over in search of a header
    seconds: Fraction = Fraction(0)


def _synchsafe(four: bytes) -> int:
    return (four[0] & 127) << 21 | (four[1] & 127) << 14 | (four[2] & 127) << 7 | four[3] & 127


def _id3v2(data: bytes, out: Stream) -> int:
    """Reads the tag at the start, if any (2.2 to 2.4, unsynchronised or with an extended header too); the offset behind it."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    version, flags, end = data[3], data[5], 10 + _synchsafe(data[6:10])
    body = data[10:end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and version > 2:
        at = 4 + int.from_bytes(body[:4]) if version == 3 else _synchsafe(body[:4])
    letters, lead = (3, 6) if version == 2 else (4, 10)
    compressed = version == 2 and flags & 0x40
    while not compressed and at + lead <= len(body) and body[at]:
        name, number = body[at : at + letters].decode("latin-1"), body[at + letters : at + 2 * letters]
        size = _synchsafe(number) if version == 4 else int.from_bytes(number)
        held = body[at + lead : at + lead + size]
        if version == 4 and body[at + 9] & 2:
            held = held.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and held:
            text = held[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(held[0], 3)], "replace")
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text.rstrip("\0"))
            out.tags[key] = value.rstrip("\0")
        at += lead + size
    return end + (10 if version == 4 and flags & 0x10 else 0)


def _table(data: bytes, at: int, head: Header, out: Stream) -> bool:
    """Reads a variable-bitrate table, if this frame is one."""
    x = at + 4 + 2 * head.checked + head.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, y = int.from_bytes(data[x + 4 : x + 8]), x + 8
        out.table["kind"] = data[x : x + 4].decode()
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out.table[name] = int.from_bytes(data[y : y + 4])
                y += 4
        if flags & 4:
            out.table["toc"] = list(data[y : y + 100])
        return True
    if data[at + 36 : at + 40] == b"VBRI":
        out.table |= {"kind": "VBRI", "bytes": int.from_bytes(data[at + 46 : at + 50]), "frames": int.from_bytes(data[at + 50 : at + 54])}
        n, scale, width = (int.from_bytes(data[y : y + 2]) for y in (at + 54, at + 56, at + 58))
        if n and width:
            out.table["toc"] = [scale * int.from_bytes(data[y : y + width]) for y in range(at + 62, at + 62 + n * width, width)]
        return True
    return False


def parse(data: bytes) -> Stream:
    """All frames of a stream. Behind damage, a header counts only if another header or the end follows its frame."""
    out, known, sums = Stream(), {}, {}
    at, end = _id3v2(data, out), len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags |= {k: v for k, v in (("title", data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").strip()), ("artist", data[end + 33 : end + 63].split(b"\0")[0].decode("latin-1").strip())) if v}

    def head_at(x: int) -> Header | None:
        four = data[x : x + 4]
        if four not in known:
            known[four] = header(four)
        return known[four]

    seconds, in_step = {}, True
    while at + 4 <= end:
        head = head_at(at)
        if head and at + head.length > end:
            head = None
        if head and not in_step and at + head.length != end and not head_at(at + head.length):
            head = None
        if not head:
            following = data.find(b"\xff", at + 1, end)
            out.skipped += (following if following >= 0 else end) - at
            at, in_step = following if following >= 0 else end, False
            continue
        in_step = True
        out.crc_unread += head.checked and head.layer == 2
        if head.checked and head.layer != 2:
            n = head.side if head.layer == 3 else 16 if head.mono else 32
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + n]
            if covered not in sums:
                if len(sums) > 4096:
                    sums.clear()
                sums[covered] = crc16(covered).to_bytes(2)
            if sums[covered] == data[at + 4 : at + 6]:
                out.crc_good += 1
            else:
                out.crc_bad += 1
        if out.headers or out.table or not _table(data, at, head, out):
            out.offsets.append(at)
            out.headers.append(head)
            seconds[head.rate] = seconds.get(head.rate, 0) + head.samples
        at += head.length
    out.skipped += max(0, end - at)
    out.seconds = sum((Fraction(n, rate) for rate, n in seconds.items()), Fraction(0))
    return out


def _frame(kbps_bits: int) -> tuple[bytes, Header]:
    """Header, checksum and silent side information of an MPEG 1 layer III mono frame at 48 kHz."""
    four = bytes((0xFF, 0xFA, kbps_bits << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return four + crc16(four[2:] + side).to_bytes(2) + side, header(four)


_FRAMES = [(*_frame(bits),) for bits in range(1, 15)]
_ROOM = [(head.length - len(start)) // UNIT * UNIT for start, head in _FRAMES]
_LEAD = len(_FRAMES[0][0])


def room(head: Header) -> int:
    """Payload bytes of one of our frames."""
    return (head.length - _LEAD) // UNIT * UNIT


def store(payload: bytes) -> bytes:
    """A stream that holds the payload (a multiple of 64 bytes)."""
    most = _ROOM[-1]
    start, head = _FRAMES[-1]
    gap = bytes(head.length - _LEAD - most)
    parts = [part for i in range(0, len(payload) - most + 1, most) for part in (start, payload[i : i + most], gap)]
    sizes = [head.length] * (len(payload) // most)
    if rest := len(payload) % most:
        k = next(k for k, n in enumerate(_ROOM) if n >= rest)
        start, head = _FRAMES[k]
        parts += [start, payload[-rest:], bytes(head.length - _LEAD - rest)]
        sizes.append(head.length)
    lead, table_head = _FRAMES[4]
    frames = b"".join(parts)
    total = table_head.length + len(frames)
    ends = np.cumsum([table_head.length, *sizes])
    toc = bytes(int(x) for x in np.minimum(255, ends[np.arange(100) * len(sizes) // 100] * 256 // total))
    table = b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc
    text = b"\0payload_bytes\0%d" % len(payload)
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    n = len(tag)
    id3 = b"ID3\3\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + tag
    return id3 + lead + table + bytes(table_head.length - len(lead) - len(table)) + frames


def load(media: bytes) -> tuple[bytes, Stream]:
    """The payload that ``store`` put into a stream."""
    stream = parse(media)
    data = b"".join([media[at + _LEAD : at + _LEAD + room(head)] for at, head in zip(stream.offsets, stream.headers, strict=True)])
    return data[: int(stream.tags["payload_bytes"])], stream


def feature(stream: Stream, size: int) -> str:
    """A readable summary: frames, exact duration, mean bitrate, checksums, table, and the byte offset a quarter, half and three quarters in."""
    n, d = stream.seconds.numerator, stream.seconds.denominator
    seek = ",".join(str(stream.offsets[len(stream.offsets) * q // 4]) for q in (1, 2, 3)) if stream.offsets else ""
    kbps = round(float(size * 8 / 1000 / stream.seconds), 1) if n else 0
    return f"frames={len(stream.offsets)};seconds={n // gcd(n, d)}/{d};kbps={kbps};crc={stream.crc_good}/{stream.crc_good + stream.crc_bad};table={stream.table.get('kind', '-')}:{stream.table.get('frames', 0)};skipped={stream.skipped};seek={seek}"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each text as MPEG audio and read the stored bytes back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    seconds (double), seek (byte offset of each frame), and ``media`` (binary) with ``keep_media``.
    """
    src = common.only(docs, doc_id=id_col, text=text_col)
    names = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("seconds", T.DoubleType()), ("seek", T.ArrayType(T.LongType()))]
    names += [("media", T.BinaryType())] if keep_media else []
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), *(T.StructField(*x) for x in names)])
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "seconds": pa.float64(), "seek": pa.list_(pa.int64()), "media": pa.binary()}

    def make() -> Callable:
        def step(batch: pa.RecordBatch):
            for part in _by_bytes(batch):
                rows = []
                for text in part.column(1):
                    payload, n_bytes = payload_of(text.as_py())
                    media = store(payload)
                    back, stream = load(media)
                    row = (n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream, len(media)), float(stream.seconds), stream.offsets)
                    rows.append((*row, media) if keep_media else row)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], kinds.get(name, pa.string())) for i, (name, _) in enumerate(names))], names=["doc_id", *(name for name, _ in names)])

        return step

    return common.map_rows(src, make, schema)


def _by_bytes(batch: pa.RecordBatch, most: int = 16 << 20):
    """Slices of a batch of some ``most`` text bytes, a row at least."""
    _, at = common.utf8(batch.column(1))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most)) - 1)
        yield batch.slice(first, last - first)
        first = last


def scan(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Parse a binary column of MPEG audio: seconds, frames, checksums good and bad, bytes skipped, tags, seek offsets. Null counts as empty."""
    src = common.only(media, doc_id=id_col, media=media_col)
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in (("frames", T.LongType()), ("seconds", T.DoubleType()), ("duration", T.StringType()), ("crc_good", T.LongType()), ("crc_bad", T.LongType()), ("skipped", T.LongType()), ("table_kind", T.StringType()), ("table_frames", T.LongType()), ("tags", T.MapType(T.StringType(), T.StringType())), ("seek", T.ArrayType(T.LongType()))))])

    def make() -> Callable:
        def step(batch: pa.RecordBatch):
            found = [parse(x.as_py() or b"") for x in batch.column(1)]
            columns = [[len(s.offsets) for s in found], [float(s.seconds) for s in found], [f"{s.seconds.numerator}/{s.seconds.denominator}" for s in found], [s.crc_good for s in found], [s.crc_bad for s in found], [s.skipped for s in found], [s.table.get("kind") for s in found], [s.table.get("frames") for s in found], [list(s.tags.items()) for s in found], [s.offsets for s in found]]
            kinds = [pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

        return step

    return common.map_rows(src, make, schema)
