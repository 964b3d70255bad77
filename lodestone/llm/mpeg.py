"""MPEG audio columns: frames resynchronised, tags and variable-bitrate tables parsed, checksums verified.

parse() walks an MPEG-1/2/2.5 Layer I-III stream header by header. It skips ID3v2 tags in front and ID3v1 and APE tags
behind, looks for the next header that a second one confirms where bytes are damaged, checks CRC-16 where the protected
part is known (Layers I and III), reads Xing/Info and VBRI tables and the encoder's delay, and returns exact sample
counts and the byte offset of every audio frame, so that a reader can seek to any frame.

encode() stores bytes losslessly in such a stream: silent Layer III frames whose ancillary bytes hold the payload, the
last of them at the least bitrate that fits, behind an ID3v2 tag with the payload's size and a Xing frame with its table.
An empty silent frame ends the stream: it is longer than what a reader searches for tags, so that payload which looks
like one is never at the end.

Defined results: null or empty media has no frames, 0 samples and null rates. Bytes that hold no frame count as junk.
A frame cut off at the end is junk and marks the stream as truncated. Repeated rows give equal values, ties do not
arise. Empty tables stay empty. Texts of any length are stored whole. Input columns named like a result are replaced.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG 1?, layer), and samples a second of MPEG 1.
KBPS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = (44100, 48000, 32000)
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    crc: bool
    kbps: int
    hz: int
    channels: int
    size: int
    samples: int
    side: int  # bytes of side information of Layer III
    checked: int  # bytes after the CRC that it covers; -1 if not known

    @property
    def kind(self):
        return self.version, self.layer, self.hz


@functools.lru_cache(maxsize=65536)
def header(raw: bytes) -> Header | None:
    """The four bytes of a frame header, or None if they are none. Free-format frames are not taken."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
    rate, hz, pad, mode = raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1, raw[3] >> 6
    if version is None or layer == 4 or rate in (0, 15) or hz == 3 or raw[3] & 3 == 2:
        return None
    first, crc = version == "1", not raw[1] & 1
    kbps, hz = KBPS[first, layer][rate - 1], HZ[hz] >> {"1": 0, "2": 1, "2.5": 2}[version]
    channels = 1 if mode == 3 else 2
    if layer == 1:
        size, samples = (12000 * kbps // hz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or first else 576
        size = samples // 8 * 1000 * kbps // hz + pad
    side = 0 if layer != 3 else (32, 17)[channels == 1] if first else (17, 9)[channels == 1]
    bound = 4 * ((raw[3] >> 4 & 3) + 1) if mode == 1 else 32
    checked = side if layer == 3 else (bound * channels + 32 - bound) * 4 // 8 if layer == 1 else -1
    if size < 4 + 2 * crc + max(0, checked):
        return None
    return Header(version, layer, crc, kbps, hz, channels, size, samples, side, checked)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()


@functools.lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial x^16 + x^15 + x^2 + 1, starting from all ones."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass
class Stream:
    frames: list[tuple[int, Header]] = field(default_factory=list)  # audio frames with their offsets
    samples: int = 0
    skipped: int = 0  # samples of the encoder's delay and padding
    crc_checked: int = 0
    crc_failed: int = 0
    junk: int = 0
    resyncs: int = 0
    truncated: bool = False
    tags: dict = field(default_factory=dict)
    table: str | None = None  # Xing, Info or VBRI
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] = field(default_factory=list)
    table_at: int = -1
    end: int = 0

    @property
    def table_ok(self) -> bool | None:
        if self.table is None:
            return None
        return self.table_frames in (None, len(self.frames)) and self.table_bytes in (None, self.end - self.table_at)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict) -> int:
    """Read the tag at `at` if there is one; where it ends."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at
    major, end = data[at + 3], at + 10 + _syncsafe(data[at + 6 : at + 10])
    pos, stop = at + 10, min(end, len(data))
    if data[at + 5] & 0x40 and stop - pos > 4:  # extended header
        pos += _syncsafe(data[pos : pos + 4]) if major == 4 else 4 + int.from_bytes(data[pos : pos + 4], "big")
    while major in (3, 4) and pos + 10 <= stop and data[pos] != 0:
        name, raw = data[pos : pos + 4].decode("latin-1"), data[pos + 4 : pos + 8]
        size = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body, pos = data[pos + 10 : min(pos + 10 + size, stop)], pos + 10 + size
        if name.startswith("T") and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace").rstrip("\0")
            label, mark, value = text.partition("\0")
            tags[f"{name}:{label}" if mark and name == "TXXX" else name] = value if mark and name == "TXXX" else text
    return end + 10 * bool(data[at + 5] & 0x10)


def _tail(data: bytes, end: int, tags: dict) -> int:
    """Where the audio ends: before ID3v1 and APE tags."""
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["ID3v1"] = data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").strip()
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack_from("<I4xI", data, end - 20)
        end = max(0, end - size - 32 * bool(flags & 0x80000000))
        tags["APE"] = str(size)
    return end


def _vbr(data: bytes, at: int, h: Header, s: Stream) -> bool:
    """Read the table in the frame at `at`, if it is one."""
    if h.layer != 3:
        return False
    for place in (at + 4 + 2 * h.crc + h.side, at + 4 + h.side):
        if data[place : place + 4] in (b"Xing", b"Info") and place + 8 <= at + h.size:
            s.table, flags, pos = data[place : place + 4].decode(), int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
            if flags & 1:
                s.table_frames, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            if flags & 2:
                s.table_bytes, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            if flags & 4:
                s.toc, pos = list(data[pos : pos + 100]), pos + 100
            pos += 4 * bool(flags & 8)
            if data[pos : pos + 4] in (b"LAME", b"Lavc", b"Lavf") and pos + 24 <= at + h.size:
                both = int.from_bytes(data[pos + 21 : pos + 24], "big")
                s.skipped = (both >> 12) + (both & 0xFFF)
            s.table_at = at
            return True
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= at + h.size:
        _, _, _, s.table_bytes, s.table_frames, n, scale, width, _ = struct.unpack_from(">HHHIIHHHH", data, at + 40)
        s.toc = [int.from_bytes(data[at + 62 + i * width : at + 62 + (i + 1) * width], "big") * scale for i in range(n) if at + 62 + (i + 1) * width <= len(data)]
        s.table, s.table_at = "VBRI", at
        return True
    return False


def parse(data: bytes) -> Stream:
    s = Stream()
    pos = 0
    while (after := _id3v2(data, pos, s.tags)) != pos:
        pos = after
    s.end = end = max(pos, _tail(data, len(data), s.tags))
    kind, lost = None, False
    while pos + 4 <= end:
        h = header(data[pos : pos + 4])
        after = pos + h.size if h else 0
        # a header in step is taken if it is of the stream's kind; one found by search must be confirmed by the next
        good = h is not None and after <= end and (h.kind == kind and not lost or after + 4 > end or ((n := header(data[after : after + 4])) is not None and n.kind == h.kind))
        if not good:
            if h is not None and h.kind == kind and not lost and after > end:
                s.truncated = True
            s.resyncs += not lost and kind is not None
            lost, start = True, pos
            pos = data.find(b"\xff", pos + 1, end)
            pos = end if pos < 0 else pos
            s.junk += pos - start
            continue
        if h.crc and h.checked >= 0:
            s.crc_checked += 1
            body = data[pos + 6 : pos + 6 + h.checked]
            s.crc_failed += crc16(data[pos + 2 : pos + 4] + body) != int.from_bytes(data[pos + 4 : pos + 6], "big")
        if s.frames or s.table or not _vbr(data, pos, h, s):
            s.frames.append((pos, h))
            s.samples += h.samples
        kind, lost, pos = h.kind, False, after
    s.junk += max(0, end - pos)
    return s


# What encode() writes: MPEG 1 Layer III, 48 kHz, two channels, with CRC. A frame has 3 bytes per kbit/s.
_OVERHEAD, _SIDE = 4 + 2 + 32, bytes(32)
_ROOMS = [(3 * k - _OVERHEAD, i + 1) for i, k in enumerate(KBPS[True, 3])]
_MOST = _ROOMS[-1][0]
_SIZE_TAG = "payload_bytes"
_LAST = 144  # the frame behind the payload, at 48 kbit/s; an ID3v1 tag has 128 bytes, an APE footer 32


@functools.cache
def _front(rate: int) -> bytes:
    head = bytes((0xFF, 0xFA, rate << 4 | 1 << 2, 0))
    return head + crc16(head[2:] + _SIDE).to_bytes(2, "big") + _SIDE


def encode(payload: bytes) -> bytes:
    """An MPEG audio stream that holds payload."""
    frames = [_front(14) + payload[a : a + _MOST] for a in range(0, len(payload) - _MOST + 1, _MOST)]
    rest = payload[len(frames) * _MOST :]
    if rest:
        room, rate = next(x for x in _ROOMS if x[0] >= len(rest))
        frames.append(_front(rate) + rest.ljust(room, b"\0"))
    frames.append(_front(3).ljust(_LAST, b"\0"))
    audio = b"".join(frames)
    first = 192  # the table's own frame, at 64 kbit/s
    total = first + len(audio)
    starts = lambda i: first + min(i * len(frames) // 100 * (_MOST + _OVERHEAD), max(0, len(audio) - 1))
    toc = bytes(min(255, 256 * starts(i) // total) for i in range(100))
    table = (_front(5) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc).ljust(first, b"\0")
    text = b"\3" + _SIZE_TAG.encode() + b"\0" + str(len(payload)).encode()
    safe = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    tag = b"TXXX" + safe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + safe(len(tag)) + tag + table + audio


def decode(data: bytes, s: Stream) -> bytes | None:
    """The payload that encode() stored, from the parsed frames; None if the stream holds none or not all of it."""
    size = s.tags.get(f"TXXX:{_SIZE_TAG}", "")
    if not size.isdigit():
        return None
    payload = b"".join(data[at + _OVERHEAD : at + h.size] for at, h in s.frames)
    return payload[: int(size)] if len(payload) >= int(size) else None


def padded(text: str | None, unit: int = 64) -> tuple[int, bytes]:
    """Length of a text in UTF-8, and it with bytes 0 up to a positive multiple of unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: every text as MPEG audio."""
    schema = T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def store(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [padded(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([encode(p) for _, p in rows], pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(store, schema)


INDEX = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("n_frames", T.LongType()),
        T.StructField("samples", T.LongType()),
        T.StructField("duration_us", T.LongType()),
        T.StructField("kbps_min", T.IntegerType()),
        T.StructField("kbps_max", T.IntegerType()),
        T.StructField("crc_checked", T.LongType()),
        T.StructField("crc_failed", T.LongType()),
        T.StructField("junk_bytes", T.LongType()),
        T.StructField("resyncs", T.LongType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("table", T.StringType()),
        T.StructField("table_ok", T.BooleanType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("seek_offsets", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def index_row(data: bytes | None) -> dict:
    data = data or b""
    s = parse(data)
    first = s.frames[0][1] if s.frames else None
    played = max(0, s.samples - s.skipped)
    rates = [h.kbps for _, h in s.frames]
    return {
        "version": first and first.version,
        "layer": first and first.layer,
        "sample_rate": first and first.hz,
        "channels": first and first.channels,
        "n_frames": len(s.frames),
        "samples": played,
        "duration_us": played * 1_000_000 // first.hz if first else 0,
        "kbps_min": min(rates, default=None),
        "kbps_max": max(rates, default=None),
        "crc_checked": s.crc_checked,
        "crc_failed": s.crc_failed,
        "junk_bytes": s.junk,
        "resyncs": s.resyncs,
        "truncated": s.truncated,
        "table": s.table,
        "table_ok": s.table_ok,
        "tags": list(s.tags.items()),
        "seek_offsets": [at for at, _ in s.frames],
        "payload": decode(data, s),
    }


def index_media(df: DataFrame, media: str = "media") -> DataFrame:
    """The columns of df with those of INDEX, read from the media column; input columns of these names are replaced."""
    mine = {f.name for f in INDEX}
    kept = [f for f in df.schema if f.name not in mine]
    schema = T.StructType([*kept, *INDEX])
    at = [f.name for f in kept].index(media)

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [(f.name, to_arrow_type(f.dataType)) for f in INDEX]
        for batch in batches:
            rows = [index_row(m.as_py()) for m in batch.column(at)]
            yield pa.record_batch([*batch.columns, *[pa.array([r[n] for r in rows], k) for n, k in kinds]], names=[*batch.schema.names, *[n for n, _ in kinds]])

    return df.select(*[f.name for f in kept]).mapInArrow(read, schema)
