import hashlib
import random
import struct
import zlib

import pytest

from lodestone.llm import mpeg, queries


def frame(kbps=9, crc=True, mode=0, fill=b"\0", side=None):
    head = bytes((0xFF, 0xFA if crc else 0xFB, kbps << 4, mode << 6))
    h = mpeg.header(head)
    side = side or bytes(h.side)
    body = (mpeg.crc16(head[2:] + side).to_bytes(2, "big") if crc else b"") + side
    return (head + body).ljust(h.size, fill)


@pytest.mark.parametrize("raw,want", [
    (b"\xff\xfb\x90\x00", ("1", 3, 128, 44100, 417, 1152)),
    (b"\xff\xfb\x92\x00", ("1", 3, 128, 44100, 418, 1152)),
    (b"\xff\xfb\x94\xc0", ("1", 3, 128, 48000, 384, 1152)),
    (b"\xff\xf3\x80\xc0", ("2", 3, 64, 22050, 208, 576)),
    (b"\xff\xe3\x80\xc0", ("2.5", 3, 64, 11025, 417, 576)),
    (b"\xff\xfd\xa4\x00", ("1", 2, 192, 48000, 576, 1152)),
    (b"\xff\xff\x94\x00", ("1", 1, 288, 48000, 288, 384)),
])
def test_headers(raw, want):
    h = mpeg.header(raw)
    assert (h.version, h.layer, h.kbps, h.hz, h.size, h.samples) == want


@pytest.mark.parametrize("raw", [b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"abcd", b"\xff"])
def test_no_headers(raw):
    assert mpeg.header(raw) is None


def crc_bitwise(data):
    c = 0xFFFF
    for byte in data:
        for i in range(7, -1, -1):
            top = c >> 15 ^ (byte >> i & 1)
            c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def test_crc_against_bit_by_bit():
    rng = random.Random(1)
    for _ in range(50):
        data = rng.randbytes(rng.randint(0, 40))
        assert mpeg.crc16(data) == crc_bitwise(data)


def test_resync_crc_and_truncation():
    good = frame()
    bad = bytearray(frame())
    bad[10] ^= 1  # in the protected side information
    junk = b"\xff\xfb\x90" + b"noise\xff\xff" * 9
    data = good * 3 + junk + good * 2 + bytes(bad) + good + good[:100]
    s = mpeg.parse(data)
    assert len(s.frames) == 7 and s.samples == 7 * 1152
    assert (s.crc_checked, s.crc_failed) == (7, 1)
    assert s.resyncs == 2 and s.truncated and s.junk == len(junk) + 100
    assert [data[a : a + 2] for a, _ in s.frames] == [b"\xff\xfa"] * 7


def test_tags_and_tables():
    n = len(frame())
    vbri = bytearray(frame(crc=False))
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 5 * n + n, 5, 2, 1, 2, 3)
    vbri[62:66] = struct.pack(">HH", 3 * n, 2 * n)
    id3v1 = b"TAG" + b"a title".ljust(30, b"\0") + bytes(95)
    v23 = b"TIT2" + struct.pack(">I", 6) + b"\0\0" + b"\0hello"
    tag = b"ID3\3\0\0" + bytes((0, 0, 0, len(v23) + 20)) + v23 + bytes(20)
    s = mpeg.parse(tag + bytes(vbri) + frame() * 5 + id3v1)
    assert s.table == "VBRI" and s.table_frames == 5 and s.table_ok is True and s.toc == [3 * n, 2 * n]
    assert s.tags == {"TIT2": "hello", "ID3v1": "a title"} and len(s.frames) == 5
    lame = bytearray(frame(crc=False))
    lame[36:48] = b"Xing" + struct.pack(">II", 1, 9)
    lame[48:72] = b"LAME3.100" + bytes(12) + ((576 << 12) | 1000).to_bytes(3, "big")
    s = mpeg.parse(bytes(lame) + frame() * 5)
    assert s.table == "Xing" and s.table_ok is False and s.skipped == 1576
    assert mpeg.index_row(bytes(lame) + frame() * 5)["samples"] == 5 * 1152 - 1576


@pytest.mark.parametrize("size", [64, 128, 896, 960, 922 * 64, 922 * 64 + 64, 300_032])
def test_round_trip(size):
    payload = random.Random(size).randbytes(size) if size != 128 else b"\xff\xfa" * 64
    data = mpeg.encode(payload)
    s = mpeg.parse(data)
    assert mpeg.decode(data, s) == payload
    assert s.table == "Xing" and s.table_ok and s.crc_failed == 0 and s.junk == 0 and s.resyncs == 0
    assert len(s.frames) == -(-size // 922) + 1


def test_decode_after_damage():
    data = mpeg.encode(bytes(5000))
    assert mpeg.decode(data[:2000], mpeg.parse(data[:2000])) is None
    assert mpeg.index_row(None)["n_frames"] == 0 and mpeg.index_row(b"")["duration_us"] == 0


def test_query(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (5, "long \U0001f600" * 20000), (4, "x" * 65), (None, "x" * 65)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7_mpeg_audio(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    text = {k: t for k, t in rows}
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        want = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-64:])
        assert r["media_bytes"] > len(want) and "crc=" in r["feature"]
    assert len({r["media_sha256"] for r in out if r["doc_id"] in (4, None)}) == 1


def test_index_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, bytearray(mpeg.encode(bytes(64))), "x"), (2, None, "y")], "doc_id long, media binary, version string")
    out = {r["doc_id"]: r for r in mpeg.index_media(df).collect()}
    assert out[1]["version"] == "1" and out[1]["seek_offsets"] and out[2]["version"] is None
    assert mpeg.index_media(df.limit(0)).count() == 0


@pytest.mark.parametrize("mark", [b"TAG", b"APETAGEX" + b"\xff" * 24, b"ID3\4\0\0\0\0\1\0", b"\xff\xfa\x94\0", b"Xing\0\0\0\7", b"VBRI"])
def test_payload_that_looks_like_tags_or_frames(mark):
    """At every offset of the last 300 bytes, for stored lengths of every size of the last frame."""
    for size in [*range(64, 2048, 64), 922 * 64, 922 * 64 + 64]:
        for back in range(len(mark), 301):
            if back > size:
                break
            payload = bytearray(b"x" * size)
            payload[size - back : size - back + len(mark)] = mark
            data = mpeg.encode(bytes(payload))
            s = mpeg.parse(data)
            assert mpeg.decode(data, s) == payload and s.table_ok and not s.junk and not s.resyncs and "ID3v1" not in s.tags and "APE" not in s.tags


@pytest.mark.parametrize("mark", ["TAG", "APETAGEX", "ID3"])
def test_texts_that_end_in_tags(mark):
    for size in range(len(mark), 2001):
        for back in {len(mark), 32, 63, 64, 124, 128, size} & set(range(size + 1)):
            n, payload = mpeg.padded("x" * (size - back) + mark + "x" * (back - len(mark)))
            data = mpeg.encode(payload)
            assert n == size and mpeg.decode(data, mpeg.parse(data)) == payload
