import hashlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import audio

from .odd import LONG, empty, odd


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=3000))
def test_round_trip(text):
    payload, n = audio.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == text.encode()
    back, stream = audio.load(audio.store(payload))
    assert back == payload and stream.crc_bad == 0 and stream.skipped == 0
    assert stream.table["frames"] == len(stream.offsets) and stream.seconds == Fraction(1152 * len(stream.offsets), 48_000)


def test_payload_that_looks_like_frames():
    payload = (b"\xff\xfa\xe4\xc0" * 64) * 40
    assert audio.load(audio.store(payload))[0] == payload


def test_damage_is_passed_over():
    media = audio.store(audio.payload_of(LONG[:5000])[0])
    whole = audio.parse(media)
    at = whole.offsets[2]
    hurt = audio.parse(media[:at] + b"junk\xff\xfbnoise" * 9 + media[at:])
    assert len(hurt.offsets) == len(whole.offsets) and hurt.skipped == 11 * 9 and hurt.seconds == whole.seconds
    bad = bytearray(media)
    bad[at + 10] ^= 1  # side information: the checksum covers it
    assert (audio.parse(bytes(bad)).crc_bad, audio.parse(bytes(bad)).crc_good) == (1, whole.crc_good - 1)
    cut = audio.parse(media[: at + 100])
    assert len(cut.offsets) == 2 and cut.skipped == 100
    assert audio.parse(b"").seconds == 0 and audio.parse(b"\xff" * 50).offsets == []


@pytest.mark.parametrize(("four", "want"), [
    (b"\xff\xfb\x90\x00", (3, 3, False, 128, 44100, False, 417, 1152, 32)),
    (b"\xff\xfb\x92\x00", (3, 3, False, 128, 44100, False, 418, 1152, 32)),
    (b"\xff\xf3\x80\xc0", (2, 3, False, 64, 22050, True, 208, 576, 9)),
    (b"\xff\xe3\x80\xc0", (0, 3, False, 64, 11025, True, 417, 576, 9)),
    (b"\xff\xfd\xa4\x00", (3, 2, False, 192, 48000, False, 576, 1152, 0)),
    (b"\xff\xff\xc4\x00", (3, 1, False, 384, 48000, False, 384, 384, 0)),
])
def test_headers(four, want):
    h = audio.header(four)
    assert (h.version, h.layer, h.checked, h.kbps, h.rate, h.mono, h.length, h.samples, h.side) == want


@pytest.mark.parametrize("four", [b"\xff\xfb\xf0\x00", b"\xff\xfb\x0c\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x9c\x00", b"\xfe\xfb\x90\x00", b"\xff\xfb"])
def test_no_headers(four):
    assert audio.header(four) is None


def test_tags_and_vbri():
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    table = bytearray(frame)
    table[36:40], table[46:50], table[50:54] = b"VBRI", (1234).to_bytes(4), (2).to_bytes(4)
    tail = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(65)
    got = audio.parse(bytes(table) + frame * 2 + tail)
    assert got.table == {"kind": "VBRI", "bytes": 1234, "frames": 2} and len(got.offsets) == 2
    assert got.tags == {"title": "Song", "artist": "Band"} and got.seconds == Fraction(2 * 1152, 44_100)


def test_odd_rows(spark):
    rows = {r["doc_id"]: r for r in audio.encode(odd(spark)).collect()}
    assert rows[1]["payload_bytes"] == rows[2]["payload_bytes"] == 64 and rows[1]["n_bytes"] == 0 and rows[1]["media_sha256"] == rows[2]["media_sha256"]
    assert rows[4]["payload_sha256"] == hashlib.sha256(audio.payload_of(LONG)[0]).hexdigest() and rows[0]["feature"] == rows[5]["feature"]
    scanned = {r["doc_id"]: r for r in audio.scan(audio.encode(odd(spark))).collect()}
    assert scanned[4]["frames"] == len(rows[4]["seek"]) and scanned[4]["tags"]["payload_bytes"] == str(rows[4]["payload_bytes"])
    assert audio.encode(empty(spark)).count() == 0


def _number(n, seven):
    return bytes(n >> s & (127 if seven else 255) for s in ((21, 14, 7, 0) if seven else (24, 16, 8, 0)))


def _tag(version, flags, body):
    return b"ID3" + bytes((version, 0, flags)) + _number(len(body), True) + body


@pytest.mark.parametrize("tag", [
    _tag(2, 0, b"TT2" + (5).to_bytes(3) + b"\0Song" + b"TXX" + (6).to_bytes(3) + b"\0mood\0"),
    _tag(3, 0x40, _number(6, False) + bytes(6) + b"TIT2" + _number(5, False) + b"\0\0\0Song"),
    _tag(4, 0x40, _number(6, True) + b"\1\0" + b"TIT2" + _number(5, True) + b"\0\0\3Song"),
    _tag(3, 0x80, b"TIT2" + _number(7, False) + b"\0\0\1\xff\0\xfeS\0o\0"),
    _tag(4, 0x10, b"TIT2" + _number(5, True) + b"\0\0\3Song") + b"3DI" + bytes(7),
])
def test_tags_of_all_versions(tag):
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    got = audio.parse(tag + frame * 3)
    assert len(got.offsets) == 3 and got.offsets[0] == len(tag) and got.skipped == 0
    assert {v for k, v in got.tags.items() if k in ("TIT2", "TT2")} in ({"Song"}, {"So"})


def test_seek_table_of_vbri_and_checksums_of_layer_two():
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    table = bytearray(frame)
    table[36:40], table[50:54], table[54:62] = b"VBRI", (2).to_bytes(4), b"\0\2\0\3\0\2\0\1"
    table[62:66] = (139).to_bytes(2) + (140).to_bytes(2)
    assert audio.parse(bytes(table) + frame * 2).table["toc"] == [417, 420]
    second = b"\xff\xfc\xa4\x00" + bytes(572)
    assert (audio.parse(second * 3).crc_unread, audio.parse(second * 3).crc_bad) == (3, 0)
