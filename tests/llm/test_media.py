import hashlib
import os
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opinara.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(raw):
    body = media.pad(raw)
    p = media.parse(media.encode(body))
    assert p["payload"] == body and p["payload_ok"] and p["bad_crc"] == 0 and p["resyncs"] == 0 and p["skipped"] == 0
    assert p["n_frames"] == p["vbr"]["frames"] and p["duration_s"] == p["n_frames"] * 1152 / 48000


def test_damage_is_found_and_resynchronised():
    body = os.urandom(0) + bytes(range(256)) * 64
    good = media.encode(body)
    p = media.parse(good)
    cut = int(p["offsets"][3])
    assert media.parse(good[:cut] + b"junk \xff\xfa junk" + good[cut:])["n_frames"] == p["n_frames"]
    q = media.parse(good[:cut] + b"junk \xff\xfa junk" + good[cut:])
    assert q["resyncs"] == 1 and q["skipped"] == 12 and q["payload"] == body
    broken = bytearray(good)
    broken[cut + 10] ^= 1  # in the side information
    assert media.parse(bytes(broken))["bad_crc"] == 1
    broken = bytearray(good)
    broken[cut + 100] ^= 1  # in the payload
    q = media.parse(bytes(broken))
    assert q["bad_crc"] == 0 and q["payload_ok"] is False
    assert media.parse(good[:-10])["truncated"] == 1
    for odd in (b"", b"abc", b"\xff" * 50, b"ID3"):
        assert media.parse(odd)["n_frames"] == 0


def test_tags_tables_and_seeking():
    body = media.pad(b"x" * 100000)
    s = media.encode(body) + b"TAG" + b"t" * 125
    p = media.parse(s)
    assert p["id3v1"].startswith(b"TAG") and p["vbr"]["kind"] == "Xing" and p["payload"] == body
    assert media.seek(p, 0) == p["offsets"][0] and media.seek(p, 1e9) == p["offsets"][-1]
    assert media.seek(p, 24.5 * 1152 / 48000) == p["offsets"][24]
    toc = p["vbr"]["toc"]
    assert toc == sorted(toc) and len(toc) == 100
    # A header of each version and layer has the size that the standard gives.
    assert media.header(bytes([0xFF, 0xFB, 0x90, 0x00]), 0)["size"] == 417
    assert media.header(bytes([0xFF, 0xFF, 0x92, 0x00]), 0)["size"] == (12 * 288000 // 44100 + 1) * 4
    assert media.header(bytes([0xFF, 0xF3, 0x80, 0x00]), 0)["size"] == 72 * 64000 // 22050


def test_crc_known_value():
    import numpy as np

    def slow(data):
        c = 0xFFFF
        for b in data:
            c ^= b << 8
            for _ in range(8):
                c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        return c

    assert int(media.crc16(np.frombuffer(b"123456789", np.uint8)[None])[0]) == slow(b"123456789") == 0xAEE7


def test_query_over_odd_rows(spark):
    rows = [(1, None, b"x"), (2, "", b"x"), (None, "héé" * 10, None), (4, "a" * 300000, None), (4, "a" * 64, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    got = media.read_media(media.media_column(docs)).collect()
    assert len(got) == 5
    for r, (i, t, _) in zip(got, rows, strict=True):
        body = media.pad((t or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len((t or "").encode()), len(body))
        assert r.payload_sha256 == hashlib.sha256(body).hexdigest() and r.tail_crc32 == zlib.crc32(body[-64:])
        stored = media.encode(body)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and r.payload_ok
    assert media.read_media(media.media_column(docs.limit(0))).count() == 0


def bit_crc(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15
        c = (c << 1) & 0xFFFF
        if top != b:
            c ^= 0x8005
    return c


def by_hand(layer, mono, joint_bound=None, seed=0, hz_index=1, rate_index=9):
    """One protected MPEG-1 frame, written bit by bit without the module, and the number of bits its checksum covers."""
    import random

    rng = random.Random(seed)
    mode = 3 if mono else 0 if joint_bound is None else 1
    b1 = 0xF8 | (4 - layer) << 1  # protected
    b3 = mode << 6 | (0 if joint_bound is None else (joint_bound // 4 - 1) << 4)
    head = [int(x) for b in (0xFF, b1, rate_index << 4 | hz_index << 2, b3) for x in f"{b:08b}"]
    channels = 1 if mono else 2
    bound = 32 if joint_bound is None else joint_bound
    body = []
    if layer == 1:
        for sb in range(32):
            for _ in range(channels if sb < bound else 1):
                body += [int(x) for x in f"{rng.randrange(15):04b}"]
        size = (12 * (32 * rate_index) * 1000 // (44100, 48000, 32000)[hz_index]) * 4
    else:
        kbps = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)[rate_index]
        hz = (44100, 48000, 32000)[hz_index]
        each = kbps // channels
        if each <= 48:
            nbal = [4, 4] + [3] * (10 if hz == 32000 else 6)
        elif each <= 80 or hz == 48000:
            nbal = [4] * 11 + [3] * 12 + [2] * 4
        else:
            nbal = [4] * 11 + [3] * 12 + [2] * 7
        chosen = 0
        for sb, n in enumerate(nbal):
            for _ in range(channels if sb < bound else 1):
                v = rng.randrange(1 << n)
                body += [int(x) for x in f"{v:0{n}b}"]
                chosen += (v > 0) * (1 if sb < bound else channels)
        body += [rng.randrange(2) for _ in range(2 * chosen)]
        size = 144 * kbps * 1000 // hz
    check = [int(x) for x in f"{bit_crc(head[16:] + body):016b}"]
    bits = head + check + body
    bits += [0] * (-len(bits) % 8)
    raw = bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))
    return raw + bytes(rng.randrange(255) for _ in range(size - len(raw)))


@pytest.mark.parametrize("kind", [(1, True, None, 1, 9), (1, False, None, 0, 9), (1, False, 8, 1, 9), (2, True, None, 1, 9), (2, False, None, 0, 9), (2, False, 12, 0, 14), (2, True, None, 2, 2), (2, False, None, 1, 1), (2, False, 4, 2, 12)])
def test_checksums_of_layers_1_and_2(kind):
    layer, mono, bound, hz, rate = kind
    frames = [by_hand(layer, mono, bound, k, hz, rate) for k in range(4)]
    p = media.parse(b"".join(frames))
    assert (p["n_frames"], p["layer"], p["n_checked"], p["bad_crc"]) == (4, layer, 4, 0)
    broken = [bytearray(f) for f in frames]
    for f in broken[:3]:
        f[6] ^= 0x80
    q = media.parse(b"".join(map(bytes, broken)))
    assert q["n_checked"] == 4 and q["bad_crc"] == 3


def test_hand_made_layer_3_stream_and_vbri_table():
    import struct

    side = bytes(range(17))
    head = bytes([0xFF, 0xFA, 0x94, 0xC0])  # 128 kbit/s, 48 kHz, mono, protected
    check = bit_crc([int(x) for b in head[2:] + side for x in f"{b:08b}"])
    frame = head + check.to_bytes(2, "big") + side
    frame += bytes(384 - len(frame))
    plain = bytes([0xFF, 0xFB, 0x94, 0xC0]) + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 384 * 6, 5, 3, 2, 2, 2) + struct.pack(">HHH", 384, 384, 192)
    first = plain + bytes(384 - len(plain))
    p = media.parse(first + frame * 5)
    assert p["vbr"] == {"kind": "VBRI", "frames": 5, "bytes": 384 * 6, "toc": [768, 768, 384], "frames_per_entry": 2}
    assert (p["n_frames"], p["n_checked"], p["bad_crc"], p["duration_s"]) == (5, 5, 0, 5 * 1152 / 48000)
    assert p["offsets"].tolist() == [384 * (k + 1) for k in range(5)]


def layer_3(mono, seed=0, rate=9):
    """A protected MPEG-1 Layer III frame at 48 kHz with its checksum, 384 bytes at 128 kbit/s."""
    import random

    rng = random.Random(seed)
    side = bytes(rng.randrange(255) for _ in range(17 if mono else 32))
    head = bytes([0xFF, 0xFA, rate << 4 | 4, 0xC0 if mono else 0x00])
    check = bit_crc([int(x) for b in head[2:] + side for x in f"{b:08b}"])
    frame = head + check.to_bytes(2, "big") + side
    return frame + bytes(3 * media.BITRATES[True, 3][rate] - len(frame))


def test_checksums_follow_each_frame_s_mode():
    frames = [layer_3(k % 2 == 0, k) for k in range(6)]
    p = media.parse(b"".join(frames))
    assert (p["n_frames"], p["n_checked"], p["bad_crc"]) == (6, 6, 0)
    broken = [bytearray(f) for f in frames]
    for k in (1, 2, 5):
        broken[k][8] ^= 1
    assert media.parse(b"".join(map(bytes, broken)))["bad_crc"] == 3


@pytest.mark.parametrize("stray", [layer_3(True, 1, 14)[:4], layer_3(True, 1, 14)[:4] + bytes(7), b"\xff\xfa", b"\xff\xfb\xe4\xc0junk"])
def test_frames_after_a_stray_header_near_the_end_are_kept(stray):
    """Five frames, a header whose frame would reach past the end, one or five frames."""
    frames = [layer_3(True, k) for k in range(10)]
    for after in (1, 2, 5):
        p = media.parse(b"".join(frames[:5]) + stray + b"".join(frames[:after]))
        assert (p["n_frames"], p["bad_crc"], p["truncated"], p["skipped"], p["resyncs"]) == (5 + after, 0, 0, len(stray), 1), after
    cut = media.parse(b"".join(frames[:5]) + frames[5][:200])
    assert (cut["n_frames"], cut["truncated"], cut["skipped"]) == (5, 1, 0)
    assert media.parse(frames[0][:200])["truncated"] == 1 and media.parse(b"no \xff frame")["truncated"] == 0
