"""MPEG audio as a column: write, resynchronise, verify and index Layer III streams.

``parse`` reads any byte string: it skips an ID3v2 tag (and reads its frames), looks for a frame header that is
followed by a consistent one, walks the frames, resynchronises after damage, reads the first frame's Xing/Info or VBRI
table, verifies the CRC-16 of each protected frame of Layers I, II and III and the CRC-32 of an attached payload, and
reads an ID3v1 tag at the end.  ``n_checked`` counts the frames whose CRC-16 was verified; a protected frame too short to
hold what its checksum covers counts as one with a wrong checksum.
It returns exact durations (samples over the sampling rate) and the byte offset of every frame for seeking.

``encode`` stores arbitrary bytes losslessly in a valid stream: an ID3v2 tag with the payload's length and CRC-32, an
Info/Xing frame with the seek table, then protected mono MPEG-1 Layer III frames whose granules are empty, so that the
whole main data area is ancillary data, which the standard leaves to the application: the payload's bytes.  Frames
use the highest rate and the last one the lowest rate that holds the rest: a variable-bitrate stream.

Edge cases: null is an empty text, stored as 64 zero bytes; bytes without any frame give zero frames and duration 0;
a last frame that the end cuts off is counted as damage (in sync only: a stray header whose frame would reach past the end
is skipped like other bytes); equal inputs give equal bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.session import small_batches

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), Hz of MPEG-1, samples per frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Fixed values of the same standards: bits of a Layer II allocation, as (subbands, bits) from the lowest subband on.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}
RATES = (44100, 48000, 32000)
VERSIONS = {0: 2.5, 2: 2, 3: 1}
RATE = 48000
HEAD = 4 + 2 + 17  # header, CRC, side information of a mono MPEG-1 Layer III frame
ALIGN = 64
TOC = 100


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table[i] = c
    return table


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 8005, start FFFF) of each row of a byte matrix."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


def crc16_bits(bits: np.ndarray) -> int:
    """The same over any number of bits."""
    c = 0xFFFF
    for bit in bits.tolist():
        c = ((c << 1) ^ (0x8005 if (c >> 15 ^ bit) & 1 else 0)) & 0xFFFF
    return c


def protected_bits(body: np.ndarray, h: dict) -> np.ndarray | None:
    """The bits after the checksum that a Layer I or II frame's checksum covers: the bit allocation and, in Layer II, the
    scale factor selection; None if they don't fit.  ``body``: the frame's bits from there on."""
    channels = 1 if h["mono"] else 2
    if h["layer"] == 1:
        bound = h["bound"] if channels == 2 else 32
        n = 4 * (channels * bound + 32 - bound) if channels == 2 else 4 * 32
        return body[:n] if len(body) >= n else None
    if h["version"] != 1:
        table = "low"
    else:
        each = h["kbps"] // channels
        low, middle = each <= 48, each <= 80 or h["hz"] == 48000
        table = ("d" if h["hz"] == 32000 else "c") if low else "a" if middle else "b"
    width = [bits for n, bits in ALLOCATION[table] for _ in range(n)]
    place, chosen = 0, 0
    for band, bits in enumerate(width):
        shared = channels == 2 and band >= h["bound"]
        for _ in range(1 if shared else channels):
            if place + bits > len(body):
                return None
            chosen += bool(body[place : place + bits].any()) * (2 if shared else 1)
            place += bits
    n = place + 2 * chosen
    return body[:n] if len(body) >= n else None


def bad_checksums(data: bytes, offsets: np.ndarray, sizes: np.ndarray, first: dict) -> int:
    """Wrong checksums among the protected frames at the given places."""
    raw = np.frombuffer(data, np.uint8)
    bad = 0
    if first["layer"] == 3:
        # A stream may change between one and two channels: each frame has the side information of its own mode.
        mono = raw[offsets + 3] >> 6 == 3
        for one in (True, False):
            own = mono == one
            side = side_bytes(first["version"], one)
            fits = own & (sizes >= 6 + side)
            at = offsets[fits]
            rows = np.concatenate([raw[at[:, None] + np.array([2, 3])], raw[at[:, None] + 6 + np.arange(side)]], 1)
            bad += int((own & ~fits).sum() + (crc16(rows) != (raw[at + 4].astype(np.uint16) << np.uint16(8) | raw[at + 5])).sum())
        return bad
    for at, size in zip(offsets.tolist(), sizes.tolist(), strict=True):
        covered = protected_bits(np.unpackbits(raw[at + 6 : at + size]), header(data, at))
        bad += covered is None or crc16_bits(np.concatenate([np.unpackbits(raw[at + 2 : at + 4]), covered])) != int(raw[at + 4]) << 8 | int(raw[at + 5])
    return int(bad)


def side_bytes(version: float, mono: bool) -> int:
    """Length of the side information of a Layer III frame."""
    return (17 if mono else 32) if version == 1 else (9 if mono else 17)


def header(data: bytes, at: int) -> dict | None:
    """The frame header at a place, or None if there is no valid one."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = VERSIONS.get(b1 >> 3 & 3), 4 - (b1 >> 1 & 3)
    rate_index, hz_index = b2 >> 4, b2 >> 2 & 3
    if version is None or layer == 4 or rate_index in (0, 15) or hz_index == 3 or b3 & 3 == 2:
        return None
    kbps = BITRATES[version == 1, layer][rate_index]
    hz = RATES[hz_index] // {1: 1, 2: 2, 2.5: 4}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    pad = b2 >> 1 & 1
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    mono = b3 >> 6 == 3
    side = side_bytes(version, mono) if layer == 3 else 0
    return {"version": version, "layer": layer, "kbps": kbps, "hz": hz, "samples": samples, "size": size, "mono": mono, "protected": not b1 & 1, "side": side, "bound": 4 * (b3 >> 4 & 3) + 4 if b3 >> 6 == 1 else 32}


def _same_stream(a: dict, b: dict) -> bool:
    return (a["version"], a["layer"], a["hz"]) == (b["version"], b["layer"], b["hz"])


def syncsafe(n: int) -> bytes:
    return bytes(n >> k & 0x7F for k in (21, 14, 7, 0))


def read_id3v2(data: bytes) -> tuple[int, dict[str, bytes]]:
    """(end of the tag, its frames); (0, {}) without a tag."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 0x7F:
        return 0, {}
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end, at, frames = min(len(data), 10 + size), 10, {}
    while at + 10 <= end and data[at] != 0:
        name = data[at : at + 4].decode("latin-1")
        raw = data[at + 4 : at + 8]
        n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if data[3] == 4 else int.from_bytes(raw, "big")
        if at + 10 + n > end:
            break
        frames[name] = data[at + 10 : at + 10 + n]
        at += 10 + n
    return end, frames


def read_vbr(data: bytes, at: int, h: dict) -> dict | None:
    """The Xing, Info or VBRI table in the frame at a place."""
    for start in (at + 4 + h["side"], at + 6 + h["side"]):  # without and with CRC
        kind = data[start : start + 4]
        if kind in (b"Xing", b"Info"):
            flags, place = int.from_bytes(data[start + 4 : start + 8], "big"), start + 8
            out = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": None}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key] = int.from_bytes(data[place : place + 4], "big")
                    place += 4
            if flags & 4:
                out["toc"] = list(data[place : place + TOC])
            return out
    start = at + 36
    if data[start : start + 4] == b"VBRI":
        if len(data) < start + 26:
            return None
        size, frames, entries, scale, width, each = struct.unpack(">IIHHHH", data[start + 10 : start + 26])
        # Bytes of each run of ``frames_per_entry`` frames.
        raw = data[start + 26 : start + 26 + entries * width] if 0 < width <= 4 else b""
        toc = [scale * int.from_bytes(raw[k : k + width], "big") for k in range(0, len(raw) - width + 1, width)] if raw else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_per_entry": each}
    return None


def _frames_inside(data: bytes, at: int, end: int, h: dict) -> bool:
    """Whether frames begin inside a frame that no frame follows: then its header is a stray one.

    Such a frame must be followed by two more, or by as many as there are up to the end."""
    p = data.find(b"\xff", at + 1, at + h["size"])
    while p >= 0:
        place, seen = p, 0
        while seen < 3 and (g := header(data, place) if place < end else None) is not None and _same_stream(h, g) and place + g["size"] <= end:
            place, seen = place + g["size"], seen + 1
        if seen == 3 or (seen and place == end):
            return True
        p = data.find(b"\xff", p + 1, at + h["size"])
    return False


def parse(data: bytes) -> dict:
    """Tags, table, frame offsets, exact duration, damage and the ancillary payload of a stream."""
    start, tags = read_id3v2(data)
    end = len(data)
    id3v1 = data[-128:] if len(data) >= 128 and data[-128:-125] == b"TAG" else b""
    end -= len(id3v1)
    offsets: list[int] = []
    sizes: list[int] = []
    rates: list[int] = []
    protected: list[int] = []
    at, skipped, resyncs, first, vbr, in_sync = start, 0, 0, None, None, False
    cut: tuple[int, int] | None = None  # a frame in sync that the end cuts off, unless frames follow: its place and what was skipped
    while at < end:
        h = header(data, at)
        if h is not None and (first is None or _same_stream(first, h)):
            # A header out of sync must be confirmed by the next one or by the end of the stream.
            follows = header(data, at + h["size"]) if at + h["size"] < end else h
            if at + h["size"] > end:
                # Out of sync this is chance; in sync it is the cut-off last frame, or damage that frames still follow.
                cut = (at, skipped) if in_sync or at == start else cut
            elif (follows is not None and _same_stream(h, follows)) or (in_sync and not _frames_inside(data, at, end, h)):
                cut = None
                resyncs += not in_sync and bool(offsets or vbr)
                in_sync = True
                if first is None:
                    first, vbr = h, read_vbr(data, at, h)
                    if vbr is not None:
                        at += h["size"]
                        continue
                offsets.append(at)
                sizes.append(h["size"])
                rates.append(h["kbps"])
                protected.append(h["protected"])
                at += h["size"]
                continue
        in_sync = False
        found = data.find(b"\xff", at + 1, end)
        found = end if found < 0 else found
        skipped += found - at
        at = found
    truncated = int(cut is not None)
    if cut is not None:
        skipped = cut[1]
    offs, size = np.array(offsets, np.int64), np.array(sizes, np.int64)
    bad = 0
    checked = np.flatnonzero(protected)
    if first is not None and len(checked):
        bad = bad_checksums(data, offs[checked], size[checked], first)
    samples = len(offsets) * first["samples"] if first else 0
    out = {
        "tags": tags, "id3v1": id3v1, "vbr": vbr, "n_frames": len(offsets), "offsets": offs, "sizes": size, "samples": samples, "hz": first["hz"] if first else 0, "layer": first["layer"] if first else 0,
        "version": first["version"] if first else 0, "duration_s": samples / first["hz"] if first else 0.0, "kbps": np.array(rates, np.int64), "n_checked": len(checked), "bad_crc": bad, "resyncs": int(resyncs), "skipped": skipped, "truncated": truncated, "payload": None, "payload_ok": None,
    }
    note = tags.get("PRIV", b"")
    if note.startswith(b"payload\0") and first is not None:
        n, crc = struct.unpack(">QI", note[8:20])
        body = b"".join(data[o + HEAD : o + s] for o, s in zip(offsets, sizes, strict=True))[:n]
        out |= {"payload": body, "payload_ok": len(body) == n and zlib.crc32(body) == crc}
    return out


def seek(parsed: dict, second: float) -> int:
    """Byte offset of the frame that plays at a time."""
    if not parsed["n_frames"]:
        return 0
    k = int(second * parsed["hz"] * parsed["n_frames"] / max(parsed["samples"], 1))
    return int(parsed["offsets"][min(max(k, 0), parsed["n_frames"] - 1)])


def _frame_head(rate_index: int) -> bytes:
    """Header, CRC and empty side information of a protected mono frame at 48 kHz."""
    head = bytes([0xFF, 0xFA, rate_index << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    check = int(crc16(np.frombuffer(head[2:4] + side, np.uint8)[None])[0])
    return head + check.to_bytes(2, "big") + side


HEADS = {i: _frame_head(i) for i in range(1, 15)}
SIZES = {i: 3 * BITRATES[True, 3][i] for i in range(1, 15)}  # 144 * bitrate / 48000
TOP = 14


def encode(payload: bytes) -> bytes:
    """A valid stream that carries the payload in its ancillary data."""
    room = SIZES[TOP] - HEAD
    whole, rest = divmod(len(payload), room)
    n = whole + (rest > 0)
    last = next((i for i in range(1, 15) if SIZES[i] - HEAD >= rest), TOP) if rest else TOP
    body = bytearray()
    if whole:
        frames = np.empty((whole, SIZES[TOP]), np.uint8)
        frames[:, :HEAD] = np.frombuffer(HEADS[TOP], np.uint8)
        frames[:, HEAD:] = np.frombuffer(payload, np.uint8, whole * room).reshape(whole, room)
        body += frames.tobytes()
    if rest:
        body += HEADS[last] + payload[whole * room :] + bytes(SIZES[last] - HEAD - rest)
    info_index = next(i for i in range(1, 15) if SIZES[i] >= HEAD + 16 + TOC)
    total = SIZES[info_index] + len(body)
    kind = b"Xing" if n and rest and last != TOP and whole else b"Info"
    toc = bytes(min(255, 256 * (SIZES[info_index] + min(k * n // TOC, whole) * SIZES[TOP]) // max(total, 1)) for k in range(TOC))
    table = kind + struct.pack(">III", 7, n, total) + toc
    info = HEADS[info_index] + table + bytes(SIZES[info_index] - HEAD - len(table))
    note = b"payload\0" + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + syncsafe(len(note)) + b"\0\0" + note
    return b"ID3\x04\0\0" + syncsafe(len(tag)) + tag + info + bytes(body)


def pad(raw: bytes, align: int = ALIGN) -> bytes:
    """Zero bytes up to a positive multiple of ``align``."""
    return raw + bytes(max(align, -(-len(raw) // align) * align) - len(raw))


def media_column(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes and media (binary): each text's UTF-8 bytes, padded, stored as an MPEG audio stream."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = [c for c in rows.columns if c != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", n_bytes long, media binary"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, len(names)):
                texts = [(t or "").encode() for t in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(pad(t)) for t in texts], pa.binary())], [*names, "n_bytes", "media"])

    return rows.mapInArrow(write, schema)


def _slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes."""
    step = max(1, int(batch.num_rows * limit / max(batch.column(column).nbytes, 1)))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def read_media(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media_col: str = "media") -> DataFrame:
    """``keep`` and what ``parse`` finds: durations, seek offsets, checks, and digests of the payload and the stream."""
    small_batches(media.sparkSession)
    rows = media.select(*keep, F.col(media_col).alias("_media"))
    names = list(keep)
    schema = (
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_media")
        + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, samples long, hz int, duration_s double, seek_offsets array<long>, bad_crc long, resyncs long, skipped long, payload_ok boolean"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, len(names)):
                out: list[list] = [[] for _ in range(15)]
                for raw in part.column(len(names)).to_pylist():
                    raw = raw or b""
                    p = parse(raw)
                    body = p["payload"] or b""
                    table = p["vbr"]["kind"] if p["vbr"] else "none"
                    feature = f"mpeg{p['version']:g}-layer{p['layer']};{p['hz']}Hz;frames={p['n_frames']};samples={p['samples']};table={table};kbps={int(p['kbps'].min()) if p['n_frames'] else 0}-{int(p['kbps'].max()) if p['n_frames'] else 0};crc={p['n_checked'] - p['bad_crc']}/{p['n_checked']}"
                    row = (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, p["n_frames"], p["samples"], p["hz"], p["duration_s"], p["offsets"].tolist(), p["bad_crc"], p["resyncs"], p["skipped"], p["payload_ok"])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                fields = [c.strip().split(" ")[0] for c in schema.split(", ")[len(names) :]]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], [*names, *fields])

    return rows.mapInArrow(read, schema)
