"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

write() stores payloads losslessly as the ancillary data of silent Layer III
frames; read() walks any MPEG audio stream of Layers I to III: it skips tags and
junk, resynchronises where a header doesn't lead to another, checks the CRC of
frames of all layers, reads a Xing or VBRI table, and sums exact durations.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from fractions import Fraction
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer) and bitrate index from 1, and sample rates.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
# Fixed values of the same: widths in bits of a Layer II allocation by subband, as (subbands, bits); tables a to d of MPEG-1, then MPEG-2.
ALLOCATIONS = (
    ((11, 4), (12, 3), (4, 2)),
    ((11, 4), (12, 3), (7, 2)),
    ((2, 4), (6, 3)),
    ((2, 4), (10, 3)),
    ((4, 4), (7, 3), (19, 2)),
)
TOC = 100
_ROWS = 64
#: Frames compared at once while a run of equal headers is followed.
_RUN = 256


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table.astype(np.uint16)


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Checksum of each row of bytes: polynomial 0x8005, start 0xFFFF, high bit first."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << 8) ^ _CRC[(crc >> 8) ^ column]
    return crc


def _crc_bits(front: bytes, rest: bytes, bits: int) -> int:
    """crc16 of the front and of this many bits of the rest."""
    whole, left = divmod(bits, 8)
    crc = int(crc16(np.frombuffer(front + rest[:whole], np.uint8)[None])[0])
    for i in range(left):
        high = crc >> 15 ^ (rest[whole] >> (7 - i) & 1)
        crc = crc << 1 & 0xFFFF ^ (0x8005 if high else 0)
    return crc


class Header:
    """What four header bytes say; None from parse() if they are no header."""

    __slots__ = ("version", "layer", "protected", "size", "samples", "rate", "channels", "bound", "side", "kbps")

    @classmethod
    def parse(cls, b: bytes) -> Header | None:
        if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
            return None
        version, layer = (b[1] >> 3) & 3, 4 - ((b[1] >> 1) & 3)
        rate, bits = (b[2] >> 2) & 3, b[2] >> 4
        if version == 1 or layer == 4 or rate == 3 or bits in (0, 15):
            return None
        h = cls()
        first = version == 3
        h.version, h.layer, h.protected = {3: "1", 2: "2", 0: "2.5"}[version], layer, not b[1] & 1
        h.rate = RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
        h.kbps, pad = BITRATES[first, layer][bits - 1], (b[2] >> 1) & 1
        h.samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
        h.size = (12000 * h.kbps // h.rate + pad) * 4 if layer == 1 else h.samples // 8 * 1000 * h.kbps // h.rate + pad
        h.channels = 1 if b[3] >> 6 == 3 else 2
        # Subbands from this one on share an allocation (joint stereo).
        h.bound = (b[3] >> 4 & 3) * 4 + 4 if b[3] >> 6 == 1 else 32
        h.side = 0 if layer != 3 else (17 if h.channels == 1 else 32) if first else (9 if h.channels == 1 else 17)
        return h

    def widths(self) -> list[int]:
        """Bits of a Layer II allocation by subband."""
        each = self.kbps // self.channels
        if self.version != "1":
            table = 4
        elif each <= 48:
            table = 3 if self.rate == 32000 else 2
        else:
            table = 0 if each <= 80 or self.rate == 48000 else 1
        return [bits for n, bits in ALLOCATIONS[table] for _ in range(n)]


def _layer2_bits(rest: bytes, h: Header) -> int | None:
    """Bits of allocation and scale factor selection, which the CRC of a Layer II frame covers; None if the frame is too short."""
    value, total, at, used = int.from_bytes(rest, "big"), 8 * len(rest), 0, 0
    for band, bits in enumerate(h.widths()):
        for _ in range(h.channels if band < h.bound else 1):
            at += bits
            if at > total:
                return None
            if value >> (total - at) & ((1 << bits) - 1):
                used += 1 if band < h.bound else h.channels
    return at + 2 * used if at + 2 * used <= total else None


def _good_frames(run: np.ndarray, h: Header) -> int:
    """How many of these protected frames, which share a header, hold their checksum."""
    if h.layer == 2:
        good = 0
        for row in run:
            rest = row[6:].tobytes()
            bits = _layer2_bits(rest, h)
            good += bits is not None and _crc_bits(row[2:4].tobytes(), rest, bits) == int(row[4]) << 8 | int(row[5])
        return good
    covered = h.side if h.layer == 3 else (16 if h.channels == 1 else (32 + h.bound) // 2)
    if 6 + covered > h.size:
        return 0
    return int((crc16(np.hstack([run[:, 2:4], run[:, 6 : 6 + covered]])) == run[:, 4].astype(np.uint16) * 256 + run[:, 5]).sum())


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2.3 or 2.4 tag, and where the tag ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    end = 10 + _synchsafe(data[6:10])
    at, tags = 10, {}
    while at + 10 <= min(end, len(data)) and data[at]:
        size = _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + size]
        if name[:1] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value
        at += 10 + size
    return tags, end + (10 if data[5] & 0x10 else 0)


def _vbr(frame: bytes, h: Header) -> dict[str, Any] | None:
    """The table of a Xing, Info or VBRI frame; what the frame's end cuts off is left out.

    toc holds the 100 seek positions of a Xing table (in 256ths of the stream), or
    the bytes of each VBRI entry, step how many frames such an entry spans.
    """
    at = 4 + (2 if h.protected else 0) + h.side
    out: dict[str, Any] = {"toc": []}

    def number(size: int) -> int | None:
        nonlocal at
        at += size
        return int.from_bytes(frame[at - size : at], "big") if at <= len(frame) else None

    if h.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info"):
        out["kind"], at = frame[at : at + 4].decode(), at + 4
        flags = number(4) or 0
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = number(4)
        if flags & 4 and at + TOC <= len(frame):
            out["toc"] = list(frame[at : at + TOC])
        return out
    if h.layer == 3 and frame[36:40] == b"VBRI":
        out["kind"], at = "VBRI", 46
        out["bytes"], out["frames"] = number(4), number(4)
        entries, scale, width, out["step"] = (number(2) for _ in range(4))
        if out["step"] is not None and 0 < width <= 4 and at + entries * width <= len(frame):
            out["toc"] = [int.from_bytes(frame[i : i + width], "big") * scale for i in range(at, at + entries * width, width)]
        return out
    return None


def parse(data: bytes) -> dict[str, Any]:
    """All that read() returns of one stream. An empty or foreign value has 0 frames and only junk."""
    tags, pos = _id3v2(data)
    end = len(data)
    if data[-128:-125] == b"TAG" and end - 128 >= pos:
        end -= 128
        fields = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97)}
        tags = {k: v for k, (a, b) in fields.items() if (v := data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"))} | tags
    raw = np.frombuffer(data, np.uint8)
    out: dict[str, Any] = {"tags": tags, "vbr": None, "frames": 0, "samples": 0, "rate": 0, "channels": 0, "version": "", "layer": 0, "crc_ok": 0, "crc_bad": 0, "junk": 0}
    length = Fraction(0)
    bodies, offsets = [], []
    synced = False
    while pos < end:
        h = Header.parse(data[pos : pos + 4])
        if h is None or pos + h.size > end or not (synced or pos + h.size == end or Header.parse(data[pos + h.size : pos + h.size + 4])):
            after = data.find(b"\xff", pos + 1, end)
            after = end if after < 0 else after
            out["junk"] += after - pos
            pos, synced = after, False
            continue
        synced = True
        n = min(_RUN, (end - pos) // h.size)
        run = raw[pos : pos + n * h.size].reshape(n, h.size)
        other = np.flatnonzero((run[:, :4] != run[0, :4]).any(axis=1))
        n = int(other[0]) if len(other) else n
        if not out["frames"] and out["vbr"] is None:
            out |= {"rate": h.rate, "channels": h.channels, "version": h.version, "layer": h.layer}
            out["vbr"] = _vbr(run[0].tobytes(), h)
            n = 1
            if out["vbr"]:
                pos += h.size
                continue
        run = run[:n]
        head = 4 + (2 if h.protected else 0) + h.side
        if h.protected:
            good = _good_frames(run, h)
            out["crc_ok"] += good
            out["crc_bad"] += n - good
        bodies.append(run[:, head:].tobytes())
        offsets.append(pos + np.arange(n) * h.size)
        out["frames"] += n
        out["samples"] += n * h.samples
        length += Fraction(n * h.samples, h.rate)
        pos += n * h.size
    out["offsets"] = np.concatenate(offsets).tolist() if offsets else []
    out["body"] = b"".join(bodies)
    out["duration"] = {"numerator": length.numerator, "denominator": length.denominator}
    return out


def _header(kbps: int, protected: bool) -> bytes:
    """MPEG-1 Layer III, 48 kHz, one channel."""
    return bytes([0xFF, 0xFA if protected else 0xFB, (BITRATES[True, 3].index(kbps) + 1) << 4 | 0x04, 0xC0])


_SIDE = bytes(17)
_ROOM = {kbps: 3 * kbps - 4 - 2 - len(_SIDE) for kbps in BITRATES[True, 3]}
_FRONT = {k: (h := _header(k, True)) + int(crc16(np.frombuffer(h[2:] + _SIDE, np.uint8)[None])[0]).to_bytes(2, "big") + _SIDE for k in BITRATES[True, 3]}


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + key.encode() + b"\0" + value.encode()
    return b"TXXX" + bytes([len(body) >> 21, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + b"\0\0" + body


def store(payload: bytes) -> bytes:
    """A silent stream that carries the payload: an ID3v2.4 tag, a Xing frame, then frames of the bitrates that fit."""
    most = max(_ROOM)
    full, rest = divmod(len(payload), _ROOM[most])
    cells = np.frombuffer(payload[: full * _ROOM[most]], np.uint8).reshape(full, _ROOM[most])
    front = np.frombuffer(_FRONT[most], np.uint8)
    frames = np.hstack([np.broadcast_to(front, (full, len(front))), cells]).tobytes()
    if rest or not full:
        kbps = min(k for k, room in _ROOM.items() if room >= rest)
        frames += _FRONT[kbps] + payload[full * _ROOM[most] :].ljust(_ROOM[kbps], b"\0")
    count = full + bool(rest or not full)
    first = 3 * 64
    size = first + len(frames)
    toc = bytes(min(255, 256 * (first + min(len(frames), (i * count // TOC) * 3 * most)) // size) for i in range(TOC))
    xing = _header(64, False) + _SIDE + b"Xing" + struct.pack(">III", 0xF, count, size) + toc + struct.pack(">I", 0)
    tag = _text_frame("payload_bytes", str(len(payload)))
    tag = b"ID3\x04\0\0" + bytes([0, 0, len(tag) >> 7, len(tag) & 127]) + tag
    return tag + xing.ljust(first, b"\0") + frames


def write(df: DataFrame, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
    """df with the payload column replaced by its stored form; a null payload is stored as an empty one."""
    keep = [f for f in df.schema.fields if f.name != payload_col]
    schema = T.StructType([*keep, T.StructField(media_col, T.BinaryType())])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                media = pa.array([store(p or b"") for p in part.column(payload_col).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), media], schema.names)

    return df.mapInArrow(batches, schema)


_PARSED = T.StructType(
    [
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("vbr_kind", T.StringType()),
        T.StructField("vbr_frames", T.LongType()),
        T.StructField("vbr_bytes", T.LongType()),
        T.StructField("vbr_toc", T.ArrayType(T.LongType())),
        T.StructField("vbr_step", T.LongType()),
        *(T.StructField(n, T.LongType()) for n in ("frames", "samples", "rate", "channels", "layer", "crc_ok", "crc_bad", "junk")),
        T.StructField("duration", T.StructType([T.StructField(n, T.LongType()) for n in ("numerator", "denominator")])),
        T.StructField("version", T.StringType()),
        T.StructField("offsets", T.ArrayType(T.LongType())),
        T.StructField("body", T.BinaryType()),
    ]
)


def read(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with what its streams hold: tags, VBR table, frames, samples, exact duration, seek offsets, body.

    duration is the exact sum over the audio frames, in seconds, as a fraction in
    lowest terms, whether or not the sample rate changes; rate, channels, version
    and layer are the first frame's. crc_ok and crc_bad count the protected frames
    of all three layers. vbr_toc and vbr_step are described at _vbr. offsets are the byte offsets of the audio frames; body joins what follows the
    side information of each. Null, empty and foreign values have 0 frames; bytes
    outside tags and frames count as junk. Repeated rows and extra columns stay;
    columns of df with a new column's name are replaced.
    """
    keep = [f for f in df.schema.fields if f.name not in _PARSED.names]
    schema = T.StructType([*keep, *_PARSED.fields])

    def one(data: bytes | None) -> dict[str, Any]:
        found = parse(data or b"")
        vbr = found.pop("vbr") or {}
        return found | {"tags": list(found["tags"].items()), "vbr_kind": vbr.get("kind"), "vbr_frames": vbr.get("frames"), "vbr_bytes": vbr.get("bytes"), "vbr_toc": vbr.get("toc", []), "vbr_step": vbr.get("step")}

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fraction = pa.struct([("numerator", pa.int64()), ("denominator", pa.int64())])
        types = {"tags": pa.map_(pa.string(), pa.string()), "duration": fraction, "vbr_kind": pa.string(), "version": pa.string(), "vbr_toc": pa.list_(pa.int64()), "offsets": pa.list_(pa.int64()), "body": pa.binary()}
        for batch in found:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                made = [one(x) for x in part.column(media_col).to_pylist()]
                new = [pa.array([m[n] for m in made], types.get(n, pa.int64())) for n in _PARSED.names]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *new], schema.names)

    return df.mapInArrow(batches, schema)


def padded(text: str = "text", unit: int = 192) -> Any:
    """The text as UTF-8 (null: empty) with spaces up to a positive multiple of unit bytes, binary."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    missing = F.when(size == 0, unit).otherwise(F.pmod(-size, F.lit(unit)))
    return F.concat(raw, F.repeat(F.lit(" "), missing).cast("binary"))
