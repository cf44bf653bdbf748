"""Operator 6: media columns holding MPEG audio (Layer III of MPEG-1, 2 and 2.5).

Reading walks a stored stream as a player would: it parses ID3v2 and ID3v1 tags, finds frame headers again after
foreign bytes (a header counts if the next one follows where it says, the stream ends there, or its checksum is
right), parses the table of variable-bitrate streams (Xing, Info or VBRI: frames, bytes, seek table), verifies the
CRC-16 of protected frames and keeps exact durations (samples and rate) and the byte offset of every frame. Writing
stores arbitrary bytes losslessly as the ancillary data of silent frames, with a tag, a Xing table and checksums.

Defined results: null media or media without frames has 0 frames, 0 duration and an empty payload; a truncated
last frame is not counted; tags and tables that are cut off or hold nonsense are read as far as they go and never
fail; bytes that belong to no tag or frame are counted as junk; a null text is stored as the empty one; equal texts
and repeated rows give equal streams; an empty table gives an empty result; other columns are untouched, and where
the input has a column of the result's name already, the result's name gets underscores until it is free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import new_column

# Fixed values of the MPEG format: kbit/s by index 1..14 and sample rates by index of MPEG-1, kbit/s of MPEG-2 and
# 2.5, whose rates are a half and a quarter, samples of a frame (half in MPEG-2 and 2.5).
KBPS = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
KBPS_LOW = [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
RATES = [44100, 48000, 32000]
SAMPLES = 1152
#: Bytes of a mono frame before its main data: header, CRC, side information.
HEAD, CRC, SIDE = 4, 2, 17
RATE_INDEX = 2
LENGTHS = [144 * k * 1000 // RATES[RATE_INDEX] for k in KBPS]

FIELDS = "payload binary, n_frames long, samples long, sample_rate int, duration double, is_vbr boolean, crc_checked long, crc_bad long, junk_bytes long, tags map<string,string>, seek_offsets array<long>, table_frames long, table_bytes long, table_toc array<int>"
#: Bytes of media that are read or written at a time.
PART = 1 << 21


def _crc_table() -> np.ndarray:
    out = []
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = (x << 1) ^ 0x8005 if x & 0x8000 else x << 1
        out.append(x & 0xFFFF)
    return np.array(out, dtype=np.uint16)


_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 8005, start FFFF) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, dtype=np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ _TABLE[(crc >> np.uint16(8)).astype(np.uint8) ^ column]
    return crc


def _header(index: int) -> bytes:
    """A protected mono frame of bitrate index+1."""
    return bytes([0xFF, 0xFA, (index + 1) << 4 | RATE_INDEX << 2, 0xC0])


def _synchsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def _tag(pairs: dict[str, str]) -> bytes:
    body = b""
    for key, value in pairs.items():
        text = b"\x03" + key.encode() + b"\0" + value.encode()
        body += b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    return b"ID3\x03\0\0" + _synchsafe(len(body)) + body


def _frames(index: int, body: bytes) -> bytes:
    """As many frames of one bitrate as body needs; body fills their main data exactly or is padded."""
    room = LENGTHS[index] - HEAD - CRC - SIDE
    n = -(-len(body) // room)
    rows = np.zeros((n, LENGTHS[index]), np.uint8)
    rows[:, :HEAD] = np.frombuffer(_header(index), np.uint8)
    rows[:, HEAD + CRC + SIDE :] = np.frombuffer(body.ljust(n * room, b"\0"), np.uint8).reshape(n, room)
    crc = crc16(np.concatenate([rows[:1, 2:HEAD], rows[:1, HEAD + CRC : HEAD + CRC + SIDE]], axis=1))[0]
    rows[:, HEAD], rows[:, HEAD + 1] = crc >> 8, crc & 255
    return rows.tobytes()


def write_stream(payload: bytes) -> bytes:
    """payload as an MPEG audio stream: tag, Xing frame, full frames, one frame of the smallest fitting bitrate."""
    top = len(KBPS) - 1
    room = LENGTHS[top] - HEAD - CRC - SIDE
    cut = len(payload) // room * room
    last = next(i for i in range(len(KBPS)) if LENGTHS[i] - HEAD - CRC - SIDE >= len(payload) - cut)
    audio = (_frames(top, payload[:cut]) if cut else b"") + (_frames(last, payload[cut:]) if payload[cut:] else b"")
    n = cut // room + bool(payload[cut:])
    total = LENGTHS[0] + len(audio)
    toc = bytes(min(255, 256 * (LENGTHS[0] + min(n * i // 100 * LENGTHS[top], len(audio))) // total) for i in range(100))
    xing = b"Xing" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc + bytes(4)
    return _tag({"payload_bytes": str(len(payload))}) + _frames(0, xing) + audio


def _number(x: str) -> int | None:
    return int(x) if x.isascii() and x.isdigit() and len(x) < 19 else None


def _parse_tag(data: bytes) -> tuple[int, dict[str, str]]:
    """(end, texts) of an ID3v2 tag at the start."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    end = min(10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]), len(data))
    at, tags = 10, {}
    while at + 10 <= end and data[at]:
        size = data[at + 4 : at + 8]
        size = size[0] << 21 | size[1] << 14 | size[2] << 7 | size[3] if data[3] >= 4 else int.from_bytes(size, "big")
        key, body = data[at : at + 4].decode("latin-1"), data[at + 11 : min(at + 10 + size, end)]
        if key == "TXXX":
            name, _, value = body.partition(b"\0")
            key, body = name.decode("utf-8", "replace"), value
        tags[key] = body.decode("utf-8", "replace")
        at += 10 + size
    return end, tags


def _parse_old_tag(data: bytes) -> tuple[int, dict[str, str]]:
    """(start, texts) of an ID3v1 tag at the end."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return len(data), {}
    field = lambda i, n: data[-128:][i : i + n].split(b"\0")[0].decode("latin-1").strip()
    return len(data) - 128, {k: v for k, v in (("title", field(3, 30)), ("artist", field(33, 30)), ("album", field(63, 30)), ("year", field(93, 4))) if v}


def _frame_of(head: bytes) -> tuple[int, int, bool, int, int] | None:
    """(length, sample rate, protected, side bytes, samples) by a header of Layer III, or None."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE6 != 0xE2 or head[1] >> 3 & 3 == 1:
        return None
    version, bitrate, rate, mono = head[1] >> 3 & 3, head[2] >> 4, head[2] >> 2 & 3, head[3] >> 6 == 3
    if not 1 <= bitrate <= 14 or rate == 3:
        return None
    first = version == 3
    hertz = RATES[rate] // {3: 1, 2: 2, 0: 4}[version]
    kbps = (KBPS if first else KBPS_LOW)[bitrate - 1]
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return (144 if first else 72) * kbps * 1000 // hertz + (head[2] >> 1 & 1), hertz, not head[1] & 1, side, SAMPLES if first else SAMPLES // 2


def _table_of(data: bytes, offset: int, frame: tuple) -> tuple[int | None, int | None, list[int]] | None:
    """(frames, bytes, seek table) of a variable-bitrate table in the frame at offset, or None."""
    end = offset + frame[0]
    at = offset + HEAD + CRC * frame[2] + frame[3]
    whole = lambda i, n=4: int.from_bytes(data[i : i + n], "big")
    if data[at : at + 4] in (b"Xing", b"Info") and at + 8 <= end:
        flags, at = whole(at + 4), at + 8
        got: list[int | None] = [None, None]
        for k in (0, 1):
            if flags >> k & 1 and at + 4 <= end:
                got[k], at = whole(at), at + 4
        return got[0], got[1], list(data[at : at + 100]) if flags & 4 and at + 100 <= end else []
    at = offset + HEAD + 32
    if data[at : at + 4] == b"VBRI" and at + 26 <= end:
        n, scale, size = whole(at + 18, 2), whole(at + 20, 2), whole(at + 22, 2)
        n = min(n, (end - at - 26) // size) if size else 0
        return whole(at + 14), whole(at + 10), [min(whole(at + 26 + i * size, size) * scale, (1 << 31) - 1) for i in range(n)]
    return None


def read_stream(data: bytes) -> dict:
    """What the stream holds, by FIELDS."""
    at, tags = _parse_tag(data)
    n, old = _parse_old_tag(data[at:])
    n += at
    known: dict[bytes, tuple | None] = {}

    def header(i: int) -> tuple | None:
        head = data[i : min(i + 4, n)]
        if head not in known:
            known[head] = _frame_of(head)
        return known[head]

    def verified(i: int, f: tuple) -> bool:
        """True if the frame at i is protected and its checksum is right."""
        own = np.frombuffer(data[i + 2 : i + HEAD] + data[i + HEAD + CRC : i + HEAD + CRC + f[3]], np.uint8)[None]
        return f[2] and int(crc16(own)[0]) == int.from_bytes(data[i + HEAD : i + HEAD + CRC], "big")

    offsets, junk, found = [], 0, []
    while at < n:
        f = header(at)
        if f and at + f[0] <= n and (at + f[0] == n or header(at + f[0]) or verified(at, f)):
            found.append(f)
            offsets.append(at)
            at += f[0]
            continue
        to = data.find(b"\xff", at + 1, n)
        to = n if to < 0 else to
        junk += to - at
        at = to
    bad = checked = 0
    raw = np.frombuffer(data, np.uint8)
    starts = np.array(offsets, dtype=np.int64)
    for side in {f[3] for f in found if f[2] and f[0] >= HEAD + CRC + f[3]}:
        own = starts[[f[2] and f[3] == side and f[0] >= HEAD + CRC + side for f in found]]
        at_bytes = np.concatenate([np.arange(2, HEAD), np.arange(HEAD + CRC, HEAD + CRC + side)])
        good = crc16(raw[own[:, None] + at_bytes]) == (raw[own + HEAD].astype(np.uint16) << np.uint16(8) | raw[own + HEAD + 1])
        checked, bad = checked + len(own), bad + int((~good).sum())
    table = _table_of(data, offsets[0], found[0]) if found else None
    first = int(table is not None)
    payload = b"".join(data[o + HEAD + CRC * f[2] + f[3] : o + f[0]] for o, f in zip(offsets[first:], found[first:], strict=True))
    size = _number(tags.get("payload_bytes", ""))
    samples, rates = sum(f[4] for f in found[first:]), {f[1] for f in found[first:]}
    duration = samples / next(iter(rates)) if len(rates) == 1 else sum(f[4] / f[1] for f in found[first:])
    frames, total, toc = table or (None, None, None)
    return {"payload": payload if size is None else payload[:size], "n_frames": len(found) - first, "samples": samples, "sample_rate": found[0][1] if found else 0, "duration": duration, "is_vbr": len({f[0] for f in found[first:]}) > 1, "crc_checked": checked, "crc_bad": bad, "junk_bytes": junk, "tags": old | tags, "seek_offsets": offsets[first:], "table_frames": frames, "table_bytes": total, "table_toc": toc}


_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_KIND = pa.struct(list(zip(_NAMES, [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int32())], strict=True)))


def _write(payload: pa.Array) -> pa.Array:
    return bytehash.by_bytes(payload, lambda some: pa.array([write_stream(x or b"") for x in some.to_pylist()], pa.binary()), pa.binary(), PART)


def _read(media: pa.Array) -> pa.Array:
    def some(media: pa.Array) -> pa.Array:
        got = [read_stream(x or b"") for x in media.to_pylist()]
        return pa.array([r | {"tags": list(r["tags"].items())} for r in got], _KIND)

    return bytehash.by_bytes(media, some, _KIND, PART)


def payload_of(text: Column) -> Column:
    """The UTF-8 bytes of text with zero bytes up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.lit(64), F.ceil(F.octet_length(raw) / 64) * 64).cast("int")
    return F.rpad(raw, size, F.lit(bytearray(1)))


def write_audio(docs: DataFrame, payload: Column, media_col: str = "media") -> DataFrame:
    """docs with a column of MPEG streams that hold the payload bytes."""
    return new_column(docs, media_col, F.arrow_udf(_write, "binary")(payload))


def read_audio(media: DataFrame, media_col: str = "media", out_col: str = "audio") -> DataFrame:
    """media with a struct column of FIELDS; duration in seconds, exactly samples over sample_rate where that is one."""
    return new_column(media, out_col, F.arrow_udf(_read, f"struct<{','.join(':'.join(f.split()) for f in FIELDS.replace('long', 'bigint').split(', '))}>")(F.col(media_col)))
