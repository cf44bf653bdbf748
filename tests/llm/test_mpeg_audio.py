from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from ordlake.llm import mpeg_audio as m


def test_round_trip_of_sizes():
    r = random.Random(1)
    for n in [0, 1, 64, 120, 121, 122, 1416, 1417, 1418, 5000, 100_000]:
        data = r.randbytes(n)
        got = m.read_stream(m.write_stream(data))
        assert got["payload"] == data and got["crc_bad"] == 0 and got["junk_bytes"] == 0
        assert got["table_frames"] == got["n_frames"] == len(got["seek_offsets"])
        assert got["samples"] == got["n_frames"] * 1152 and got["duration"] == got["samples"] / 32000
        stream = m.write_stream(data)
        assert got["table_bytes"] == len(stream) - stream.index(b"\xff\xfa") and len(got["table_toc"]) == 100
        assert all(stream[o : o + 2] == b"\xff\xfa" for o in got["seek_offsets"])


def test_resynchronises_and_checks():
    data = bytes(range(256)) * 20
    stream = m.write_stream(data)
    offsets = m.read_stream(stream)["seek_offsets"]
    dirty = stream[: offsets[1]] + b"\xff\xfb\x10 junk \xff\xff" + stream[offsets[1] :]
    got = m.read_stream(dirty)
    assert got["payload"] == data and got["junk_bytes"] == 11
    broken = bytearray(stream)
    broken[offsets[0] + m.HEAD + m.CRC + 3] ^= 1
    assert m.read_stream(bytes(broken))["crc_bad"] == 1
    assert m.read_stream(stream[:-5])["n_frames"] == len(offsets) - 1
    assert m.read_stream(b"")["n_frames"] == 0 and m.read_stream(b"\xff" * 50)["payload"] == b""


def test_crc_is_the_public_one():
    assert m.crc16(m.np.frombuffer(b"123456789", m.np.uint8)[None])[0] == 0xAEE7


def frame(version, kbps_index, rate_index, body=b"", mono=True, padding=0):
    """An unprotected frame of Layer III."""
    head = bytes([0xFF, 0xE3 | version << 3, kbps_index << 4 | rate_index << 2 | padding << 1, 0xC0 if mono else 0])
    return head + body.ljust(m._frame_of(head)[0] - 4, b"\0")


def test_other_versions_tags_and_tables():
    low = frame(2, 8, 0) * 3  # MPEG-2, 64 kbit/s, 22050 Hz
    got = m.read_stream(low)
    assert (got["n_frames"], got["sample_rate"], got["samples"], got["junk_bytes"]) == (3, 22050, 3 * 576, 0)
    assert got["duration"] == 3 * 576 / 22050 and got["crc_checked"] == 0
    lowest = m.read_stream(frame(0, 4, 2) * 2)
    assert (lowest["n_frames"], lowest["sample_rate"]) == (2, 8000)
    old = b"TAG" + b"song".ljust(30, b"\0") + b"me".ljust(30, b"\0") + bytes(30) + b"1999" + bytes(31)
    got = m.read_stream(low + old)
    assert got["n_frames"] == 3 and got["junk_bytes"] == 0 and got["tags"] == {"title": "song", "artist": "me", "year": "1999"}
    table = bytes(32) + b"VBRI" + bytes(6) + (900).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (3, 2, 2, 1)) + b"".join(x.to_bytes(2, "big") for x in (10, 20, 30))
    got = m.read_stream(frame(3, 9, 0, table) + frame(3, 9, 0) + frame(3, 10, 0))
    assert (got["n_frames"], got["table_frames"], got["table_bytes"], got["table_toc"], got["is_vbr"]) == (2, 2, 900, [20, 40, 60], True)


def test_foreign_and_broken_tags_do_not_fail():
    stream = m.write_stream(b"x" * 64)
    at = stream.index(b"\xff\xfa")
    for value in ("abc", "-5", "9" * 40, "", "\u0663"):
        got = m.read_stream(m._tag({"payload_bytes": value}) + stream[at:])
        assert got["payload"][:64] == b"x" * 64 and got["n_frames"] == 1
    r = random.Random(7)
    for _ in range(300):
        broken = bytearray(stream)
        for _ in range(r.randint(1, 30)):
            broken[r.randrange(len(broken))] = r.randrange(256)
        m.read_stream(bytes(broken[: r.randint(0, len(broken))]))


def test_a_column_of_the_result_s_name_stays(spark):
    df = spark.createDataFrame([(1, "a", "mine", 5)], "doc_id long, text string, media string, audio int")
    r = m.read_audio(m.write_audio(df, m.payload_of(F.col("text"))), "media_").first()
    assert (r.media, r.audio, r.audio_.n_frames) == ("mine", 5, 1)


def test_operator(docs, texts, empty):
    stored = m.write_audio(docs, m.payload_of(F.col("text")))
    for r in m.read_audio(stored).select("text", "media", "audio").collect():
        raw = (r.text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert hashlib.sha256(r.audio.payload).digest() == hashlib.sha256(padded).digest()
        assert r.audio.tags["payload_bytes"] == str(len(padded))
    assert m.read_audio(m.write_audio(empty, m.payload_of(F.col("text")))).count() == 0
