import hashlib
import os
import random
import re
import zlib

import pytest

from sluice.llm import queries, transport


@pytest.mark.parametrize("n", [0, 1, 144, 150, 161, 162, 163, 170, 176, 180, 184, 192, 345, 346, 347, 1000, 12288, 12289, 50_000, transport.UNIT * 20])
def test_round_trip(n):
    data = bytes(i * 31 % 256 for i in range(n))
    media = transport.mux(data)
    assert len(media) % 188 == 0 and set(media[::188]) == {0x47}
    d = transport.Demuxer().feed(media)
    assert b"".join(d.parts) == data
    assert (d.gaps, d.bad_tables, d.lost_sync) == (0, 0, 0)
    assert d.pid == transport.DATA_PID and d.program == 1 and d.packets == len(media) // 188
    assert [u[0] for u in d.units] == [transport.START + o * 90000 // 8000 for _, o, _ in d.units] and all(u[2] for u in d.units)


def test_continuity_and_damage():
    data = bytes(range(256)) * 200
    media = transport.mux(data)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    lost = transport.Demuxer().feed(b"".join(packets[:40] + packets[41:]))
    assert lost.gaps >= 1 and len(lost.units) == len(transport.Demuxer().feed(media).units) - 1
    twice = transport.Demuxer().feed(b"".join(packets[:40] + packets[39:]))
    assert twice.gaps == 0 and b"".join(twice.parts) == data  # a repeated packet is no gap
    shifted = transport.Demuxer().feed(b"\x00\x01\x02" + media)
    assert shifted.lost_sync >= 1 and b"".join(shifted.parts) == data
    bad = bytearray(media)
    bad[12] ^= 1
    assert transport.Demuxer().feed(bytes(bad)).bad_tables >= 1
    assert transport.Demuxer().feed(b"").packets == 0


def test_crc():
    # the published check value of this CRC
    assert transport.crc(b"123456789") == 0x0376E6E7
    assert transport.crc(transport.PAT) == transport.crc(transport.PMT) == 0


def test_stamps_wrap():
    for t in (0, 1, 90000, 2**32, 2**33 - 1, 2**33 + 5):
        assert transport._ticks(transport._stamp(t)) == t % 2**33


def test_columns(spark, docs, none):
    rows = docs.selectExpr("doc_id", "encode(text, 'UTF-8') AS samples", "label AS media_label")
    back = transport.read(transport.write(rows, carry=("media_label",)), carry=("media_label",)).collect()
    want = sorted((repr(r.doc_id), (r.text or "").encode()) for r in docs.collect())
    assert sorted((repr(r.doc_id), bytes(r.samples)) for r in back) == want
    empty = none.selectExpr("doc_id", "encode(text, 'UTF-8') AS samples")
    assert transport.read(transport.write(empty)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op7_transport_streams"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        padded = data + b" " * (192 * max(1, -(-len(data) // 192)) - len(data))
        media = transport.mux(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-16:]), len(media), hashlib.sha256(media).hexdigest())


def test_any_damage_is_counted():
    """Truncated, flipped and made-up packets never raise; what is whole is read."""
    r = random.Random(1)
    media = transport.mux(bytes(range(256)) * 100)
    for _ in range(3000):
        x = bytearray(media[: r.randrange(len(media) + 1)])
        for _ in range(r.randint(1, 30)):
            if x:
                x[r.randrange(len(x))] = r.randrange(256)
        transport.Demuxer().feed(bytes(x))
    for pid in (transport.PAT_PID, transport.DATA_PID):
        head = bytes((0x47, 0x40 | pid >> 8, pid & 255))
        for flags, rest in ((0x30, b"\xff" * 184), (0x30, bytes([183]) + b"\0" * 183), (0x30, bytes([182]) + b"\0" * 183), (0x10, b"\xff" * 184), (0x10, b"\xb7" * 184), (0x10, b"\0" * 184)):
            transport.Demuxer().feed(transport.mux(b"abc")[:376] + head + bytes([flags]) + rest)
    short = b"\0\0\1\xbd\0\4\x84\x80\5\x21"  # says it has a time, and ends
    d = transport.Demuxer().feed(transport.mux(b"")[:376] + bytes((0x47, 0x41, 0, 0x30, 183 - len(short))) + b"\0" + b"\xff" * (182 - len(short)) + short)
    assert [u[0] for u in d.units] in ([], [-1])


def test_repeated_rows_long_payloads_and_clashes(spark):
    long = bytes(range(251)) * 8000
    df = spark.createDataFrame([(1, long), (1, long), (None, b"a"), (2, None)], "doc_id long, samples binary")
    got = [(r.doc_id, bytes(r.samples)) for r in transport.read(transport.write(df)).collect()]
    assert sorted(got, key=repr) == sorted([(1, long), (1, long), (None, b"a"), (2, b"")], key=repr)
    with pytest.raises(ValueError, match="clash"):
        transport.read(df.withColumnRenamed("samples", "media").withColumn("level", df["doc_id"]), carry=("level",))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_feature_of_the_query(spark):
    """Every part of the feature from the text itself."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_transport_streams"](spark, sf).collect():
        data = texts[r.doc_id].encode()
        data += b" " * (192 * max(1, -(-len(data) // 192)) - len(data))
        units = -(-len(data) // transport.UNIT)
        packets = 0
        for low in range(0, len(data), transport.UNIT):
            pes = 14 + len(data[low : low + transport.UNIT])
            packets += 3 + max(0, -(-(pes - 176) // 184))
        mean, square = sum(data) / len(data), (sum(b * b for b in data) / len(data)) ** 0.5
        last = 90000 + (units - 1) * transport.UNIT * 90000 // 8000
        told, level, rms = re.fullmatch(r"(.*);level=([0-9.]+),rms=([0-9.]+)", r.feature).groups()
        assert told == f"program=1,pid=256,type=6,packets={packets},gaps=0;units={units},entries={units},pts=90000-{last}"
        assert abs(float(level) - mean) < 1e-6 and abs(float(rms) - square) < 1e-6
