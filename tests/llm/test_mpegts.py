import hashlib
import os
import zlib

import pytest

from meshlake.llm import mpegts, queries


@pytest.mark.parametrize("n", [0, 1, 161, 162, 163, 164, 183, 184, 185, 345, 346, 347, 348, 32767, 32768, 32769, 300_001])
def test_round_trip(n):
    data = os.urandom(n)
    ts = mpegts.mux(data)
    (s,) = mpegts.demux(ts)
    assert len(ts) % 188 == 0 and ts[::188] == b"G" * (len(ts) // 188)
    assert s.data == data and s.continuity_errors == 0 and s.duplicates == 0
    assert [u[0] for u in s.units] == [i * mpegts.PES_TICKS for i in range(-(-n // mpegts.PES_BYTES))]
    assert [u[1] for u in s.units] == [i % mpegts.RANDOM_EVERY == 0 for i in range(len(s.units))]


def test_lost_and_duplicate_packets():
    ts = mpegts.mux(os.urandom(100_000))
    assert mpegts.demux(ts[: 188 * 20] + ts[188 * 21 :])[0].continuity_errors == 1
    again = mpegts.demux(ts[: 188 * 5] + ts[188 * 4 :])[0]
    assert again.duplicates == 1 and again.continuity_errors == 0 and len(again.data) == 100_000


def test_bad_streams():
    with pytest.raises(ValueError):
        mpegts.demux(b"G" * 100)
    with pytest.raises(ValueError):
        mpegts.demux(b"\0" * 188)
    assert mpegts.demux(b"") == []
    broken = bytearray(mpegts.mux(b"x"))
    broken[10] ^= 1  # the PAT's checksum no longer holds
    assert mpegts.demux(bytes(broken)) == []


def test_query(spark, tmp_path):
    texts = [None, "", "a", "é" * 40_000, "x" * 64, "x" * 65, "x" * 64]
    spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, media string, units int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op7_media_ts(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        p = mpegts.pad64((t or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(mpegts.mux(p)), hashlib.sha256(mpegts.mux(p)).hexdigest())
    assert rows[4].asDict() | {"doc_id": 6} == rows[6].asDict()
