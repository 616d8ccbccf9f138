import hashlib
import random
import zlib

import pytest

from gridlake.llm import ogg
from tests.llm.common import as_dict, docs


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
    return c


def test_checksum_against_bit_by_bit():
    for n in (0, 1, 27, 300):
        data = random.Random(n).randbytes(n)
        assert ogg.page_checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 64, 254, 255, 256, 4096, 65025, 65026, 400_000])
@pytest.mark.parametrize("packet", [255, 4096, 70_000])
def test_round_trip(n, packet):
    data = random.Random(n).randbytes(n)
    media = ogg.write(data, b"note", packet)
    assert media == ogg.write(data, b"note", packet)
    streams = ogg.read(media)
    assert len(streams) == 2
    assert ogg.samples(media)[0] == data
    notes = next(s for s in streams.values() if s.packets[0][:4] == b"NOTE")
    assert notes.packets[1:] == [b"note"]
    sound = next(s for s in streams.values() if s.packets[0][:4] == b"PCM8")
    for k, seconds in ogg.timestamps(sound):
        assert seconds == min(k * packet, n) / ogg.RATE


def test_damage_is_found():
    media = bytearray(ogg.write(b"a" * 70_000))
    for at in (30, 200, 66_000, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.samples(bytes(bad))
    with pytest.raises(ValueError):
        ogg.samples(bytes(media[:-5]))


def test_digests(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 300_000), (4, "x" * 300_000), (None, "a" * 64)]
    out = ogg.media_digests(docs(spark, rows)).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    for i, t in rows:
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(pay))
        assert r.payload_sha256 == hashlib.sha256(pay).hexdigest()
        assert r.tail_crc32 == zlib.crc32(pay[-64:])
        media = ogg.write(pay)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert ogg.media_digests(docs(spark, [])).count() == 0


def test_column(spark):
    out = as_dict(ogg.ogg_column(docs(spark, [(1, "abc")])))
    assert ogg.samples(bytes(out[1]["media"]))[0] == b"abc" + bytes(61)
