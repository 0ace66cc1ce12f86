import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import mpegts


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_round_trip(data):
    payload = mpegts.pad(data)
    media = mpegts.write(payload)
    s = mpegts.read(media)
    assert len(media) % 188 == 0 and all(media[k] == 0x47 for k in range(0, len(media), 188))
    assert s.payload == payload and (s.lost, s.repeated, s.bad) == (0, 0, 0)
    assert [t for t, *_ in s.units] == [k * mpegts.TICKS for k in range(len(s.units))]
    assert [k for k, u in enumerate(s.units) if u[3]] == list(range(0, len(s.units), mpegts.EVERY))


def test_damage():
    media = mpegts.write(mpegts.pad(b"x" * 60_000))
    assert mpegts.read(media[:188 * 20] + media[188 * 21 :]).lost == 1
    assert mpegts.read(media[:188 * 20] + media[188 * 19 : 188 * 20] + media[188 * 20 :]).repeated == 1
    assert mpegts.read(media[:-5]).bad > 0
    broken = bytearray(media)
    broken[10] ^= 1  # in the first program table
    assert mpegts.read(bytes(broken)).bad >= 1
    assert mpegts.read(None).payload == b"" and mpegts.read(b"\x00" * 400).bad == 400
    assert mpegts.read(b"junk" + media).payload == mpegts.read(media).payload


def test_wrap_of_counters_and_table_crc():
    media = mpegts.write(b"a" * 192 * 1000)
    assert mpegts.read(media).lost == 0
    assert mpegts.crc(bytes.fromhex("00b00d0001c100000001f000")) == 0x2AB104B2


def test_query_columns(odd, empty):
    rows = mpegts.probe(mpegts.store(odd)).collect()
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd.collect())
    got = sorted(((r.doc_id is None, r.doc_id or 0, r) for r in rows), key=lambda x: (x[0], x[1], x[2].n_bytes))
    for (_, i, t), (_, j, r) in zip(sorted(texts, key=lambda x: (x[0], x[1], len(x[2].encode()))), got, strict=True):
        b = t.encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192), b" ")
        assert i == j and (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        m = mpegts.write(p)
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    assert mpegts.probe(mpegts.store(empty)).count() == 0
