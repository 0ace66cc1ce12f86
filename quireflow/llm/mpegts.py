"""Media columns: MPEG transport streams.

write() multiplexes bytes into 188-byte packets: a program association and a program map table before every
random-access point, access units as PES packets with a time stamp each, continuity counters, stuffing by
adaptation fields. read() parses the tables to find the stream, checks continuity, reassembles the packets
and gives the time stamps with the random-access points.

Defined results: null text is the empty text (192 spaces are stored); read(None) finds nothing; bytes that
are no packets, or sections with a wrong CRC, are counted as errors and skipped, never raised; repeated rows get a row each, and
so do rows without doc_id; an empty table gives an empty result. A text is held in memory whole, with its packets, so a very
long one costs a task about three times its length. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

PACKET, PAT, PMT, STREAM = 188, 0x0000, 0x1000, 0x0100
#: Bytes of payload are padded with spaces to a positive multiple of this.
UNIT = 192
#: Bytes of payload in an access unit, 90 kHz ticks between units, and units between random-access points.
ACCESS, TICKS, EVERY = 32 * UNIT, 3600, 8


def _table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _table()


def crc(data: bytes) -> int:
    """CRC-32 of program tables: not reflected, not inverted at the end."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 ^ CRC[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def _section(kind: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", kind, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc(head + body))


def _psi(pid: int, section: bytes) -> list[bytes]:
    """The table's packet for each value of the counter."""
    return [(struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | n) + b"\0" + section).ljust(PACKET, b"\xff") for n in range(16)]


PAT_PACKETS = _psi(PAT, _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT)))
PMT_PACKETS = _psi(PMT, _section(0x02, 1, struct.pack(">HH", 0xE000 | STREAM, 0xF000) + struct.pack(">BHH", 0x06, 0xE000 | STREAM, 0xF000)))
HEADS = [struct.pack(">BHB", 0x47, STREAM, 0x10 | n) for n in range(16)]


def _pts(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def pad(data: bytes) -> bytes:
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def write(payload: bytes) -> bytes:
    """A transport stream of one program with one private stream that holds the payload."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), ACCESS)):
        unit, random = payload[at : at + ACCESS], k % EVERY == 0
        if random:
            out += [PAT_PACKETS[tables & 15], PMT_PACKETS[tables & 15]]
            tables += 1
        pes = b"\0\0\1\xbd" + struct.pack(">H", len(unit) + 8) + b"\x80\x80\x05" + _pts(k * TICKS & (1 << 33) - 1) + unit
        first = PACKET - 6
        room = min(first, len(pes))
        out.append(struct.pack(">BHBBB", 0x47, 0x4000 | STREAM, 0x30 | counter & 15, 1 + first - room, 0x40 * random) + b"\xff" * (first - room) + pes[:room])
        counter += 1
        for p in range(room, len(pes) - 183, 184):
            out.append(HEADS[counter & 15] + pes[p : p + 184])
            counter += 1
        left = (len(pes) - room) % 184
        if left:
            n = 183 - left  # length of the adaptation field
            out.append(struct.pack(">BHBB", 0x47, STREAM, 0x30 | counter & 15, n) + (b"\0" + b"\xff" * (n - 1) if n else b"") + pes[-left:])
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    units: list[tuple[int, int, int, bool]] = field(default_factory=list)  # time stamp, offset and bytes in payload, random access
    lost: int = 0  # breaks of a continuity counter
    repeated: int = 0
    bad: int = 0  # bytes without sync, tables with a wrong CRC, units without a start code


def _sections(s: Stream, packet: bytes, start: int) -> bytes | None:
    at = start + 1 + packet[start]
    if at + 3 > PACKET:
        return None
    end = at + 3 + (struct.unpack_from(">H", packet, at + 1)[0] & 0xFFF)
    if end > PACKET or crc(packet[at:end]):
        s.bad += 1
        return None
    return packet[at : end - 4]


def read(media: bytes | None) -> Stream:
    s, maps, stream, counters = Stream(), set(), None, {}
    parts: list[bytes] = []
    pes: list[bytes] = []
    random, offset = False, 0

    def close() -> None:
        nonlocal offset
        if not pes:
            return
        unit = b"".join(pes)
        pes.clear()
        if unit[:3] != b"\0\0\1" or len(unit) < 9:
            s.bad += 1
            return
        length = struct.unpack_from(">H", unit, 4)[0]
        body = unit[9 + unit[8] : 6 + length if length else None]
        t = None
        if unit[7] & 0x80 and len(unit) >= 14:
            b = unit[9:14]
            t = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
        parts.append(body)
        s.units.append((t, offset, len(body), random))
        offset += len(body)

    data = media or b""
    at = 0
    while at + PACKET <= len(data):
        if data[at] != 0x47:
            s.bad += 1
            at += 1
            continue
        packet = data[at : at + PACKET]
        at += PACKET
        s.packets += 1
        pid, flags = (packet[1] & 0x1F) << 8 | packet[2], packet[3]
        if not flags & 0x10:
            continue
        was, now = counters.get(pid), flags & 15
        counters[pid] = now
        if was is not None and now != (was + 1) & 15:
            if now == was:
                s.repeated += 1
                continue
            s.lost += 1
        start = 4 + (1 + packet[4] if flags & 0x20 else 0)
        opens = packet[1] & 0x40
        if pid == stream:
            if opens:
                close()
                random = bool(flags & 0x20 and packet[4] and packet[5] & 0x40)
            if opens or pes:
                pes.append(packet[start:])
        elif pid == PAT and opens and (t := _sections(s, packet, start)):
            maps = {struct.unpack_from(">H", t, k + 2)[0] & 0x1FFF for k in range(8, len(t), 4) if t[k : k + 2] != b"\0\0"}
        elif pid in maps and opens and (t := _sections(s, packet, start)):
            k = 12 + (struct.unpack_from(">H", t, 10)[0] & 0xFFF)
            if k + 5 <= len(t):
                stream = struct.unpack_from(">H", t, k + 1)[0] & 0x1FFF
    close()
    s.bad += len(data) - at
    s.payload = b"".join(parts)
    return s


def feature(s: Stream) -> str:
    points = [t for t, _, _, r in s.units if r]
    return f"ts packets={s.packets} units={len(s.units)} random={len(points)} pts={s.units[0][0] if s.units else ''}-{s.units[-1][0] if s.units else ''} lost={s.lost} repeated={s.repeated} bad={s.bad}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the transport stream that holds the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in b.column("text")[at : at + 256]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[at : at + 256], pa.array([len(x) for x in texts], pa.int64()), pa.array([write(pad(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


PROBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pts: long, offset: long, bytes: long, random_access: boolean>>"
ARROW = pa.schema(
    [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("units", pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()), ("random_access", pa.bool_())])))]
)


def _probed(media: bytes) -> tuple:
    s = read(media)
    return (len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), [dict(zip(("pts", "offset", "bytes", "random_access"), u, strict=True)) for u in s.units])


def probe(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from the column media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_probed(x.as_py() or b"") for x in b.column("media")]
            columns = list(zip(*rows, strict=True)) or [()] * len(ARROW)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True))], ["doc_id", "n_bytes", *ARROW.names])

    d = stored.select("doc_id", "n_bytes", "media")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, {PROBED}")
