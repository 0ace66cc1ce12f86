"""WARC archives with an index, and coalesced byte-range reads of the records selected from it.

write() stores each page as a gzip member of its own in an archive of the task that has it, and gives the index:
path, offset, length, url, digest and what else is known per record. read() sorts selected index rows by place,
joins neighbouring ranges to one read, and parses the records.

Defined results: null html is an empty payload; a payload of which no copy has a page_id is all responses, and a null
page_id is after all others; rows that repeat the least page_id of a payload are responses too; a null or odd url is
stored percent-encoded (null: no header) and comes back from the index unchanged; an empty table gives no archive and no
row. A page is held in memory whole, so a very long one costs a task its own length; archives end after ARCHIVE_BYTES, with
the page that reaches them. Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import lookup, shared_dir, stored

#: Bytes of an archive after which a task begins the next one; of a range read at once; between ranges that are joined.
ARCHIVE_BYTES, RANGE_BYTES, GAP_BYTES = 1 << 30, 8 << 20, 64 << 10


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A response, or with refers_to a revisit, whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """type, refers_to, digest (header), payload (None for a revisit) and payload_bytes of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    refers = fields.get("WARC-Refers-To")
    return {"type": fields["WARC-Type"], "refers_to": int(refers[10:-1]) if refers else None, "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None if refers else payload, "payload_bytes": size}


def assigned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the least page_id with the same payload, where that is another one."""
    p = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    groups = p.filter(size >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("least")).filter("n > 1")
    found = lookup(p, stored(groups, "groups"), "sha", F.col("page_id"))
    other = (size >= min_bytes) & ~F.col("least").eqNullSafe(F.col("page_id"))
    return found.select("page_id", "url", "html", F.when(other, F.col("least")).alias("refers_to"))


INDEX = "path string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"


def write(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below folder, a URI that all executors share, and returns their index, itself stored there.

    A task that runs again writes new archives; the index names those of the attempt whose rows it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            for page_id, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                sha = digest(payload)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, payload, sha, refers)) + z.flush()
                out.write(member)
                rows.append((f"{folder}/{name}", at, len(member), url, sha, page_id, "response" if refers is None else "revisit", refers))
                at += len(member)
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return stored(assigned(pages, min_bytes).mapInArrow(run, INDEX), "index")


def read(index: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """Records of the index rows given: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload.

    Of a response bytes and digest are those of the payload read, and must agree with the header; a revisit has what its header says.
    """

    def ranges(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        part: list[tuple] = []
        for r in rows:
            end = part[-1][1] + part[-1][2] if part else 0
            if part and (r[0] != part[0][0] or r[1] > end + gap_bytes or r[1] + r[2] - part[0][1] > range_bytes):
                yield part
                part = []
            part.append(r)
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, tuple] = {}
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length", "page_id", "url")), strict=True))
        for part in ranges(rows):
            folder, _, name = part[0][0].rpartition("/")
            if folder not in stores:
                stores[folder] = fs.FileSystem.from_uri(folder)
            store, base = stores[folder]
            first, last = part[0][1], part[-1][1] + part[-1][2]
            with store.open_input_file(f"{base}/{name}") as f:
                f.seek(first)
                data = f.read(last - first)
            out = []
            for _, offset, length, page_id, url in part:
                r = parse(zlib.decompress(data[offset - first : offset - first + length], 31))
                sha = r["digest"]
                if r["payload"] is not None and (digest(r["payload"]) != sha or len(r["payload"]) != r["payload_bytes"]):
                    raise ValueError(f"record of page {page_id} at {offset} of {name} is damaged")
                out.append((page_id, url, r["payload_bytes"], sha, r["type"], r["refers_to"]) + ((r["payload"],) if with_payload else ()))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], NAMES[: len(out[0])])

    schema = READ + (", payload binary" if with_payload else "")
    placed = index.select("path", "offset", "length", "page_id", "url", F.expr(f"offset div {range_bytes}").alias("piece"))
    return placed.repartition("path", "piece").sortWithinPartitions("path", "offset").mapInArrow(run, schema)


NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """All pages written as archives in a new shared folder and read back by the index."""
    return read(write(pages, f"{shared_dir(pages.sparkSession)}/warc", min_bytes), with_payload=False)
