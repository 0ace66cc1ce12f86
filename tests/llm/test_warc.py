import base64
import hashlib
import zlib

import pytest

from quireflow.llm import warc
from quireflow.llm.common import shared_dir

SCHEMA = "page_id LONG, url STRING, html STRING, sha STRING, path STRING, offset STRING"


def brute(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        first = least.get(h or "")
        other = first is not None and first != i
        out.append((i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if other else "response", first if other else None))
    return sorted(map(repr, out))


ROWS = [(5, "http://a/x y", "<p>a"), (2, None, "<p>a"), (9, "http://b/é\r\nX: 1", None), (7, "", ""), (None, "http://c", "<p>a"), (None, None, None), (3, "u", "ü" * 200_000), (5, "http://a/x y", "<p>a"), (2, None, "<p>a"), (11, "v", "lone")]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x", "x", "x") for r in ROWS], SCHEMA).repartition(3)
    got = warc.round_trip(pages).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(ROWS)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_page_id_at_all(spark):
    got = warc.round_trip(spark.createDataFrame([(None, "u", "same", "", "", "")] * 2, SCHEMA)).collect()
    assert [r.record_type for r in got] == ["response"] * 2


def test_selected_payloads_and_ranges(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}" * k, "", "", "") for k in range(60)], SCHEMA).coalesce(2)
    folder = f"{shared_dir(spark)}/w"
    index = warc.write(pages, folder, archive_bytes=4000)
    assert index.select("path").distinct().count() > 2
    some = index.filter("page_id % 7 = 0")
    for gap in (0, 1 << 20):
        got = {r.page_id: r.payload for r in warc.read(some, gap_bytes=gap, range_bytes=1500).collect()}
        assert got == {k: f"<p>{k}".encode() * k for k in range(0, 60, 7)}
    with open(index.first().path.removeprefix("file://"), "rb") as f:
        assert zlib.decompressobj(31).decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_minimum_size(spark):
    pages = spark.createDataFrame([(k, None, h, "", "", "") for k, h in enumerate(["ab", "ab", "abcdef", "abcdef"])], SCHEMA)
    assert [r.record_type for r in warc.round_trip(pages, min_bytes=3).orderBy("page_id").collect()] == ["response", "response", "response", "revisit"]


def test_damage_is_found(spark):
    data = warc.record(1, "u", b"payload", warc.digest(b"payload"), None)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(Exception, match="damaged"):
        index = warc.write(spark.createDataFrame([(1, "u", "payload", "", "", "")], SCHEMA), folder := f"{shared_dir(spark)}/w")
        path = index.first().path.removeprefix("file://")
        bad = zlib.compressobj(1, zlib.DEFLATED, 31)
        with open(path, "wb") as f:
            f.write(bad.compress(data.replace(b"\r\n\r\npayload", b"\r\n\r\npaylaod")) + bad.flush())
        from pyspark.sql import functions as F

        import os

        assert folder
        warc.read(index.withColumn("length", F.lit(os.path.getsize(path)).cast("long"))).collect()
