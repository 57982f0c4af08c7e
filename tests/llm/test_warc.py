"""Archives written, read back and held against the pages they came from."""

import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import warc
from ledgerleaf.llm.queries import QUERIES
from ledgerleaf.session import scratch_path

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def brute(rows, least=1000):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each (page_id, url, html)."""
    copies = defaultdict(list)
    data = [(i, (h if isinstance(h, bytes) else (h or "").encode())) for i, _, h in rows]
    for i, payload in data:
        copies[payload].append(i)
    out = []
    for i, payload in data:
        last = max((k for k in copies[payload] if k is not None), default=None)
        revisit = len(payload) >= least and len(copies[payload]) > 1 and last is not None and last != i
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response",
                    last if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(QUERIES["op12_warc"](spark, SF)) == brute(rows)


BIG = "<p>" + "é" * 600 + "</p>"
AWKWARD = ["", "\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "\r", "\n", "\r\r\n\r\n", "a\r\n", "a\r\n\r", "\r\n\r\nWARC/1.1\r\n", "\r\n\r\r\n\r\nx",
           "WARC/1.1\r\nContent-Length: 3\r\n\r\n", "x" * 999, "x" * 1000, BIG, BIG + "\r\n\r\n", None, "\x00", "y" * 500 + "\r\n\r\n" * 300]


def test_awkward_payloads_come_back(spark):
    rows = [(i, f"http://a.b/{i}", h) for i, h in enumerate(AWKWARD * 3)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = warc.archive(df)
        assert result(got) == brute(rows) and got.where("not intact").count() == 0


def test_large_group_and_edges(spark):
    """A third of the rows hold one payload; ids repeat or are null, urls are null or hold line ends."""
    big, other = "z" * 1500, "q" * 1200
    rows = [(i, "http://h/", big if i % 3 == 0 else f"{i} " * 400) for i in range(300)]
    rows += [(298, None, big), (None, "u\r\nX: 1\r\n\r\n v", big), (None, None, other), (None, None, other), (400, "u", other + "!"),
             (400, "u", other + "!"), (401, "", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("bytes", "sha256", "sha1", "payload", "original_id", "value", "a.b"):
        df = df.withColumn(c, F.lit(c))
    got = warc.archive(df)
    assert result(got) == brute(rows)
    assert {r.url for r in got.where("page_id is null and payload_bytes = 1500").collect()} == {"u%0D%0AX:%201%0D%0A%0D%0A%20v"}
    assert warc.archive(df.limit(0)).count() == 0


def test_invalid_text_is_kept_byte_by_byte(spark):
    raw = b"\xff\xfe" + b"\x80" * 1200
    df = spark.createDataFrame([(1, "u", raw), (2, "v", raw)], "page_id long, url string, html binary")
    assert result(warc.archive(df.withColumn("html", F.col("html").cast("string")))) == brute([(1, "u", raw), (2, "v", raw)])


def test_archives_are_warc(spark):
    """The files themselves, taken apart with plain string work."""
    rows = [(1, "http://a/", BIG), (2, "http://b/", BIG), (3, "http://c/", "small\r\n\r\n")]
    path = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    (file,) = Path(path.removeprefix("file:")).glob("*.gz")
    data, found = gzip.decompress(file.read_bytes()), {}
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        block, end, data = rest[:n], rest[n:n + 4], rest[n + 4:]
        assert end == b"\r\n\r\n"
        found[fields["X-Page-Id"]] = fields, block
    assert {k: v[0]["WARC-Type"] for k, v in found.items()} == {"1": "revisit", "2": "response", "3": "response"}
    fields, block = found["1"]
    assert fields["WARC-Refers-To"] == found["2"][0]["WARC-Record-ID"] and fields["WARC-Refers-To-Target-URI"] == "http://b/"
    assert fields["WARC-Payload-Digest"] == found["2"][0]["WARC-Payload-Digest"] and block.endswith(b"\r\n\r\n")
    assert found["2"][1].endswith(BIG.encode()) and found["3"][1].endswith(b"\r\n\r\nsmall\r\n\r\n")


def test_damage_is_seen(spark):
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.Reader().feed(b"hello"))
    found = spark.createDataFrame([("r1", "response", "1", None, None, "aa", 3, False),
                                   ("r2", "revisit", "2", None, "r1", "bb", None, True),
                                   ("r3", "revisit", "3", None, "gone", "cc", None, True)], warc.RECORD)
    got = {r.record_id: (r.refers_to, r.payload_bytes, r.payload_digest, r.intact) for r in warc.resolve(found).collect()}
    assert got == {"r1": (None, 3, "aa", False), "r2": ("1", 3, "aa", False), "r3": (None, None, "cc", None)}
