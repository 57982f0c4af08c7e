"""WARC archives with revisit resolution.

``plan`` shuffles the headers of the pages (id, digest, size; never the payload) by payload digest: of equal
payloads of some size the largest page id is the original, and the others revisit it. ``write`` joins the pages to
the originals of their digests and writes WARC 1.1 records with fresh headers, a revisit without its payload.
``read`` takes the archives apart again by their own lengths, and ``resolve`` joins each revisit record read to the
response record it refers to.

A record is one row of a text table whose line separator is the two line ends between WARC records, so Spark's own
writer and reader stream the archives, gzipped; lines that a payload's own blank lines make are put together again
by the record's length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import Stage, narrow

LEAST_BYTES = 1000
END, BLANK = "\r\n", "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # capture date where the caller gives none
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("record_id string, record_type string, page_id string, url string, refers_to_record string, "
          "payload_digest string, payload_bytes long, intact boolean")


def _record_id(page_id: Column, digest: Column, url: Column) -> Column:
    """A name-based UUID (version 5 form) of a record, the same on every run."""
    h = F.sha1(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest, F.coalesce(url, F.lit("-"))).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
                    F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(END)))


def pages_of(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """page_id, url (blanks and line ends percent-encoded), payload (null is empty), its size and digests."""
    own = narrow(pages, page_id=id_col, url=url_col, payload=payload_col)
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    url = F.col("url")
    for plain, encoded in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(plain), F.lit(encoded))
    return own.select("page_id", url.alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"),
                      F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("sha256"))


def plan(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The originals: sha256, original_id, original_url, for each payload of at least ``least_bytes`` bytes that more
    than one row has. Headers meet by digest in a partial aggregate, so a payload that a third of the pages has
    is one row of each task."""
    row = F.struct("page_id", "url")
    return (headers.where(F.col("bytes") >= least_bytes).groupBy("sha256")
            .agg(F.count("*").alias("rows"), F.max(F.when(F.col("page_id").isNotNull(), row)).alias("last"))
            .where("rows > 1 and last is not null")
            .select("sha256", F.col("last.page_id").alias("original_id"), F.col("last.url").alias("original_url")))


def records(pages: DataFrame, originals: DataFrame, date: str = DATE) -> DataFrame:
    """One text row per page: its WARC record without the two line ends that close it."""
    joined = pages.join(originals, "sha256", "left")
    is_revisit = F.col("original_id").isNotNull() & ~F.col("original_id").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(BLANK))
    block_bytes = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("bytes"))
    target = F.when(is_revisit, _record_id(F.col("original_id"), F.col("sha1"), F.col("original_url")))
    head = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit(END),
        F.lit("WARC-Record-ID: <"), _record_id(F.col("page_id"), F.col("sha1"), F.col("url")), F.lit(f">{END}"),
        F.lit(f"WARC-Date: {date}{END}"), _header("WARC-Target-URI", F.col("url")),
        _header("X-Page-Id", F.col("page_id").cast("string")),
        _header("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.concat(F.lit("<"), target, F.lit(">"))),
        _header("WARC-Refers-To-Target-URI", F.when(is_revisit, F.col("original_url"))),
        _header("WARC-Refers-To-Date", F.when(is_revisit, F.lit(date))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.lit(f"Content-Type: application/http;msgtype=response{END}Content-Length: "), block_bytes.cast("string"), F.lit(BLANK))
    body = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(F.concat(head.cast("binary"), http.cast("binary"), body).cast("string").alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *,
          least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes one WARC record per row into gzipped archives under ``path`` (part files of a text table, one per task).

    Of the rows with equal payloads of at least ``least_bytes`` bytes those with the largest id are responses and the
    others revisit it; rows with smaller payloads, and rows none of whose copies has an id, are all responses. Rows
    that repeat the response's id are responses too. A null payload is empty; a null url or id leaves its header out.
    Other columns are ignored. An empty table gives archives without records.
    """
    own = pages_of(pages, id_col, url_col, payload_col)
    # As a written table the originals have a known size: few are broadcast, and the payloads stay where they are.
    originals = Stage(pages.sparkSession, "warc").table(plan(own.drop("payload"), least_bytes), "originals")
    rows = records(own, originals, date)
    rows.write.option("lineSep", BLANK).option("compression", "gzip").text(path)


class Reader:
    """Records from the pieces of an archive between blank lines, in order."""

    def __init__(self):
        self.buffer, self.head, self.need = bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict, bytes]]:
        """(headers, block) of each record that ends with this piece."""
        self.buffer += piece
        self.buffer += b"\r\n\r\n"
        while True:
            if self.head is None:
                start = 0  # line ends between records
                while self.buffer[start:start + 1] in (b"\r", b"\n"):
                    start += 1
                del self.buffer[:start]
                end = self.buffer.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = bytes(self.buffer[:end]).split(b"\r\n")
                if not lines[0].startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {bytes(lines[0][:60])!r}")
                self.head = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace")
                             for k, _, v in (x.partition(b":") for x in lines[1:])}
                self.need = int(self.head["content-length"])
                del self.buffer[:end + 4]
            if len(self.buffer) < self.need:
                return
            yield self.head, bytes(self.buffer[:self.need])
            del self.buffer[:self.need]
            self.head = None


def _reader(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    reader = Reader()
    types = [pa.string()] * 6 + [pa.int64(), pa.bool_()]
    names = ["record_id", "record_type", "page_id", "url", "refers_to_record", "payload_digest", "payload_bytes", "intact"]
    for batch in batches:
        rows = []
        for piece in batch.column(0):
            for head, block in reader.feed(piece.as_py()):
                _, _, payload = block.partition(b"\r\n\r\n")
                kind, said = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
                full = kind == "response"
                digest = hashlib.sha1(payload).hexdigest() if full else None
                rows.append((head["warc-record-id"].strip("<>"), kind, head.get("x-page-id"), head.get("warc-target-uri"),
                             head.get("warc-refers-to", "").strip("<>") or None, digest or said,
                             len(payload) if full else None, not full or digest == said))
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives that ``write`` wrote: record_id, record_type, page_id (as text), url, refers_to_record,
    payload_digest (of a response: computed from the payload read), payload_bytes (null for a revisit), intact."""
    return spark.read.option("lineSep", BLANK).text(path).select(F.col("value").cast("binary")).mapInArrow(_reader, RECORD)


def resolve(found: DataFrame) -> DataFrame:
    """Each record with the size and digest of its full payload: a revisit takes them from the response that it refers to.
    Adds refers_to, the page id of that response as text; null for a response and where the response is missing."""
    response = (found.where("record_type = 'response'").groupBy("record_id")
                .agg(F.max(F.struct("page_id", "payload_bytes", "payload_digest")).alias("response")))
    joined = (found.where("record_type = 'revisit'").join(response.withColumnRenamed("record_id", "refers_to_record"),
                                                          "refers_to_record", "left"))
    revisits = joined.select("record_id", "record_type", "page_id", "url", F.col("response.payload_bytes").alias("payload_bytes"),
                             F.coalesce("response.payload_digest", "payload_digest").alias("payload_digest"),
                             F.col("response.page_id").alias("refers_to"),
                             (F.col("payload_digest") == F.col("response.payload_digest")).alias("intact"))
    return found.where("record_type = 'response'").select(
        "record_id", "record_type", "page_id", "url", "payload_bytes", "payload_digest",
        F.lit(None).cast("string").alias("refers_to"), "intact").union(revisits)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            path: str | None = None, **options) -> DataFrame:
    """Writes the archives (under ``path``, or a scratch path of the session) and reads them back, resolved: the columns
    of ``resolve`` with ids as in the table. See ``write`` for what becomes of nulls and repeated rows."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path, id_col, url_col, payload_col, **options)
    kind = pages.schema[id_col].dataType
    found = resolve(Stage(spark, "warc").table(read(spark, path), "records"))
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
