"""WARC archives: writing, reading, and assembly of transactions.

`write_archives` gives each page a request, a response (or a revisit of an equal earlier-written payload) and a
metadata record, packs records into segments and writes each as one gzipped file of the shared folder through
Spark's text writer, whose line separator is the blank lines that end a WARC record. `read_records` parses such
files (or any WARC files of bounded size) by Content-Length. `transactions` brings the records of a capture
together through WARC-Concurrent-To: one nested row per capture, one shuffle.

Defined cases: a null payload is empty; of equal payloads of at least MIN_REVISIT bytes the row with the largest
page_id is the response (all rows with that id, if it repeats), the rest revisit it; rows with a null page_id
refer to the largest id and are responses if there is none; a null url gives no target; an empty table gives no
archives and no rows; extra columns are ignored. A single record must fit a worker's memory; segments beyond
SEGMENT bytes hold one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, python_batches, table

MIN_REVISIT = 1000
SEGMENT = 4 << 20
SALTS = 16
BREAK = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "warc_type string, record_id string, concurrent_to string, target_uri string, refers_to string, content_type string, "
    "payload_digest string, payload_bytes long, payload binary, fields map<string,string>"
)


def to_header(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def from_header(value: str) -> str:
    return base64.b32decode(value.removeprefix("sha1:")).hex()


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {' '.join(v.splitlines())}" for k, v in headers if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + BREAK + block


def capture(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, serial: str) -> list[bytes]:
    """The three records of one page, without the blank lines that end a record."""
    request, target = f"<urn:capture:{page_id}:{serial}>", ("WARC-Target-URI", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = [("WARC-Record-ID", f"<urn:page:{page_id}:response>"), target, ("WARC-Concurrent-To", request), ("WARC-Payload-Digest", to_header(digest)), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}:response>")]
    fields = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {len(payload)}\r\n".encode()
    return [
        record("request", [("WARC-Record-ID", request), target, ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n"),
        record("revisit" if revisit else "response", own, http if revisit else http + payload),
        record("metadata", [("WARC-Record-ID", f"<urn:meta:{page_id}:{serial}>"), target, ("WARC-Concurrent-To", request), ("Content-Type", "application/warc-fields")], fields),
    ]


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and the page that the row revisits (null: it is a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    shared = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = rows.join(shared.hint("shuffle_hash"), ["digest", "size", "salt"], "left")
    revisited = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", revisited.alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    python_batches(pages.sparkSession, 256)

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0
        segment = lambda: pa.RecordBatch.from_arrays([pa.array([BREAK.join(held)], pa.binary())], names=["value"])
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                made = capture(page_id.as_py(), url.as_py(), payload.as_py().encode(), digest.as_py(), refers_to.as_py(), refers_to.is_valid, f"{part}-{serial}")
                serial += 1
                if held and size + sum(map(len, made)) > SEGMENT:
                    yield segment()
                    held, size = [], 0
                held += made
                size += sum(map(len, made))
        if held:
            yield segment()

    segments = planned(pages).mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    segments.write.option("lineSep", BREAK.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse(data: bytes, with_payload: bool = True) -> Iterator[tuple]:
    """The records of one WARC file, gzipped or not; a payload that doesn't have its digest raises."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(BREAK, start)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[start:end].decode().split("\r\n")[1:])}
        size = int(headers["content-length"])
        block, at = data[end + 4 : end + 4 + size], end + 4 + size
        if len(block) < size:
            raise ValueError("a WARC record is cut short")
        kind, payload, fields = headers["warc-type"], None, None
        digest = headers.get("warc-payload-digest")
        digest = digest and from_header(digest)
        if kind == "response":
            payload = block.partition(BREAK)[2]
            found = hashlib.sha1(payload).hexdigest()
            if digest and digest != found:
                raise ValueError(f"{headers['warc-record-id']}: the payload has another digest")
            digest = found
        elif kind == "metadata":
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)]
        yield (kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"),
               headers.get("content-type"), digest, None if payload is None else len(payload), payload if with_payload else None, fields)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    python_batches(spark, 8)

    def work(batches):
        import pyarrow as pa

        types = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                for some in sliced(parse(content.as_py(), with_payload)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(work, RECORD)


def sliced(rows: Iterator[tuple], size: int = 2 << 20) -> Iterator[list[tuple]]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 200 + len(row[8] or b"")
        if total > size:
            yield held
            held, total = [], 0
    if held:
        yield held


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, request, response (a response or revisit record) and its metadata records.

    Records without a WARC-Concurrent-To are captures of their own, keyed by their record id.
    """
    key = F.coalesce("concurrent_to", "record_id")
    whole = F.struct(*[c for c in records.columns])
    one = lambda kinds: F.max_by(F.when(F.col("warc_type").isin(*kinds), whole), F.when(F.col("warc_type").isin(*kinds), F.col("record_id")))
    return records.groupBy(key.alias("capture_id")).agg(
        one(["request"]).alias("request"), one(["response", "revisit"]).alias("response"),
        F.collect_list(F.when(F.col("warc_type") == "metadata", F.struct("record_id", "fields"))).alias("metadata"))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    t = transactions(read_records(spark, path, with_payload=False))
    field = lambda k: F.element_at(F.col("metadata")[0]["fields"], k)
    return t.select(
        F.nullif(field("page-id"), F.lit("")).cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", field("payload-bytes").cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.warc_type").alias("record_type"),
        F.regexp_extract("response.refers_to", r"^<urn:page:(-?\d+):response>$", 1).try_cast("long").alias("refers_to"))


SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest, max(page_id) OVER (PARTITION BY t) AS last
      FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))
"""
