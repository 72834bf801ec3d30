"""Web archives: pages to WARC files and back, with segmented records reassembled.

Writing. Every page is one record: a response with the page in chunked transfer framing, or, if a page of at least
`LEAST` bytes has an equal payload and comes first in the order, a revisit that refers to it. Blocks of over `SEGMENT`
bytes are split into continuation records, which may lie anywhere in the archive. Files hold `FILE_RECORDS` records at
most, so that their size is bounded, and are written by Spark's text writer as one gzip stream each (a record's last
line end is the writer's line separator).

Reading. Files are streamed record by record. Segments are grouped by the identifier of their origin, ordered by their
number, and joined; a record counts as whole only if no number is missing or doubled and its length is the total that
the last segment states. Chunked framing is then decoded.

Defined results: a null page is an empty payload; null urls and ids are left out of the header and come back as null; of
repeated rows with equal ids one is the response; records that are not whole come back with status `broken` and no
payload; an empty table gives an archive without records; other columns of pages are not read. A page of any length is
written and joined in one task; a reading task holds one record and about 4 MB more.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, discard, materialise, numbered, setting, shared_dir

LEAST = 1000
SEGMENT = 64 * 1024
CHUNK = 8 * 1024
FILE_RECORDS = 2000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(key))}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        if size == 0:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    # the second line end after the block is written between records
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n"


def page_records(key, page_id, url, payload: bytes, refers_to, segment: int) -> list[bytes]:
    """The records of one page: one, or as many as there are segments."""
    rid, digest = record_uri(key), "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-Id", page_id), ("WARC-Payload-Digest", digest)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, ("WARC-Refers-To", record_uri(refers_to)), ("WARC-Profile", PROFILE), ("Content-Type", "application/http;msgtype=response")], http)]
    block = http + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if len(parts) > 1 else None)]
    out = [_record(first, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_uri(f"{key}-{n}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part))
    return out


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, segment: int = SEGMENT, file_records: int = FILE_RECORDS) -> None:
    """Writes one record per row of pages into new files under path."""
    # rows are numbered once, and the numbers are stored with the payloads: records refer to each other by them
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = numbered(rows, "warc-pages", "key")
    # Only payloads that occur again need a record to refer to. They are found without the payloads, which are then
    # dealt by row, so that a page with many copies fills no task.
    sized = rows.where(F.octet_length("payload") >= least).select("key", "page_id", F.sha1("payload").alias("digest"))
    first = sized.groupBy("digest").agg(F.max(F.struct("page_id", "key")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.key").alias("refers_to"))
    first = materialise(first, "warc-first")
    again = materialise(sized.join(first, "digest").where("refers_to <> key").select("key", "refers_to"), "warc-again")
    discard(first)
    placed = rows.join(again, "key", "left")

    def make(key: pa.Array, page_id: pa.Array, url: pa.Array, payload: pa.Array, refers_to: pa.Array) -> pa.Array:
        return pa.array([page_records(*x, segment) for x in zip(key.to_pylist(), page_id.to_pylist(), url.to_pylist(), payload.to_pylist(), refers_to.to_pylist(), strict=True)], pa.list_(pa.binary()))

    records = F.arrow_udf(make, "array<binary>")("key", "page_id", "url", "payload", "refers_to")
    lines = placed.select(F.explode(records).alias("value")).select(F.col("value").cast("string"))
    with setting(pages.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS)):
        lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)
    discard(again)
    discard(rows)


def parse(stream) -> list[tuple[dict[str, str], bytes]]:
    """Records of a binary stream, one after the other: (fields in lower case, block)."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def payload_of(block: bytes) -> bytes | None:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


_FIELDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("payload", pa.binary())])
_DDL = "record_id string, record_type string, page_id string, url string, refers_to string, digest string, origin string, segment long, total long, block binary, payload binary"
_BYTES = 4 << 20


def _parse_files(batches):
    for batch in batches:
        for content in batch.column("content"):
            raw = io.BytesIO(memoryview(content.as_buffer()))
            rows, held = [], 0
            for f, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=raw))):
                number = f.get("warc-segment-number")
                whole = number is None
                digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                rows.append({
                    "record_id": f["warc-record-id"], "record_type": f["warc-type"], "page_id": f.get("x-page-id"), "url": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to"), "digest": base64.b32decode(digest).hex() if digest else None,
                    "origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "segment": int(number) if number else None, "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                    "block": None if whole else block, "payload": payload_of(block) if whole and f["warc-type"] != "revisit" else None,
                })
                held += len(block)
                if held > _BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


def read_archive(spark, path: str) -> DataFrame:
    """One row per record that is no continuation: (record_id, record_type, page_id, url, refers_to, digest, status, payload).

    A revisit has no payload of its own; status is `whole`, `broken` or, for revisits, `revisit`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    # one file at a time in each task
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
        records = materialise(files.mapInArrow(_parse_files, _DDL), "warc-records")
    named = ["record_id", "record_type", "page_id", "url", "refers_to", "digest"]
    single = records.where("segment is null").select(*named, F.when(F.col("record_type") == "revisit", "revisit").when(F.col("payload").isNull(), "broken").otherwise("whole").alias("status"), "payload")
    # A group is one record, so its size is bounded by the largest record.
    parts = records.where("segment is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.when(F.col("segment") == 1, F.struct(*named))).alias("first"),
    )
    in_order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    blocks = F.when(in_order & (length == F.col("total")), F.transform("parts", lambda p: p["block"]))

    def decode(blocks: pa.Array) -> pa.Array:
        # segments are joined at once: one after the other they would be copied as often as there are segments
        return pa.array([None if b is None else payload_of(b"".join(b)) for b in blocks.to_pylist()], pa.binary())

    parts = parts.withColumn("blocks", blocks).withColumn("payload", F.arrow_udf(decode, "binary")("blocks")).withColumn("first", F.coalesce("first", F.struct(F.col("origin").alias("record_id"), F.lit("response").alias("record_type"), *[F.lit(None).cast("string").alias(c) for c in named[2:]])))
    return single.union(parts.select("first.*", F.when(F.col("payload").isNull(), "broken").otherwise("whole").alias("status"), "payload"))


def described(records: DataFrame) -> DataFrame:
    """Records with the length and digest of the full payload, revisits through the record that they refer to."""
    own = materialise(records.select("record_id", "record_type", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")), "warc-described")
    # only revisits look for another record, so that the others do not meet in the task of nulls
    named = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    base = own.where("record_type = 'response'").select(F.col("record_id").alias("base"), F.col("page_id").alias("base_page"), F.col("payload_bytes").alias("base_bytes"), F.col("payload_digest").alias("base_digest"))
    revisits = own.where("refers_to is not null").join(base, F.col("refers_to") == F.col("base"), "left")
    revisits = revisits.select("page_id", F.coalesce("payload_bytes", "base_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "base_digest").alias("payload_digest"), "record_type", F.col("base_page").alias("refers_to"))
    return revisits.union(own.where("refers_to is null").select(*named, F.lit(None).cast("string").alias("refers_to")))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    out = described(read_archive(spark, path))
    return out.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
        max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to FROM q
"""
