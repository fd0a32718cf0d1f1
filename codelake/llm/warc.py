"""WARC archives: writing pages, reading archives, reassembling segmented records.

Writing: each page is one record in chunked transfer framing. A block longer than a segment is cut
into a first record and continuation records with the identifier of the first one, their number,
and, in the last, the total length. Of pages with equal payloads of at least 100 bytes only the one
with the smallest id is stored, the others are revisit records that refer to it. Files are written
by Spark's text writer with the record separator as line separator, so executors need no file
system of their own, and hold a bounded number of records each.

Reading: one task parses one file at a time. Records without a segment number pass straight
through; the others are grouped by origin identifier, ordered by number, checked against the total
length, joined, and their chunked framing is decoded. A broken group gives a row with complete =
false and what could be read of it.

Edge cases: null markup is an empty payload; a null address is left out of the record; control
characters of an address are percent-encoded. A null id is larger than any other. Rows with the same
id, address and payload are stored as often as they occur. An empty table gives no files and an
empty result. Very long pages are many segments; one page at a time is in memory.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import rows_of, ship, stored, table, text_bytes
from codelake.session import new_folder

ship(__name__)

SEGMENT = 32 << 10  # bytes of a record block
RECORDS = 2000  # in a file
CHUNK = 8 << 10  # bytes of a transfer chunk
LEAST = 100  # bytes of a payload that may be revisited
DATE = "2024-01-01T00:00:00Z"
GAP = b"\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for start in range(0, len(payload), size):
        part = payload[start:start + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0" + GAP


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The payload of a chunked body, and whether the framing was whole."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return b"".join(out), False
        n = int(size, 16)
        if n == 0:
            return b"".join(out), True
        out.append(body[end + 2:end + 2 + n])
        at = end + 4 + n
        if len(out[-1]) < n or body[at - 2:at] != b"\r\n":
            return b"".join(out), False


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    name = "|".join(["" if page_id is None else str(page_id), url or "", digest])
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16])}>"


def safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(head)).encode() + GAP + block


def records_of(page: dict, segment: int) -> Iterator[bytes]:
    """The records of one page, without the separator that follows each."""
    own = record_id(page["page_id"], page["url"], page["digest"])
    revisit = page["first"] is not None
    shared = [("WARC-Date", DATE), ("X-Page-Id", page["page_id"]),
              ("WARC-Target-URI", safe(page["url"]) if page["url"] else None)]
    mime = ("Content-Type", "application/http; msgtype=response")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), *shared, mime,
            ("WARC-Payload-Digest", f"sha256:{page['digest']}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        first = page["first"]
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", record_id(first["page_id"], first["url"], page["digest"])),
                 ("X-Refers-To-Page-Id", first["page_id"])]
        yield record(head, http + b"\r\n")
        return
    block = http + b"Transfer-Encoding: chunked" + GAP + chunked(page["payload"])
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record(head, block)
        return
    yield record([*head, ("WARC-Segment-Number", 1)], parts[0])
    for number, part in enumerate(parts[1:], 2):
        last = number == len(parts)
        name = hashlib.sha256(f"{own}{number}".encode()).digest()[:16]
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=name)}>"),
                      *shared, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number),
                      ("WARC-Segment-Total-Length", len(block) if last else None)], part)


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT, per_file: int = RECORDS) -> None:
    """Write pages (page_id, url, html) as gzipped archives into a folder."""
    payload = text_bytes("html")
    slim = stored(pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"),
                               F.octet_length(payload).alias("n")), "page-digests")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    groups = stored(slim.where(F.col("n") >= LEAST).groupBy(F.col("digest").alias("same"))
                    .agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"))
                    .where("copies > 1").drop("copies"), "page-copies")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    found = F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    rows = (rows.join(groups, F.col("digest") == F.col("same"), "left")
            .withColumn("first", found).drop("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(records_of(page, segment)), pa.binary())], names=["value"])

    (rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.DOTALL)
FIELDS = {"type": "warc-type", "id": "warc-record-id", "origin": "warc-segment-origin-id",
          "number": "warc-segment-number", "total": "warc-segment-total-length",
          "digest": "warc-payload-digest", "refers": "warc-refers-to", "page": "x-page-id",
          "refers_page": "x-refers-to-page-id", "url": "warc-target-uri"}


def parsed(content: bytes) -> Iterator[dict]:
    """Records of one archive, gzipped as a whole or record by record, or plain."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while found := HEAD.match(data, at):
        fields = {}
        for line in found[1].split(b"\r\n"):
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        n = int(fields.get("content-length", 0))
        out = {k: fields.get(v) for k, v in FIELDS.items()}
        out["block"] = data[found.end():found.end() + n]
        yield out
        at = found.end() + n + len(GAP)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives of a folder, in no order: the values of FIELDS as text, and block."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = ", ".join(f"`{k}` string" for k in FIELDS) + ", block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for one in parsed(content.as_py()):
                    held.append(one)
                    size += len(one["block"])
                    if size > 4 << 20:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    return files.mapInArrow(run, schema)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(pa.array([r[k] for r in rows], pa.string()) for k in FIELDS),
         pa.array([r["block"] for r in rows], pa.binary())], names=[*FIELDS, "block"])


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit record: type, id, page, refers, refers_page, digest, url, payload
    and complete. Only segments are shuffled."""
    number = F.col("number").cast("int")
    alone = records.where("number IS NULL AND type <> 'continuation'").select(
        *FIELDS, F.array("block").alias("blocks"), F.octet_length("block").cast("long").alias("length"),
        F.lit(1).alias("copies"), F.lit(True).alias("whole"))
    parts = records.where("number IS NOT NULL OR type = 'continuation'").select(
        F.coalesce("origin", "id").alias("of"), number.alias("number"), F.col("total").cast("long").alias("total"),
        F.struct(*FIELDS).alias("fields"), "block")
    # Equal segments of repeated pages are told apart by their number of copies.
    groups = parts.groupBy("of", "number").agg(
        F.count(F.lit(1)).alias("copies"), F.max("total").alias("total"), F.first("fields").alias("fields"),
        F.first("block").alias("block"))
    joined = groups.groupBy("of").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("length"), F.max("number").alias("last"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("number") == 1, F.col("copies"))).alias("copies"),
        F.first(F.when(F.col("number") == 1, F.col("fields")), ignorenulls=True).alias("fields"))
    whole = joined.select(
        "fields.*", F.transform("parts", lambda x: x["block"]).alias("blocks"), F.col("length"),
        F.coalesce("copies", F.lit(1)).cast("int").alias("copies"),
        ((F.col("n") == F.col("last")) & F.col("copies").isNotNull()).alias("whole"))
    rows = alone.unionByName(whole.select(alone.columns))
    keep = ["type", "id", "page", "refers", "refers_page", "digest", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, whole = [], []
            for blocks, total, ok in zip(*(rows_of(batch, c) for c in ("blocks", "length", "whole")), strict=True):
                block = b"".join(x for x in blocks if x)
                head, gap, body = block.partition(GAP)
                fine = bool(gap) and len(block) == total
                if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head):
                    body, fine = unchunked(body)
                payloads.append(body)
                whole.append(bool(ok and fine))
            columns = [batch.column(batch.schema.get_field_index(k)) for k in (*keep, "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(payloads, pa.binary()), pa.array(whole)],
                                             names=[*keep, "copies", "payload", "complete"])

    schema = ", ".join(f"`{k}` string" for k in keep) + ", copies int, payload binary, complete boolean"
    out = rows.mapInArrow(run, schema)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def round_trip(pages: DataFrame, folder: str, segment: int = SEGMENT) -> DataFrame:
    """Write pages, read the archives back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, complete. Payloads of revisits are looked up in the records they refer to."""
    spark = pages.sparkSession
    write_warc(pages, folder, segment)
    read = reassemble(read_warc(spark, folder))
    facts = stored(read.select(
        "type", "id", F.col("page").cast("long").alias("page_id"), "refers",
        F.col("refers_page").cast("long").alias("refers_to"), "complete",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "digest"), "records")
    checked = F.col("complete") & (F.concat(F.lit("sha256:"), "payload_digest") == F.col("digest"))
    response = facts.where("type = 'response'").withColumn("complete", checked)
    first = (response.groupBy(F.col("id").alias("first_id")).agg(
        F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("sha"),
        F.first("complete").alias("ok")))
    revisit = (facts.where("type = 'revisit'").drop("payload_bytes", "payload_digest")
               .join(first, F.col("refers") == F.col("first_id"), "left")
               .withColumnsRenamed({"bytes": "payload_bytes", "sha": "payload_digest"})
               .withColumn("complete", F.coalesce("ok", F.lit(False)) & checked))
    return response.unionByName(revisit.select(response.columns)).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "complete")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))


QUERIES = {"op9_warc": op9_warc}
SQL = {"op9_warc": """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER same
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER same
            THEN min(page_id) OVER same END AS refers_to, true AS complete
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))"""}
