"""WARC archives: writing pages as records, and reading archives back with segment reassembly.

Writing: a page is a response record whose block is an HTTP message in chunked transfer framing. A block over
SEGMENT_CHARS characters is cut into segments: a first record with segment number 1 and continuation records that name
the first as origin; the last gives the total length. Of pages with equal payloads of LEAST_REVISIT bytes or more only the
one with the smallest id is stored; the others are revisit records that name it and its digest. Files are gzip members
of bounded numbers of records, in the shared folder.

Reading: whole records are decoded where they are parsed. Segments are grouped by origin identifier (only they are
shuffled), ordered by number, checked to be complete and of the stated total length, joined, and decoded. Revisits take
length and digest from the response they name, if its digest is the one they state. What fails a check has a null payload
and says why in defect.

Null html is an empty payload. Pages without id are stored, and never referred to; their equals refer to the smallest id
there is. Repeated rows of the smallest id are responses, all of them. Payloads are whole, however long. Extra columns are
dropped. An empty table gives none. A file that is cut short, damaged or no archive gives what stands before the damage,
and one row of type damaged with the reason in defect.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import new_path, table, written

CHUNK_CHARS = 8_192
SEGMENT_CHARS = 16_384
LEAST_REVISIT = 100
FILE_RECORDS = 2_000  # of at most SEGMENT_CHARS characters each, so a file holds 131 MB at most before compression
BROADCAST_ROWS = 200_000
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
BREAK = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RAW = "record_id string, type string, origin string, segment int, total long, page_id long, refers_to long, stated string, block binary"
READ = "record_id string, type string, page_id long, refers_to long, stated string, payload binary, defect string"


def _record(headers: list[tuple[str, object]], block: str) -> str:
    """A record without its last two line breaks (the file writer puts those)."""
    given = [("WARC-Date", DATE), *[(k, v) for k, v in headers if v is not None], ("Content-Length", len(block.encode()))]
    return "WARC/1.1" + BREAK + "".join(f"{k}: {v}{BREAK}" for k, v in given) + BREAK + block


def chunked(payload: str) -> str:
    parts = [payload[i : i + CHUNK_CHARS] for i in range(0, len(payload), CHUNK_CHARS)]
    return "".join(f"{len(p.encode()):x}{BREAK}{p}{BREAK}" for p in parts) + f"0{BREAK}{BREAK}"


def records_of(page_id: int | None, url: str | None, html: str, digest: str, uid: str, refers_to: int | None) -> list[str]:
    name = f"<urn:uuid:{uid}>"
    said = "".join((url or "").split()) or None
    about = [("WARC-Target-URI", said), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *about, ("WARC-Profile", profile), ("X-Refers-To-Page-ID", refers_to)], "")]
    block = HTTP + "Transfer-Encoding: chunked" + BREAK + BREAK + chunked(html)
    http = ("Content-Type", "application/http; msgtype=response")
    cut = [block[i : i + SEGMENT_CHARS] for i in range(0, len(block), SEGMENT_CHARS)]
    if len(cut) == 1:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *about, http], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *about, http, ("WARC-Segment-Number", 1)], cut[0])]
    for i, part in enumerate(cut[1:], 2):
        total = len(block.encode()) if i == len(cut) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uid}:{i}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)], part))
    return out


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = zip(*[part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "uid", "refers_to")], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([r for row in rows for r in records_of(*row)], pa.string())], names=["value"])


def write_archive(pages: DataFrame, path: str) -> None:
    """pages (page_id, url, html) as *.warc.gz files under path."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    first = written(pages.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1 and first is not null").select("digest", "first"), "first")
    if first.count() <= BROADCAST_ROWS:
        named = pages.join(F.broadcast(first), "digest", "left")
    else:  # salted, for a payload that very many pages share
        spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["digest", "salt"], "left")
    refers_to = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = named.select("page_id", "url", "html", "digest", F.uuid().alias("uid"), refers_to.alias("refers_to"))
    rows.mapInArrow(_format, "value string").write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in store.listStatus(folder):
        if f.getPath().getName().endswith(".txt.gz"):
            store.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f.getPath().getName().replace(".txt.gz", ".warc.gz")))


NUMBERS = ("content-length", "warc-segment-number", "warc-segment-total-length", "x-page-id", "x-refers-to-page-id")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive. Ends with a record of type damaged where one cannot be read; its block says why."""
    at, damaged = 0, {"warc-type": "damaged", "warc-record-id": None}
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        version, *lines = content[at : max(end, at)].decode(errors="replace").split(BREAK)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if end < 0 or not version.startswith("WARC/"):
            yield damaged, f"no WARC record at byte {at}".encode()
            return
        if not all(headers.get(k, "0").isdecimal() or k.startswith("x-") and headers[k].removeprefix("-").isdecimal() for k in NUMBERS) or not {"content-length", "warc-type", "warc-record-id"} <= set(headers):
            yield damaged, f"headers of the record at byte {at} are missing or no numbers".encode()
            return
        size = int(headers["content-length"])
        if end + 4 + size > len(content):
            yield damaged, f"record at byte {at} is cut short".encode()
            return
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def inflated(content: bytes) -> tuple[bytes, str | None]:
    """What the gzip members of a file hold, up to the first damage, and what that is."""
    out = []
    while content:
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(content))
        except zlib.error as e:
            return b"".join(out), f"not gzip: {e}"
        if not member.eof:
            return b"".join(out), "gzip member is cut short"
        content = member.unused_data
    return b"".join(out), None


def dechunked(data: bytes) -> tuple[bytes | None, str | None]:
    """Payload of chunked framing, or None and why."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            return None, "chunk without size"
        said = data[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", said):
            return None, "chunk size is no number"
        size = int(said, 16)
        if size == 0:
            return b"".join(out), None
        part = data[end + 2 : end + 2 + size]
        if len(part) < size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            return None, "chunk is cut short"
        out.append(part)
        at = end + 4 + size


def http_payload(block: bytes) -> tuple[bytes | None, str | None]:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None, "no end of HTTP headers"
    coded = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return dechunked(body) if coded else (body, None)


def assembled(segments: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str | None]:
    """Block of the segments (number, total or None, part) in any order, or None and why."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        return None, "segments missing or repeated"
    block = b"".join(s[2] for s in segments)
    if segments[-1][1] is None:
        return None, "last segment missing"
    return (block, None) if segments[-1][1] == len(block) else (None, "total length differs")


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _stated(headers: dict[str, str]) -> str | None:
    return headers.get("warc-payload-digest", "").removeprefix("sha256:") or None


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _files(batches: Iterator[pa.RecordBatch], segments: bool) -> Iterator[pa.RecordBatch]:
    """The segments of archive files, as they are, or else all whole records, decoded."""
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            raw, broken = inflated(content.as_py())
            for h, block in parse(raw):
                if h["warc-type"] == "damaged":
                    broken = broken or block.decode()
                    break
                if ("warc-segment-number" in h) != segments or h["warc-type"] not in ("response", "revisit", "continuation"):
                    continue
                common = h["warc-record-id"], h["warc-type"]
                about = _number(h.get("x-page-id")), _number(h.get("x-refers-to-page-id")), _stated(h)
                if segments:
                    rows.append((*common, h.get("warc-segment-origin-id", common[0]), int(h["warc-segment-number"]), _number(h.get("warc-segment-total-length")), *about, block))
                else:
                    rows.append((*common, *about, *((None, None) if common[1] == "revisit" else http_payload(block))))
                held += len(block)
                if held > 8 << 20:
                    yield _arrow(rows, RAW if segments else READ)
                    rows, held = [], 0
            if broken and not segments:
                rows.append((None, "damaged", None, None, None, None, broken))
            yield _arrow(rows, RAW if segments else READ)


def _reassemble(rows: pa.Table) -> pa.Table:
    got = rows.to_pylist()
    first = next((r for r in got if r["type"] != "continuation"), None)
    block, defect = assembled([(r["segment"], r["total"], r["block"]) for r in got])
    payload, defect = http_payload(block) if block is not None else (None, defect)
    first = first or {"record_id": got[0]["origin"], "type": "response", "page_id": None, "refers_to": None, "stated": None}
    return pa.Table.from_batches([_arrow([(first["record_id"], first["type"], first["page_id"], first["refers_to"], first["stated"], payload, defect)], READ)])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """record_id, type (response, revisit, damaged), page_id, refers_to, stated (digest), payload (null for revisits), defect: one row for each logical record and each damaged file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    whole = files.mapInArrow(lambda b: _files(b, False), READ)
    segments = files.mapInArrow(lambda b: _files(b, True), RAW)
    return whole.unionByName(segments.groupBy("origin").applyInArrow(_reassemble, READ))


def resolve(records: DataFrame) -> DataFrame:
    """page_id, type, refers_to, payload_bytes, payload_digest, defect of each record; a revisit's from the response that it names."""
    facts = written(records.select("page_id", "type", "refers_to", "stated", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "defect"), "records")
    stored = facts.where("type = 'response'")
    wrong = F.col("payload_digest") != F.col("stated")
    stored_ok = stored.withColumn("defect", F.coalesce("defect", F.when(wrong, F.lit("digest differs"))))
    revisits = facts.where("type = 'revisit'")
    named = revisits.select("refers_to", "stated").distinct().join(stored_ok.where("defect is null").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"), F.col("payload_bytes").alias("bytes")).distinct(), ["refers_to", "stated"])
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = revisits.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["refers_to", "stated", "salt"], "left")
    found = found.select("page_id", "type", "refers_to", F.col("bytes").alias("payload_bytes"), F.when(F.col("bytes").isNotNull(), F.col("stated")).alias("payload_digest"), F.when(F.col("bytes").isNull(), F.lit("no such response")).alias("defect"))
    return stored_ok.select("page_id", "type", "refers_to", "payload_bytes", "payload_digest", "defect").unionByName(found)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    out = resolve(read_archive(spark, path))
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "defect")


OP8_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages
), f as (
  select *, case when n >= 100 then min(page_id) over (partition by d) end as first from p
)
select page_id, n::bigint as payload_bytes, d as payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to, null::varchar as defect
from f
"""
