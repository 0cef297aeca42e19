"""WARC archives: writing with segments and revisits, and reading with segment reassembly.

Writing: a record per page. Of the records whose payloads are equal, that of the largest id is the response and the others revisit
it; a response's block is an HTTP message with the payload in chunked transfer framing. A block over ``SEGMENT`` bytes is cut into
segments: the first stays a response, the others are continuation records that name the first by WARC-Segment-Origin-ID, and the last
one carries WARC-Segment-Total-Length. Every record is a gzip member of its own. Spark's text writer puts the members into files one
after the other, so archives go wherever Spark writes: a member under 16 MiB ends in a zero byte (the top of its length), which the
writer adds as its line separator.

Reading: each archive is cut into records by their lengths. Whole records are decoded where they are read. Only segments are shuffled:
they are grouped by their origin, ordered by segment number, joined, and checked against the total length and for gaps. Then the chunked
framing is decoded and the payload held against its digest.

Keys of very many rows (an empty payload that most pages share) are joined by a broadcast (see ``joined_by_key``).

Defined cases: a null payload is an empty one; a null id loses to any other and revisits it (a group of null ids only is responses);
repeated rows of the winning id are all responses; a null URL is an empty one; one with white space, control characters or more than
``LINE`` bytes stands in a header of its own in base64, one over ``LONG_URL`` bytes is named by its SHA-1; a payload of any length is cut into segments;
missing, surplus or damaged segments raise an error; an empty table gives empty archives, which read as no rows; other columns are not
read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Workspace, joined_by_key

SEGMENT = 1 << 20
CHUNK = 1 << 16
#: Bytes of compressed records that are written at once, and in one archive.
BUNDLE, ARCHIVE = 4 << 20, 32 << 20
#: Most bytes of a URL in its plain header, and in any; bytes that are inflated at once.
LINE, LONG_URL, STEP = 1 << 13, 4 << 20, 1 << 16
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload in chunked transfer framing; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body ends early")
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk has another length than it says")
        parts.append(part)
        at = end + 4 + n


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member; its last byte, the top of the record's length, is zero."""
    if len(raw) >= 1 << 24:
        raise ValueError("a record must be shorter than 16 MiB")
    return gzip.compress(raw, 1, mtime=0)


def url_fields(url: str) -> list[tuple[str, str]]:
    """The headers that hold a URL as it is."""
    raw = url.encode()
    if len(raw) > LONG_URL:
        return [("WARC-Target-URI", f"urn:sha1:{base32_sha1(raw)}")]
    plain = "".join(url.split())
    if plain == url and url.isprintable() and len(raw) <= LINE:
        return [("WARC-Target-URI", url)]
    return [("WARC-Target-URI", f"urn:sha1:{base32_sha1(raw)}"), ("X-Target-URI-Base64", base64.b64encode(raw).decode())]


def page_records(page_id: int | None, url: str, payload: bytes, winner: int | None, serial: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page; ``winner`` is the id that it revisits, or None."""
    name = uuid.UUID(bytes=hashlib.md5(f"{serial}/{page_id}".encode()).digest())
    own, digest = f"<urn:uuid:{name}>", f"sha1:{base32_sha1(payload)}"
    fields = [("WARC-Date", _DATE), *url_fields(url), ("WARC-Payload-Digest", digest), *([("X-Page-ID", str(page_id))] if page_id is not None else [])]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if winner is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *fields, ("WARC-Profile", _PROFILE), ("X-Refers-To-Page-ID", str(winner)), kind], head)
        return
    block = head + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *fields, kind], block)
        return
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *fields, ("WARC-Segment-Number", "1"), kind], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(name, str(k))}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), *total], part)


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT, space: Workspace | None = None) -> None:
    """Writes archives of ``ARCHIVE`` bytes and a few records at most to the folder ``path``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    space = space or Workspace(pages.sparkSession, "warc")
    digests = space.table(rows.select("page_id", F.sha1("payload").alias("digest")), "digests")
    groups = digests.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null")
    # Only the losers of equal payloads: a page that isn't here is a response. The payloads are shuffled once, by id, and not sorted.
    losers = joined_by_key(digests, groups, ["digest"], "n", digests.count()).where("page_id is null or page_id <> winner").groupBy("page_id", "digest").agg(F.max("winner").alias("winner"))
    marked = rows.withColumn("digest", F.sha1("payload")).join(losers.withColumnRenamed("page_id", "loser").withColumnRenamed("digest", "d").hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("loser")) & (F.col("digest") == F.col("d")), "left")
    lean = marked.select("page_id", "url", "winner", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page_id, url, winner, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at += 1
                for raw in page_records(page_id, url, payload, winner, f"{path}/{task}/{at}", segment):
                    out.append(member(raw))
                    size += len(out[-1])
                    if size > BUNDLE:
                        yield bundle(out)
                        out, size = [], 0
            if out:
                yield bundle(out)

    def bundle(out: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["value"])

    members = lean.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", ARCHIVE // BUNDLE).text(path)


def members_of(raw: bytes) -> Iterator[bytes]:
    """The records of one archive; what follows a record is never copied further than ``STEP`` bytes."""
    view, at = memoryview(raw), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + STEP]
            if not len(piece):
                raise ValueError("an archive ends inside a record")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, cut, rest = raw.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a record has another length than it says")
    return fields, rest[:n]


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def read_archives(spark: SparkSession, path: str, *, keep_payload: bool = True, space: Workspace | None = None) -> DataFrame:
    """Rows (record_id, page_id, url, record_type, refers_to, payload_digest, payload_bytes[, payload]) of the archives in a folder.

    The records are parsed once and written to the workspace; revisits have no length yet (see ``with_revisits``).
    """

    def verified(payload: bytes, stated: str | None) -> tuple[int, str]:
        digest = base32_sha1(payload)
        if stated is not None and stated != f"sha1:{digest}":
            raise ValueError(f"payload digest {digest}, stated {stated}")
        return len(payload), digest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("segment", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for raw in members_of(content.as_buffer()):
                    f, block = parsed(raw)
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    url = base64.b64decode(f["X-Target-URI-Base64"]).decode() if "X-Target-URI-Base64" in f else f.get("WARC-Target-URI")
                    meta = (f["WARC-Record-ID"], number("X-Page-ID"), url, f["WARC-Type"], number("X-Refers-To-Page-ID"))
                    stated = f.get("WARC-Payload-Digest")
                    if "WARC-Segment-Number" in f:
                        rows.append((*meta, stated, None, None, f.get("WARC-Segment-Origin-ID", meta[0]), int(f["WARC-Segment-Number"]), number("WARC-Segment-Total-Length"), block))
                    elif f["WARC-Type"] == "revisit":
                        rows.append((*meta, stated.removeprefix("sha1:"), None, None, None, None, None, None))
                    else:
                        payload = http_payload(block)
                        n, digest = verified(payload, stated)
                        rows.append((*meta, digest, n, payload if keep_payload else None, None, None, None, None))
                    held += len(block)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)

    def joined(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["number"])
        first, last = parts[0], parts[-1]
        if [r["number"] for r in parts] != list(range(1, len(parts) + 1)):
            raise ValueError(f"segments of {first['origin']} are missing or repeated")
        block = b"".join(r["segment"] for r in parts)
        if last["total"] != len(block):
            raise ValueError(f"{first['origin']} has {len(block)} bytes, stated {last['total']}")
        payload = http_payload(block)
        n, digest = verified(payload, first["payload_digest"])
        out = {k: [first[k]] for k in ("record_id", "page_id", "url", "record_type", "refers_to")}
        return pa.table(out | {"payload_digest": [digest], "payload_bytes": [n], "payload": [payload if keep_payload else None]}, schema=pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]))

    whole = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    files = spark.read.format("binaryFile").load(path).select("content")
    space = space or Workspace(spark, "warc")
    records = space.table(files.mapInArrow(cut, f"{whole}, origin string, number int, total long, segment binary"), "records")
    names = [c.split()[0] for c in whole.split(", ")]
    done = records.where("origin is null").select(*names)
    together = records.where("origin is not null").groupBy("origin").applyInArrow(joined, whole)
    found = done.unionByName(together)
    return found if keep_payload else found.drop("payload")


def with_revisits(records: DataFrame, space: Workspace | None = None) -> DataFrame:
    """``records`` whose revisits have the payload length of the page that they refer to, if a response of that page has the same digest."""
    space = space or Workspace(records.sparkSession, "warc")
    keys = ["__page", "__digest"]
    slim = space.table(records.drop("payload"), "slim")
    first = slim.where("record_type = 'response'").groupBy(F.col("page_id").alias(keys[0]), F.col("payload_digest").alias(keys[1])).agg(F.max("payload_bytes").alias("__bytes"))
    again = slim.where("record_type = 'revisit' and refers_to is not null and payload_digest is not null").withColumns({keys[0]: F.col("refers_to"), keys[1]: F.col("payload_digest")})
    groups = space.table(again.groupBy(*keys).agg(F.count("*").alias("__n")).join(first, keys, "left"), "revisited")
    told = joined_by_key(again, groups, keys, "__n", slim.count()).withColumn("payload_bytes", F.col("__bytes")).select(*slim.columns)
    rest = (records if "payload" in records.columns else slim).where("not (record_type = 'revisit' and refers_to is not null and payload_digest is not null)")
    return rest.unionByName(told, allowMissingColumns=True)
