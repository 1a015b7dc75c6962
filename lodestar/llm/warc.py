"""WARC archives: writing pages as records, reading them back and reassembling segmented records.

Archives are gzip members, one a record, kept as a table (archive, data) in a folder that all executors share: Spark's
committed files survive lost executors and any file system that Spark writes to will do.  A payload is an HTTP response
body; longer ones are sent in chunked transfer framing, and a record whose block exceeds ``SEGMENT`` bytes is cut into
the record itself and continuation records.

Reading groups the continuation records by the identifier of their origin, orders them by segment number, verifies the
total length, and then decodes the chunked framing.  Records that are whole are done where they are read; only segments
are dealt out, by origin, so a page's bytes are all that ever meets in one place.

Of records with equal payloads of at least ``least`` bytes that with the smallest page id is the response and the others
revisit it.  Equal payloads are found by an aggregation over digests and one join on them; both leave a digest that a
third of all pages share spread over tasks.

Defined results: urls come back as they were, in whatever signs; a null payload is an empty one; a null id is never the smallest, and a payload none of whose records
has an id is a response each time; rows that repeat an id and a payload are alike; an empty table gives no records; extra
columns of the input are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, fresh_path, named, small_batches

#: Bytes of a record's block beyond which it is cut into segments, and of a payload from which it is sent in chunks.
SEGMENT = 4 * 1024
CHUNKED = 2 * 1024
CHUNK = 1024
#: Compressed bytes that are read at once; what lies behind a member is read again for the next.
FEED = 4096
#: Bytes of records that make an archive, about.
ARCHIVE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = b"\r\n"
#: Signs of a url that are written as they are; others, white space and the percent sign among them, are percent-encoded.
URI_SIGNS = "!#$&'()*+,/:;=?@[]~"


def digest_of(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object, url: str | None, digest: str, segment: int = 1) -> str:
    """Identifier of the record of a page at a url with a payload of that digest, or of one of its continuations."""
    made = hashlib.md5(f"{page}/{url!r}/{digest}/{segment}".encode()).hexdigest()
    return f"<urn:uuid:{made[:8]}-{made[8:12]}-{made[12:16]}-{made[16:20]}-{made[20:]}>"


def to_chunks(body: bytes, size: int = CHUNK) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def from_chunks(framed: bytes) -> bytes:
    """Body of a chunked transfer; extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = framed.index(LINE, at)
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if len(framed) < at + size + 2:
            raise ValueError("a chunk is shorter than its size says")
        out.append(framed[at : at + size])
        at += size + 2


def record(headers: dict[str, object], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers.items()), b"Content-Length: %d" % len(block)]
    return LINE.join(lines) + LINE * 2 + block + LINE * 2


def records_of(
    page: object, url: str | None, payload: bytes, kind: str, refers_to: object, refers_url: str | None = None, segment: int = SEGMENT
) -> list[bytes]:
    """The records of a page: one, or more if its block is cut."""
    digest = digest_of(payload)
    headers = {"WARC-Type": kind, "WARC-Record-ID": record_id(page, url, digest), "WARC-Date": DATE}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe=URI_SIGNS)
    headers |= {"Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    headers |= {} if page is None else {"WARC-Page-ID": page}
    if kind == "revisit":
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, refers_url, digest), "WARC-Refers-To-Page-ID": refers_to}
        return [record(headers, b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload))]
    if len(payload) >= CHUNKED:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + to_chunks(payload)
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    if len(block) <= segment:
        return [record(headers, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record(headers | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(page, url, digest, n), "WARC-Date": DATE}
        more |= {"WARC-Segment-Origin-ID": headers["WARC-Record-ID"], "WARC-Segment-Number": n}
        if n == len(parts):
            more["WARC-Segment-Total-Length"] = len(block)
        out.append(record(more, part))
    return out


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of an archive of gzip members, or of plain records."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            one, parts = zlib.decompressobj(31), []
            while not one.eof:
                parts.append(one.decompress(data[at : at + FEED]))
                if at >= len(data) and not one.eof:
                    raise ValueError("an archive ends within a member")
                at = min(len(data), at + FEED)
            at -= len(one.unused_data)
            plain = b"".join(parts)
        else:
            plain, at = data[at:], len(data)
        while plain.strip():
            plain = plain.lstrip(LINE)
            end = plain.index(LINE * 2)
            first, *lines = plain[:end].decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("no WARC record here")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            size = int(headers["content-length"])
            block = plain[end + 4 : end + 4 + size]
            if len(block) != size:
                raise ValueError("a record is shorter than its length says")
            yield headers, block
            plain = plain[end + 4 + size :]


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """(HTTP headers, decoded body) of a response block."""
    end = block.index(LINE * 2)
    lines = block[:end].decode("latin-1").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    body = block[end + 4 :]
    return headers, from_chunks(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


def reassemble(parts: Iterable[tuple[int, int | None, bytes]]) -> bytes:
    """Block of a segmented record from (segment number, total length if the last, bytes) in the order of segments.

    Segments that come again, as those of repeated rows do, have to be equal.
    """
    block, total = [], None
    for number, said, data in parts:
        if number == len(block) and block[-1] == data:
            continue
        if number != len(block) + 1:
            raise ValueError(f"segment {len(block) + 1} is missing, or segment {number} has two contents")
        block.append(data)
        total = said if said is not None else total
    whole = b"".join(block)
    if total is None or len(whole) != total:
        raise ValueError("the segments are not as long as the last one says")
    return whole


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> DataFrame:
    """(id, url, payload, kind, refers_to, refers_url) of every row."""
    payload = F.coalesce(named(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(named(id_col).alias("id"), named(url_col).cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha1("payload")
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, digest))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first")
    first = rows.where("digest is not null").groupBy(F.col("digest").alias("d")).agg(first, F.count("*").alias("n"))
    # Only payloads that several rows have need the join; one that stands alone is a response.  Written, they have a known
    # size: Spark broadcasts them if they are small, and no page is dealt by its digest then.
    repeated = cut(first.where("n > 1").select("d", "first"), "repeated")
    joined = rows.join(repeated, F.col("digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    kind = F.when(again, "revisit").otherwise("response")
    return joined.select("id", "url", "payload", kind.alias("kind"), F.when(again, F.col("first.id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url"))


def write_archives(planned: DataFrame, path: str, archive: int = ARCHIVE, segment: int = SEGMENT) -> DataFrame:
    """The archives of planned records, as the table (archive, data) at path."""
    small_batches(planned.sparkSession)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size, members = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for page, url, payload, kind, refers, refers_url in zip(*[c.to_pylist() for c in batch.columns]):
                for one in records_of(page, url, payload, kind, refers, refers_url, segment):
                    members.append(gzip.compress(one, 1, mtime=0))
                    size += len(members[-1])
                if size >= archive:
                    yield pa.RecordBatch.from_pydict({"archive": [f"part-{part:05}-{n:05}.warc.gz"], "data": [b"".join(members)]})
                    n, size, members = n + 1, 0, []
        if members:
            yield pa.RecordBatch.from_pydict({"archive": [f"part-{part:05}-{n:05}.warc.gz"], "data": [b"".join(members)]})

    planned.mapInArrow(written, "archive string, data binary").write.parquet(path)
    return planned.sparkSession.read.schema("archive string, data binary").parquet(path)


FIELDS = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "n_segments"]


def _row(headers: dict[str, str], block: bytes, segments: int = 1) -> list:
    http, body = payload_of(block)
    kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"]) if kind == "revisit" else len(body)
    if kind == "response" and digest_of(body) != said:
        raise ValueError("a payload is not what its digest says")
    page, refers = headers.get("warc-page-id"), headers.get("warc-refers-to-page-id")
    url = headers.get("warc-target-uri")
    url = unquote(url) if url is not None else None
    return [int(page) if page else None, url, kind, int(refers) if refers else None, said, size, segments, body if kind == "response" else None]


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, n_segments[, payload]) of every record of the
    archives, segmented ones reassembled; of a revisit the payload is null.  A damaged record raises an error."""
    spark = archives.sparkSession
    small_batches(spark)
    kept = [*FIELDS, *["payload"] * payloads]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * payloads]
    segment_kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    names = [*kept, "origin", "segment", "total", "bytes", "head"]
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, n_segments long" + ", payload binary" * payloads

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            for data in batch.column(0):
                rows: list[list] = []
                for headers, block in read_records(data.as_py()):
                    number = headers.get("warc-segment-number")
                    if headers["warc-type"] in ("response", "revisit") and not number:
                        rows.append([*_row(headers, block)[: len(kept)], None, None, None, None, None])
                    elif number:
                        origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
                        total = headers.get("warc-segment-total-length")
                        head = json.dumps(headers) if number == "1" else None
                        # Dealt deflated, as segments hold most of the bytes that are shuffled.
                        rows.append([None] * len(kept) + [origin, int(number), int(total) if total else None, zlib.compress(block, 1), head])
                for a in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 256]), [*kinds, *segment_kinds])], names)

    def done(head: dict | None, parts: list[tuple]) -> list[list]:
        """The row of an origin's segments, as often as its first one came."""
        if not parts:
            return []
        if head is None:
            raise ValueError("segment 1 is missing")
        return [_row(head, reassemble(parts), parts[-1][0])[: len(kept)]] * sum(p[0] == 1 for p in parts)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        origin, head, parts = None, None, []
        for batch in batches:
            rows: list[list] = []
            columns = [c.to_pylist() for c in batch.columns]
            for *whole, o, number, total, data, said in zip(*columns):
                if o is None:
                    rows.append(whole)
                    continue
                if o != origin:
                    rows += done(head, parts)
                    origin, head, parts = o, None, []
                parts.append((number, total, zlib.decompress(data)))
                head = json.loads(said) if said else head
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], kept)
        if parts:
            rows = done(head, parts)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], kept)

    found = archives.select("data").mapInArrow(parsed, f"{schema}, origin string, segment long, total long, bytes binary, head string")
    # Whole records are dealt by what they are, segments by the identifier of their origin, which a page's url is part of.
    where = F.when(F.col("origin").isNotNull(), F.xxhash64("origin")).otherwise(F.xxhash64("page_id", "url", "payload_digest"))
    dealt = found.withColumn("_deal", where).repartition("_deal").sortWithinPartitions("origin", "segment").drop("_deal")
    return dealt.mapInArrow(joined, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0, payloads: bool = False) -> DataFrame:
    """The records of pages, written to archives in the shared folder and read back."""
    path = fresh_path(pages.sparkSession, "archives")
    return read_archives(write_archives(plan_records(pages, id_col, url_col, text_col, least), path), payloads)
