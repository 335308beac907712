"""WARC archives: writing response and revisit records, and a reader that salvages damaged archives."""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.shared import small_batches, stored

VERSION = b"WARC/1.1\r\n"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_text(page_id, url, payload: str, refers_to) -> str:
    """One record without its closing CRLFCRLF; a revisit has the HTTP head only."""
    body = payload.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    block = http.encode() + (body if refers_to is None else b"")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {'' if url is None else re.sub('[\r\n]', ' ', url)}",
            f"WARC-Payload-Digest: sha1:{digest32(body)}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION.decode() + "\r\n".join(head) + END + block.decode()


def first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, first) of the pages whose payload an earlier page id has too.

    The smallest page id of each payload is a partial aggregate over digest and length; only
    digests that occur twice go on, so a payload that a third of all pages share meets its
    first page as one row. Ids are unique; of rows that repeat an id all are written alike."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keys = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).filter(F.col("size") >= min_bytes)
    shared = (keys.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
              .filter("first < last").drop("last"))
    return keys.join(shared, ["digest", "size"]).filter("page_id > first").select("page_id", "first").distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 2000) -> None:
    """Writes `pages` (page_id, url, html; further columns are ignored) as uncompressed .warc text files.

    Null html is an empty payload, a null url an empty one. Records are written where the
    pages are read. The list of revisits is stored first: Spark broadcasts it only if its
    measured size is below the session's limit and otherwise shuffles both sides."""
    small_batches(pages.sparkSession)
    revisits = stored(first_copies(pages, min_bytes), "revisits")

    def run(batches):
        for batch in batches:
            values = [record_text(i, u, h or "", f) for i, u, h, f in zip(*(batch.column(c).to_pylist() for c in range(4)))]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", url.cast("string").alias("url"), "html").join(revisits, "page_id", "left")
    (rows.mapInArrow(run, "value string").write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path))


def _parse(data: bytes, at: int):
    """(record, end) at a version line, or None if any check fails."""
    match = _VERSION_LINE.match(data, at)
    if not match:
        return None
    stop = data.find(b"\r\n\r\n", match.end() - 2)
    if stop < 0:
        return None
    head = {}
    for line in data[match.end():stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    digest = head.get("warc-block-digest")
    if digest is not None and digest != "sha1:" + digest32(block):
        return None
    return (head, block), end + 4


def _plain(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """('record', begin, end, (head, block)) and ('gap', begin, end, reason) in order, covering all bytes.

    After a failed check the next version line after the failed one is tried, and so on; the
    bytes passed over form one gap."""
    at, gap, n = 0, None, len(data)
    while at < n:
        found = _parse(data, at)
        if found:
            if gap is not None:
                yield "gap", gap, at, "no valid record"
                gap = None
            yield "record", at, found[1], found[0]
            at = found[1]
            continue
        if gap is None:
            gap = at
        nxt = _VERSION_LINE.search(data, at + 1)
        at = nxt.start() if nxt else n
    if gap is not None:
        yield "gap", gap, n, "no valid record"


def _member(data: bytes, at: int):
    """(content, end) of the gzip member at `at`, or None if it is cut or its checksum fails."""
    try:
        unpack = zlib.decompressobj(31)
        content = unpack.decompress(data[at:])
        return (content, len(data) - len(unpack.unused_data)) if unpack.eof else None
    except zlib.error:
        return None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Records and quarantined gaps of an archive of plain records, gzip members or a mixture of both."""
    at, gap, n = 0, None, len(data)
    while at < n:
        made = None
        if data.startswith(_MEMBER, at):
            member = _member(data, at)
            if member:
                inner = list(_plain(member[0]))
                made = [(kind, at, member[1], value) for kind, _, _, value in inner], member[1]
        else:
            found = _parse(data, at)
            if found:
                made = [("record", at, found[1], found[0])], found[1]
        if made:
            if gap is not None:
                yield "gap", gap, at, "no valid record or member"
                gap = None
            yield from made[0]
            at = made[1]
            continue
        if gap is None:
            gap = at
        line, member = _VERSION_LINE.search(data, at + 1), data.find(_MEMBER, at + 1)
        at = min(line.start() if line else n, member if member >= 0 else n)
    if gap is not None:
        yield "gap", gap, n, "no valid record or member"


READ_SCHEMA = ("path string, kind string, begin long, end long, reason string, page_id string, record_type string, uri string, "
               "refers_to string, payload_digest string, payload_bytes long, payload binary")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of every archive below `path`: kind 'record' or 'gap' with its byte range in the file.

    payload_bytes and payload_digest are those of the full payload: measured and compared with
    the header for a response, taken from the HTTP head and the header for a revisit. A response
    whose payload differs from its digest becomes a gap. One task holds one file at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [part.split()[0] for part in READ_SCHEMA.split(", ")]
    kinds = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[part.split()[1]]) for n, part in zip(names, READ_SCHEMA.split(", "))])

    def urn(value):
        return None if value is None else value.removeprefix("<urn:page:").removesuffix(">")

    def row(path, kind, begin, end, value):
        if kind == "gap":
            return (path, kind, begin, end, value) + (None,) * 7
        head, block = value
        record_type, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        if record_type == "response":
            if digest is not None and digest32(payload) != digest:
                return (path, "gap", begin, end, "payload digest differs") + (None,) * 7
            digest, size = digest or digest32(payload), len(payload)
        else:
            size, payload = int(stated[1]) if stated else None, None
        return (path, kind, begin, end, None, urn(head.get("warc-record-id")), record_type, head.get("warc-target-uri"),
                urn(head.get("warc-refers-to")), digest, size, payload if with_payload else None)

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0), batch.column(1)):
                out = []
                for found in salvage(content.as_py()):
                    out.append(row(p.as_py(), *found))
                    if len(out) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)

    return files.mapInArrow(run, READ_SCHEMA)
