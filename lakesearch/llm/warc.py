"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

The reader never holds more than one record: it inflates a stream piece by piece, takes header and block by Content-Length,
and checks block and payload digests. Archives lie in a folder that all executors reach (a local path or any address that
``pyarrow.fs`` opens). A task writes under names of its own and reports a file only when it is closed, so files of lost or
repeated tasks are never read.
"""

from collections.abc import Iterator
from hashlib import sha256
import re
from typing import Any
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.exact_dedup import BROADCAST_ROWS
from lakesearch.llm.rows import materialise, small_batches
from lakesearch.session import broadcast_within

#: Payloads under so many bytes are always written in full. Bytes after which a new archive is begun; bytes read at once;
#: payload bytes in an output batch.
SMALLEST_REVISIT, ARCHIVE_BYTES, CHUNK, BATCH_BYTES = 100, 1 << 30, 1 << 16, 8 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GAP = b"\r\n\r\n"


def payload_of(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def with_roles(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, head): head is the page that a revisit refers to, null for a response.

    Of equal payloads of ``smallest`` bytes or more, rows with the smallest id are responses and the others revisit it. A null
    id is never referred to: such rows are revisits if a row with an id has the payload, else responses.
    """
    small_batches(pages.sparkSession)
    payload = payload_of(F.col(f"`{html}`"))
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    groups = rows.where(F.length("payload") >= smallest).groupBy("digest").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = materialise(groups.where("n > 1 and head is not null").select("digest", "head"), "warc-heads")
    joined = rows.join(broadcast_within(heads, BROADCAST_ROWS)[0], "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("head"))


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha256:{sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + b"\r\n" + block + GAP) + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, head: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    target = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or _name(page_id)[1:-1])
    headers = [("WARC-Record-ID", _name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest.hex()}"), ("Content-Type", "application/http; msgtype=response")]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if head is None:
        return _record("response", headers, block + payload)
    return _record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(head))], block)


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of ``with_roles`` and returns the archives as a written table (path, records, bytes).

    Each archive begins with a warcinfo record. No rows, no archives.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, path, count, size = None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "records": count, "bytes": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "head"))):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder.rstrip(chr(47))}/{name}", store.open_output_stream(f"{top}/{name}", compression=None)
                    info = _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    count, size = 1, len(info)
                member = page_record(*(x.as_py() for x in row), date)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialise(records.select("page_id", "url", "payload", "digest", "head").mapInArrow(run, "path string, records long, bytes long"), "warc-archives")


def members(stream: Any, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of each gzip member, read and inflated ``chunk`` by ``chunk``. Zero bytes between members are skipped."""
    at, data = 0, stream.read(chunk)
    while data:
        if not (rest := data.lstrip(b"\0")) or len(rest) < len(data):
            at, data = at + len(data) - len(rest), rest or stream.read(chunk)
            continue
        start, inflate, parts = at, zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                raise ValueError(f"the member at {start} is cut short")
            parts.append(inflate.decompress(data))
            at += len(data) - len(inflate.unused_data)
            data = inflate.unused_data or (b"" if inflate.eof else stream.read(chunk))
        data = data or stream.read(chunk)
        yield start, b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ``error`` says what doesn't hold."""
    head, found, rest = raw.partition(GAP)
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out = {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"), "payload": None, "payload_bytes": None, "payload_digest": None, "error": None}
    length = fields.get("content-length", "")
    if not found or not lines[0].startswith("WARC/") or not length.isdigit():
        return out | {"error": "no WARC header with a content length"}
    block, end = rest[: int(length)], rest[int(length) :]
    if len(block) < int(length) or end != GAP:
        return out | {"error": "the block doesn't have its content length"}
    if (told := fields.get("warc-block-digest")) and told != f"sha256:{sha256(block).hexdigest()}":
        return out | {"error": "the block digest differs"}
    told = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if out["record_type"] in ("response", "revisit"):
        http, _, payload = block.partition(GAP)
        if out["record_type"] == "response":
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": sha256(payload).hexdigest()}
            if told and told != out["payload_digest"]:
                out["error"] = "the payload digest differs"
        else:
            size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
            out |= {"payload_bytes": int(size[1]) if size else None, "payload_digest": told}
    return out


RECORDS = "path string, offset long, record_type string, record_id string, target_uri string, date string, refers_to string, payload binary, payload_bytes long, payload_digest string, error string"


def read_archives(archives: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """Every record of the archives in the column ``path``, a task reading its archives one after the other.

    ``strict`` ends the job at the first fault; otherwise a faulty record has its ``error``, and of an archive that can't be
    inflated further one row tells the fault.
    """
    kind = pa.schema([("path", pa.string()), ("offset", pa.int64()), *((c, pa.string()) for c in ("record_type", "record_id", "target_uri", "date", "refers_to")), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])

    def records(path: str):
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at, compression=None) as stream:
            try:
                for offset, raw in members(stream):
                    yield {"path": path, "offset": offset} | parse_record(raw)
            except (ValueError, zlib.error) as fault:
                yield {"path": path, "error": str(fault)}

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for r in records(path):
                    if strict and r["error"]:
                        raise ValueError(f"{path}, record at {r.get('offset')}: {r['error']}")
                    size += len(r.get("payload") or b"")
                    held.append(r if payloads else r | {"payload": None})
                    if size >= BATCH_BYTES or len(held) >= 10_000:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, kind)

    return archives.select("path").repartition("path").mapInArrow(run, RECORDS)


def page_id_of(name: Column) -> Column:
    """The id in a record id that ``page_record`` made."""
    return F.regexp_extract(name, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
