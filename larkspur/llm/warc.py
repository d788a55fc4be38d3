"""WARC archives: one gzip member per record, written by tasks and read back as a stream."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.inputs import spread_files
from larkspur.session import scratch_path, ship, stage

#: An archive is closed at this size.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
_GZIP = 31
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(text: str) -> str:
    """A URI that fits on a header line: blanks and control characters are escaped."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
    return packer.compress(record) + packer.flush()


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def response_record(record_id: str, uri: str | None, payload: bytes, date: str) -> bytes:
    block = _http(len(payload)) + payload
    return _record([
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", uri if uri is None else _uri(uri)), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")], block)


def revisit_record(record_id: str, uri: str | None, refers_to: str, length: int, digest: str, date: str) -> bytes:
    block = _http(length)
    return _record([
        ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", uri if uri is None else _uri(uri)), ("WARC-Profile", _REVISIT),
        ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")], block)


def open_folder(folder: str):
    """The file system and the path on it of an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", uri_column: str = "url",
                   payload_column: str = "html", revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z",
                   level: int = 6) -> DataFrame:
    """Write a record per row to archives in ``folder``; returns the staged ``path``, ``records``, ``bytes`` of each.

    Of rows with equal payloads of at least ``revisit_from`` bytes those with the smallest id are responses, the others
    revisits that refer to it. A null payload is empty; a null address leaves its header out; a row with a null id is a
    response with a random record id. A payload is compressed where it is read, and only the finished member is moved,
    to meet the smallest id of its digest. A task names its files anew each time it runs and reports them at its end,
    so what a lost executor wrote is never read. ``folder`` must be one that pyarrow's file systems reach from every
    executor; by default it is a new one in the shared folder of the session.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = (folder or scratch_path(spark, "warc")).rstrip("/")
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.expr("X''"))
    rows = pages.select(
        F.col(id_column).alias("id"), F.col(uri_column).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    kind = rows.schema["id"].dataType.simpleString()
    firsts = rows.where(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = stage(firsts, "firsts")

    def compress(batches):
        for batch in batches:
            members = []
            for key, uri, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                members.append(_member(response_record(_record_id(key), uri, body, date), level))
            lengths = pc.binary_length(batch.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), lengths, pa.array(members, pa.large_binary())],
                ["id", "uri", "digest", "length", "member"])

    members = rows.mapInArrow(compress, f"id {kind}, uri string, digest binary, length bigint, member binary")
    known = members.join(firsts, "digest", "left").select("id", "uri", "digest", "length", "member", "first")
    # Only responses carry their member on.
    again = F.col("id").isNotNull() & F.col("first").isNotNull() & (F.col("id") != F.col("first"))
    known = known.withColumn("first", F.when(again, F.col("first"))).withColumn("member", F.when(~again | again.isNull(), F.col("member")))

    def write(batches):
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        done, out, path, n, size = [], None, None, 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, n, size))
                out = None

        for batch in batches:
            for key, uri, digest, length, member, first in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if member is None:
                    name = base64.b32encode(digest).decode()
                    member = _member(revisit_record(_record_id(key), uri, _record_id(first), length, name, date), level)
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        names = [f"{folder}/{p.rsplit('/', 1)[1]}" for p, _, _ in done]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return stage(known.mapInArrow(write, "path string, records bigint, bytes bigint"), "archives")


def _record_id(key) -> str:
    return f"urn:uuid:{uuid.uuid4()}" if key is None else f"urn:record:{key}"


class _Bytes:
    """Decompressed bytes of one gzip member, in parts, from a stream of members."""

    def __init__(self, stream):
        self.stream, self.raw, self.at = stream, b"", 0
        self.held = b""

    def begin(self) -> bool:
        """Start the next member; false at the end of the archive."""
        if not self.raw:
            self.raw = self.stream.read(READ_BYTES)
        self.member, self.held, self.offset = zlib.decompressobj(_GZIP), b"", self.at
        return bool(self.raw)

    def more(self) -> bytes:
        """Some more bytes of the member, none at its end."""
        while True:
            if self.member.eof:
                return b""
            if not self.raw:
                self.raw = self.stream.read(READ_BYTES)
                if not self.raw:
                    raise ValueError("the archive ends inside a member")
            given = self.raw
            part = self.member.decompress(given, READ_BYTES)
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            self.at += len(given) - len(self.raw)
            if part:
                return part

    def line(self) -> bytes:
        """Bytes before the next line end, which is passed over."""
        parts, part = [], self.held or self.more()
        while b"\n" not in part:
            if not part:
                raise ValueError("a header has no end")
            parts.append(part)
            part = self.more()
        last, self.held = part.split(b"\n", 1)
        return b"".join([*parts, last]).removesuffix(b"\r")

    def lines(self) -> list[bytes]:
        """Lines before an empty one, which is passed over."""
        return list(iter(self.line, b""))

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly ``n`` bytes, in parts."""
        while n:
            part = self.held or self.more()
            if not part:
                raise ValueError("a record is shorter than its Content-Length")
            self.held = part[n:]
            part = part[:n]
            n -= len(part)
            yield part

    def rest(self) -> bytes:
        out = self.held
        while part := self.more():
            out += part
        self.held = b""
        return out


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(stream, with_payload: bool) -> Iterator[dict]:
    """Records of an archive in order. Bytes are taken from the stream as needed; a payload is held only if asked for.

    ``verified`` tells whether block and payload have the digests of their headers. A member that is cut off, a block
    shorter than its Content-Length and a record that does not end as it must are errors.
    """
    source = _Bytes(stream)
    while source.begin():
        header = _fields(source.lines())
        length = int(header["content-length"])
        block, payload, kept, seen, http = hashlib.sha1(), hashlib.sha1(), [], 0, b""
        is_http = header.get("content-type", "").startswith("application/http")
        in_body = not is_http
        for part in source.take(length):
            block.update(part)
            if not in_body:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                http, part = http.split(b"\r\n\r\n", 1)
                in_body = True
            payload.update(part)
            seen += len(part)
            if with_payload:
                kept.append(part)
        if source.rest() != b"\r\n\r\n":
            raise ValueError("a record does not end after its block")
        name = "sha1:" + base64.b32encode(payload.digest()).decode()
        revisit = header.get("warc-type") == "revisit"
        stated = header.get("warc-payload-digest")
        good = header.get("warc-block-digest") in (None, "sha1:" + base64.b32encode(block.digest()).decode())
        declared = int(_fields(http.split(b"\r\n")).get("content-length", seen)) if is_http else seen
        good = good and (not seen if revisit else stated in (None, name) and declared == seen)
        yield {
            "offset": source.offset, "record_id": header.get("warc-record-id", "").strip("<>"),
            "record_type": header.get("warc-type"), "uri": header.get("warc-target-uri"),
            "payload_length": declared if revisit else seen,
            "payload_digest": (stated if revisit else name or "").removeprefix("sha1:"),
            "refers_to": header["warc-refers-to"].strip("<>") if "warc-refers-to" in header else None,
            "verified": good, "payload": b"".join(kept) if with_payload and not revisit else None}


_SCHEMA = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
    ("uri", pa.string()), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
    ("verified", pa.bool_()), ("payload", pa.binary())])
_SPARK = ("path string, offset bigint, record_id string, record_type string, uri string, payload_length bigint, "
          "payload_digest string, refers_to string, verified boolean, payload binary")


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives in column ``path``, each archive read in sequence by one task (see ``read_records``).

    A task reads several archives, by their ``bytes`` where that column is there. A null path is left out.
    """
    ship(paths.sparkSession)
    size = F.col("bytes") if "bytes" in paths.columns else F.lit(ARCHIVE_BYTES)
    spread = spread_files(paths.where("path IS NOT NULL").select("path", size.alias("bytes")))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = open_folder(path)
                held, size = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for record in read_records(stream, with_payload):
                        held.append(record | {"path": path})
                        size += 200 + len(record["payload"] or b"")
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _SCHEMA)

    return spread.mapInArrow(run, _SPARK)
