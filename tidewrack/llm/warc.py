"""WARC archives written from pages, and read back as a table of bounded chunks."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import broadcast_if_small, settled

PIECE = 64 << 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = (
    "record_id string, chunk_no long, start long, chunk binary, sha1_so_far string, is_last boolean,"
    " record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string,"
    " refers_to long"
)
ARCHIVES = "path string, bytes long, records long"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop-style URI (local, HDFS, object store), and the path inside it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# -- writing ----------------------------------------------------------------------------------------


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, h, refers_to): the pages whose payload a page with a larger id also has.

    Equal payloads are told by SHA-1, a second hash and length together. `h` is the second hash.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    meta = settled(
        pages.select("page_id", F.sha1(html).alias("sha1"), F.xxhash64(html).alias("h"), F.octet_length(html).alias("n"))
    ).where(F.col("n") >= least_bytes)
    same = ("sha1", "h", "n")
    kept = settled(
        meta.groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    )
    return settled(
        meta.join(broadcast_if_small(kept, 100), list(same))
        .where(F.col("page_id") < F.col("refers_to"))
        .select("page_id", "h", "refers_to")
        .distinct()
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}')}>"


def _record_head(row: dict, digest: str, date: str) -> bytes:
    """The WARC and HTTP header lines of a record; the payload follows a response's."""
    again = row["refers_to"] is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['n']}\r\n\r\n"
    ).encode()
    url = re.sub(r"\s+", "%20", row["url"] or "").strip("<>") or f"urn:page:{row['page_id']}"
    fields = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", _record_id(row["page_id"], digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if again else row["n"]))),
    ]
    if row["page_id"] is not None:
        fields.append(("Page-Id", str(row["page_id"])))
    if again:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _record_id(row["refers_to"], digest)),
            ("Refers-To-Page-Id", str(row["refers_to"])),
        ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


class _Archive:
    """One .warc.gz file in the making, a gzip member per record."""

    def __init__(self, folder: str) -> None:
        system, inside = file_system(folder)
        system.create_dir(inside, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.path, self.bytes, self.records = f"{folder}/{name}", 0, 0
        self.stream = system.open_output_stream(f"{inside}/{name}", compression=None)

    def add(self, parts: Iterator[bytes]) -> None:
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        for part in parts:
            self._put(packer.compress(part))
        self._put(packer.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def close(self) -> dict:
        self.stream.close()
        return {"path": self.path, "bytes": self.bytes, "records": self.records}


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 64 << 20,
    date: str = "2001-01-01T00:00:00Z",
) -> DataFrame:
    """Write one WARC record per row of `pages` under `folder`; the settled list of the archives.

    Of rows with equal payloads of at least `least_bytes`, the one with the largest page_id is a
    response and the others are revisits of it; smaller payloads are all responses. A null html is an
    empty payload, a null url becomes a urn. A null page_id writes a response without Page-Id; rows
    that repeat a page_id and payload are all written, as the same kind. An empty table writes nothing.

    A task writes files of its own under new names and reports them, so files of a lost or repeated
    task are in no list and are never read. A file holds about `archive_bytes` at most.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    again = revisits(pages, least_bytes)
    rows = (
        pages.select("page_id", "url", html.alias("payload"), F.xxhash64(html).alias("h"))
        .join(broadcast_if_small(again, 32), ["page_id", "h"], "left")
        .select(
            "page_id", "url", "refers_to", F.octet_length("payload").alias("n"),
            F.unhex(F.sha1("payload")).alias("sha1"),
            F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        )
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            payloads = batch.column("payload")
            small = batch.drop_columns(["payload"]).to_pylist()
            for i, row in enumerate(small):
                archive = archive or _Archive(folder)
                head = _record_head(row, base64.b32encode(row["sha1"]).decode(), date)
                payload = payloads[i].as_buffer() if row["refers_to"] is None else None
                body = memoryview(payload) if payload is not None else memoryview(b"")
                pieces = (body[at : at + PIECE] for at in range(0, len(body), PIECE))
                archive.add(part for whole in ((head,), pieces, (b"\r\n\r\n",)) for part in whole)
                if archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return settled(rows.mapInArrow(write, ARCHIVES))


# -- reading ----------------------------------------------------------------------------------------


class _Unpacked:
    """The bytes of a (multi-member gzip or plain) stream, with a buffer of bounded size."""

    def __init__(self, stream, packed: bool) -> None:
        self.stream, self.packed, self.raw, self.buffer = stream, packed, b"", b""
        self.unpacker = zlib.decompressobj(31) if packed else None

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(PIECE)
                if not self.raw:
                    return False
            if not self.packed:
                self.buffer, self.raw = self.buffer + self.raw, b""
                return True
            if self.unpacker.eof:
                self.unpacker = zlib.decompressobj(31)
            out = self.unpacker.decompress(self.raw, PIECE)
            self.raw = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if out:
                self.buffer += out
                return True

    def line(self, most: int = 1 << 20) -> bytes | None:
        """The next line without its end, or None at the end of the stream."""
        while (end := self.buffer.find(b"\n")) < 0:
            if len(self.buffer) > most:
                raise ValueError(f"a header line of over {most} bytes")
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends inside a header")
                return None
        line, self.buffer = self.buffer[:end], self.buffer[end + 1 :]
        return line.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        """Exactly n bytes; n is at most a chunk."""
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def _fields(source: _Unpacked) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name up to the empty line, and the bytes they took with CR LF."""
    fields, taken = {}, 0
    while line := source.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
        taken += len(line) + 2
    return fields, taken + 2


def record_chunks(source: _Unpacked, chunk_bytes: int) -> Iterator[dict]:
    """The chunk rows of each record, in order; no more than a chunk of a payload is held."""
    while (version := source.line()) is not None:
        if not version:
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head, _ = _fields(source)
        left = int(head["content-length"])
        again = head["warc-type"] == "revisit"
        size = None
        if head.get("content-type", "").startswith("application/http") and left:
            status = source.line()
            http, taken = _fields(source)
            left -= taken + len(status) + 2
            size = int(http["content-length"]) if "content-length" in http else None
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        common = {
            "record_id": head["warc-record-id"], "record_type": head["warc-type"],
            "page_id": int(head["page-id"]) if "page-id" in head else None,
            "target_uri": head.get("warc-target-uri"),
            "refers_to": int(head["refers-to-page-id"]) if "refers-to-page-id" in head else None,
        }
        sha1, start, number = hashlib.sha1(), 0, 0
        while True:
            chunk = source.take(min(left, chunk_bytes))
            left -= len(chunk)
            sha1.update(chunk)
            so_far = base64.b32encode(sha1.digest()).decode()
            if not left and not again and digest not in (None, so_far):
                raise ValueError(f"{common['record_id']}: payload digest {so_far}, declared {digest}")
            yield common | {
                "chunk_no": number, "start": start, "chunk": chunk, "sha1_so_far": so_far, "is_last": not left,
                "payload_bytes": size if again else start + len(chunk), "payload_digest": digest if again else so_far,
            }
            start, number = start + len(chunk), number + 1
            if not left:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"{common['record_id']}: the record does not end where it declares")


def read_chunks(archives: DataFrame, chunk_bytes: int = 256 << 10, columns: str = CHUNKS) -> DataFrame:
    """The chunked record table of archives listed by path: a row per record and chunk number.

    Each row carries the SHA-1 of the payload up to its end. `payload_bytes` and `payload_digest` of
    the last chunk are the whole payload's (a revisit's are those it declares: it has one empty
    chunk). An empty payload is one empty chunk. Files are read as streams: a task holds one chunk
    and a buffer, whatever the record's size. A payload that does not match its declared digest, a
    truncated archive or a wrong length raises. `columns` may leave columns of CHUNKS out.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    listed = archives.select("path")
    schema = pa.schema([(n, _ARROW[n]) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inside = file_system(path)
                with system.open_input_stream(inside, compression=None) as stream:
                    held, size = [], 0
                    for row in record_chunks(_Unpacked(stream, path.endswith(".gz")), chunk_bytes):
                        held.append({n: row[n] for n in names})
                        size += len(row["chunk"]) + 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return listed.repartition(max(1, listed.count())).mapInArrow(read, columns)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_ARROW = {name: _KINDS[kind] for name, kind in (c.split() for c in CHUNKS.split(", "))}
