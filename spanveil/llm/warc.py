"""Web archives in ZIP packages: a writer, and a reader that range-reads single records without extraction.

A package is a ZIP file of stored (uncompressed) members: archive/data.warc.gz with one gzip member per WARC record,
indexes/index.cdxj with a line per record (offset, length, digest), and datapackage.json. The reader finds the end
record, the ZIP64 records where there are any, and the central directory; from there the members' places, then the
index, then each record by its byte range in the package.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, new_path, written

#: Bytes of records after which a task begins its next package.
PACKAGE_BYTES = 16 << 20
ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Half of the record ids; the other half is the page id.
NAMESPACE = 0x5350414E5645494C


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    if page is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    return f"<urn:uuid:{uuid.UUID(int=NAMESPACE << 64 | page & (1 << 64) - 1)}>"


def page_of(record: str | None) -> int | None:
    if not record:
        return None
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 != NAMESPACE:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def clean_uri(url: str | None) -> str | None:
    """Control characters and spaces would break a header line; they are percent-encoded."""
    return None if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record: the whole response, or a revisit with the response's head only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri := clean_uri(url):
        head.append(f"WARC-Target-URI: {uri}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def parse_record(raw: bytes) -> Record:
    """One record, gzip-compressed or plain."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompressobj(31).decompress(raw)
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    found = headers(lines[1:])
    block = rest[: int(found.get("content-length", 0))]
    if not found.get("content-type", "").startswith("application/http"):
        return Record(found, {}, block)
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(found, headers(http.split(b"\r\n")[1:]), payload)


class Package:
    """A package being filled in memory, up to PACKAGE_BYTES and one record."""

    def __init__(self):
        self.data, self.index = io.BytesIO(), []

    def add(self, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        raw = packer.compress(record(page, url, payload, digest, refers_to)) + packer.flush()
        about = {"url": url, "digest": f"sha1:{digest}", "offset": str(self.data.tell()), "length": str(len(raw)), "filename": "data.warc.gz", "mime": "warc/revisit" if refers_to is not None else "text/html", "status": "200"}
        self.index.append(f"{clean_uri(url) or '-'} {DATE.translate({ord(c): None for c in '-:TZ'})} {json.dumps(about)}\n")
        self.data.write(raw)

    def write(self, out) -> None:
        import zipfile

        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            z.writestr(ARCHIVE, self.data.getvalue())
            z.writestr(INDEX, "".join(self.index))
            z.writestr(ABOUT, json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": "data.warc.gz", "path": ARCHIVE}, {"name": "index.cdxj", "path": INDEX}]}))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    start: int  # of the local header


def range_reader(file):
    """(start, length) -> bytes, of an open seekable file."""

    def read(start: int, length: int) -> bytes:
        file.seek(start)
        got = file.read(length)
        if len(got) < length:
            raise ValueError("the package ends too early")
        return bytes(got)

    return read


def members(read, size: int) -> dict[str, Member]:
    """The central directory of a ZIP file of `size` bytes, ZIP64 or not."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<H2I", tail[end + 10 : end + 20])
    locator = tail_at + end - 20
    if locator >= 0 and (where := read(locator, 20))[:4] == b"PK\x06\x07":
        at = struct.unpack("<Q", where[8:16])[0]
        wide = read(at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<3Q", wide[32:56])
    raw, at, found = read(start, length), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", raw[at + 10 : at + 12])[0]
        packed, plain, n_name, n_extra, n_note = struct.unpack("<2I3H", raw[at + 20 : at + 34])
        local = struct.unpack("<I", raw[at + 42 : at + 46])[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<2H", extra[:4])
            if kind == 1:  # of the three, those that are full stand here, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        found[name] = Member(name, method, packed, local)
        at += 46 + n_name + n_extra + n_note
    return found


def data_start(read, member: Member) -> int:
    """Where a stored member's bytes begin: its local header may have another extra field than the directory's."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; records can't be read by range")
    head = read(member.start, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.start + 30 + sum(struct.unpack("<2H", head[26:30]))


def about_of(line: str) -> dict | None:
    """The third field of an index line. Header lines begin with '!', as a url may, but have no date as their second field."""
    fields = line.split(" ", 2)
    if len(fields) < 3 or line.startswith("!") and not re.fullmatch("[0-9]{14}", fields[1]):
        return None
    return json.loads(fields[2])


def read_package(read, size: int) -> Iterator[Record]:
    """The records that the package's indexes name, each by its range."""
    found = members(read, size)
    starts: dict[str, int] = {}
    for name, member in sorted(found.items()):
        if not (name.startswith("indexes/") and name.endswith((".cdx", ".cdxj"))):
            continue
        for line in read(data_start(read, member), member.size).decode().split("\n"):
            if about := about_of(line):
                path = f"archive/{about['filename']}"
                if path not in starts:
                    starts[path] = data_start(read, found[path])
                yield parse_record(read(starts[path] + int(about["offset"]), int(about["length"])))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record per row; returns path and records of each package that the successful tasks wrote.

    Of the rows with equal payloads (SHA-256) of at least `least_bytes` bytes, that with the largest id is a response
    and the others revisit it; rows of that id, and rows without an id, are responses. A null payload is an empty one;
    one of any length is held whole, and closes its package. A package's name is new for each attempt of a task, so
    what a lost attempt left is in no list. `folder` is a whole URI.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit("").cast("binary"))
    given = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.unhex(F.sha2(payload, 256)).alias("same"))
    ids = given.where(F.length("payload") >= least_bytes).groupBy("same").agg(F.max("id").alias("owner"), F.count("id").alias("n")).where("n > 1")
    joined = given.join(ids.select(F.col("same").alias("of"), "owner"), F.col("same") == F.col("of"), "left")
    refers_to = F.when(F.col("id") < F.col("owner"), F.col("owner"))
    rows = joined.select("id", "url", "payload", "sha1", refers_to.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def put(package: Package) -> pa.RecordBatch:
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as out:
                package.write(out)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(package.index)], pa.int64())], ["path", "records"])

        package = Package()
        for batch in batches:
            cols = batch.columns
            for i in range(len(batch)):
                page, url, payload, sha1, to = (c[i].as_py() for c in cols)
                package.add(page, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), to)
                if package.data.tell() >= package_bytes:
                    yield put(package)
                    package = Package()
        if package.index:
            yield put(package)

    return map_batches(rows, run, "path string, records long")


def read_packages(packages: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the packages in column `path`: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for a revisit).

    A response's size and digest are taken of the payload that was read; a revisit's from its heads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with store.open_input_file(path) as file:
                    for r in read_package(range_reader(file), file.size()):
                        revisit = r.headers["warc-type"] == "revisit"
                        size = int(r.http.get("content-length", 0)) if revisit else len(r.payload)
                        digest = r.headers["warc-payload-digest"].removeprefix("sha1:") if revisit else digest_of(r.payload)
                        rows.append((page_of(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), size, digest, r.headers["warc-type"], page_of(r.headers.get("warc-refers-to")), None if revisit else r.payload))
                        held += len(r.payload)
                        if len(rows) == 4096 or with_payload and held > 8 << 20:
                            yield shaped(rows)
                            rows, held = [], 0
                if rows:
                    yield shaped(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def shaped(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: len(kinds)], kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return map_batches(packages.select("path"), run, schema)


def round_trip(pages: DataFrame, **more) -> DataFrame:
    """Writes `pages` as packages in the shared folder and reads every record back. An empty table writes none and gives no rows."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    packages = written(write_packages(pages, folder, **more), "warc-list")
    n = max(spark.sparkContext.defaultParallelism, packages.count())
    return read_packages(packages.repartition(n), folder)
