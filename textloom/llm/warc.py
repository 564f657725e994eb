"""Web archives: pages as WARC records in ZIP packages, and a reader that takes records out of
packages by ranges, without extracting or copying a member.

A package is a ZIP file with stored (not deflated) members: `archive/data.warc.gz`, in which each
record is a gzip member of its own, and `indexes/index.cdxj`, a line of JSON for each record with
its offset and length there. The reader fetches a package's end, its directory, by ZIP64 records
where sizes ask for them, and the index; the index gives blocks of consecutive records, the blocks
are dealt to all tasks, and each block is one range read.

Packages lie in the cluster's shared folder. A task names its packages by a draw of its own and
says in a table which ones it finished, so that what a lost or repeated attempt has left is never
read. One package and one block are bounded in bytes and records; a single record may be larger
and is read whole.

Null html is empty, a null url has no target. Control characters of a url are percent-encoded. Of
pages with equal payloads (by SHA-1 and length) that with the smallest id is the response, and
all rows of that id are; pages without an id are revisits where one with an id has their payload,
else responses. An empty table gives no packages and no rows. Further columns are not read."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Shelf, arrow_rows, lookup_counted

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bounds of a package and of a block of records that is read at once.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 200_000
BLOCK_BYTES, BLOCK_RECORDS = 1 << 20, 500
#: Packed bytes that a reading task takes, and the most tasks.
TASK_BYTES, MOST_TASKS = 8 << 20, 20_000
#: Read of an index at once.
INDEX_BYTES = 1 << 20

# Signatures, sizes and layouts of the ZIP format's records.
_EOCD, _EOCD64_LOCATOR, _EOCD64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_EOCD_LAYOUT = struct.Struct("<4s4H2LH")
_LOCATOR_LAYOUT = struct.Struct("<4sLQL")
_EOCD64_LAYOUT = struct.Struct("<4sQ2H2L4Q")
_ENTRY_LAYOUT = struct.Struct("<4s6H3L5H2L")
_LOCAL_LAYOUT = struct.Struct("<4s5H3L2H")
_FULL16, _FULL32, _ZIP64_EXTRA = 0xFFFF, 0xFFFFFFFF, 1
# Fields and profile of the WARC format.
_VERSION = "WARC/1.1"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """A path, or URI of any store that Arrow opens, as its file system and the path there."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


# ---- records -----------------------------------------------------------------

def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or, with refers_to, a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id))]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = f"{_VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    """Names in lower case -> values; a line that begins with white space goes on from the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse_record(raw: bytes) -> dict:
    """type, id, url, digest, refers_to, http headers and payload of a WARC record with an HTTP
    message; a record that is cut short or whose digest isn't that of its payload is an error."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    fields = _headers(head)
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ValueError(f"{fields.get('warc-record-id')} has {len(rest)} of {length} bytes")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    http_fields = _headers(http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"{fields.get('warc-record-id')}: the payload is not that of its digest")
    return {
        "type": fields["warc-type"], "id": fields["warc-record-id"], "url": fields.get("warc-target-uri"), "digest": digest, "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": int(http_fields["content-length"]) if revisit else len(payload), "payload": None if revisit else payload,
    }


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- packages ----------------------------------------------------------------

class Package:
    """One ZIP package being written: records one by one, then its index."""

    def __init__(self, folder: str):
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wacz"
        self.out = store.open_output_stream(f"{root.rstrip('/')}/{self.path.rpartition('/')[2]}", compression=None)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.size, self.records = io.BytesIO(), 0, 0

    def add(self, page_id: int | None, record: bytes) -> None:
        packed = zlib.compress(record, 4, wbits=31)
        self.member.write(packed)
        self.index.write(json.dumps({"id": page_id, "offset": self.size, "length": len(packed)}).encode() + b"\n")
        self.size += len(packed)
        self.records += 1

    def full(self) -> bool:
        return self.size >= PACKAGE_BYTES or self.records >= PACKAGE_RECORDS

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write(self.index.getbuffer())
        self.zip.close()
        self.out.close()
        return self.path, self.records, self.size


class Ranges:
    """Range reads of one file of any store."""

    def __init__(self, path: str):
        store, at = file_system(path)
        self.file = store.open_input_file(at)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"{length} bytes at {start}: the file ends before")
        return data

    def close(self) -> None:
        self.file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def zip_members(file: Ranges) -> dict[str, tuple[int, int, int]]:
    """Name -> (offset of the local header, stored length, method) by the central directory."""
    tail_size = min(file.size, _EOCD_LAYOUT.size + _FULL16)
    tail = file.read(file.size - tail_size, tail_size)
    at = tail.rfind(_EOCD)
    while at >= 0 and at + _EOCD_LAYOUT.size + _EOCD_LAYOUT.unpack_from(tail, at)[-1] != len(tail):
        at = tail.rfind(_EOCD, 0, at)  # a comment may hold the signature
    if at < 0:
        raise ValueError("no ZIP directory at the end")
    end = file.size - tail_size + at
    *_, count, size, start, _ = _EOCD_LAYOUT.unpack_from(tail, at)
    place = end - size
    if end >= _LOCATOR_LAYOUT.size and (locator := file.read(end - _LOCATOR_LAYOUT.size, _LOCATOR_LAYOUT.size)).startswith(_EOCD64_LOCATOR):
        where = _LOCATOR_LAYOUT.unpack(locator)[2]
        sign, *_, count, size, start = _EOCD64_LAYOUT.unpack(file.read(where, _EOCD64_LAYOUT.size))
        if sign != _EOCD64:
            raise ValueError("the ZIP64 locator leads astray")
        place = where - size
    shift = place - start  # bytes that were put in front of the package
    directory, at, out = file.read(place, size), 0, {}
    for _ in range(count):
        sign, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_comment, _, _, _, offset = _ENTRY_LAYOUT.unpack_from(directory, at)
        if sign != _ENTRY:
            raise ValueError("the ZIP directory is broken")
        at += _ENTRY_LAYOUT.size
        name = directory[at : at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        packed, offset = _wide(directory[at + n_name : at + n_name + n_extra], plain, packed, offset)
        out[name] = (offset + shift, packed, method)
        at += n_name + n_extra + n_comment
    return out


def _wide(extra: bytes, plain: int, packed: int, offset: int) -> tuple[int, int]:
    """Length and offset of an entry, from its ZIP64 field where they are full there."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == _ZIP64_EXTRA:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            if plain == _FULL32:
                next(values)
            packed = next(values) if packed == _FULL32 else packed
            offset = next(values) if offset == _FULL32 else offset
        at += 4 + n
    return packed, offset


def stored_member(file: Ranges, name: str, members: dict) -> tuple[int, int]:
    """(offset of the bytes, length) of a stored member."""
    offset, length, method = members[name]
    if method != zipfile.ZIP_STORED:
        raise ValueError(f"{name} is compressed: its records have no places in the file")
    sign, *_, n_name, n_extra = _LOCAL_LAYOUT.unpack(file.read(offset, _LOCAL_LAYOUT.size))
    if sign != _LOCAL:
        raise ValueError(f"{name}: no local header at {offset}")
    return offset + _LOCAL_LAYOUT.size + n_name + n_extra, length


def index_lines(file: Ranges, start: int, length: int) -> Iterator[dict]:
    """The lines of a stored index, read piece by piece."""
    rest, at = b"", 0
    while at < length:
        data = rest + file.read(start + at, n := min(INDEX_BYTES, length - at))
        at += n
        *lines, rest = data.split(b"\n")
        yield from (json.loads(x) for x in lines if x)
    if rest.strip():
        yield json.loads(rest)


def package_blocks(path: str) -> Iterator[tuple[str, int, list[int]]]:
    """(path, start, lengths): runs of records that stand one after the other, in the file's own offsets."""
    with Ranges(path) as file:
        members = zip_members(file)
        data, _ = stored_member(file, DATA, members)
        index, length = stored_member(file, INDEX, members)
        start, lengths = 0, []
        for line in index_lines(file, index, length):
            full = lengths and (len(lengths) >= BLOCK_RECORDS or sum(lengths) + line["length"] > BLOCK_BYTES)
            if full or lengths and start + sum(lengths) != line["offset"]:
                yield path, data + start, lengths
                lengths = []
            if not lengths:
                start = line["offset"]
            lengths.append(line["length"])
        if lengths:
            yield path, data + start, lengths


def read_block(path: str, start: int, lengths: list[int]) -> Iterator[dict]:
    with Ranges(path) as file:
        data, at = file.read(start, sum(lengths)), 0
    for n in lengths:
        yield parse_record(zlib.decompress(data[at : at + n], wbits=31))
        at += n


# ---- jobs --------------------------------------------------------------------

def with_first(pages: DataFrame, shelf: Shelf) -> DataFrame:
    """(page_id, url, html, refers_to): of copies, the least id with the same payload; else null.

    Only groups of copies are looked up; their number is counted, and beyond BROADCAST_ROWS the
    pages shuffle, copies of a large group spread."""
    html = F.coalesce("html", F.lit(""))
    keys = {"digest": F.unhex(F.sha1(html)), "size": F.octet_length(html)}
    groups = pages.select("page_id", *[e.alias(c) for c, e in keys.items()]).groupBy(*keys).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = shelf.put(groups.filter("n > 1 and first is not null"), "copies")
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = pages.select("page_id", "url", html.alias("html"), *[e.alias(c) for c, e in keys.items()])
    if count <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(groups.drop("n")), list(keys), "left")
    else:
        spread = rows.withColumn("__row", F.xxhash64("page_id", "url"))
        rows = lookup_counted(spread, groups, list(keys), "first", "n", total, "__row")
    return rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) as packages below folder, each task its own;
    gives (path, records, size) of those that are whole. Each evaluation writes anew: keep the result."""
    arrow_rows(pages.sparkSession)
    schema = "path string, records long, size long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                package = package or Package(folder)
                payload = (html or "").encode()
                package.add(page_id, warc_record(page_id, url, payload, payload_digest(payload), refers_to))
                if package.full():
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "size"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, schema)


def read_archives(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """(record_type, record_id, url, payload_digest, payload_bytes, payload, refers_to) of all
    records of the packages (path, size: bytes of records); payload is null for revisits.

    Paths and blocks are few bytes that stand for many: the number of their partitions follows
    what they stand for, not their own size, by which adaptive execution would merge them."""
    n, size = packages.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    locators, readers = min(max(n, 1), MOST_TASKS), min(max(-(-size // TASK_BYTES), 1), MOST_TASKS)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for block in package_blocks(path):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(block, (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["path", "start", "lengths"])

    fields = {"record_type": "type", "record_id": "id", "url": "url", "payload_digest": "digest", "payload_bytes": "payload_bytes", "payload": "payload", "refers_to": "refers_to"}
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths")), strict=True):
                rows = list(read_block(path, start, lengths))
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(fields.values(), types, strict=True)], list(fields))

    paths = packages.select("path").repartition(locators, "path")
    blocks = paths.mapInArrow(locate, "path string, start long, lengths array<long>").repartition(readers, "path", "start")
    schema = "record_type string, record_id string, url string, payload_digest string, payload_bytes long, payload binary, refers_to string"
    return blocks.mapInArrow(fetch, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url): a row for each page, as its
    archive's record says; pages are archived first, copies as revisits."""
    spark = pages.sparkSession
    shelf = Shelf(spark, "warc")
    written = shelf.put(write_archives(with_first(pages, shelf), f"{shelf.root}/packages"), "written")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    records = read_archives(spark, written)
    return records.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), "url")
