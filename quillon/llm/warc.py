"""Web archives (WARC) in ZIP packages: written in tasks, read back by ranges without unpacking.

A package holds stored (not compressed) members only: ``archive/data.warc.gz``, each record a gzip member of its own, and
``indexes/index.jsonl`` with the place of each record in it. So a reader needs the package's directory, the index, and the
bytes of the records that it wants.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_bytes

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
DATE = "2026-01-01T00:00:00Z"


# --- ZIP packages ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # where its local header begins


def _wide(extra: bytes, fields: list[int]) -> list[int]:
    """Of the fields (size, packed size, place) those that are full come from the ZIP64 extra field, in that order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return [next(wide) if f == 0xFFFFFFFF else f for f in fields]
        at += 4 + length
    return fields


def directory(read, size: int) -> dict[str, Member]:
    """The members of a package. ``read(start, n)`` gives bytes of it, ``size`` is its length.

    The end record is searched from the end; where a field of it is full, the ZIP64 end record has the true one.
    """
    back = min(size, 22 + 0xFFFF)
    tail = read(size - back, back)
    at = tail.rfind(END, 0, max(0, back - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (length, start):
        place = size - back + at - 20
        locator = read(place, 20)
        if locator[:4] != LOCATOR:
            raise ValueError("no ZIP64 locator")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of the directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    listing, at, found = read(start, length), 0, {}
    for _ in range(count):
        if listing[at : at + 4] != CENTRAL:
            raise ValueError("a ZIP directory that is cut off")
        flags, method = struct.unpack_from("<HH", listing, at + 8)
        packed, full, names, extras, comments = struct.unpack_from("<IIHHH", listing, at + 20)
        header = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, header = _wide(listing[at + 46 + names : at + 46 + names + extras], [full, packed, header])
        found[name] = Member(name, method, packed, header)
        at += 46 + names + extras + comments
    return found


def stored_range(read, member: Member) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many there are."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members are read by ranges")
    head = read(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError("no local ZIP header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26)), member.size


# --- Records --------------------------------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header's value: a URI without control characters and spaces."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """A response record, or a revisit record with the response's HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = lambda x: f"<urn:page:{'' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {uri(page)}", f"WARC-Date: {DATE}"]
    head += [] if url is None else [f"WARC-Target-URI: {_line(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    head += [f"WARC-Refers-To: {uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Fields of a record's header, the length that its HTTP header tells, and its payload (None in a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)[1])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != said or digest_of(payload) != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not the one that was written")
    page = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">") if name in fields else None
    return {"page": page("warc-record-id") or None, "url": fields.get("warc-target-uri"), "kind": kind, "bytes": said, "digest": digest, "refers": page("warc-refers-to") or None, "payload": payload if kind == "response" else None}


# --- Writing --------------------------------------------------------------------------------------------------------


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that driver and executors share, by its URI: file, hdfs, s3, gs, abfs."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Package:
    """A package being written: records go straight to the file, their places to the index."""

    def __init__(self, store: fs.FileSystem, path: str):
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.path, self.records, self.at = path, 0, 0
        self.sink = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index = io.BytesIO()

    def add(self, raw: bytes) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self.data.write(packed)
        self.index.write(json.dumps({"offset": self.at, "length": len(packed)}).encode() + b"\n")
        self.at, self.records = self.at + len(packed), self.records + 1

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue())
        self.zip.close()
        self.sink.close()
        return self.path, self.records, self.at


def with_kinds(pages: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """page, url, body and refers: the largest page of an equal payload, null for pages that are responses themselves.

    Groups are found by SHA-256 of the payload over (page, digest) alone, partially aggregated; only those of several rows
    are joined back. They are a written table, so both sides of the join are exchanged and Spark's skew handling can cut
    a payload that a third of all pages have.
    """
    rows = pages.withColumn("sha", F.sha2("body", 256))
    groups = rows.where(F.octet_length("body") >= least).groupBy("sha").agg(F.max("page").alias("last"), F.count("*").alias("n"))
    several = scratch.table(groups.where("n > 1").select("sha", "last"))
    joined = rows.join(several, "sha", "left")
    return joined.select("page", "url", "body", F.when(~F.col("page").eqNullSafe(F.col("last")), F.col("last")).alias("refers"))


def write_archives(pages: DataFrame, path: str, scratch: Scratch, least: int = 0, archive_bytes: int = 256 << 20, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row to packages below ``path``, a URI that all executors reach; returns them (file, records, bytes).

    Of payloads that are equal and have ``least`` bytes or more, the one of the largest key is a response record, the
    others revisit it. A null html is an empty payload; a null url is left out. Repeated rows of the largest key are all
    responses. A null key counts as smaller than all others; where a payload has null keys only, all are responses. An
    empty table gives no packages.

    Each task streams into packages of about ``archive_bytes``, under names of its own attempt. The returned table is
    what Spark commits of the attempts: packages of lost or repeated tasks aren't in it, and nobody reads them. Memory is
    a slice of rows and the index of a package (40 bytes a record).
    """
    store_uri = path.rstrip("/")
    named = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).cast("binary").alias("body"))

    @by_bytes(2)
    def run(batches):
        store, folder = _folder(store_uri)
        task, package, done = TaskContext.get(), None, []
        for batch in batches:
            for page, u, body, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    package = _Package(store, f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.wacz")
                package.add(record(page, u, body, refers, refers is not None))
                if package.at >= archive_bytes:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "records", "bytes"])

    return scratch.table(with_kinds(named, least, scratch).mapInArrow(run, "file string, records long, bytes long"))


# --- Reading --------------------------------------------------------------------------------------------------------


def _ranges(read, size: int):
    """(offset, length) of each record of a package, offsets within the package."""
    members = directory(read, size)
    start, _ = stored_range(read, members[DATA])
    for line in io.BytesIO(read(*stored_range(read, members[INDEX]))):
        entry = json.loads(line)
        yield start + entry["offset"], entry["length"]


def read_archives(archives: DataFrame, path: str, run_bytes: int = 4 << 20, task_bytes: int = 16 << 20, key: str = "page_id") -> DataFrame:
    """The records of packages (file, bytes): key, url, record_type, payload_bytes, payload_digest, refers_to and payload.

    First the packages' directories and indexes are read and records that stand together are dealt out as runs of about
    ``run_bytes``; then each run is one range read, in any task, of which there are so many that one gets about
    ``task_bytes``: the rows of runs are small and tell nothing of their records. Payloads of responses are checked against their digests;
    a revisit has no payload, its length is the one that its HTTP header tells. Nothing is extracted to a disk. An empty
    table of packages gives an empty table.
    """
    uri = path.rstrip("/")

    def listed(batches):
        store, _ = _folder(uri)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_file(file) as source:
                    starts, lengths, last, total = [], [], -1, 0
                    for at, n in _ranges(lambda a, k: source.read_at(k, a), source.size()):
                        if at != last or total + n > run_bytes:
                            starts.append(at)
                            lengths.append([])
                            total = 0
                        lengths[-1].append(n)
                        last, total = at + n, total + n
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["file", "start", "lengths"])

    def run(batches):
        store, _ = _folder(uri)
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for file, start, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(file) as source:
                    packed = memoryview(source.read_at(sum(lengths), start))
                ends = list(accumulate(lengths))
                rows = [parsed(gzip.decompress(packed[end - n : end])) for end, n in zip(ends, lengths)]
                out = [[r[name] for r in rows] for name in ("page", "url", "kind", "bytes", "digest", "refers", "payload")]
                out[0], out[5] = list(map(number, out[0])), list(map(number, out[5]))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[key, "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    runs = archives.select("file").mapInArrow(listed, "file string, start long, lengths array<long>")
    tasks = (archives.agg(F.sum("bytes")).first()[0] or 0) // task_bytes + 1
    dealt = runs.repartition(tasks, "file", "start")
    return dealt.mapInArrow(run, f"`{key}` long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def packed_and_read(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) into the shared folder, and read their records back."""
    scratch = Scratch(spark)
    path = f"{scratch.root}/archives"
    return read_archives(write_archives(pages, path, scratch, least), path)
