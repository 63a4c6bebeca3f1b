"""Converter of legacy ARC archives to WARC.

An ARC file begins with a version block that names the fields of its header
lines: five in version 1, ten in version 2. Each record is such a line, as many
bytes as the line declares, and a line end. The converter makes of each a WARC
record: an identifier that follows from the record, the 14-digit date in
ISO 8601, the type, and SHA-1 digests of block and payload. Of records with
equal payloads the one of largest page id stays a response; the others become
revisit records that refer to it and hold the HTTP header alone.

Files are gzip, one member a record, in the cluster's shared folder; each is
written under a temporary name and then moved. Every attempt of a task has names
of its own, and the names of the attempts that counted are written beside the
files: readers take those alone, so what a lost attempt leaves is never read. A
file is rolled at ROLL bytes, which bounds what a reader holds at once.

Defined results: null html is an empty payload; empty payloads are equal ones;
a null or empty url becomes ``unknown:``; white space and control characters in
a url are percent-encoded; rows of equal page id and payload are all responses;
a row with a null page_id refers to the largest of its group or, if none has an
id, is a response; payloads of any length are one record; columns other than
page_id, url and html are ignored; an empty table gives no rows. Torn records
raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, shared_dir

ROLL = 8 << 20
BROADCAST_GROUPS, BROADCAST_FILES = 100_000, 100_000
NAMESPACE = uuid.UUID("6f1d6a52-53f7-5c39-9e0b-9a1c1f3f7a10")
#: Fixed values of the formats.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes


def safe_url(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "unknown:"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 lexiforge\n{' '.join(FIELDS[version])}\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, status: int = 200, offset: int = 0, name: str = "-") -> bytes:
    extra = "" if version == 1 else f" {status} {hashlib.md5(block).hexdigest()} - {offset} {name}"
    return f"{url} {ip} {date} {mime}{extra} {len(block)}\n".encode() + block + b"\n"


def members(data: bytes) -> Iterator[bytes]:
    """The inflated gzip members of a file, one at a time; bytes that aren't gzip are one member."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        step, parts = 1 << 20, []
        while not d.eof:
            if at >= len(data):
                raise ValueError("a gzip member is torn")
            chunk = data[at : at + step]
            parts.append(d.decompress(chunk))
            at += len(chunk) - len(d.unused_data)
        yield b"".join(parts)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, plain or gzip, after its version block, by their declared lengths."""
    version, names = None, FIELDS[1]
    for part in members(data):
        at = 0
        while at < len(part):
            end = part.find(b"\n", at)
            if end < 0:
                raise ValueError("an ARC header line is torn")
            line = part[at:end].decode("utf-8", "replace").rstrip("\r")
            if not line:
                at = end + 1
                continue
            if version is None:
                if not line.startswith("filedesc://"):
                    raise ValueError("an ARC file begins with its version block")
                length = int(line.rsplit(" ", 1)[1])
                head = part[end + 1 : end + 1 + length].decode("utf-8", "replace").split("\n")
                version, names = int(head[0].split()[0]), head[1].split()
                if version not in FIELDS or names[0] != "URL" or names[-1] != "Archive-length":
                    raise ValueError(f"unknown ARC version block: {head[:2]}")
            else:
                values = line.rsplit(" ", len(names) - 1)
                if len(values) != len(names) or not values[-1].isdigit():
                    raise ValueError(f"bad ARC header line: {line[:200]!r}")
                length = int(values[-1])
                block = part[end + 1 : end + 1 + length]
                if len(block) != length:
                    raise ValueError("an ARC record is shorter than it declares")
                yield ArcRecord(version, dict(zip(names, values)), block)
            at = end + 1 + length + 1


def http_block(page_id, payload: bytes) -> bytes:
    known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload); a block without a header is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, sep, payload = block.partition(b"\r\n\r\n")
    return head + sep, payload


def page_id_of(head: bytes) -> int | None:
    m = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(m[1]) if m else None


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """A 14-digit date (shorter ones are filled up) in ISO 8601."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, plain or gzip, by their declared lengths."""
    for part in members(data):
        at = 0
        while at < len(part):
            end = part.find(b"\r\n\r\n", at)
            if end < 0 or not part.startswith(b"WARC/", at):
                raise ValueError("a WARC record is torn")
            headers = dict(line.split(": ", 1) for line in part[at:end].decode().split("\r\n")[1:])
            length = int(headers["Content-Length"])
            block = part[end + 4 : end + 4 + length]
            if len(block) != length:
                raise ValueError("a WARC record is shorter than it declares")
            yield headers, block
            at = end + 4 + length + 4


def convert(r: ArcRecord, refers_to: str | None = None, own_id: str | None = None) -> bytes:
    """The WARC record of an ARC record; ``refers_to``: of the record that holds its payload."""
    head, payload = split_http(r.block)
    block = r.block if refers_to is None else head
    http = bool(head)
    headers = {
        "WARC-Type": "revisit" if refers_to is not None else "response" if http else "resource",
        "WARC-Record-ID": own_id or record_id(f"{r.fields['URL']} {r.fields['Archive-date']} {hashlib.sha1(r.block).hexdigest()}"),
        "WARC-Date": iso_date(r.fields["Archive-date"]),
        "WARC-Target-URI": r.fields["URL"],
        "WARC-IP-Address": r.fields["IP-address"],
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "Content-Type": "application/http; msgtype=response" if http else r.fields["Content-type"],
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to}
    return warc_record(headers, block)


class ArchiveWriter:
    """Rolls gzip files in a folder that all executors share."""

    def __init__(self, folder: str, suffix: str, first):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.suffix, self.first, self.serial, self.out, self.made = suffix, first, 0, None, []
        self.attempt = uuid.uuid4().hex

    def _open(self) -> None:
        task = TaskContext.get()
        self.name = f"part-{task.partitionId() if task else 0:06d}-{self.serial:05d}-{self.attempt}{self.suffix}"
        self.temp = f"{self.root}/.{self.name}"
        self.serial, self.size, self.raw = self.serial + 1, 0, 0
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.add(self.first(self.name))

    def add(self, data: bytes) -> None:
        if self.out is None:
            self._open()
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = c.compress(data) + c.flush()
        self.out.write(packed)
        self.size, self.raw = self.size + len(packed), self.raw + len(data)
        if self.size >= ROLL:
            self.close()

    def offset(self) -> int:
        if self.out is None:
            self._open()
        return self.raw

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.out = None
            self.made.append(self.name)


def _made(*writers: ArchiveWriter) -> pa.RecordBatch:
    names = []
    for w in writers:
        w.close()
        names += w.made
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000", ip: str = "0.0.0.0") -> int:
    """Write every page as an ARC record, even page ids to version-1 files and the others to version-2 ones; gives the number of files."""

    def run(batches):
        out = {v: ArchiveWriter(folder, f".v{v}.arc.gz", lambda name, v=v: arc_version_block(v, name, date)) for v in FIELDS}
        for b in batches:
            for page_id, url, html in zip(*b.columns):
                page_id, w = page_id.as_py(), 1 if (page_id.as_py() or 0) % 2 == 0 else 2
                block = http_block(page_id, (html.as_py() or "").encode())
                at = out[w].offset()
                out[w].add(arc_record(w, safe_url(url.as_py()), ip, date, "text/html", block, offset=at, name=out[w].name))
        yield _made(*out.values())

    return _listed(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "file string"), folder)


LISTED = "_files"


def _listed(written: DataFrame, folder: str) -> int:
    """Runs the writing tasks and lists the files of the attempts that counted; gives their number."""
    written.write.parquet(f"{folder}/{LISTED}")
    return written.sparkSession.read.schema("file string").parquet(f"{folder}/{LISTED}").count()


def _files(spark, folder: str) -> DataFrame:
    """(path, content) of a folder's archives: those that are listed, or all of a folder without a list."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{LISTED}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return files
    listed = spark.read.schema("file string").parquet(f"{folder}/{LISTED}")
    listed = broadcast_if(listed, listed.count(), BROADCAST_FILES)
    return files.join(listed, F.substring_index("path", "/", -1) == F.col("file"), "left_semi")


def read_arc(spark, folder: str) -> DataFrame:
    """(page_id, digest, version, fields, block): the records of a folder of ARC files."""

    def run(batches):
        for b in batches:
            for data in b.column(1):
                rows = []
                for r in parse_arc(data.as_py()):
                    head, payload = split_http(r.block)
                    rows.append((page_id_of(head), base32_sha1(payload), r.version, list(r.fields.items()), r.block))
                    if sum(len(x[4]) for x in rows[-1:]) > ROLL or len(rows) >= 256:
                        yield _arc_rows(rows)
                        rows = []
                yield _arc_rows(rows)

    return _files(spark, folder).mapInArrow(run, "page_id long, digest string, version int, fields map<string,string>, block binary")


def _arc_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "digest", "version", "fields", "block"])


def page_record_id(page_id: int | None, fields: dict[str, str], digest: str) -> str:
    return record_id(f"page {page_id}" if page_id is not None else f"{fields['URL']} {fields['Archive-date']} {digest}")


def convert_folder(spark, arc_folder: str, warc_folder: str) -> int:
    """Convert a folder of ARC files to WARC files; gives their number.

    First the digests alone are grouped, then the records meet their groups: by
    broadcast while the groups with equal payloads are few, else by a shuffle.
    """
    records = read_arc(spark, arc_folder)
    groups = records.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null").select("digest", "response")
    groups = materialize(groups, "payload-groups")
    joined = records.join(broadcast_if(groups, groups.count(), BROADCAST_GROUPS), "digest", "left").select("page_id", "digest", "version", "fields", "block", "response")

    def run(batches):
        def info(name: str) -> bytes:
            return warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(f"info {name}"), "WARC-Date": iso_date(""), "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"software: lexiforge\r\nformat: WARC File Format 1.1\r\n")

        w = ArchiveWriter(warc_folder, ".warc.gz", info)
        for b in batches:
            for page_id, digest, version, fields, block, response in zip(*b.columns):
                page_id, response, r = page_id.as_py(), response.as_py(), ArcRecord(version.as_py(), dict(fields.as_py()), block.as_py())
                refers = record_id(f"page {response}") if response is not None and response != page_id else None
                w.add(convert(r, refers, page_record_id(page_id, r.fields, digest.as_py())))
        yield _made(w)

    return _listed(joined.mapInArrow(run, "file string"), warc_folder)


def read_warc(spark, folder: str) -> DataFrame:
    """(record_id, record_type, page_id, uri, date, digest, payload_bytes, refers_to_id): records of a folder, without warcinfo.

    Payloads are checked against their digests; payload_bytes is null for revisits.
    """

    def run(batches):
        names = ["record_id", "record_type", "page_id", "uri", "date", "digest", "payload_bytes", "refers_to_id"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for data in b.column(1):
                rows = []
                for h, block in parse_warc(data.as_py()):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    digest, whole = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] != "revisit"
                    if whole and base32_sha1(payload) != digest:
                        raise ValueError(f"payload digest of {h['WARC-Record-ID']} doesn't hold")
                    rows.append((h["WARC-Record-ID"], h["WARC-Type"], page_id_of(head), h["WARC-Target-URI"], h["WARC-Date"], digest, len(payload) if whole else None, h.get("WARC-Refers-To")))
                cols = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return _files(spark, folder).mapInArrow(run, "record_id string, record_type string, page_id long, uri string, date string, digest string, payload_bytes long, refers_to_id string")


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """Write pages as ARC, convert, read back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    arc, warc = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    empty = spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    if not write_arc(pages, arc):
        return empty
    convert_folder(spark, arc, warc)
    records = read_warc(spark, warc)
    records = materialize(records, "warc-records")
    held = records.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes")).dropDuplicates(["refers_to_id"])
    return records.join(held, "refers_to_id", "left").select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
