"""WARC archives as a PySpark data source, written and read.

Writing: every task writes archives of its own, rolled at a size; the driver
lists those of the tasks that succeeded in a manifest, so what a lost executor
or a repeated attempt left behind is never read. Each record is a gzip member of
its own whose header says how long the member is.

Reading: the driver plans a partition for each archive. Filters on header
columns are pushed down: a task inflates a member only up to the end of its
headers, tests them, and jumps to the next member when the record isn't wanted
or its payload isn't asked for (option ``payload`` = false).

Archives from elsewhere may be plain, may hold several records in a member, and
records of any type: each but a revisit has its payload. Reading goes through a
buffer, so small records that lie side by side share a request.

Options: ``path``; for reading ``payload`` and ``damaged``: ``fail`` (the default)
raises an error that names the archive and the place, ``skip`` gives the records
before the damage and goes on with the next archive; for writing ``roll`` (bytes).
Paths are URIs that pyarrow's file systems know: file, hdfs, s3, gs.

Defined cases for ``archive_pages``: a null html is an empty payload; a null url
has no target header; a null id is written as ``null`` and read back as null;
rows that repeat an id and a payload are alike, all response or all revisit;
control characters in a url are percent-encoded; an empty table gives archives
without records; other columns may have any names. ``payload_bytes`` is the length
of a payload, read or not; of a revisit what its HTTP headers say, else null.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.skew import frequent, salted_join
from ..session import discard, materialise, scratch_path

ROLL = 64 << 20
MANIFEST = "_archives.json"
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
    "payload_bytes bigint, payload binary"
)
#: Columns that headers alone decide.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}


def file_system(uri: str):
    """The file system of a URI or a local path, and the path in it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field ``LG`` holds the member's own length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", 12) + b"LG" + struct.pack("<HQ", 8, len(body) + 32)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit, which has only HTTP headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe=_PRINTABLE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PRINTABLE = "".join(chr(c) for c in range(33, 127))


@dataclass
class Archives(WriterCommitMessage):
    names: list[str]
    records: int


class WarcWriter(DataSourceWriter):
    """Rows: record_type, record_id, target_uri, payload_digest, refers_to, payload."""

    def __init__(self, options: dict):
        self.path, self.roll = options["path"], int(options.get("roll", ROLL))

    def write(self, rows: Iterator) -> Archives:
        fs, top = file_system(self.path)
        fs.create_dir(top, recursive=True)
        names, out, size, n = [], None, 0, 0
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
        for r in rows:
            if out is None:
                names.append(f"{uuid.uuid4().hex}.warc.gz")
                out, size = fs.open_output_stream(f"{top}/{names[-1]}", compression=None), 0
                out.write(member(info % (str(uuid.uuid4()).encode(), DATE.encode())))
            data = member(record(r.record_type, r.record_id, r.target_uri, bytes(r.payload or b""), r.payload_digest, r.refers_to))
            out.write(data)
            size, n = size + len(data), n + 1
            if size >= self.roll:
                out.close()
                out = None
        if out:
            out.close()
        return Archives(names, n)

    def commit(self, messages: list) -> None:
        fs, top = file_system(self.path)
        fs.create_dir(top, recursive=True)
        names = sorted(x for m in messages if m for x in m.names)
        with fs.open_output_stream(f"{top}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        """Without a manifest nothing that was written is read."""


@dataclass
class Archive(InputPartition):
    name: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.skip = options.get("damaged", "fail").lower() == "skip"
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((column, "some", ()))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        from pyarrow.fs import FileSelector, FileType

        fs, top = file_system(self.path)
        if fs.get_file_info(f"{top}/{MANIFEST}").type == FileType.File:
            with fs.open_input_stream(f"{top}/{MANIFEST}") as f:
                names = json.loads(f.read())
        else:  # archives from elsewhere
            names = sorted(x.base_name for x in fs.get_file_info(FileSelector(top)) if x.base_name.endswith((".warc", ".warc.gz")))
        return [Archive(x) for x in names]

    def read(self, part: Archive | None) -> Iterator[tuple]:
        if part is None:  # what Spark asks for where no partition is planned
            return
        fs, top = file_system(self.path)
        with fs.open_input_file(f"{top}/{part.name}") as f:
            try:
                yield from self.rows(records(f, part.name.endswith(".gz")))
            except (ValueError, zlib.error) as x:
                if not self.skip:
                    raise ValueError(f"{self.path}/{part.name} is damaged near byte {f.tell()}: {x}") from None

    def rows(self, found: Iterator) -> Iterator[tuple]:
        for headers, size, block_of in found:
            own = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
            if own["payload_digest"]:
                own["payload_digest"] = own["payload_digest"].removeprefix("sha1:")
            if not all(own[c] in values if how == "in" else own[c] is not None for c, how, values in self.wanted):
                continue
            again = own["record_type"] == "revisit"
            whole = self.payload and not again
            if "application/http" in headers.get("content-type", ""):
                head, gap, body = block_of(whole).partition(b"\r\n\r\n")
                size -= len(head) + len(gap)
                if again:
                    said = (x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    size = next((int(x) for x in said if x.isdigit()), None)
            else:
                body = block_of(True) if whole else b""
                size = None if again else size
            yield (*own.values(), size, body if whole else None)


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Stream:
    """Bytes that come piece by piece; ``have`` are those read and not yet passed."""

    def __init__(self):
        self.have = bytearray()

    def more(self) -> bool:
        """Read on; False at the end."""
        raise NotImplementedError

    def need(self, n: int) -> bool:
        while len(self.have) < n:
            if not self.more():
                return False
        return True

    def find(self, mark: bytes, most: int) -> int:
        """Where the mark begins in the next ``most`` bytes, -1 if it doesn't."""
        at = 0
        while True:
            k = self.have.find(mark, at, most)
            if k >= 0 or len(self.have) >= most:
                return k
            at = max(0, len(self.have) - len(mark) + 1)
            if not self.more():
                return -1

    def skip(self, n: int) -> None:
        while n > len(self.have):
            n -= len(self.have)
            self.have.clear()
            if not self.more():
                return
        del self.have[:n]


#: Bytes of a request behind a jump, and of those that follow it.
READ, READ_ON = 64 << 10, 1 << 20
#: Bytes that are inflated at a time.
SLICE = 4 << 10


class Plain(Stream):
    """A file. ``at`` is where ``have`` begins in it."""

    def __init__(self, f):
        super().__init__()
        self.f, self.at, self.end, self.ask = f, 0, f.size(), READ

    def more(self) -> bool:
        got = self.f.read(self.ask) if self.at + len(self.have) < self.end else b""
        self.ask = READ_ON
        self.have += got
        return bool(got)

    def skip(self, n: int) -> None:
        if n <= len(self.have):
            del self.have[:n]
        else:
            self.f.seek(min(self.end, self.at + n))
            self.have.clear()
            self.ask = READ
        self.at = min(self.end, self.at + n)

    def slice(self) -> bytes:
        self.need(1)
        out = bytes(self.have[:SLICE])
        self.skip(len(out))
        return out

    def back(self, out: bytes) -> None:
        """Give back the end of a slice."""
        self.have[:0] = out
        self.at -= len(out)


class Member(Stream):
    """What a gzip member holds."""

    def __init__(self, plain: Plain):
        super().__init__()
        self.plain, self.z, self.last = plain, zlib.decompressobj(31), b""

    def more(self) -> bool:
        n = len(self.have)
        while not self.z.eof and len(self.have) == n:
            raw = self.z.unconsumed_tail
            if not raw:
                raw = self.last = self.plain.slice()
                if not raw:
                    raise ValueError("it ends within a record")
            self.have += self.z.decompress(raw, 64 << 10)
        return len(self.have) > n

    def leave(self, to: int | None) -> None:
        """Put the file where the next member begins."""
        if to is None:
            while not self.z.eof:
                self.have.clear()
                if not self.more():
                    break
            self.plain.back(self.z.unused_data)
        elif to >= self.plain.at:
            self.plain.skip(to - self.plain.at)
        else:
            self.plain.back(self.last[to - self.plain.at :])


def _in_stream(s: Stream) -> Iterator:
    while True:
        while s.need(2) and s.have[:2] == b"\r\n":
            s.skip(2)
        if not s.need(1):
            return
        top = s.find(b"\r\n\r\n", 1 << 20)
        if top < 0 or s.have[:5] != b"WARC/":
            raise ValueError("no WARC record where one must be")
        headers = _headers(bytes(s.have[:top]))
        size = int(headers.get("content-length", ""))
        s.skip(top + 4)

        def block(whole: bool, size=size) -> bytes:
            if whole:
                if not s.need(size):
                    raise ValueError("it ends within a record")
                return bytes(s.have[:size])
            k = s.find(b"\r\n\r\n", size)
            return bytes(s.have[: k + 4 if k >= 0 else size])

        yield headers, size, block
        s.skip(size)


def records(f, packed: bool) -> Iterator:
    """Headers of each record, its block's size, and a function that gives the block, or only its beginning up to a blank line.

    The function must be called before the next record is asked for; if it
    isn't, the block is skipped, in a member that names its length without inflating it.
    """
    plain = Plain(f)
    if not packed:
        yield from _in_stream(plain)
        return
    while plain.need(1):
        start = plain.at
        if plain.need(24) and plain.have[:3] != b"\x1f\x8b\x08":
            raise ValueError("no gzip member where one must be")
        own = plain.have[3] == 4 and plain.have[12:14] == b"LG" if len(plain.have) >= 24 else False
        to = start + struct.unpack("<Q", plain.have[16:24])[0] if own else None
        member_ = Member(plain)
        for found in _in_stream(member_):
            yield found
            if to is not None:  # a record of its own
                break
        member_.leave(to)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _urn(key) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def _unurn(column: str) -> F.Column:
    return F.regexp_extract(column, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")


def archive_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write a record for each row; of equal payloads of at least ``least`` bytes one is stored, the others revisit it.

    The digests of all rows are summed up first (a hot payload is one row for each
    task); rows of a frequent digest are dealt out to join that summary.
    """
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    stored = rows.where(F.length("payload") >= least).groupBy("sha").agg(F.max("id").alias("stored"), F.count("*").alias("n"))
    stored = materialise(spark, stored, "digests")
    hot = frequent(stored, "sha", "n", stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    known = salted_join(rows, stored.drop("n"), ["sha"], hot, ["id"], "left").withColumn("revisit", (F.length("payload") >= least) & ~F.col("id").eqNullSafe(F.col("stored")))
    out = known.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        _urn(F.col("id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        _base32(F.col("sha")).alias("payload_digest"),
        F.when(F.col("revisit"), _urn(F.col("stored"))).alias("refers_to"),
        "payload",
    )
    out.write.format("warc").mode("append").option("path", path).save()
    discard(stored)


def _base32(hexa: F.Column) -> F.Column:
    """Base32 of 40 hexadecimal digits: eight groups of five digits, four letters each."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.lpad(F.conv(F.conv(F.substring(hexa, g * 5 + 1, F.lit(5)), 16, 10), 10, 32), 4, "0"))
    return F.translate(F.array_join(groups, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def read_archives(spark: SparkSession, path: str, payload: bool = True, damaged: str = "fail") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload)).option("damaged", damaged).load()


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    archive_pages(pages, path, key, url, html, least)
    back = read_archives(spark, path).where(F.col("record_type").isin("response", "revisit"))
    stored = F.col("payload").isNotNull()
    return back.select(
        _unurn("record_id").alias(key),
        F.when(stored, F.length("payload")).otherwise(F.col("payload_bytes")).cast("bigint").alias("payload_bytes"),
        F.when(stored, _base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        _unurn("refers_to").alias("refers_to"),
    )
