"""Operator 3: WARC archives as a Python data source.

Writing: each page is a record.  Of pages with equal payloads of at least
``LEAST_BYTES`` bytes the one with the largest page_id is a response and the
others are revisits that name it; smaller payloads are always responses.
Records are gzip members of their own, so a reader can begin at any of them.

Reading: ``spark.read.format("docspark-warc")`` plans one partition for each
file, or for each byte range of a large one that has an index beside it; takes
``=`` and ``IN`` predicates on record_type and on header columns down to the
records; parses a record's headers first; and skips the bytes of payloads that
no predicate or column asks for.

Nulls and empty texts have empty payloads.  Very long ones are records like
others.  Ties in page_id among equal payloads (repeated rows) are all
responses.  A null page_id makes a response without an id.  Empty tables give
no records.  Extra columns are ignored.  A file that ends within a record is an
error.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import shared

LEAST_BYTES = 1000
#: Digests of repeated payloads (some 60 bytes each) that may be broadcast; beyond, pages are joined with them by shuffle.
BROADCAST_DIGESTS = 500_000
#: Bytes of a file that one partition reads, if the file has an index.
SPLIT_BYTES = 64 << 20
#: The record's columns: name, header that it comes from.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, content_type string, payload_length bigint, payload binary"
ID = "urn:docspark:page:"
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


# ---- writing


def plan_records(pages: DataFrame, scratch: shared.Scratch, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to: what kind of record each page becomes.

    Only digests and ids are shuffled, counted before they are: digests that
    occur once, most of them, never leave the aggregation.  Pages themselves
    stay where they are unless there are too many repeated digests to
    broadcast; a digest that a third of all pages have is then many tasks'.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    sized = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    first = (
        sized.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    first = scratch.keep(first, "repeated")
    if first.count() <= BROADCAST_DIGESTS:
        joined = sized.join(F.broadcast(first), "payload_digest", "left")
    else:
        joined = shared.spread(sized, first, ["payload_digest"], "page_id", "left")
    revisit = (F.col("payload_bytes") >= least) & (F.col("page_id") < F.col("response_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, F.col("response_id")).alias("refers_to"))


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {clean(value)}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def zipped(data: bytes, level: int) -> bytes:
    """A gzip member whose header notes its own compressed size, so that readers can leap over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HBBHI", 8, 0x44, 0x53, 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def write_warc(records: DataFrame, folder: str, level: int = 1, file_bytes: int = 256 << 20) -> DataFrame:
    """Write plan_records() rows as .warc.gz files; returns (path, records, bytes), lazily.

    Every attempt of a task has files of its own, so the kept table of paths
    names each record once; files of attempts that were lost stay unread.
    """

    def write(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        held: list[bytes] = []
        size = count = number = 0

        def close():
            nonlocal size, count, number
            path = f"{folder}/part-{part:06d}-{number:04d}-{attempt}.warc.gz"
            shared.write_whole(path, held)
            row = pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})
            held.clear()
            size, count, number = 0, 0, number + 1
            return row

        for batch in batches:
            for row in batch.to_pylist():
                body = (row["html"] or "").encode("utf-8")
                own = f"{ID}{row['page_id']}" if row["page_id"] is not None else f"{ID}unknown:{part}:{number}:{count}"
                headers = [
                    ("WARC-Type", "response" if row["refers_to"] is None else "revisit"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", EPOCH),
                    ("WARC-Target-URI", row["url"] or ""), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("Content-Type", "application/http; msgtype=response"),
                    ("X-Payload-Length", str(len(body))),
                ]
                if row["refers_to"] is not None:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{ID}{row['refers_to']}>")]
                    body = b""
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
                member = zipped(record(headers, block), level)
                held.append(member)
                size += len(member)
                count += 1
                if size >= file_bytes:
                    yield close()
        if held:
            yield close()

    return records.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(write, "path string, records bigint, bytes bigint")


# ---- reading


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


def member_size(head: bytes) -> int | None:
    """The size that a member notes about itself."""
    if len(head) < 20 or head[:2] != b"\x1f\x8b" or not head[3] & 4 or head[12:14] != b"DS":
        return None
    return struct.unpack("<I", head[16:20])[0]


def parse_headers(data: bytes) -> tuple[dict[str, str], int]:
    """Headers of a record by lower-case name, and where its block begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}, end + 4


def fields(headers: dict[str, str]) -> dict[str, str | None]:
    row: dict[str, str | None] = {}
    for column, name in HEADERS.items():
        value = headers.get(name.lower())
        if value is not None and column in ("record_id", "refers_to"):
            value = value.strip("<>")
        if value is not None and column == "payload_digest":
            value = value.removeprefix("sha1:")
        row[column] = value
    return row


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = listed(options["manifest"]) if "manifest" in options else list_files(options["path"])
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.wanted.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.wanted.append((f.attribute[0], frozenset(f.value)))
            else:
                yield f

    def partitions(self):
        out = []
        for path in self.paths:
            system, place = shared.open_fs(path)
            size = system.get_file_info(place).size
            n = max(1, -(-size // SPLIT_BYTES)) if place.endswith(".warc.gz") else 1
            out += [Range(path, i * SPLIT_BYTES, size if i == n - 1 else (i + 1) * SPLIT_BYTES) for i in range(n)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range):
        if not partition.path:
            return
        rows: list[dict] = []
        held = 0
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_length", pa.int64()), ("payload", pa.binary())])
        for row in self.records(partition):
            rows.append(row)
            held += len(row["payload"] or b"")
            if len(rows) >= 4096 or held > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def accept(self, row: dict) -> bool:
        return all(row[column] in values for column, values in self.wanted)

    def records(self, partition: Range) -> Iterator[dict]:
        system, place = shared.open_fs(partition.path)
        with system.open_input_file(place) as file:
            at = first_member(file, partition.start) if partition.start else 0
            size = file.size()
            while at is not None and at < partition.stop:
                file.seek(at)
                head = file.read(4096)
                if head[:2] != b"\x1f\x8b":
                    yield from self.plain(file, at, size)
                    return
                length = member_size(head)
                if length is None:
                    yield from self.foreign(file, at)
                    return
                # headers first: enough of the member to hold them
                unpacker = zlib.decompressobj(-15)
                data = unpacker.decompress(head[20:length], 16384)
                while b"\r\n\r\n" not in data and not unpacker.eof:
                    more = unpacker.unconsumed_tail or file.read(4096)
                    if not more:
                        raise ValueError(f"{partition.path}: a file that ends within a record, at byte {at}")
                    data += unpacker.decompress(more, 16384)
                headers, begin = parse_headers(data)
                row = fields(headers)
                if self.accept(row):
                    if self.payloads and row["record_type"] != "revisit":
                        file.seek(at)
                        member = file.read(length)
                        if len(member) < length:
                            raise ValueError(f"{partition.path}: a file that ends within a record, at byte {at}")
                        unpacker = zlib.decompressobj(-15)
                        data = unpacker.decompress(member[20:])
                        crc, total = struct.unpack("<II", member[-8:])
                        if self.verify and (crc != zlib.crc32(data) or total != len(data) & 0xFFFFFFFF):
                            raise ValueError(f"{partition.path}: a damaged record at byte {at}")
                        block = data[begin : begin + int(headers["content-length"])]
                        yield row | payload_of(headers, block)
                    else:
                        yield row | {"payload_length": int(headers.get("x-payload-length", headers["content-length"])), "payload": None}
                at += length

    def plain(self, file, at: int, size: int) -> Iterator[dict]:
        """Uncompressed records: seek over the blocks that aren't wanted."""
        while at < size:
            file.seek(at)
            data = b""
            while b"\r\n\r\n" not in data:
                more = file.read(4096)
                if not more:
                    if not data.strip():
                        return
                    raise ValueError(f"a file that ends within a record's headers, at byte {at}")
                data += more
            headers, begin = parse_headers(data)
            length = int(headers["content-length"])
            row = fields(headers)
            if at + begin + length > size:
                raise ValueError(f"a file that ends within a record, at byte {at}")
            if self.accept(row):
                if self.payloads:
                    file.seek(at + begin)
                    yield row | payload_of(headers, file.read(length))
                else:
                    yield row | {"payload_length": length, "payload": None}
            at += begin + length + 4

    def foreign(self, file, at: int) -> Iterator[dict]:
        """Members of other writers, whose size is known only once they are decompressed."""
        file.seek(at)
        rest = b""
        while True:
            unpacker, data = zlib.decompressobj(31), b""
            while not unpacker.eof:
                rest = rest or file.read(1 << 16)
                if not rest:
                    if not data:
                        return
                    raise ValueError(f"a file that ends within a record of {len(data)} bytes so far")
                data += unpacker.decompress(rest)
                rest = unpacker.unused_data if unpacker.eof else b""
            headers, begin = parse_headers(data)
            row = fields(headers)
            if self.accept(row):
                found = payload_of(headers, data[begin : begin + int(headers["content-length"])])
                yield row | (found if self.payloads else found | {"payload": None})


def payload_of(headers: dict[str, str], block: bytes) -> dict:
    if headers.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    if headers.get("warc-type") == "revisit":
        return {"payload_length": int(headers.get("x-payload-length", "0")), "payload": None}
    return {"payload_length": len(block), "payload": block}


def first_member(file, start: int) -> int | None:
    """The first record that begins at or after ``start``: a member's fixed first bytes, confirmed by the next member."""
    mark, size = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x08\0DS\x04\0", file.size()
    at, window = start, 1 << 20
    while at < size:
        file.seek(at)
        data = file.read(window + 32)
        k = data.find(mark)
        while 0 <= k < window:
            length = member_size(data[k : k + 20])
            end = at + k + (length or 0)
            if length and end <= size:
                file.seek(end)
                if end == size or file.read(len(mark)) == mark:
                    return at + k
            k = data.find(mark, k + 1)
        at += window
    return None


def list_files(path: str) -> list[str]:
    from pyarrow import fs

    system, place = shared.open_fs(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    scheme = path[: len(path) - len(path.partition("://")[2])] if "://" in path else ""
    keep = sorted(f.path for f in found if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path))
    return [(f"file://{p}" if scheme.startswith("file") or not scheme else path.split(place)[0] + p) for p in keep]


def listed(folder: str) -> list[str]:
    """The paths of a kept table of write_warc()."""
    import pyarrow.parquet as pq

    system, place = shared.open_fs(folder)
    return sorted(pq.read_table(place, columns=["path"], filesystem=system)["path"].to_pylist())


class WarcDataSource(DataSource):
    """options: path (a file or folder), or manifest (a table of write_warc() whose files alone are read); payloads=false skips all payloads."""

    @classmethod
    def name(cls) -> str:
        return "docspark-warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payloads: bool = True, manifest: str | None = None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    reader = spark.read.format("docspark-warc").option("payloads", str(payloads).lower())
    return (reader.option("manifest", manifest) if manifest else reader).load(path)


def page_of(urn: Column) -> Column:
    return F.substring(urn, len(ID) + 1, 20).try_cast("bigint")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = shared.Scratch(spark, "op3")
    written = scratch.keep(write_warc(plan_records(shared.table(spark, sf_dir, "pages"), scratch), scratch.path("warc")), "written")
    if not written.limit(1).count():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    found = read_warc(spark, scratch.path("warc"), manifest=scratch.path("written"))
    response = F.col("record_type") == "response"
    # responses are digested from what was read back; revisits carry no payload, their headers say what it was
    return found.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
