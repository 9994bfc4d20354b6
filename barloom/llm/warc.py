"""WARC archives as a Spark data source, written in Python.

``df.write.format("warc").mode("append").save(folder)`` writes one gzip member
for each record, with the length of the member in the gzip header's extra field
(``sl``), into files of a bounded size. ``spark.read.format("warc").load(folder)``
plans tasks over files by their size, parses the headers of a record first, and
goes on to the next member without inflating the rest where the pushed filters
reject it or the schema has no ``payload``. Members without the field, files
without compression and archives of other writers are read too.

A task writes under names of its own, and the driver lists the files of the
tasks that were committed in a manifest, so that a lost or repeated task leaves
nothing that a reader sees. Folders are reached through ``pyarrow.fs``, which
knows local and mounted folders, HDFS, S3 and GCS.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .stages import shared_dir

COLUMNS = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
# Names of the format's headers.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a writer begins a new file, and of files that a task reads.
FILE_BYTES, TASK_BYTES = 256 << 20, 128 << 20
#: Bytes read at a time, and the first bytes of a member that are inflated for its headers.
READ_BYTES, HEAD_BYTES = 4 << 20, 2048

_KINDS = {"payload_length": pa.int64(), "payload": pa.binary()}
_COMPARED = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b, StringContains: lambda a, b: b in a, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
}


def holds(one: Filter, record: dict) -> bool | None:
    """Whether a filter holds for the header values of a record; None where SQL does not know."""
    if isinstance(one, Not):
        inner = holds(one.child, record)
        return None if inner is None else not inner
    value = record[one.attribute[0]]
    if isinstance(one, IsNull):
        return value is None
    if isinstance(one, IsNotNull):
        return value is not None
    if isinstance(one, EqualNullSafe):
        return value == one.value
    return None if value is None or one.value is None else _COMPARED[type(one)](value, one.value)


def _pushed(one: Filter) -> bool:
    if isinstance(one, Not):
        return _pushed(one.child)
    return (type(one) in _COMPARED or isinstance(one, (IsNull, IsNotNull, EqualNullSafe))) and len(one.attribute) == 1 and one.attribute[0] != "payload" and not (isinstance(one, In) and None in one.value)


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _value(text: str) -> str:
    """Header values with spaces and control characters as in a URI, so that none ends a line."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in text)


def _member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own and the inflated length."""
    coder = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = coder.compress(data) + coder.flush()
    size = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(record: dict) -> bytes:
    """A record; responses and revisits carry an HTTP head with the length of the payload."""
    lines = [f"{name}: {_value(record[c])}" for c, name in HEADERS.items() if record.get(c) is not None]
    payload, kind = record.get("payload") or b"", record.get("record_type")
    head = b""
    if kind in ("response", "revisit"):
        size = len(payload) if record.get("payload_length") is None else record["payload_length"]
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        lines.append("Content-Type: application/http; msgtype=response")
        if kind == "revisit":
            lines.append(f"WARC-Profile: {PROFILE}")
            payload = b""
    lines.append(f"Content-Length: {len(head) + len(payload)}")
    return "\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n" + head + payload + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; continued lines are joined."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class _Window:
    """Bytes of a file by place; a place far ahead is sought, not read through."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def __call__(self, place: int, n: int) -> bytes:
        if place < self.at or place + n > self.at + len(self.held):
            self.file.seek(place)
            self.at, self.held = place, self.file.read(min(max(n, READ_BYTES), self.size - place))
        return self.held[place - self.at : place - self.at + n]


class _Record:
    """One record at a place of a file, whose bytes are inflated as far as asked for."""

    def __init__(self, window: _Window, place: int, packed: bool) -> None:
        self.window, self.next, self.packed, self.data = window, place, packed, b""
        self.skip = 0
        if packed:
            head = window(place, 24)
            if head[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"no gzip member at byte {place}")
            if head[3] & 4 and head[12:14] == b"sl" and struct.unpack("<H", head[14:16])[0] == 8:
                size, whole = struct.unpack("<II", head[16:24])
                if whole < 1 << 31 and size < 1 << 31:  # longer ones do not fit the field
                    self.skip = place + size
            self.coder = zlib.decompressobj(31)

    def more(self, n: int) -> bool:
        if not self.packed:
            got = self.window(self.next, min(n, self.window.size - self.next))
            self.data, self.next = self.data + got, self.next + len(got)
            return bool(got)
        if self.coder.eof:
            return False
        got = self.window(self.next, min(n, self.window.size - self.next))
        if not got:
            raise ValueError("an archive ends inside a record")
        self.data += self.coder.decompress(got)
        self.next += len(got) - len(self.coder.unused_data)
        return True

    def until(self, mark: bytes, start: int = 0) -> int:
        """Where ``mark`` is first met after ``start``."""
        while (at := self.data.find(mark, start)) < 0:
            if not self.more(HEAD_BYTES):
                raise ValueError("a record's head has no end")
        return at

    def whole(self, size: int) -> bytes:
        while len(self.data) < size and self.more(max(size - len(self.data), HEAD_BYTES)):
            pass
        if len(self.data) < size:
            raise ValueError("a record is shorter than its length")
        return self.data

    def end(self, size: int, start: int) -> int:
        """Where the next record begins; only members without a length are inflated to their end."""
        if not self.packed:
            return start + size
        if self.skip:
            return self.skip
        while self.more(READ_BYTES):
            self.data = self.data[-4:] if len(self.data) > 1 << 26 else self.data
        return self.next


def records(file: pa.NativeFile, packed: bool, filters: Sequence[Filter], payload: bool) -> Iterator[dict]:
    """The records of a file that all filters let through; of others, and without ``payload``, only heads are decoded."""
    window, place = _Window(file), 0
    while place < window.size:
        one = _Record(window, place, packed)
        cut = one.until(b"\r\n\r\n") + 4
        if not one.data.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {place}")
        named = _fields(one.data[: cut - 4])
        size = int(named["content-length"])
        record = {c: named.get(h.lower()) for c, h in HEADERS.items()}
        body = cut
        record["payload_length"] = size
        if size and named.get("content-type", "").startswith("application/http"):
            stop = one.until(b"\r\n\r\n", cut) + 4
            if stop <= cut + size:
                body = stop
                said = _fields(one.data[cut : stop - 4]).get("content-length", "")
                record["payload_length"] = int(said) if said.isdigit() and record["record_type"] == "revisit" else cut + size - body
        if all(holds(f, record) for f in filters):
            if payload:
                record["payload"] = one.whole(cut + size)[body : cut + size]
            yield record
        place = one.end(cut + size + 4, place)


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    """Reads the columns of its schema; filters on headers are applied before payloads are inflated."""

    def __init__(self, path: str, schema: StructType, task_bytes: int) -> None:
        self.path, self.schema, self.task_bytes, self.filters = path, schema, task_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if _pushed(one):
                self.filters.append(one)
            else:
                yield one

    def partitions(self) -> list[Files]:
        """Files, largest first, dealt to tasks of about ``task_bytes``."""
        store, folder = _folder(self.path)
        info = store.get_file_info(folder)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(folder, recursive=False))
        shown = [f for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and f.size]
        listed = [f for f in found if f.base_name.startswith("_manifest-")]
        if listed:
            names = set()
            for f in listed:
                with store.open_input_stream(f.path) as stream:
                    names |= set(json.loads(stream.read()))
            shown = [f for f in shown if f.base_name in names]
        tasks, rest, held = [], [], 0
        for f in sorted(shown, key=lambda f: (-f.size, f.path)):
            if held and held + f.size > self.task_bytes:
                tasks, rest, held = [*tasks, Files(rest)], [], 0
            rest, held = [*rest, (f.path, f.size)], held + f.size
        return [*tasks, Files(rest)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        kinds = pa.schema([(n, _KINDS.get(n, pa.string())) for n in names])
        store, _ = _folder(self.path)
        rows, held = [], 0
        for path, _ in partition.names:
            with store.open_input_file(path) as file:
                for record in records(file, path.endswith(".gz"), self.filters, "payload" in names):
                    rows.append(record)
                    held += len(record.get("payload") or b"") + 400
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of :data:`COLUMNS` (others are ignored, missing ones null) as records."""

    def __init__(self, path: str, overwrite: bool, level: int, file_bytes: int) -> None:
        self.path, self.overwrite, self.level, self.file_bytes = path, overwrite, level, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _folder(self.path)
        store.create_dir(folder, recursive=True)
        names, file = [], None
        for batch in iterator:
            have = [c for c in [*HEADERS, "payload_length", "payload"] if c in batch.schema.names]
            columns = {c: batch.column(c) for c in have}
            for i in range(batch.num_rows):
                if file is None or file.tell() >= self.file_bytes:
                    if file is not None:
                        file.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    file = store.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                file.write(_member(record_bytes({c: x[i].as_py() for c, x in columns.items()}), self.level))
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _folder(self.path)
        store.create_dir(folder, recursive=True)
        before = [f.path for f in store.get_file_info(pafs.FileSelector(folder))] if self.overwrite else []
        kept = [n for m in messages if m for n in m.names]
        with store.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json", compression=None) as file:
            file.write(json.dumps(kept).encode())
        for path in before:
            if path.rsplit("/", 1)[-1] not in kept:
                store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _folder(self.path)
        for name in [n for m in messages if m for n in m.names]:
            store.delete_file(f"{folder}/{name}")


class WarcSource(DataSource):
    """Options: ``path``, ``level`` (of gzip, 6), ``fileBytes`` and ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> WarcReader:
        known = {c.split()[0] for c in COLUMNS.split(", ")}
        if unknown := set(schema.names) - known:
            raise ValueError(f"no such columns in an archive: {sorted(unknown)}")
        return WarcReader(self.options["path"], schema, int(self.options.get("taskBytes", TASK_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("level", 6)), int(self.options.get("fileBytes", FILE_BYTES)))


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source known to it and filters of Python sources pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


# Digits of base 32 as Spark writes them, and as RFC 4648 does.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: 20 bits are five digits of base 16 and four of base 32."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def page_records(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records for ``pages(page_id, url, html)``, of which those that repeat a payload of at least ``least`` bytes revisit the smallest page_id with it.

    Null html is an empty payload. A null page_id counts as larger than any; of
    rows with the smallest page_id of a payload, or of a payload whose ids are
    all null, each is a response. Record ids name the page_id, so rows that
    repeat one share it. A null url has no target. Extra columns are ignored.
    Payloads move once, to meet the smallest page_id of their digest; a payload
    of very many rows is split by adaptive joins.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("payload_digest", digest(F.col("payload")))
    large = F.octet_length("payload") >= least
    firsts = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1 and first is not null").drop("_rows")
    seen = rows.join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return seen.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.when(again, urn("first")).alias("refers_to"), F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"), F.when(~again, F.col("payload")).alias("payload"),
    )


def archived(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write :func:`page_records` as archives into ``folder``."""
    registered(pages.sparkSession)
    page_records(pages, least).write.format("warc").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of archived pages, read back.

    Length and digest of responses are those of the payload read; revisits,
    which have none, are read by their heads alone.
    """
    registered(spark)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    heads = ", ".join(c for c in COLUMNS.split(", ") if not c.startswith("payload "))
    again = spark.read.format("warc").schema(heads).load(folder).where("record_type = 'revisit'")
    first = spark.read.format("warc").load(folder).where("record_type = 'response'")
    first = first.withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.concat(F.lit("sha1:"), digest(F.col("payload")))}).drop("payload")
    return first.unionByName(again).select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


def archived_pages(pages: DataFrame) -> DataFrame:
    """:func:`read_pages` of archives that ``pages`` is written to, in the shared folder."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archived(pages, folder)
    return read_pages(spark, folder)


ORACLE = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < coalesce(page_id, first + 1) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < coalesce(page_id, first + 1) THEN first END AS refers_to FROM d"""
