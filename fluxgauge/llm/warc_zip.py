"""WARC records in ZIP packages: a writer, and a reader that works by ranges of bytes.

A package is a ZIP archive with two stored members: ``archive/data.warc.gz``, one gzip member per
record, and ``indexes/index.cdxj``, a line per record with its place. The reader fetches the end
of the archive, its central directory (ZIP64 included) and the index, and deals ranges of records
to tasks, which read just those bytes; nothing is extracted.

Packages lie in the shared folder and are reached through Arrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.llm.tables import Stages
from fluxgauge.session import scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed when its records reach this size, a range of records likewise.
PACKAGE_BYTES = 1 << 30
RANGE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"

_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = (
    b"PK\x05\x06",
    b"PK\x06\x06",
    b"PK\x06\x07",
    b"PK\x01\x02",
    b"PK\x03\x04",
)


@dataclass
class Member:
    """A stored member: where its bytes begin in the archive, and how many they are."""

    name: str
    start: int
    size: int


def directory(file) -> list[Member]:
    """Stored members of the archive, from its central directory; compressed ones are left out."""
    total = file.size()
    tail_at = max(0, total - 65_557 - 20)
    tail = file.read_at(total - tail_at, tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    count, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == _LOCATOR64:
        (at,) = struct.unpack("<Q", tail[locator + 8 : locator + 16])
        record = file.read_at(56, at)
        if record[:4] != _END64:
            raise ValueError("not a ZIP archive: broken ZIP64 record")
        count, size, start = struct.unpack("<QQQ", record[32:56])
    entries, at, members = file.read_at(size, start), 0, []
    for _ in range(count):
        if entries[at : at + 4] != _ENTRY:
            raise ValueError("not a ZIP archive: broken central directory")
        (method,) = struct.unpack("<H", entries[at + 10 : at + 12])
        packed, plain, name_len, extra_len, note_len = struct.unpack("<IIHHH", entries[at + 20 : at + 34])
        (local,) = struct.unpack("<I", entries[at + 42 : at + 46])
        name = entries[at + 46 : at + 46 + name_len].decode("utf-8", "replace")
        extra = entries[at + 46 + name_len : at + 46 + name_len + extra_len]
        at += 46 + name_len + extra_len + note_len
        while len(extra) >= 4:
            kind, length = struct.unpack("<HH", extra[:4])
            wide = extra[4 : 4 + length]
            extra = extra[4 + length :]
            if kind != 1:
                continue
            # The 64-bit fields stand for those that are full, in this order.
            if plain == 0xFFFFFFFF:
                (plain,), wide = struct.unpack("<Q", wide[:8]), wide[8:]
            if packed == 0xFFFFFFFF:
                (packed,), wide = struct.unpack("<Q", wide[:8]), wide[8:]
            if local == 0xFFFFFFFF:
                (local,) = struct.unpack("<Q", wide[:8])
        if method == 0:
            head = file.read_at(30, local)
            if head[:4] != _LOCAL:
                raise ValueError(f"not a ZIP archive: no local header of {name}")
            own_name, own_extra = struct.unpack("<HH", head[26:30])
            members.append(Member(name, local + 30 + own_name + own_extra, plain))
    return members


def _header_text(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC response record, or a revisit record without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_header_text(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(raw: bytes) -> bytes:
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html, refers_to)``; returns ``(package, records)``, lazily.

    Every attempt of a task writes packages of its own names. Those of failed attempts are not in
    the result, and so never read.
    """

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        rows = (row for batch in batches for piece in batch_rows(batch) for row in piece)
        row = next(rows, None)
        while row is not None:
            name = f"{uuid.uuid4().hex}.wacz"
            lines, at = [], 0
            with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                with package.open(DATA, "w", force_zip64=True) as data:
                    while row is not None and at < PACKAGE_BYTES:
                        packed = _packed(record(*row))
                        data.write(packed)
                        lines.append((at, len(packed)))
                        at += len(packed)
                        row = next(rows, None)
                with package.open(INDEX, "w", force_zip64=True) as index:
                    for offset, length in lines:
                        index.write(json.dumps({"offset": offset, "length": length}).encode() + b"\n")
            yield pa.RecordBatch.from_pydict({"package": [name], "records": [len(lines)]})

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "package string, records long")


def batch_rows(batch: pa.RecordBatch, size: int = 256) -> Iterator[list[tuple]]:
    """Rows (id, url, payload, refers_to) of a batch, some at a time."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size).to_pydict()
        yield [
            (page_id, url, (html or "").encode(), refers)
            for page_id, url, html, refers in zip(part["page_id"], part["url"], part["html"], part["refers_to"])
        ]


def ranges(packages: DataFrame, folder: str) -> DataFrame:
    """``(package, start, length)``: runs of whole records, from the packages' own indexes."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("package").to_pylist():
                found = {"package": [], "start": [], "length": []}
                with store.open_input_file(f"{base}/{name}") as file:
                    members = {m.name: m for m in directory(file)}
                    data, index = members[DATA], members[INDEX]
                    first = length = 0
                    for line in file.read_at(index.size, index.start).splitlines():
                        place = json.loads(line)
                        if length and length + place["length"] > RANGE_BYTES:
                            for key, value in zip(found, (name, data.start + first, length)):
                                found[key].append(value)
                            first, length = place["offset"], 0
                        length += place["length"]
                    if length:
                        for key, value in zip(found, (name, data.start + first, length)):
                            found[key].append(value)
                yield pa.RecordBatch.from_pydict(found, schema=pa.schema([("package", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    return packages.select("package").mapInArrow(run, "package string, start long, length long")


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(raw: bytes) -> tuple[int | None, str, str, int, str, int | None, bytes]:
    """(page id, url, type, payload size, payload digest, refers to, payload) of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    named = _headers(head)
    http, _, payload = block[: int(named["content-length"])].partition(b"\r\n\r\n")
    kind, stated = named["warc-type"], named["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != stated:
        raise ValueError(f"payload of {named['warc-record-id']} differs from its digest")
    size = int(_headers(http)["content-length"])
    refers = _page(named["warc-refers-to"]) if "warc-refers-to" in named else None
    return _page(named["warc-record-id"]), named["warc-target-uri"], kind, size, stated, refers, payload


_FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_records(places: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records in ``places(package, start, length)``, each range read on its own."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        names = [part.split()[0] for part in (_FIELDS + ", payload binary").split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        wanted = len(names) if payload else len(names) - 1
        schema = pa.schema(list(zip(names, types))[:wanted])
        for batch in batches:
            for name, start, length in zip(*(batch.column(c).to_pylist() for c in ("package", "start", "length"))):
                with store.open_input_file(f"{base}/{name}") as file:
                    rest = file.read_at(length, start)
                rows = []
                while rest:
                    press = zlib.decompressobj(31)
                    rows.append(parse(press.decompress(rest))[:wanted])
                    rest = press.unused_data
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return places.mapInArrow(run, _FIELDS + (", payload binary" if payload else ""))


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: of equal payloads of at least ``least_bytes``, the largest page.

    Rows with the largest id, and rows without an id, refer to nothing. Null payloads are empty.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    named = named.withColumn("key", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha2("html", 256))))
    # The digests of groups, a row each, decide before any page moves.
    keys = named.where("key is not null").select("page_id", "key")
    groups = keys.groupBy("key").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last")
    return named.join(groups.select("key", "last"), "key", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to")
    )


def archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all pages below ``folder``; returns the stored list of packages, ``(package, records)``.

    An empty table gives no packages. Repeated rows become records each; other columns are left.
    """
    return Stages(pages.sparkSession).put(write_packages(with_references(pages, least_bytes), folder))


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, payload: bool = False) -> DataFrame:
    """Write the pages as packages in the shared folder and read every record back."""
    folder = scratch_path(spark, "warc")
    packages = archive(pages, folder, least_bytes)
    places = Stages(spark).put(ranges(packages, folder))
    return read_records(places.repartition(max(spark.sparkContext.defaultParallelism, 8)), folder, payload)
