"""WARC records in ZIP archives: a writer, and a reader that extracts nothing.

An archive is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``, whose
records are gzip members of their own, and ``indexes/index.jsonl``, which has the place of
each record in it. The reader finds the end of the central directory (following the ZIP64
locator where there is one), reads the directory, locates the two members through their local
headers, and then reads ranges: the index, and runs of neighbouring records of at most
``RANGE`` bytes. Runs, not archives, are dealt over the cluster.

Paths are URIs of any file system that pyarrow opens (file, hdfs, s3, gs). Archives go to a
folder that all executors share. Their names are unique to the attempt that wrote them, a file
appears under its name only when complete, and the list of archives is stored, so a repeated
task does no harm.

Records with equal payloads of at least ``MIN_REVISIT`` bytes are written once: the smallest
page_id is the response, others are revisits that refer to it.

Defined cases: a null html is an empty payload; rows with a null page_id are responses unless
a row with an id has the same payload; rows that repeat the smallest id are all responses; an
empty table writes no archive. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import new_folder, stored

MIN_REVISIT = 100
#: Date of the records where a caller names none: fixed, so that a repeated task writes the same.
DATE = "2000-01-01T00:00:00Z"
#: Bytes of records after which a writer begins another archive, and of one range read.
ARCHIVE, RANGE = 64 << 20, 4 << 20
#: Rows of pages that one task writes, about.
ROWS_PER_TASK = 4000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"

# ZIP signatures and the marks that send a reader to the ZIP64 fields.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


class ZipWriter:
    """Stored members written one after another; ZIP64 fields where a value needs them."""

    def __init__(self, out: BinaryIO, force64: bool = False):
        self.out, self.force64, self.at, self.members = out, force64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, chunks: list[bytes]) -> None:
        size, crc, start = sum(map(len, chunks)), 0, self.at
        for c in chunks:
            crc = zlib.crc32(c, crc)
        big = self.force64 or size >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        short = MAX32 if big else size
        raw = name.encode()
        head = struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra))
        self._write(head + raw + extra)
        for c in chunks:
            self._write(c)
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        first = self.at
        for raw, crc, size, start in self.members:
            fields = []
            for v in (size, size, start):
                if self.force64 or v >= MAX32:
                    fields.append(v)
            extra = struct.pack(f"<HH{len(fields)}Q", 1, 8 * len(fields), *fields) if fields else b""
            a, b = (MAX32 if self.force64 or v >= MAX32 else v for v in (size, start))
            self._write(
                struct.pack(
                    "<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 33, crc, a, a, len(raw), len(extra), 0, 0, 0, 0, b
                ) + raw + extra
            )
        length, n = self.at - first, len(self.members)
        if self.force64 or n >= MAX16 or length >= MAX32 or first >= MAX32:
            end64 = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, first))
            self._write(struct.pack("<4sIQI", LOCATOR, 0, end64, 1))
            n, length, first = MAX16, MAX32, MAX32
        self._write(struct.pack("<4sHHHHIIH", END, 0, 0, n, n, length, first, 0))


class Ranged:
    """A file of which ranges are read."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.size = system.get_file_info(path).size
        self.file = system.open_input_file(path)

    def read(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"the file ends within {length} bytes from {start}")
        return data

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_: Any) -> None:
        self.file.close()


def members(file: Ranged) -> dict[str, tuple[int, int]]:
    """Name to (place, length) of the stored members, from the central directory."""
    tail_at = max(0, file.size - 22 - MAX16)
    tail = file.read(tail_at, file.size - tail_at)
    # The comment after the record may hold its signature, so its length must fit.
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    n, length, first = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR:
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        n, length, first = struct.unpack_from("<QQQ", file.read(end64, 56), 32)
    directory = file.read(first, length)
    found, at = {}, 0
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method, packed, size, name_n, extra_n, comment_n = struct.unpack_from("<10xH8xIIHHH", directory, at)
        (start,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        packed, size, start = _wide(extra, [packed, size, start])
        if method == 0:
            head = file.read(start, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            a, b = struct.unpack_from("<HH", head, 26)
            found[name] = (start + 30 + a + b, size)
        at += 46 + name_n + extra_n + comment_n
    return found


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Size, packed size and place (in their order in the ZIP64 field: size, packed, place)."""
    packed, size, start = values
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            rest = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            size = rest.pop(0) if size == MAX32 else size
            packed = rest.pop(0) if packed == MAX32 else packed
            start = rest.pop(0) if start == MAX32 else start
        at += 4 + n
    return [packed, size, start]


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE
) -> bytes:
    """One WARC record; a revisit has the digest and length of its payload, but not its bytes."""
    kind = "response" if refers_to is None else "revisit"
    # One line per field, so a line break in an url must not start another.
    target = json.dumps(url or "")[1:-1]
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(len(payload)),
        "Content-Type": "text/html; charset=utf-8",
    }
    if refers_to is not None:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        payload = b""
    fields["Content-Length"] = str(len(payload))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _named(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): what each record is."""
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    first = (
        rows.where(F.octet_length("html") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    # Stored, so that a join on a payload that many pages share can be split.
    again = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(stored(first, "payloads"), "digest", "left").select(
        "page_id", "url", "html", "digest", again.alias("refers_to")
    )


def write(
    pages: DataFrame, folder: str | None = None, rows_per_task: int = ROWS_PER_TASK, date: str = DATE
) -> DataFrame:
    """Archives of all ``pages``, dated ``date``; a stored table of (archive, records)."""
    folder = folder or new_folder(pages.sparkSession, "archives")
    if "://" not in folder:
        folder = f"file://{folder}" if folder.startswith("/") else folder.replace("file:", "file://", 1)

    def save(records: list[bytes], index: list[dict]) -> pd.DataFrame:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"
        with system.open_output_stream(f"{path}/.{name}.part") as out:
            archive = ZipWriter(out)
            archive.member(DATA, records)
            archive.member(INDEX, [json.dumps(x, separators=(",", ":")).encode() + b"\n" for x in index])
            archive.close()
        system.move(f"{path}/.{name}.part", f"{path}/{name}")
        return pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [len(records)]})

    def run(batches: Iterator[Any]) -> Iterator[pd.DataFrame]:
        records: list[bytes] = []
        index: list[dict] = []
        at = 0
        for batch in batches:
            # Arrow columns keep null and large ids as they are.
            for r in batch.to_pylist():
                raw = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], date)
                packed = gzip.compress(raw, 1, mtime=0)
                records.append(packed)
                index.append({"offset": at, "length": len(packed), "id": r["page_id"]})
                at += len(packed)
                if at >= ARCHIVE:
                    yield save(records, index)
                    records, index, at = [], [], 0
        if records:
            yield save(records, index)

    def to_arrow(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    rows = marked(pages)
    tasks = max(1, -(-pages.count() // rows_per_task))
    return stored(rows.repartition(tasks).mapInArrow(to_arrow, "archive string, records long"), "manifest")


def ranges(archives: DataFrame) -> DataFrame:
    """(archive, start, lengths): runs of neighbouring records, from directories and indexes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["archive"]:
                with Ranged(uri) as file:
                    found = members(file)
                    data_at, data_size = found[DATA]
                    index = [json.loads(x) for x in file.read(*found[INDEX]).splitlines()]
                rows, run_of, begin = [], [], 0
                for x in index:
                    end = x["offset"] + x["length"]
                    if end > data_size:
                        raise ValueError(f"{uri}: the index points beyond the records")
                    if run_of and end - begin > RANGE:
                        rows.append((uri, data_at + begin, run_of))
                        run_of = []
                    begin = begin if run_of else x["offset"]
                    run_of.append(x["length"])
                if run_of:
                    rows.append((uri, data_at + begin, run_of))
                yield pd.DataFrame(rows, columns=["archive", "start", "lengths"])

    return archives.select("archive").mapInPandas(run, "archive string, start long, lengths array<long>")


def read(archives: DataFrame) -> DataFrame:
    """Every record: page_id, url, record_type, refers_to, digest, length and stored payload.

    A response's payload is checked against its digest.
    """
    schema = (
        "page_id long, url string, record_type string, refers_to long,"
        " payload_digest string, payload_bytes long, payload binary"
    )

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        kinds = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for r in batch.to_pylist():
                with Ranged(r["archive"]) as file:
                    data = file.read(r["start"], sum(r["lengths"]))
                rows, at = [], 0
                for n in r["lengths"]:
                    fields, payload = parse(gzip.decompress(data[at : at + n]))
                    at += n
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = fields["WARC-Type"] == "response"
                    if response and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{r['archive']}: a payload does not match its digest")
                    rows.append(
                        {
                            "page_id": _named(fields["WARC-Record-ID"]),
                            "url": json.loads(f'"{fields["WARC-Target-URI"]}"'),
                            "record_type": fields["WARC-Type"],
                            "refers_to": None if response else _named(fields["WARC-Refers-To"]),
                            "payload_digest": digest,
                            "payload_bytes": len(payload) if response else int(fields["WARC-Payload-Length"]),
                            "payload": payload if response else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    # One range is one row, so any number of tasks can share them.
    tasks = archives.sparkSession.sparkContext.defaultParallelism * 4
    return ranges(archives).repartition(tasks).mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the payload of a revisit taken from its response."""
    held = records.where("record_type = 'response'").select(
        F.col("payload_digest").alias("__digest"), F.col("payload").alias("__held")
    )
    held = held.groupBy("__digest").agg(F.first("__held").alias("__held"))
    revisit = records.where("record_type = 'revisit'")
    filled = revisit.drop("payload").join(held, F.col("payload_digest") == F.col("__digest"))
    filled = filled.withColumn("payload", F.col("__held")).select(*records.columns)
    return records.where("record_type = 'response'").unionByName(filled)


def report(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives and reads them back: one row per page."""
    return read(write(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
