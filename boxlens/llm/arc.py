"""Legacy ARC archives and their conversion to WARC.

``write_arc`` stores pages as ARC files of version 1 or 2, ``convert`` turns ARC
files into WARC/1.1 files and ``read_warc`` reads those back. Files are gzip
members, one a record, of about ``ARCHIVE_BYTES`` before compression, in the
shared folder. Tasks write files under names of their own attempt and return
them as manifest rows; only files named in the written manifest count, so a
lost or repeated task leaves nothing that is read. Records are streamed: a task
holds one record at a time.

The converter reads the version block of an ARC file, takes the field names it
declares (they differ by version), cuts records by their declared lengths, and
synthesises for each a WARC type, an identifier (a UUID named by archive and
record number), a timestamp from the 14-digit date, and SHA-1 digests of block
and payload. Records with payloads already stored elsewhere become ``revisit``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import discard, scratch, written

ARCHIVE_BYTES = 32 << 20
MOST_TASKS = 20_000  # partitions asked for at most; beyond, a task reads several files
FIELDS = {  # fixed values of the format: header fields by version
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "19960101000000"  # pages carry no time of capture
MANIFEST = "archive string, name string, records bigint"
INDEX = ("archive string, name string, ordinal bigint, page_id bigint, uri string, date string, "
         "payload_digest string, payload_bytes bigint")
READ = ("page_id bigint, uri string, date string, record_id string, record_type string, payload_digest string, "
        "payload_bytes bigint, refers_to_record string")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(path: str, mode: str):
    store, local = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(local.rpartition("/")[0])
        return store.open_output_stream(local, compression=None)
    return io.BufferedReader(store.open_input_file(local))


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _stream(path: str):
    """The archive's bytes, unpacked if it is compressed."""
    raw = _open(path, "r")
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


# --- ARC ---------------------------------------------------------------------

def arc_header(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(f, "-") for f in FIELDS[version].split()) + "\n").encode()


def _version_block(version: int, name: str) -> bytes:
    block = f"{version} 0 boxlens\n{FIELDS[version]}\n".encode()
    head = arc_header(version, {
        "URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain",
        "Result-code": "200", "Offset": "0", "Filename": name, "Archive-length": str(len(block))})
    return head + block + b"\n"


def arc_record(version: int, name: str, offset: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    http = (f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
            f"X-Page-Id: {'-' if page_id is None else page_id}\r\n\r\n").encode()
    body = http + payload
    return arc_header(version, {
        "URL": quote(url, safe="/:?#[]@!$&'()*+,;=%~") if url else "-", "IP-address": "0.0.0.0",
        "Archive-date": DATE, "Content-type": "text/html", "Result-code": "200", "Checksum": sha1(body),
        "Offset": str(offset), "Filename": name, "Archive-length": str(len(body))}) + body + b"\n"


def read_arc(path: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(ordinal, header fields, block)`` of an ARC file of either version.

    A file cut short ends with the block read so far and ``Truncated`` set.
    """
    with _stream(path) as src:
        first = src.readline().split(b" ")
        if not first[0].startswith(b"filedesc:"):
            raise ValueError(f"{path}: no version block")
        about = src.read(int(first[-1])).split(b"\n")
        version = int(about[0].split()[0])
        names = about[1].decode().split() if len(about) > 1 and about[1] else FIELDS[version].split()
        ordinal = 0
        while line := src.readline():
            if not line.strip():
                continue
            # an unescaped URL may hold spaces: cut from the right
            values = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(names) - 1)
            fields = dict(zip(names, values, strict=True))
            want = int(fields["Archive-length"])
            block = src.read(want)
            if len(block) < want:
                fields["Truncated"] = "length"
            yield ordinal, fields, block
            ordinal += 1


def _entity(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """HTTP fields, head and payload of a block; a block without a head is payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + gap, payload


def _page(fields: dict[str, str]) -> int | None:
    value = fields.get("x-page-id", "-")
    return int(value) if value.lstrip("-").isdigit() else None


class _ArcFile:
    def __init__(self, folder: str, number: int):
        context = TaskContext.get()
        part = context.partitionId()
        self.version = 1 + (part + number) % 2
        self.name = f"pages-{part:05d}-{number:04d}.arc.gz"
        self.path = f"{folder}/{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}/{self.name}"
        self.out, self.size, self.records = _open(self.path, "w"), 0, 0
        self.put(_version_block(self.version, self.name))

    def put(self, data: bytes) -> None:
        self.out.write(_member(data))
        self.size += len(data)

    def add(self, page_id: int | None, url: str | None, html: str | None) -> None:
        self.put(arc_record(self.version, self.name, self.size, page_id, url, (html or "").encode()))
        self.records += 1

    def close(self) -> list[tuple[str, str, int]]:
        self.out.close()
        return [(self.path, self.name, self.records)]


def _manifest(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
         pa.array([r[2] for r in rows], pa.int64())], names=["archive", "name", "records"])


def _write_arc(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    number, file = 0, None
    for batch in batches:
        for k in range(batch.num_rows):
            if file is None:
                file = _ArcFile(folder, number)
                number += 1
            file.add(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
            if file.size >= ARCHIVE_BYTES:
                yield _manifest(file.close())
                file = None
    if file is not None:
        yield _manifest(file.close())


def _tasks(manifest: DataFrame) -> int:
    """Tasks for the files of a manifest: a file is read whole by one task, so
    about one task a file (some more, as hashing puts several files together)."""
    return max(1, min(2 * manifest.count(), MOST_TASKS))


def write_arc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Store pages ``(page_id, url, html, ..)`` as ARC files, versions 1 and 2 in
    turn; returns the written manifest ``(archive, name, records)``.

    A null html is an empty payload, a null url is written ``-``, a null page
    id is kept as null; other columns are ignored; no pages give no file.
    """
    folder = folder or scratch(pages.sparkSession, "arc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return written(rows.mapInArrow(lambda it: _write_arc(it, folder), MANIFEST), "arc-manifest")


# --- conversion --------------------------------------------------------------

def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for ordinal, fields, block in read_arc(archive):
                http, _, payload = _entity(block)
                rows.append((archive, name, ordinal, _page(http), fields["URL"], fields["Archive-date"], sha1(payload), len(payload)))
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64"}),
                preserve_index=False,
                schema=pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in INDEX.split(", ")]))


def record_id(name: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{ordinal}')}>"


def warc_date(date: str) -> str:
    d = (date + DATE[len(date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_record(name: str, ordinal: int, fields: dict[str, str], block: bytes, earlier: tuple[str, str, str] | None) -> bytes:
    """The WARC record of an ARC record; ``earlier``: id, URI and date of the
    record that holds the same payload, if this one revisits it."""
    _, head, payload = _entity(block)
    kind = "revisit" if earlier else "response" if head else "resource"
    out = [("WARC-Type", kind), ("WARC-Record-ID", record_id(name, ordinal)), ("WARC-Date", warc_date(fields["Archive-date"])),
           ("WARC-Target-URI", fields["URL"]), ("WARC-IP-Address", fields["IP-address"]),
           ("WARC-Payload-Digest", f"sha1:{sha1(payload)}")]
    if earlier:
        block = head
        out += [("WARC-Profile", REVISIT), ("WARC-Refers-To", earlier[0]), ("WARC-Refers-To-Target-URI", earlier[1]),
                ("WARC-Refers-To-Date", earlier[2])]
    if "Truncated" in fields:
        out.append(("WARC-Truncated", fields["Truncated"]))
    out += [("WARC-Block-Digest", f"sha1:{sha1(block)}"),
            ("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"])]
    return _warc(out, block)


def _convert(archives: pd.DataFrame, revisits: pd.DataFrame, folder: str) -> pd.DataFrame:
    done = []
    earlier = {r.ordinal: (record_id(r.to_name, r.to_ordinal), r.to_uri, warc_date(r.to_date)) for r in revisits.itertuples()}
    for archive, name in zip(archives["archive"], archives["name"], strict=True):
        context = TaskContext.get()
        target = name.removesuffix(".gz").removesuffix(".arc") + ".warc.gz"
        path = f"{folder}/{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}/{target}"
        records = 0
        with _open(path, "w") as out:
            about = f"software: boxlens\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\n".encode()
            out.write(_member(_warc([
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", warc_date(DATE)),
                ("WARC-Filename", target), ("Content-Type", "application/warc-fields")], about)))
            for ordinal, fields, block in read_arc(archive):
                out.write(_member(warc_record(name, ordinal, fields, block, earlier.get(ordinal))))
                records += 1
        done.append((path, target, records))
    return pd.DataFrame(done, columns=["archive", "name", "records"])


def convert(manifest: DataFrame, folder: str | None = None) -> DataFrame:
    """Convert the ARC files of a manifest to WARC; returns the WARC manifest.

    Of records with equal payloads, the one with the largest page id (then
    archive and ordinal) is stored, all others revisit it.
    """
    folder = folder or scratch(manifest.sparkSession, "warc")
    # a number of partitions that is asked for is not coalesced: the rows are few
    # and small, the files that they name are not
    n = _tasks(manifest)
    index = written(manifest.repartition(n).select("archive", "name").mapInArrow(_index, INDEX), "arc-index")
    stored = (index.groupBy("payload_digest").agg(
        F.max(F.struct("page_id", "archive", "ordinal", "name", "uri", "date")).alias("to"), F.count(F.lit(1)).alias("c"))
        .where("c > 1").select(F.col("payload_digest").alias("same"), "to"))
    revisits = (index.join(stored, F.col("payload_digest") == F.col("same"))
                .where("archive <> to.archive or ordinal <> to.ordinal")
                .selectExpr("archive", "ordinal", "to.name as to_name", "to.ordinal as to_ordinal", "to.uri as to_uri", "to.date as to_date"))
    return written(
        manifest.select("archive", "name").repartition(n, "archive").groupBy("archive")
        .cogroup(revisits.repartition(n, "archive").groupBy("archive"))
        .applyInPandas(lambda a, r: _convert(a, r, folder), MANIFEST), "warc-manifest")


def read_warc_file(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    with _stream(path) as src:
        while line := src.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: not at the start of a record: {line[:40]!r}")
            fields = {}
            while (line := src.readline()).strip():
                k, _, v = line.decode().partition(":")
                fields[k.strip().lower()] = v.strip()
            yield fields, src.read(int(fields["content-length"]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ.split(", ")]
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in READ.split(", ")])
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            rows = []
            for fields, block in read_warc_file(archive):
                if fields["warc-type"] == "warcinfo":
                    continue
                if fields["warc-block-digest"] != f"sha1:{sha1(block)}":
                    raise ValueError(f"{archive}: block digest of {fields['warc-record-id']} differs")
                http, _, payload = _entity(block)
                size = int(http["content-length"]) if fields["warc-type"] == "revisit" else len(payload)
                rows.append((_page(http), fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"], fields["warc-type"],
                             fields["warc-payload-digest"].removeprefix("sha1:"), size, fields.get("warc-refers-to")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
                                             if rows else [pa.array([], t) for t in schema.types], names=names)


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the WARC files of a manifest, checked against their digests."""
    return manifest.repartition(_tasks(manifest)).select("archive").mapInArrow(_read, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC and back: a row per page ``(page_id,
    payload_bytes, payload_digest, record_type, refers_to, uri, date,
    record_id)``; ``refers_to`` is the page whose record a revisit names.

    Repeated page ids keep a record each; of equal payloads one is stored. The
    archives are a detour here: they are deleted once the rows are written.
    """
    spark = pages.sparkSession
    arcs, warcs = scratch(spark, "arc"), scratch(spark, "warc")
    rows = written(read_warc(convert(write_arc(pages, arcs), warcs)), "warc-rows")
    for folder in (arcs, warcs):
        discard(spark, folder)
    stored = rows.where("record_type = 'response'").select(F.col("record_id").alias("__id"), F.col("page_id").alias("__page"))
    return (rows.join(stored, F.col("refers_to_record") == F.col("__id"), "left")
            .select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("__page").alias("refers_to"),
                    "uri", "date", "record_id"))
