"""WARC records in ZIP packages: writing them, and reading records by range without extraction.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.tsv`` with record id, offset and length of each. The reader finds the end-of-central-directory record
(and, where a field is full, the ZIP64 one), parses the central directory, locates the data of the stored members
behind their local headers, reads the index, and fetches each record by its range.

Packages go to the shared folder under a fresh name per task attempt; a checkpointed manifest lists those of the
attempts that counted, so a lost executor leaves at most an unlisted file. ``pyarrow.fs`` opens the paths, so
any store it knows will do.

Of pages with equal payloads of at least LEAST bytes the one with the largest page_id is the response and the others
refer to it; rows that tie for the largest are all responses, as are smaller payloads. A null html is an empty
payload; a null page_id never is referred to while another is there; a null url is left out of the record; an empty
table gives no package and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm.common import cut, shared_folder, small, table

LEAST = 1000
#: A package is closed after so many records or bytes; its index is held in memory until then.
MOST_RECORDS, MOST_BYTES = 50_000, 1 << 30
DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the ZIP format: signatures, sizes of fixed parts, the value that refers to ZIP64.
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE, FULL16, FULL32 = 22, 20, 46, 30, 0xFFFF, 0xFFFFFFFF


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", "%0A", url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """A ZIP package being written."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.zip"
        store, path = opened(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.at, self.index = self.zip.open(DATA, "w", force_zip64=True), 0, []

    def add(self, name: object, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.data.write(packed)
        self.index.append(f"{name}\t{self.at}\t{len(packed)}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(self.index))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index), self.at


def write_packages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write (page_id, url, html) as packages; the manifest (path, records, bytes)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), (F.octet_length(html) >= least).alias("large"))
    alike = pages.filter("large").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").select(F.col("digest").alias("_digest"), "last")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("last")), None).otherwise(F.col("last"))
    # a row for each payload that is met again; few of them go to all tasks, so that pages stay where they are read
    alike = small(cut(alike))
    ready = pages.join(alike, (F.col("digest") == F.col("_digest")) & F.col("large"), "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package, done = None, []
        for b in batches:
            b = b.astype({"page_id": object, "refers_to": object}).where(b.notna(), None)
            for page_id, url, text, digest, refers_to in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"], strict=True):
                package = package or Package(folder)
                page_id, refers_to = (None if x is None else int(x) for x in (page_id, refers_to))
                package.add(page_id, record(page_id, url, text.encode("utf-8", "replace"), digest, refers_to))
                if len(package.index) >= MOST_RECORDS or package.at >= MOST_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return cut(ready.mapInPandas(write, "path string, records long, bytes long"))


class Reader:
    """Members and ranges of a ZIP package, read without extraction."""

    def __init__(self, uri: str) -> None:
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        self.members = dict(self.directory())

    def at(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def directory(self) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """(name, (method, offset of the local header, stored size)) of each member."""
        size = self.file.size()
        tail_at = max(0, size - END_SIZE - FULL16)  # a comment of up to 65535 bytes may follow
        tail = self.at(tail_at, size - tail_at)
        end = tail.rfind(END)
        while end >= 0 and end + END_SIZE + struct.unpack_from("<H", tail, end + 20)[0] > len(tail):
            end = tail.rfind(END, 0, end)
        if end < 0:
            raise ValueError("not a ZIP package: no end of central directory")
        many, length, start = struct.unpack_from("<HII", tail, end + 10)
        if FULL16 == many or FULL32 in (length, start):
            locator = self.at(tail_at + end - LOCATOR_SIZE, LOCATOR_SIZE)
            if locator[:4] == LOCATOR:
                (end64,) = struct.unpack_from("<Q", locator, 8)
                record = self.at(end64, 56)
                if record[:4] != END64:
                    raise ValueError("ZIP64 end of central directory not where its locator says")
                many, length, start = struct.unpack_from("<QQQ", record, 32)
        central, p = self.at(start, length), 0
        for _ in range(many):
            if central[p : p + 4] != ENTRY:
                raise ValueError("central directory is damaged")
            flags, method = struct.unpack_from("<HH", central, p + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", central, p + 20)
            (local,) = struct.unpack_from("<I", central, p + 42)
            name = central[p + ENTRY_SIZE : p + ENTRY_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = central[p + ENTRY_SIZE + n_name : p + ENTRY_SIZE + n_name + n_extra], 0
            while q + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # ZIP64: only the full fields are there, in this order
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                    plain = next(values) if plain == FULL32 else plain
                    packed = next(values) if packed == FULL32 else packed
                    local = next(values) if local == FULL32 else local
                q += 4 + n
            yield name, (method, local, packed)
            p += ENTRY_SIZE + n_name + n_extra + n_comment

    def stored(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's data."""
        method, local, size = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; records in it have no ranges")
        head = self.at(local, LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ValueError(f"{name} has no local header where the directory says")
        return local + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26)), size

    def records(self) -> Iterator[tuple[str, bytes]]:
        at, length = self.stored(INDEX)
        base, end = self.stored(DATA)
        for line in self.at(at, length).decode().splitlines():
            name, offset, size = line.split("\t")
            if int(offset) + int(size) > end:
                raise ValueError("index points beyond the archive")
            yield name, zlib.decompress(self.at(base + int(offset), int(size)), 31)


def parsed(raw: bytes) -> dict:
    """A WARC record; the digest of a payload that is there is computed and must be the header's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda urn: None if (x := urn[len("<urn:page:") : -1]) == "None" else int(x)
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what its header says")
    refers_to = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload": payload if refers_to is None else None, "payload_bytes": length, "payload_digest": digest, "refers_to": refers_to}


def read_packages(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages that (path, ...) rows name."""
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                rows, held = [], 0
                for _, raw in Reader(path).records():
                    rows.append(parsed(raw) if payloads else parsed(raw) | {"payload": None})
                    held += len(raw) if payloads else 200
                    if held > 1 << 24:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return manifest.select("path").mapInPandas(read, schema)


def frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})


def op6_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_packages(table(spark, sf_dir, "pages"))
    return read_packages(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_archive": op6_archive}
ORACLE_SQL: dict[str, str] = {
    "op6_archive": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT *, CASE WHEN n >= {LEAST} THEN max(page_id) OVER (PARTITION BY digest) END AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN last <> page_id OR (page_id IS NULL AND last IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id OR (page_id IS NULL AND last IS NOT NULL) THEN last END AS refers_to FROM g"""
}
