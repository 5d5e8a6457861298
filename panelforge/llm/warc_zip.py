"""WARC in ZIP packages: written as stored members, read by ranges.

A package is a ZIP file with ``archive/data.warc.gz`` (a gzip member per record, so a record is a
range of bytes), ``indexes/index.cdxj`` (sorted lines of key, timestamp and JSON with offset and
length) and ``datapackage.json``, all stored, not compressed by ZIP. The reader needs only
``read_at(offset, n)``: it finds the end of the central directory (and its ZIP64 form), lists the
members, and reads each record the index names straight from its place in the open file; nothing is
extracted, and no archive is held in memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.store import shared_dir, written

#: Bytes of records after which a package is closed.
PACKAGE = 32 << 20
#: Bytes of an index that are read at a time.
STEP = 1 << 20
SMALL = 16 << 20
DATA, INDEX, MANIFEST = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- reading -----------------------------------------------------------------------------------------


class Package:
    """The members of a ZIP archive that ``read_at`` gives access to."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int) -> None:
        self.read_at = read_at
        self.members: dict[str, tuple[int, int, int]] = {}
        tail_at = max(0, size - 65557)
        tail = read_at(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        if at < 0 or len(tail) - at < 22:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<H2I", tail[at + 10 : at + 20])
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = read_at(tail_at + at - 20, 20)
            if locator[:4] == b"PK\6\7":
                end = read_at(struct.unpack("<Q", locator[8:16])[0], 56)
                if end[:4] != b"PK\6\6":
                    raise ValueError("no ZIP64 end of central directory")
                count, length, start = struct.unpack("<3Q", end[32:56])
        directory = read_at(start, length)
        p = 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, = struct.unpack("<H", directory[p + 10 : p + 12])
            packed, plain, n_name, n_extra, n_note = struct.unpack("<2I3H", directory[p + 20 : p + 34])
            header, = struct.unpack("<I", directory[p + 42 : p + 46])
            name = directory[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
            extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack("<2H", extra[:4])
                if kind == 1:  # the 64-bit values of those fields that are full, in this order
                    wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            self.members[name] = (method, header, packed)
            p += 46 + n_name + n_extra + n_note

    def start_of(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        method, header, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        local = self.read_at(header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError("no local header")
        return header + 30 + sum(struct.unpack("<2H", local[26:30]))

    def range(self, name: str, offset: int, length: int) -> bytes:
        if offset + length > self.members[name][2]:
            raise ValueError("beyond the member")
        return self.read_at(self.start_of(name) + offset, length)

    def whole(self, name: str) -> bytes:
        return self.range(name, 0, self.members[name][2])

    def lines(self, name: str) -> Iterator[bytes]:
        """The lines of a member, read (and unzipped, if its name ends so) range by range."""
        unzip = zlib.decompressobj(31) if name.endswith(".gz") else None
        size, left, inside = self.members[name][2], b"", False
        for at in range(0, size, STEP):
            data = self.range(name, at, min(STEP, size - at))
            if unzip is not None:
                out = []
                while data:  # an index may be of many gzip members
                    out.append(unzip.decompress(data))
                    data, inside = unzip.unused_data, not unzip.eof
                    if unzip.eof:
                        unzip = zlib.decompressobj(31)
                data = b"".join(out)
            *whole, left = (left + data).split(b"\n")
            yield from whole
        yield left
        if inside:
            raise EOFError("the index breaks off")

    def located(self, filename: str) -> str:
        """The data member that an index line names, by its whole name or by a last part that no other has."""
        for name in (filename, f"archive/{filename}"):
            if name in self.members:
                return name
        base = filename.rsplit("/", 1)[-1]
        found = [m for m in self.members if m.startswith("archive/") and m.rsplit("/", 1)[-1] == base]
        if len(found) != 1:
            raise ValueError(f"{len(found)} members are named {filename}")
        return found[0]

    def records(self) -> Iterator[tuple[dict[str, str], dict[str, str], bytes] | str]:
        """WARC headers, HTTP headers and payload of each record that an index names; of one that can't be read, what is wrong.

        Indexes are CDXJ (key, timestamp, JSON) or CDX (columns named by the letters of a first line), as they are or gzipped; a
        package without one, or with one that breaks off, tells so.
        """
        names = sorted(m for m in self.members if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", m))
        if not names:
            yield "no index"
        for name in names:
            letters: list[str] = []
            try:
                for line in self.lines(name):
                    if line.startswith(b" CDX"):
                        letters = line.decode("utf-8", "replace").split()[1:]
                    elif line.strip():
                        yield self._record(line, letters)
            except _BROKEN as e:
                yield f"{name}: {type(e).__name__}: {e}"

    def _record(self, line: bytes, letters: list[str]) -> tuple[dict[str, str], dict[str, str], bytes] | str:
        try:
            if letters:
                of = dict(zip(letters, line.decode().split(), strict=True))
                where = {"filename": of["g"], "offset": of["V"], "length": of["S"]}
            else:
                where = json.loads(line[line.index(b"{") :])
            return parse(gzip.decompress(self.range(self.located(where.get("filename", DATA)), int(where["offset"]), int(where["length"]))))
        except _BROKEN as e:
            return f"{type(e).__name__}: {e}"


#: What a damaged package can raise.
_BROKEN = (ValueError, KeyError, AttributeError, TypeError, EOFError, OSError, zlib.error, struct.error)


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode().lower()] = value.strip().decode()
    return out


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- writing -----------------------------------------------------------------------------------------


def record(page_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record; a revisit keeps the HTTP headers (so the payload's length) and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[6:6] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sort_key(url: str) -> str:
    """The URL with its host's parts in reverse: ``http://a.b.c/d`` is ``c,b,a)/d``."""
    rest = url.split("://", 1)[-1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub(r"\s", "%20", ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host) :])


def package(records: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A package of (url, gzipped record) pairs."""
    out, offset, lines = io.BytesIO(), 0, []
    stamp = re.sub(r"\D", "", DATE)
    for url, data in records:
        where = {"url": url, "offset": str(offset), "length": str(len(data)), "filename": DATA.rsplit("/", 1)[-1]}
        lines.append(f"{sort_key(url)} {stamp} {json.dumps(where)}")
        offset += len(data)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64) as f:
            for _, data in records:
                f.write(data)
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(lines)))
        z.writestr(zipfile.ZipInfo(MANIFEST), json.dumps({"profile": "data-package", "records": len(records)}))
    return out.getvalue()


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; Hadoop's names of object stores are the ones that Arrow has for them."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri)))


def _put(folder: str, data: bytes) -> str:
    """Write a package under its content's hash: a task that runs again writes the same file, and none is ever seen half done."""
    name = f"{folder}/{hashlib.sha1(data).hexdigest()}.wacz"
    store, path = _opened(name)
    store.create_dir(path.rsplit("/", 1)[0])
    if store.get_file_info(path).type == fs.FileType.NotFound:
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, path)
    return name


def _packed(limit: int, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple[str, bytes]] = []
    size = 0

    def close() -> pa.RecordBatch:
        data = package(kept)
        return pa.RecordBatch.from_pydict({"name": pa.array([_put(folder, data)]), "size": pa.array([len(data)])})

    for batch in batches:
        for name, url, html, first in zip(*(batch[c] for c in ("id", "url", "html", "first"))):
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            url = (url.as_py() or "").replace("\r", " ").replace("\n", " ")
            data = gzip.compress(record(name.as_py() or "", url, payload, first.as_py()), 1, mtime=0)
            kept.append((url, data))
            size += len(data)
            if size >= limit:
                yield close()
                kept, size = [], 0
    if kept:
        yield close()


def write_packages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, limit: int = PACKAGE) -> DataFrame:
    """``(name, size)``: package files that hold a record for each row of ``pages``, in the shared folder.

    Only files of this table count: what a task that was run again may leave besides is never read. Rows
    with equal payloads of at least ``least`` bytes revisit the one with the smallest id; all rows with
    that id are responses, and rows without an id revisit it (are responses if none has one). Null
    payloads are empty. An empty table gives no package.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "UTF-8"))))
    same = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = written(same)
    near = F.broadcast(same) if same.count() * 96 <= SMALL else same
    rows = rows.join(near, "digest", "left").select(F.col("id").cast("string").alias("id"), "url", "html", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).cast("string").alias("first"))
    folder = f"{shared_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    return written(rows.mapInArrow(partial(_packed, limit, folder), "name string, size long"))


_COLUMNS = {"page_id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "html": pa.string(), "error": pa.string()}


def _row(found: tuple[dict[str, str], dict[str, str], bytes] | str, payloads: bool) -> tuple:
    if isinstance(found, str):
        return (None,) * 7 + (found,)
    warc, http, payload = found
    bare = lambda x: x.removeprefix("<").removesuffix(">").removeprefix("urn:page:") or None
    kind, stated = warc.get("warc-type", ""), warc.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit, error = kind == "revisit", None
    if not revisit and stated != digest(payload):
        error = "payload and digest differ"
    size = len(payload)
    if revisit and "content-length" in http:
        if not re.fullmatch(r"\d{1,18}", http["content-length"]):
            return _row(f"length of payload: {http['content-length'][:80]}", payloads)
        size = int(http["content-length"])
    return bare(warc.get("warc-record-id", "")), warc.get("warc-target-uri"), size, stated, kind, bare(warc.get("warc-refers-to", "")) if revisit else None, payload.decode("utf-8", "replace") if payloads and not revisit else None, error


def _read(payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), _COLUMNS.values())], list(_COLUMNS))

    for batch in batches:
        for name, size in zip(batch["name"].to_pylist(), batch["size"].to_pylist()):
            store, path = _opened(name)
            rows: list[tuple] = []
            with store.open_input_file(path) as f:
                try:
                    for found in Package(lambda at, n: f.read_at(n, at), size).records():  # noqa: B023
                        rows.append(_row(found, payloads))
                        if len(rows) == 512:
                            yield batch_of(rows)
                            rows = []
                except _BROKEN as e:
                    rows.append(_row(f"{type(e).__name__}: {e}", payloads))
            if rows:
                yield batch_of(rows)


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of package files given as ``(name, size)`` rows; ids are text.

    A record or index line that can't be read, a revisit whose length of payload is no number, an index that breaks off, a package without an
    index, and a file that is no package give a row with ``error`` (and nothing else) each; the records beside it are read. A payload that doesn't have its digest has ``error`` beside its columns.
    """
    return packages.select("name", "size").mapInArrow(partial(_read, payloads), "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string, error string")


def packages_at(spark: SparkSession, path: str) -> DataFrame:
    """The package files at a path, for ``read_packages``; only their names and sizes are read here."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.col("length").alias("size"))
