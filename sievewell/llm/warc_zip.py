"""WARC archives packaged as ZIP files: writing, and reading by ranges without extraction.

A package holds, uncompressed, ``archive/data.warc.gz`` with one gzip member for each record,
``indexes/index.cdxj`` with the place of each, and ``datapackage.json``. Writing: Spark finds
which of the records with equal payloads is the response; tasks write packages of bounded
size, and a written table lists those of the tasks that ended well, so a task that is run
again leaves no record twice. Reading: a task for each package reads the end record, the
ZIP64 end record where there is one, and the central directory, locates the stored members by
their local headers, and turns the index into (package, offset, length). Spark deals these by
place, so that one large package is read by many tasks, each with one range for many records.

Folders are named by a URI that ``pyarrow.fs`` opens (a path, ``file:``, ``s3:``, ``hdfs:``).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.llm.hot import looked_up
from sievewell.llm.texts import slices
from sievewell.session import work_dir, written_once

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
RECORD = "path string, offset long, record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string"
RUN_BYTES, GAP_BYTES = 4 << 20, 64 << 10


# ---- which record is the response -------------------------------------------------------------


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_sha1, record_type, refers_to, sole), a record for each row of (page_id, url, html).

    Of records with equal payloads of ``least_bytes`` or more, that with the largest page_id is
    the response, among those with that id the one with the largest url, and of rows that are
    equal in both one. The others revisit it and carry no payload. ``sole`` says that no other response has the payload.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("same", F.sha2("payload", 256))
    rows = rows.withColumn("payload_sha1", F.sha1("payload"))
    counted = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("same", "payload_bytes", "payload_sha1", "page_id", "url").agg(F.count("*").alias("n"))
    groups = counted.groupBy("same", "payload_bytes", "payload_sha1").agg(F.sum("n").alias("rows"), F.max(F.struct("page_id", "url", "n")).alias("top")).where("rows > 1")
    groups = groups.select("same", "payload_bytes", "payload_sha1", "top.page_id", "top.url", "top.n").toDF("same", "top_bytes", "top_sha1", "top_id", "top_url", "top_n")
    groups = written_once(groups, "equal-pages")
    known = looked_up(rows, groups, ["same"], "left", "hot-pages")
    is_top = F.col("page_id").eqNullSafe(F.col("top_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    first = F.col("top_n").isNull() | is_top
    kind = F.when(first, F.lit("response")).otherwise(F.lit("revisit"))
    out = known.select(
        "page_id", "url", F.when(first, F.col("payload")).alias("payload"), "payload_bytes", "payload_sha1", kind.alias("record_type"),
        F.when(~first, F.col("top_id")).alias("refers_to"), (F.col("payload_bytes") >= least_bytes).alias("sole"), "same", (is_top & (F.col("top_n") > 1)).alias("tied"),
    )
    repeated = groups.where("top_n > 1")
    if repeated.isEmpty():
        return out.drop("same", "tied")
    # of rows that repeat the response, one stays what it is; the others become revisits of the same id
    tied = out.where("tied").dropDuplicates(["same"])
    others = repeated.select(
        F.col("top_id").alias("page_id"), F.col("top_url").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("top_bytes").alias("payload_bytes"), F.col("top_sha1").alias("payload_sha1"),
        F.lit("revisit").alias("record_type"), F.col("top_id").alias("refers_to"), F.lit(True).alias("sole"), F.explode(F.sequence(F.lit(2).cast("long"), "top_n")).alias("nth"),
    )
    return out.where("tied IS NULL OR NOT tied").unionByName(tied).drop("same", "tied").unionByName(others.drop("nth"))


# ---- writing ----------------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, digest: str, place: str = "") -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{digest}{place and ':' + place}>"


def _warc(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


class _Package:
    """One package being written, to a stream that cannot be wound back."""

    def __init__(self, system: fs.FileSystem, path: str, level: int, date: str):
        self.path, self.level, self.date = path, level, date
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Sink(self.stream), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.lines = 0, []
        self.add([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

    def add(self, fields: list[tuple[str, str | None]], block: bytes, entry: dict | None = None) -> None:
        record = gzip.compress(_warc(fields, block), self.level, mtime=0)
        if entry is not None:
            place = {"offset": str(self.size), "length": str(len(record)), "filename": DATA.rsplit("/", 1)[1]}
            self.lines.append(f"{entry['url'] or '-'} {''.join(c for c in self.date if c.isdigit())} {json.dumps(entry | place)}\n")
        self.member.write(record)
        self.size += len(record)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        index = "".join(sorted(self.lines)).encode()
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        about = {"profile": "data-package", "resources": [{"name": "index.cdxj", "path": INDEX, "bytes": len(index)}, {"name": "data.warc.gz", "path": DATA, "bytes": self.size}]}
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(about, indent=1))
        self.zip.close()
        total = self.stream.tell()
        self.stream.close()
        return self.path, total, len(self.lines)


class _Sink(io.RawIOBase):
    def __init__(self, stream: pa.NativeFile):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)


def write_packages(records: DataFrame, folder: str, package_bytes: int = 128 << 20, level: int = 6, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``page_records`` to packages below ``folder``; returns (path, bytes, records) of each, stored.

    A package is closed when its records hold ``package_bytes``. The list is what counts: a task
    that fails or is run twice may leave a package that is not on it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        package, done = None, []
        for batch in batches:
            for piece in slices([batch], "payload"):
                for row in piece.to_pylist():
                    package = package or _Package(system, f"{base}/{uuid.uuid4().hex}.wacz", level, date)
                    _add_page(package, row)
                    if package.size >= package_bytes:
                        done.append(package.close())
                        package = None
        if package is not None:
            done.append(package.close())
        paths, sizes, numbers = zip(*done, strict=True) if done else ((), (), ())
        uris = [folder.rstrip("/") + p[len(base.rstrip("/")) :] for p in paths]
        yield pa.record_batch([pa.array(uris, pa.string()), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64())], names=["path", "bytes", "records"])

    return written_once(records.mapInArrow(write, MANIFEST), "packages")


def _add_page(package: _Package, row: dict) -> None:
    page, response = row["page_id"], row["record_type"] == "response"
    digest = base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()
    url = None if row["url"] is None else quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~")
    name = _urn(page, digest, "" if response and row["sole"] else f"{package.path.rsplit('/', 1)[1].removesuffix('.wacz')}-{package.size}")
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", name), ("WARC-Date", package.date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", None if response else REVISIT_PROFILE), ("WARC-Refers-To", None if response else _urn(row["refers_to"], digest)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    block = _http(row["payload_bytes"]) + (row["payload"] or b"" if response else b"")
    package.add(fields, block, {"url": url, "mime": "text/html" if response else "warc/revisit", "status": "200", "digest": f"sha1:{digest}"})


# ---- reading: directories ---------------------------------------------------------------------

Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    header: int
    packed: int
    size: int


def _directory(read: Read, total: int) -> tuple[int, int, int, int]:
    """(offset, size, entries, shift) of the central directory; ``shift`` is the length of what precedes the ZIP file."""
    tail_at = max(0, total - (22 + 0xFFFF))
    tail = read(tail_at, total - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)  # a comment may hold the signature; the real one's comment ends the file
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut off")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    if end >= 20 and (locator := read(end - 20, 20)).startswith(b"PK\6\7"):
        wanted = struct.unpack_from("<Q", locator, 8)[0]
        # what precedes the file moves the record; it then ends right before its locator
        for place in (wanted, end - 20 - 56):
            record = read(place, 56) if 0 <= place <= total - 56 else b""
            if record.startswith(b"PK\6\6"):
                entries, size, offset = struct.unpack_from("<QQQ", record, 32)
                return offset + place - wanted, size, entries, place - wanted
        raise ValueError("no ZIP64 end of central directory where its locator points")
    shift = end - size - offset
    if shift < 0:
        raise ValueError("the central directory overlaps its end record")
    return offset + shift, size, entries, shift


def members(read: Read, total: int, block: int = 1 << 20) -> Iterator[Member]:
    """The entries of the central directory, read in blocks."""
    at, size, entries, shift = _directory(read, total)
    end, held, seen = at + size, b"", 0
    while seen < entries:
        need = 46 if len(held) < 46 else 46 + sum(struct.unpack_from("<HHH", held, 28))
        if len(held) < need:
            more = read(at, min(max(block, need - len(held)), end - at))
            if not more:
                raise ValueError(f"the central directory ends after {seen} of {entries} entries")
            at, held = at + len(more), held + more
            continue
        if not held.startswith(b"PK\1\2"):
            raise ValueError("no directory entry where one should be")
        flags, method = struct.unpack_from("<HH", held, 8)
        packed, full, n, extra = struct.unpack_from("<IIHH", held, 20)
        (header,) = struct.unpack_from("<I", held, 42)
        values = {"full": full, "packed": packed, "header": header}
        values |= _zip64(held[46 + n : 46 + n + extra], [k for k, v in values.items() if v == 0xFFFFFFFF])
        name = held[46 : 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        yield Member(name, method, values["header"] + shift, values["packed"], values["full"])
        held, seen = held[need:], seen + 1


def _zip64(extra: bytes, wanted: list[str]) -> dict[str, int]:
    """The 8-byte values of the ZIP64 field for the 4-byte ones that are full, which come in a fixed order."""
    at = 0
    while wanted and at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1 and size >= 8 * len(wanted):
            return dict(zip(wanted, struct.unpack_from(f"<{len(wanted)}Q", extra, at + 4), strict=True))
        at += 4 + size
    if wanted:
        raise ValueError("a ZIP64 entry without its sizes")
    return {}


def data_start(read: Read, member: Member) -> int:
    """Where the bytes of a member begin: after its local header, whose lengths differ from the directory's."""
    local = read(member.header, 30)
    if not local.startswith(b"PK\3\4"):
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def stored_places(read: Read, total: int) -> Iterator[tuple[int, int]]:
    """(offset, length) in the file of every indexed record of a package."""
    archives, indexes = {}, []
    for m in members(read, total):
        base = m.name.rsplit("/", 1)[-1]
        if m.name.startswith("archive/") and base:
            archives[base] = m
        elif m.name.startswith("indexes/") and base.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
            indexes.append(m)
    starts = {}
    for m in indexes:
        for line in _lines(read, m):
            if b"{" not in line:
                continue
            entry = json.loads(line[line.index(b"{") :])
            name = entry["filename"].rsplit("/", 1)[-1]
            if name not in archives:
                raise ValueError(f"the index names {name}, which the package lacks")
            held = archives[name]
            if held.method != zipfile.ZIP_STORED:
                raise ValueError(f"{held.name} is not stored, so that no range of it can be read")
            if name not in starts:
                starts[name] = data_start(read, held)
            offset, length = int(entry["offset"]), int(entry["length"])
            if offset + length > held.packed:
                raise ValueError(f"the index points beyond {held.name}")
            yield starts[name] + offset, length


def _lines(read: Read, member: Member, block: int = 1 << 20) -> Iterator[bytes]:
    """The lines of an index, which may be stored, deflated or a gzip file of its own."""
    at = data_start(read, member)
    end, held = at + member.packed, b""
    if member.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{member.name} is packed by method {member.method}")
    unpack = zlib.decompressobj(-15) if member.method else None
    gunzip = zlib.decompressobj(31) if member.name.endswith(".gz") else None
    while at < end:
        data = read(at, min(block, end - at))
        at += len(data)
        data = unpack.decompress(data) if unpack else data
        while gunzip is not None and data:  # an index may be many gzip members
            text = gunzip.decompress(data)
            data, more = gunzip.unused_data, gunzip.eof
            gunzip = zlib.decompressobj(31) if more else gunzip
            held += text
            if not more:
                break
        held += data if gunzip is None else b""
        *whole, held = held.split(b"\n")
        yield from whole
    if held:
        yield held


def package_files(spark: SparkSession, folder: str, pattern: str = "*.wacz") -> DataFrame:
    """(path) of the packages of a folder, for archives that were written elsewhere."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")


def record_places(packages: DataFrame) -> DataFrame:
    """(path, offset, length) of every indexed record of the packages (path)."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                with _opened(uri) as f:
                    some: list[tuple[int, int]] = []
                    try:
                        for place in stored_places(lambda at, n, f=f: f.read_at(n, at), f.size()):
                            some.append(place)
                            if len(some) == 1 << 16:
                                yield _places(uri, some)
                                some = []
                    except ValueError as e:
                        raise ValueError(f"{uri}: {e}") from e
                    yield _places(uri, some)

    return packages.select("path").repartition(1 + packages.count() // 8, "path").mapInArrow(locate, "path string, offset long, length long")


def _places(uri: str, some: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([uri] * len(some), pa.string()), pa.array([a for a, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], names=["path", "offset", "length"])


def _opened(uri: str) -> pa.NativeFile:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


# ---- reading: records -------------------------------------------------------------------------


def parsed_record(data: bytes) -> dict:
    """The columns of a record from its bytes; the payload's digest is worked out again and must be the stated one."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record where the index points")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("a record is cut off")
    kind, stated = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if kind == "revisit":
            lengths = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(lengths[0]) if lengths else None
    if kind == "response" and stated and base32_sha1(payload) != stated:
        raise ValueError(f"the payload of {fields.get('warc-record-id')} has not the stated digest")
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "page_id": _page(fields.get("warc-record-id")), "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": size,
        "payload_digest": stated or base32_sha1(payload), "payload": None if kind == "revisit" else payload,
    }


def _page(name: str | None) -> int | None:
    parts = (name or "").strip("<>").split(":")
    return int(parts[2]) if parts[:2] == ["urn", "x-page"] and parts[2] != "none" else None


def _runs(places: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Places in order, as runs of records of one package that lie close enough for one read."""
    path, run, first, end = None, [], 0, 0
    for uri, offset, length in places:
        if run and (uri != path or offset - end > GAP_BYTES or offset < first or offset + length - first > RUN_BYTES):
            yield path, run
            run = []
        if not run:
            path, first = uri, offset
        run.append((offset, length))
        end = offset + length
    if run:
        yield path, run


def read_records(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """The indexed records of the packages (path): path, offset, record_id, record_type, target_uri, page_id, refers_to, payload_bytes, payload_digest, payload.

    A package that is damaged, or an index that points at something else than a record, ends the
    job with an error that names it. Records that no index names are not read. ``page_id`` and
    ``refers_to`` come from record ids of this module's form, and are null for others.
    """
    names = [c.split(" ")[0] for c in RECORD.split(", ")] + (["payload"] if with_payload else [])
    schema = RECORD + (", payload binary" if with_payload else "")
    types = {"offset": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        places = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
        for path, run in _runs(places):
            if path != now:
                if f is not None:
                    f.close()
                now, f = path, _opened(path)
            first = run[0][0]
            data = f.read_at(max(o + n for o, n in run) - first, first)
            out = []
            for offset, length in run:
                try:
                    out.append(parsed_record(data[offset - first : offset - first + length]) | {"path": path, "offset": offset})
                except (ValueError, KeyError, OSError, EOFError, zlib.error) as e:
                    raise ValueError(f"{path} at {offset}: {e}") from e
            yield pa.record_batch([pa.array([r[n] for r in out], types.get(n, pa.string())) for n in names], names=names)
        if f is not None:
            f.close()

    places = written_once(record_places(packages).withColumn("part", F.floor(F.col("offset") / RUN_BYTES)), "record-places")
    # places are few bytes, but each stands for a record: tasks are as many as the parts call for
    tasks = 1 + places.groupBy("path", "part").agg(F.count("*").alias("n")).count() // 4
    places = places.repartition(tasks, "path", "part").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    return places.mapInArrow(read, schema)


def archived_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a WARC record for each row of (page_id, url, html) and read the packages back: page_id, payload_bytes, payload_digest, record_type, refers_to, and where each lies.

    ``payload_digest`` is the SHA-1 of the full payload in base32, ``payload_bytes`` its length, for
    revisits too. Of equal payloads of ``least_bytes`` or more, empty ones included, one record is
    the response, that of the largest page_id (see ``page_records`` for ties); ``refers_to`` is that id.

    A null html is empty; a null page_id is smaller than any other, and a revisit of it refers to
    null; a null url is left out; rows that repeat are records of their own; other columns do not
    matter; an empty table gives no rows. Packages go to ``folder``, or to the session's shared folder.
    """
    packages = write_packages(page_records(pages, least_bytes), folder or work_dir(pages.sparkSession, "warc"))
    found = read_records(packages, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset")


def archived_pages_sql(least_bytes: int = 0) -> str:
    """The columns of ``archived_pages`` but the places in DuckDB's SQL, which writes no archive. Rows that repeat one page_id and html are not told apart."""
    five = "('0x' || substr(hex, 5 * g + 1, 5))::BIGINT"
    letters = f"list_transform([32768, 1024, 32, 1], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({five}) // d) % 32 + 1)::INT, 1))"
    return f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), tops AS (
  SELECT html, max(page_id) AS top FROM payloads WHERE payload_bytes >= {least_bytes} GROUP BY html
)
SELECT p.page_id, p.payload_bytes, array_to_string(list_transform(range(8), lambda g: array_to_string({letters}, '')), '') AS payload_digest,
       CASE WHEN t.top IS NULL OR t.top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN t.top <> p.page_id THEN t.top END AS refers_to
FROM payloads p LEFT JOIN tops t ON t.html = p.html
"""
