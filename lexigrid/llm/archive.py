"""Operator 10, web archives packaged in ZIP files, read by range.

A package is a ZIP file whose members are stored, not compressed: ``archive/*.warc.gz`` (each record a gzip member of its own),
``indexes/*.cdxj`` (a line for each record: sort key, time stamp, JSON with filename, offset and length) and ``datapackage.json``. The reader takes the end of the
central directory (with the ZIP64 locator and record, and the ZIP64 fields of entries), finds the members, turns each index line into an absolute range
of the file, and tasks fetch and parse those ranges. Nothing is extracted, and no more than directories, indexes and the wanted
records is read.
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
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .records import _filesystem
from .shared import fresh_path, partitions, save, small_batches, table

#: Pages in a package, and about the bytes of text in one; a task closes a package at either.
PACKAGE_PAGES = 5_000
PACKAGE_BYTES = 64 << 20
TIME = "20260101000000"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MOST_COMMENT = 65_535
#: Header of a record that stands for a null text.
NO_TEXT = "x-no-text"
#: Records are read together if no more than GAP bytes lie between them, up to MOST_READ bytes at once.
GAP = 64 << 10
MOST_READ = 8 << 20


class Member:
    def __init__(self, name: str, method: int, size: int, packed: int, header: int, crc: int):
        self.name, self.method, self.size, self.packed, self.header, self.crc = name, method, size, packed, header, crc


def directory(read, size: int) -> list[Member]:
    """The members in a ZIP file's central directory. read(offset, length) gives bytes of the file."""
    tail_at = max(0, size - 22 - MOST_COMMENT - 20)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)  # the mark was part of a comment or of data
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        record = read(where, 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator names no ZIP64 record")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    data, out, at = read(offset, length), [], 0
    for _ in range(count):
        if data[at : at + 4] != ENTRY:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", data, at + 16)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: only the fields that are full in the entry, in this order
                p = e + 4
                if plain == 0xFFFFFFFF:
                    plain, p = struct.unpack_from("<Q", extra, p)[0], p + 8
                if packed == 0xFFFFFFFF:
                    packed, p = struct.unpack_from("<Q", extra, p)[0], p + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", extra, p)[0]
            e += 4 + n
        out.append(Member(name, method, plain, packed, header, crc))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_offset(read, member: Member) -> int:
    """Where a member's bytes begin: its local header may differ in length from the directory's entry."""
    head = read(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name}: no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def member_bytes(read, member: Member) -> bytes:
    raw = read(data_offset(read, member), member.packed)
    if member.method == 0:
        return raw
    if member.method == 8:
        return zlib.decompress(raw, -15)
    raise ValueError(f"{member.name}: method {member.method} isn't supported")


def record_ranges(read, size: int) -> Iterator[tuple[str, int, int, str]]:
    """(archive member, absolute offset, length, index line's URL) of each record that the package's indexes name."""
    members = {m.name: m for m in directory(read, size)}
    bases: dict[str, int] = {}
    for name, member in members.items():
        if not name.startswith("indexes/") or not name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
            continue
        body = member_bytes(read, member)
        for line in (gzip.decompress(body) if name.endswith(".gz") else body).decode("utf-8").splitlines():
            if "{" not in line or line.startswith("!"):
                continue
            fields = json.loads(line[line.index("{") :])
            target = fields["filename"] if fields["filename"] in members else "archive/" + fields["filename"]
            if target not in members:
                raise ValueError(f"an index names {target}, which isn't in the package")
            if members[target].method != 0:
                raise ValueError(f"{target} isn't stored: its records can't be read by range")
            if target not in bases:
                bases[target] = data_offset(read, members[target])
            if int(fields["offset"]) + int(fields["length"]) > members[target].size:
                raise ValueError(f"an index names bytes beyond the end of {target}")
            yield target, bases[target] + int(fields["offset"]), int(fields["length"]), fields.get("url", "")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower case) and block of a record."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError("a WARC record is cut off")
    return headers, rest[:length]


def _dechunked(body: bytes) -> bytes:
    """The body of a chunked HTTP message; as it is if it isn't one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size):
            return body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if end + 2 + n > len(body):
            return body
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def payload(headers: dict[str, str], block: bytes) -> tuple[bytes, list[bytes]]:
    """What the record is about, and what its payload digest may cover: for HTTP messages the body, with and without its transfer encoding."""
    if not headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block, [block]
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/") and headers.get("warc-type") != "request":
        return block, [block]
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    plain = _dechunked(body) if "chunked" in fields.get("transfer-encoding", "") else body
    text, coding = plain, fields.get("content-encoding", "")
    try:
        if coding in ("gzip", "x-gzip"):
            text = gzip.decompress(plain)
        elif coding == "deflate":
            text = zlib.decompress(plain, -15 if plain[:1] != b"x" else 15)
    except (OSError, EOFError, zlib.error):
        text = plain  # some archives keep the header of a body that they have decoded
    return text, [plain, body, block, text]


def agrees(digest: str, contents: list[bytes]) -> bool:
    """Whether a labelled digest (``sha1:`` in hexadecimal or base 32, ``sha256:``, ``md5:``) is that of any of these; other labels can't be checked."""
    name, _, value = digest.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "md5"):
        return True
    for c in contents:
        own = hashlib.new(name, c).digest()
        if value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("="):
            return True
    return False


def text_of(headers: dict[str, str], body: bytes) -> str | None:
    """The payload as text; None for the mark of a page without any."""
    return None if headers.get(NO_TEXT) else body.decode("utf-8", "replace")


def make_record(number: int, url: str, html: str | None) -> bytes:
    body = b"" if html is None else html.encode()
    kind = b"metadata" if html is None else b"resource"
    digest = hashlib.sha1(body).hexdigest()
    head = b"WARC/1.1\r\nWARC-Type: %b\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Target-URI: %b\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:%b\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%b\r\n" % (kind, number, url.replace("\r", "%0D").replace("\n", "%0A").encode(), digest.encode(), len(body), b"" if html is not None else NO_TEXT.encode() + b": yes\r\n")
    return gzip.compress(head + body + b"\r\n\r\n", 3, mtime=0)


def sort_key(url: str) -> str:
    """Host parts in reverse order, then the path."""
    rest = url.partition("://")[2] or url
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.lower().split("."))) + ")" + slash + path


def package(records: list[tuple[int, str, bytes]], force_zip64: bool = False) -> bytes:
    """A package of these (page_id, url, record) rows."""
    out, at, lines = io.BytesIO(), 0, []
    for _, url, raw in records:
        lines.append(f"{sort_key(url)} {TIME} " + json.dumps({"url": url, "filename": "data.warc.gz", "offset": at, "length": len(raw)}, ensure_ascii=False))
        at += len(raw)
    body = b"".join(r for _, _, r in records)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in (("archive/data.warc.gz", body), ("indexes/index.cdxj", "\n".join(sorted(lines)).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz", "bytes": len(body)}]}).encode())):
            with z.open(zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0)), "w", force_zip64=force_zip64) as f:
                f.write(data)
    return out.getvalue()


def _write(batches, folder):
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    held: list[tuple[int, str, bytes]] = []
    size = 0

    def close():
        name = f"pages-{uuid.uuid4().hex}.wacz"
        with system.open_output_stream(f"{path}/{name}") as f:
            f.write(package(held))
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], ["file", "records"])

    for b in tk.slices(batches, "html"):
        for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist()):
            held.append((page, url, make_record(page, url, html)))
            size += len(held[-1][2])
            if len(held) >= PACKAGE_PAGES or size >= PACKAGE_BYTES:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def write_packages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to packages; file and records of each. A task that is run again writes other files, and the result names those that count.

    Rows without page_id are left out; a null URL counts as ''; a null html makes a metadata record, so that it reads as null again; an empty
    table writes nothing; other columns are ignored."""
    small_batches(pages.sparkSession)
    folder = folder or fresh_path(pages.sparkSession, "packages")
    rows = pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string").alias("html"))
    return save(rows.mapInArrow(lambda it: _write(it, folder), "file string, records bigint"), "packages")


def _reader(uri: str):
    system, path = _filesystem(uri)
    f = system.open_input_file(path)
    return f, lambda offset, length: f.read_at(length, offset)


def _ranges(batches):
    for b in batches:
        for file in b.column("file").to_pylist():
            f, read = _reader(file)
            with f:
                rows = list(record_ranges(read, f.size()))
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())], ["file", "offset", "length"])


def _runs(ranges: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, [(offset, length)]): sorted ranges, with neighbours together."""
    held: list[tuple[int, int]] = []
    name, start, end = "", 0, 0
    for file, offset, length in ranges:
        if held and (file != name or offset > end + GAP or max(end, offset + length) - start > MOST_READ):
            yield name, start, end, held
            held = []
        if not held:
            name, start, end = file, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield name, start, end, held


def _fetch(batches):
    f = name = None
    for b in batches:
        rows = sorted(zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()))
        for file, start, end, parts in _runs(rows):
            if file != name:
                if f is not None:
                    f.close()
                f, read = _reader(file)
                name = file
            data = read(start, end - start)
            for at in range(0, len(parts), 64):
                out = {"page_id": [], "url": [], "html": [], "warc_type": []}
                for offset, length in parts[at : at + 64]:
                    headers, block = parse_record(data[offset - start : offset - start + length])
                    body, contents = payload(headers, block)
                    if not agrees(headers.get("warc-payload-digest", ""), contents) or not agrees(headers.get("warc-block-digest", ""), [block]):
                        raise ValueError(f"{file} at {offset}: the record's digest is wrong")
                    number = headers.get("warc-record-id", "").removeprefix("<urn:page:").removesuffix(">")
                    out["page_id"].append(int(number) if number.lstrip("-").isdigit() else None)
                    out["url"].append(headers.get("warc-target-uri", ""))
                    out["html"].append(text_of(headers, body))
                    out["warc_type"].append(headers.get("warc-type"))
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "page_id" else pa.string()) for k, v in out.items()})
    if f is not None:
        f.close()


def read_packages(files: DataFrame) -> DataFrame:
    """page_id, url, html, warc_type of all records in the packages that column ``file`` names. page_id is null in records of other writers; html is the
    body of an HTTP message, decoded, or the block of another record, as UTF-8.

    A damaged package, index or record raises ValueError; null file names are left out; a file named twice is read twice; an empty table
    gives none."""
    spark = files.sparkSession
    small_batches(spark)
    ranges = save(files.where("file IS NOT NULL").select("file").repartition(partitions(spark)).mapInArrow(_ranges, "file string, offset bigint, length bigint"), "ranges")
    return ranges.mapInArrow(_fetch, "page_id bigint, url string, html string, warc_type string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to packages and read from them by range, with the length and digest of each."""
    found = read_packages(write_packages(table(spark, sf_dir, "pages")))
    return found.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("digest"))


SQL = "SELECT page_id, coalesce(url, '') AS url, length(html) AS n_chars, md5(html) AS digest FROM pages WHERE page_id IS NOT NULL"
