"""WARC records in stored members of ZIP archives: written by tasks, read back by ranges.

An archive holds `archive/data.warc.gz`, a chain of records each compressed alone, and
`indexes/index.cdxj`, a line per record with its range in that member. Both members are
stored, so that a record is read by one range request, without extraction. Archives of
other writers may have any number of `archive/*.warc` and `archive/*.warc.gz`, and indexes
of lines that end in JSON, in `indexes/*.cdxj`, `*.cdx` or either compressed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitloom.llm.common import kept
from splitloom.operators.joins import lookup_side
from splitloom.session import scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes from which equal payloads are stored once.
LEAST_REVISIT = 100
#: An archive is closed when its data reach this size; reads take up to a window at once.
ARCHIVE_BYTES, WINDOW_BYTES = 256 << 20, 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE, NO_PAGE = "urn:page:", "urn:nopage"
#: Record bytes for one reading task, once there are more than the shuffle's partitions.
TASK_BYTES = 128 << 20
DATA_NAMES, INDEX_NAMES = (".warc", ".warc.gz"), (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")

RECORDS = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}, payload binary"


@dataclass
class Member:
    """An entry of a central directory."""

    name: str
    method: int
    packed: int
    size: int
    header: int


def _wide(entry: list[int], extra: bytes) -> list[int]:
    """Replace 32-bit fields that are all ones by those of the ZIP64 extra field, in its order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body = extra[at + 4 : at + 4 + size]
            values = iter(struct.unpack(f"<{len(body) // 8}Q", body[: len(body) // 8 * 8]))
            return [next(values) if value == 0xFFFFFFFF else value for value in entry]
        at += 4 + size
    return entry


def directory(read: Callable[[int, int], bytes], size: int) -> tuple[int, int, int]:
    """Start, length and entries of the central directory; ZIP64 records are followed."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("not a ZIP archive: no end of central directory")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at += 3
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end of central directory")
            entries, length, start = struct.unpack_from("<QQQ", end, 32)
    return start, length, entries


def members(read: Callable[[int, int], bytes], size: int) -> list[Member]:
    start, length, entries = directory(read, size)
    raw, at, found = read(start, length), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", raw, at + 10)[0]
        packed, plain, name, extra, comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        label = raw[at + 46 : at + 46 + name].decode()
        plain, packed, header = _wide([plain, packed, header], raw[at + 46 + name : at + 46 + name + extra])
        found.append(Member(label, method, packed, plain, header))
        at += 46 + name + extra + comment
    return found


def _data_start(read: Callable[[int, int], bytes], member: Member) -> int:
    head = read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    name, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name + extra


def stored_range(read: Callable[[int, int], bytes], member: Member) -> tuple[int, int]:
    """Where the bytes of a stored member lie."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed, so it has no ranges")
    return _data_start(read, member), member.packed


def _inflated(chunks: Iterator[bytes], window_bits: int) -> Iterator[bytes]:
    """Plain bytes of a chain of compressed streams."""
    unpacker = zlib.decompressobj(window_bits)
    for chunk in chunks:
        while chunk:
            yield unpacker.decompress(chunk)
            chunk = unpacker.unused_data
            if unpacker.eof:
                unpacker = zlib.decompressobj(window_bits)


def index_lines(read: Callable[[int, int], bytes], member: Member) -> Iterator[list[bytes]]:
    """The lines of an index, some at a time; it may be compressed by the archive, by gzip, or by both."""
    start, packed = _data_start(read, member), member.method == 8 or member.name.endswith(".gz")
    if member.method not in (0, 8):
        raise ValueError(f"{member.name} is compressed by an unknown method")
    step = 1 << 16 if packed else WINDOW_BYTES
    chunks = (read(start + at, min(step, member.packed - at)) for at in range(0, member.packed, step))
    if member.method == 8:
        chunks = _inflated(chunks, -15)
    if member.name.endswith(".gz"):
        chunks = _inflated(chunks, 31)
    rest = b""
    for chunk in chunks:
        *lines, rest = (rest + chunk).split(b"\n")
        yield lines
    yield [rest]


def index_entry(line: bytes) -> dict[str, object]:
    """The JSON at the end of an index line, after its key and time if it has them."""
    at = line.find(b"{")
    if at < 0:
        raise ValueError(f"index line without JSON: {line[:80]!r}")
    return json.loads(line[at:])


def _named(value: object) -> str:
    return NO_PAGE if value is None else PAGE + quote(str(value), safe="")


def record(
    page: object, url: str | None, kind: str, digest: str, size: int, refers_to: object, payload: bytes
) -> bytes:
    """One WARC/1.1 record, compressed. A revisit has the HTTP header of its page alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "about:blank"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_named(page)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_named(refers_to)}>"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode(errors="replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _page(name: str) -> str | None:
    """The page of a record's name; records of other writers have their name itself."""
    plain = name.strip("<>")
    if plain.startswith(PAGE):
        return unquote(plain.removeprefix(PAGE))
    return None if plain == NO_PAGE else plain


def _joined(chunked: bytes) -> bytes:
    """The payload of a chunked transfer."""
    parts, at = [], 0
    while True:
        end = chunked.index(b"\r\n", at)
        size = int(chunked[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        parts.append(chunked[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _holds(claim: str, payload: bytes) -> bool:
    """Whether a digest as `algorithm:value`, in hex or base 32, is the payload's; unknown algorithms hold."""
    algorithm, _, value = claim.partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return True
    got = hashlib.new(algorithm, payload)
    return value.lower() == got.hexdigest() or value.upper().rstrip("=") == base64.b32encode(got.digest()).decode().rstrip("=")


def parse_record(raw: bytes) -> dict[str, object]:
    """The parts of a record, compressed or not; a length or digest that does not hold is an error.

    The payload of an HTTP response is what follows its header, put together if it came in
    chunks; that of other records is their block. A revisit has none: its digest is the one it
    claims, bare if that is SHA-256, and its size the one of its HTTP header, NULL without one.
    """
    plain = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = _fields(head)
    length = int(fields["content-length"])
    block = rest[:length]
    if not head.startswith(b"WARC/1.") or len(block) < length:
        raise ValueError("broken WARC record")
    kind, claim = fields["warc-type"], fields.get("warc-payload-digest")
    http, payload = {}, block
    if fields.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(top)
    if kind == "revisit":
        size = int(http["content-length"]) if "content-length" in http else None
        digest = claim and claim.removeprefix("sha256:")
    else:
        if http.get("transfer-encoding", "").lower() == "chunked" and not (claim and _holds(claim, payload)):
            payload = _joined(payload)
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if claim and claim != f"sha256:{digest}" and not _holds(claim, payload):
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    refers = fields.get("warc-refers-to")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(refers) if refers else None,
        "payload": None if kind == "revisit" else payload,
    }


def planned(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to): the least id of equal payloads is the response."""
    html = F.coalesce(F.col(f"`{html_column}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"), html.alias("html"),
        F.sha2(html, 256).alias("digest"),
    )
    large = rows.where(F.octet_length("html") >= LEAST_REVISIT)
    again = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(lookup_side(again.drop("n")), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "html", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, **columns: str
) -> DataFrame:
    """Write archives below a folder that all executors share; returns (archive, records, bytes).

    Each task writes under names of its own attempt, and the returned table, itself
    stored, lists those of attempts that ended well; other files are never read.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = filesystems.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        task, number, done = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, []
        rows = (row for batch in batches for row in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "record_type", "refers_to"))))
        row = next(rows, None)
        while row is not None:
            name, lines, size = f"{task}-{number:05d}.wacz", [], 0
            with system.open_output_stream(f"{root}/{name}") as stream, zipfile.ZipFile(stream, "w") as archive:
                with archive.open(DATA, "w", force_zip64=True) as member:
                    while row is not None and size < archive_bytes:
                        page, url, html, digest, kind, refers = (None if pd.isna(value) else value for value in row)
                        payload = html.encode()
                        raw = record(page, url, kind, digest, len(payload), refers, payload)
                        member.write(raw)
                        lines.append(json.dumps({"offset": size, "length": len(raw), "type": kind}))
                        size += len(raw)
                        row = next(rows, None)
                with archive.open(INDEX, "w", force_zip64=True) as member:
                    for line in lines:
                        member.write(line.encode() + b"\n")
            done.append((f"{folder.rstrip('/')}/{name}", len(lines), size))
            number += 1
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    plan = planned(pages, **columns).withColumns(
        {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}  # integers with NULL would turn into floats
    )
    return kept(plan.mapInPandas(run, "archive string, records long, bytes long"), "warc-manifest")


def _reader(path: str) -> tuple[Callable[[int, int], bytes], int, Callable[[], None]]:
    system, name = filesystems.FileSystem.from_uri(path)
    file = system.open_input_file(name)

    def read(start: int, length: int) -> bytes:
        return file.read_at(length, start)

    return read, file.size(), file.close


def locate_records(archives: DataFrame) -> DataFrame:
    """(archive, start, length) of every record, from the directories and indexes alone.

    An index line without a file name stands for the archive's only data member. Data
    without an index, members that a line names but the archive lacks, and lines without
    JSON are errors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (path for batch in batches for path in batch["archive"]):
            read, size, close = _reader(path)
            found = members(read, size)
            data = {
                member.name.rpartition("/")[2]: stored_range(read, member)[0]
                for member in found
                if member.name.startswith("archive/") and member.name.endswith(DATA_NAMES)
            }
            indexes = [m for m in found if m.name.startswith("indexes/") and m.name.endswith(INDEX_NAMES)]
            if data and not indexes:
                raise ValueError(f"{path} has records but no index")
            alone = next(iter(data)) if len(data) == 1 else ""
            for member in indexes:
                for lines in index_lines(read, member):
                    entries = [index_entry(line) for line in lines if line.strip()]
                    if not entries:
                        continue
                    names = [str(entry.get("filename", alone)).rpartition("/")[2] for entry in entries]
                    if missing := set(names) - set(data):
                        raise ValueError(f"{path} has no stored member {sorted(missing)[0]!r}")
                    yield pd.DataFrame(
                        {
                            "archive": [path] * len(entries),
                            "start": [data[name] + int(entry["offset"]) for name, entry in zip(names, entries)],
                            "length": [int(entry["length"]) for entry in entries],
                        }
                    )
            close()

    return archives.select("archive").mapInPandas(run, "archive string, start long, length long")


def _reading_tasks(archives: DataFrame) -> int:
    """A task per window up to the shuffle's partitions, and one for every TASK_BYTES beyond."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["archive"]:
                _, size, close = _reader(path)
                close()
                found.append(size)
            yield pd.DataFrame({"bytes": found})

    sized = archives if "bytes" in archives.columns else archives.select("archive").mapInPandas(sizes, "bytes long")
    row = sized.agg(F.sum("bytes").alias("bytes"), F.sum(F.expr(f"bytes div {WINDOW_BYTES} + 1")).alias("windows")).first()
    most = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(row.windows or 1, most), (row.bytes or 0) // TASK_BYTES)


def read_records(archives: DataFrame, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """Every record of the archives: ids, sizes, digests, type, and a payload.

    `archives` has the paths as `archive`, and sizes as `bytes` if they are known. Records of
    other writers have names in place of ids, so their `id_type` is string. Windows of
    neighbouring records are read at once; they are dealt over a number of tasks that follows
    from the bytes of the archives, so that one large archive is read by many.
    """
    ranges = locate_records(archives).withColumn("window", F.expr(f"start div {WINDOW_BYTES}"))
    dealt = ranges.repartition(_reading_tasks(archives), "archive", "window").sortWithinPartitions("archive", "start")
    schema = RECORDS.format(id="string") if with_payload else RECORDS.format(id="string").removesuffix(", payload binary")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (path, _), part in batch.groupby(["archive", "window"], sort=False):
                read, _, close = _reader(path)
                begin = int(part["start"].iloc[0])
                end = int(part["start"].iloc[-1] + part["length"].iloc[-1])
                raw = read(begin, end - begin)
                close()
                parsed = [
                    parse_record(raw[start - begin : start - begin + length])
                    for start, length in zip(part["start"], part["length"])
                ]
                yield pd.DataFrame(parsed, columns=names)

    records = dealt.mapInPandas(run, schema)
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, with_payload: bool = False, **columns: str) -> DataFrame:
    """Write a WARC record per page to archives and read all of them back.

    NULL html is an empty payload, a NULL url `about:blank`. Payloads under 100 bytes
    are all responses. Rows of one id with an equal payload are each a response if the
    id is the least. A row with a NULL id refers to the least id, and is a response
    if there is none. An empty table gives no rows. Further columns are left out.
    """
    id_type = pages.schema[columns.get("id_column", "page_id")].dataType.simpleString()
    return read_records(write_archives(pages, **columns), id_type, with_payload)
