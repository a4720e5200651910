"""WARC archives inside ZIP packages: writing, directories, and range reads without extraction.

A package holds the stored members ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.jsonl`` (place
of each record). The reader finds the end record, follows the ZIP64 locator where there is one, parses the central
directory, finds where the stored members' bytes begin, reads the index and then fetches only byte ranges of records:
ranges are dealt out to tasks in slices of ``SLICE_BYTES``, so one package is read by many tasks. A package without index
is read as one stream. Compressed or encrypted archive members can't be read by range and are refused with an error.

Each task streams its rows to packages of about ``PACKAGE_BYTES`` in the shared folder; memory is bounded by one record. A
repeated task writes files of other names, and only those of the attempt that counted stand in the list of packages.

Defined cases: a null text is an empty payload; a null URL has no target line; line ends in a URL are percent-encoded. Of
equal payloads of at least ``REVISIT_BYTES`` bytes the row with the largest page id is the response (each, if that id
repeats, and all, if every id is null); an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rasterlake.llm.rows import partitions
from rasterlake.session import cut, ensure_checkpoint_dir

REVISIT_BYTES = 1000
PACKAGE_BYTES = 32 << 20
SLICE_BYTES = 2 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FULL = 0xFFFFFFFF


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or of a URI that pyarrow knows (file, hdfs, s3, gs, abfs)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class PackageWriter:
    """Stored members written as a stream: sizes follow the data, and the directory has them in ZIP64 form."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, FULL, FULL, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        m = self.members[-1]
        m[2], m[3] = zlib.crc32(data, m[2]), m[3] + len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, FULL, FULL, len(raw), len(extra), 0, 0, 0, 0, FULL) + raw + extra)
        size, end, n = self.at - start, self.at, len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, FULL, FULL, 0))
        self.out.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    encrypted: bool
    size: int
    header: int


def _range(f, start: int, size: int) -> bytes:
    f.seek(start)
    data = f.read(size)
    if len(data) != size:
        raise ValueError(f"the package ends inside a range: {start} + {size}")
    return data


def directory(f) -> list[Member]:
    """Members of the central directory of a package, classic or ZIP64."""
    total = f.size()
    span = min(total, 22 + 0xFFFF + 20)
    tail = _range(f, total - span, span)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end record of a package")
    size, start = struct.unpack_from("<II", tail, at + 12)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        place = struct.unpack_from("<Q", tail, at - 12)[0]
        size, start = struct.unpack_from("<QQ", _range(f, place, 56), 40)
    data, at, out = _range(f, start, size), 0, []
    while at < len(data):
        sign, _, _, flags, method, _, _, _, packed, plain, n, m, k, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
        if sign != 0x02014B50:
            raise ValueError("the central directory is damaged")
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = data[at + 46 + n : at + 46 + n + m], 0
        while e + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # only the saturated fields stand there, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                plain = wide.pop(0) if plain == FULL else plain
                packed = wide.pop(0) if packed == FULL else packed
                header = wide.pop(0) if header == FULL else header
            e += 4 + length
        out.append(Member(name, method, bool(flags & 1), packed, header))
        at += 46 + n + m + k
    return out


def data_start(f, member: Member) -> int:
    """First byte of a stored member."""
    if member.method or member.encrypted:
        raise ValueError(f"{member.name} is not stored as it is, so it can't be read by range")
    sign, n, m = struct.unpack("<I22xHH", _range(f, member.header, 30))
    if sign != 0x04034B50:
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + n + m


def _record(row: dict) -> bytes:
    """One WARC record of a page."""
    name = "null" if row["page_id"] is None else str(row["page_id"])
    payload = row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def parse(record: bytes) -> dict:
    """Headers and payload of one record; a response whose payload doesn't fit its digest is refused."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")]
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't fit its digest")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
        "payload_bytes": len(payload) if kind == "response" else sizes[0], "payload_digest": digest, "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


def _writer(folder: str, package_bytes: int):
    def run(batches):
        store, root = open_store(folder)
        made, writer, index = [], None, []

        def close():
            writer.end()
            writer.begin(INDEX)
            writer.write("".join(index).encode())
            writer.end()
            writer.close()

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if writer is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.wacz"
                    writer, index, first = PackageWriter(store.open_output_stream(f"{root}/{name}", compression=None)), [], 0
                    made.append(f"{folder}/{name}")
                    writer.begin(ARCHIVE)
                    first = writer.at
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(_record(row)) + z.flush()
                index.append(json.dumps({"page": row["page_id"], "filename": ARCHIVE, "offset": writer.at - first, "length": len(data)}) + "\n")
                writer.write(data)
                if writer.at >= package_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["package"])

    return run


def write_packages(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """The paths of the packages that hold a record of each (page_id, url, html) row."""
    folder = f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/packages-{uuid.uuid4().hex}"
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    repeats = cut(large.filter("n > 1").select("payload_digest", "keep"))
    joined = rows.join(repeats, "payload_digest", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    typed = joined.select(
        "page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keep")).alias("refers_to"),
    )
    return cut(typed.mapInArrow(_writer(folder, package_bytes), "package string"))


def _list(batches):
    """Slices of neighbouring records of each package; no lengths where there is no index."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = open_store(path)
            with store.open_input_file(name) as f:
                members = {m.name: m for m in directory(f)}
                starts = {m.name: data_start(f, m) for m in members.values() if m.name.startswith("archive/")}
                rows: list[tuple[int, list[int]]] = []
                if INDEX in members:
                    held: list[int] = []
                    begin = size = end = 0
                    raw = _range(f, data_start(f, members[INDEX]), members[INDEX].size)
                    for entry in map(json.loads, raw.splitlines()):
                        place = starts[entry["filename"]] + entry["offset"]
                        if held and (size >= SLICE_BYTES or place != end):
                            rows.append((begin, held))
                            held, size = [], 0
                        if not held:
                            begin = place
                        held.append(entry["length"])
                        size += entry["length"]
                        end = place + entry["length"]
                    if held:
                        rows.append((begin, held))
                else:
                    rows = [(s, [-members[n].size]) for n, s in starts.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                ["package", "start", "lengths"],
            )


def _stream(f, start: int, size: int):
    """Records of an archive member without index, one gzip member after the other."""
    f.seek(start)
    left, data = size, b""
    while left or data:
        z, record = zlib.decompressobj(31), b""
        while not z.eof:
            if not data:
                data = f.read(min(1 << 20, left))
                left -= len(data)
                if not data:
                    raise ValueError("the archive ends inside a record")
            record += z.decompress(data)
            data = z.unused_data
        yield record


def _fetch(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            store, name = open_store(path)
            with store.open_input_file(name) as f:
                if lengths[0] < 0:
                    for record in _stream(f, start, -lengths[0]):
                        yield pa.RecordBatch.from_pylist([parse(record)], schema)
                    continue
                data, at, rows = _range(f, start, sum(lengths)), 0, []
                for n in lengths:
                    rows.append(parse(zlib.decompress(data[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_packages(packages: DataFrame) -> DataFrame:
    """One row per record of the packages whose paths are in the column ``package``."""
    slices = packages.select("package").repartition(partitions(packages)).mapInArrow(_list, "package string, start long, lengths array<long>")
    dealt = cut(slices).repartition(partitions(packages))
    return dealt.mapInArrow(_fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page written to packages and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_packages(write_packages(pages)).drop("payload", "url")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN keep IS NULL OR keep IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep <> page_id OR page_id IS NULL THEN keep END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
