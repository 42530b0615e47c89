"""WARC records in ZIP archives: writer, and a reader that takes records by range without extracting.

An archive holds stored members: ``data-N.warc.gz`` with records, each compressed for itself as the WARC standard has
it, and ``data-N.cdx`` with their places. The reader parses the end record, the ZIP64 end record where there is one, and
the central directory; a stored member's bytes lie in the file as they are, so an index entry gives the absolute place
of a record, and neighbouring records are fetched in one range read. Records that are not compressed are read as well.
Members that ZIP itself has compressed or encrypted are an error: no range of them can be read.

Of pages with equal payloads (SHA-1 and length) of at least ``revisit_from`` bytes the one with the largest page_id
is a response, the others are revisit records that refer to it; they keep its HTTP headers, so the length stays known.

Defined results: a null html is an empty payload; a null url gives a record without target; rows with a null
page_id are always responses; repeated rows of the largest page_id are each a response; an empty table gives no
archives and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, stored

MEMBER_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
#: Effort of the records' compression; groups of equal payloads, by count, that every task may hold (some 100 bytes each).
LEVEL, HELD_GROUPS = 4, 200_000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record, compressed or not; the payload's digest is checked."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload and digest differ")
    number = lambda x: int(x.removeprefix("<urn:x-page:").removesuffix(">") or -1) if x != "<urn:x-page:>" else None
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload}


def directory(f) -> list[tuple[str, int, int]]:
    """(name, place of the first byte, size) of the stored members of an open archive, by its central directory."""
    size = f.size()
    tail = f.read_at(min(size, 22 + 65535 + 20), max(0, size - 22 - 65535 - 20))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, at = struct.unpack_from("<8xHHLLH", tail, end)[1:4]
    n_total = n
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        at64 = struct.unpack_from("<4xLQL", tail, end - 20)[1]
        end64 = f.read_at(56, at64)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
        n_total, length, at = struct.unpack_from("<32xQQQ", end64)
    data, k, out = f.read_at(length, at), 0, []
    for _ in range(n_total):
        if data[k : k + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", data, k + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<LLHHH", data, k + 20)
        local = struct.unpack_from("<L", data, k + 42)[0]
        name = data[k + 46 : k + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[k + 46 + n_name : k + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n_field = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[4 : 4 + n_field - n_field % 8])]
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n_field :]
        if method != 0 or flags & 1:
            raise ValueError(f"{name} is compressed or encrypted")
        head = f.read_at(30, local)
        out.append((name, local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed))
        k += 46 + n_name + n_extra + n_comment
    return out


def with_types(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """(page_id, url, html, digest hex, refers_to) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    groups = rows.where(F.col("size") >= revisit_from).groupBy("sha", "size").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    groups = stored(groups, "groups")
    few = groups.count() <= HELD_GROUPS  # then no page needs to move; beyond that pages and groups meet by digest
    joined = rows.join(F.broadcast(groups) if few else groups.hint("merge"), ["sha", "size"], "left")
    return joined.select("page_id", "url", "html", "sha", F.when(F.col("page_id") < F.col("_last"), F.col("_last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> None:
    """One archive per task, under a name that a repeated task gives again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"{base}/pages-{context.partitionId():06d}"
        part, archive, count, n = f"{name}.{context.taskAttemptId()}.part", None, 0, 0
        body, index = bytearray(), []

        def flush() -> None:
            nonlocal n
            archive.writestr(f"data-{n:05d}.warc.gz", bytes(body))
            archive.writestr(f"data-{n:05d}.cdx", "\n".join(index))
            body.clear(), index.clear()
            n += 1

        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    out = fs.open_output_stream(part)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                data = record(row["page_id"], row["url"], row["html"].encode(), digest, row["refers_to"])
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = squeeze.compress(data) + squeeze.flush()
                index.append(f"{'-' if row['page_id'] is None else row['page_id']} {len(body)} {len(data)}")
                body += data
                count += 1
                if len(body) >= MEMBER_BYTES:
                    flush()
        if archive is not None:
            if index:
                flush()
            archive.close()
            out.close()
            fs.move(part, name + ".zip")
        yield pa.RecordBatch.from_pylist([{"n": count}])

    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record (``RECORDS``, and payload if wanted) of the archives in a folder."""
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    paths = sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(base)) if x.path.endswith(".zip"))
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4096)), "path")
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * with_payload

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with fs.open_input_file(path) as f:
                    members = {name: (at, size) for name, at, size in directory(f)}
                    for name, (at, size) in members.items():
                        if not name.endswith(".cdx"):
                            continue
                        start = (members.get(name[:-4] + ".warc.gz") or members[name[:-4] + ".warc"])[0]
                        first, sizes = None, []
                        for line in f.read_at(size, at).decode().split("\n"):
                            _, place, length = line.split(" ")
                            if first is not None and sum(sizes) + int(length) > RANGE_BYTES:
                                rows.append({"path": path, "at": start + first, "sizes": sizes})
                                first, sizes = None, []
                            first = int(place) if first is None else first
                            sizes.append(int(length))
                        if sizes:
                            rows.append({"path": path, "at": start + first, "sizes": sizes})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("at", pa.int64()), ("sizes", pa.list_(pa.int64()))]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        opened, f = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != opened:
                    opened, f = row["path"], fs.open_input_file(row["path"])
                data, at, out = f.read_at(sum(row["sizes"]), row["at"]), 0, []
                for size in row["sizes"]:
                    out.append(parse(data[at : at + size]))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in zip(names, kinds, strict=False)], names)

    return listed.mapInArrow(ranges, "path string, at long, sizes array<long>").mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    folder = new_path(pages.sparkSession, "archives")
    write_archives(with_types(pages, revisit_from), folder)
    return read_archives(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
