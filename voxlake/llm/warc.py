"""WARC archives as a Spark data source: planned file parts, pushed-down header predicates, payloads read only on demand."""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from voxlake.llm.common import new_folder, table

RECORD = "page_id long, record_type string, uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648
HEADER_OF = {"page_id": "warc-record-id", "record_type": "warc-type", "uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "payload_bytes": "x-payload-length", "refers_to": "warc-refers-to"}
EXTRA = b"VL"  # gzip extra field that holds the member's whole length, so that a reader can step over it
HEAD_BYTES = 4096


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column as upper-case base32, by arithmetic on its hex digits."""
    digits = F.sha1(payload)
    letters = [
        F.substring(F.lit(ALPHABET), (F.shiftright(F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int"), 15 - 5 * i).bitwiseAND(31) + 1), F.lit(1))
        for g in range(8) for i in range(4)
    ]
    return F.concat(*letters)


def _files(path: str):
    """(file system, path in it) of a folder URI, wherever pyarrow reaches it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found.lstrip("-").isdigit() else None


def make_record(row: Any) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    lines = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: {record_urn(row.page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row.payload_digest}", f"X-Payload-Length: {row.payload_bytes}",
    ]
    if row.uri is not None:
        lines.append("WARC-Target-URI: " + row.uri.replace("\r", "%0D").replace("\n", "%0A"))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if row.record_type == "revisit":
        lines += [f"WARC-Refers-To: {record_urn(row.refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += bytes(row.payload or b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, EXTRA, 8, total)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceWriter):
    """Writes each task's rows to files of at most about `roll` bytes; a file counts once its task has committed."""

    def __init__(self, path: str, roll: int):
        self.path, self.roll = path, roll

    def write(self, rows: Iterator) -> Written:
        store, folder = _files(self.path)
        store.create_dir(folder, recursive=True)
        stem, out, size, names = uuid.uuid4().hex, None, 0, []
        for row in rows:
            if out is None:
                names.append(f"{stem}-{len(names):05d}.warc.gz")
                out, size = store.open_output_stream(posixpath.join(folder, "_" + names[-1]), compression=None), 0
            out.write(data := make_record(row))
            size += len(data)
            if size >= self.roll:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(",".join(names))

    def commit(self, messages: list) -> None:
        store, folder = _files(self.path)
        for m in messages:
            for name in filter(None, m.name.split(",") if m else []):
                store.move(posixpath.join(folder, "_" + name), posixpath.join(folder, name))

    def abort(self, messages: list) -> None:
        store, folder = _files(self.path)
        for m in messages:
            for name in filter(None, m.name.split(",") if m else []):
                store.delete_file(posixpath.join(folder, "_" + name))


@dataclass
class FilePart(InputPartition):
    """Some whole files of the archive."""

    paths: tuple


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, part_bytes: int):
        self.path, self.payload, self.part_bytes = path, payload, part_bytes
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, IN and IS NOT NULL on header columns; gives the rest back to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADER_OF and isinstance(f, EqualTo) and f.value is not None:
                self.wanted.append((name, frozenset([f.value])))
            elif name in HEADER_OF and isinstance(f, In):
                self.wanted.append((name, frozenset(v for v in f.value if v is not None)))
            elif name in HEADER_OF and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        """Files in name order, packed up to part_bytes a partition."""
        from pyarrow import fs

        store, folder = _files(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        parts, now, size = [], [], 0
        for info in sorted((i for i in found if i.is_file and i.base_name.endswith(".warc.gz") and i.base_name[0] != "_"), key=lambda i: i.path):
            if now and size + info.size > self.part_bytes:
                parts.append(FilePart(tuple(now)))
                now, size = [], 0
            now.append(info.path)
            size += info.size
        return [*parts, FilePart(tuple(now))] if now or not parts else parts

    def read(self, part: FilePart) -> Iterator[tuple]:
        store, _ = _files(self.path)
        for path in part.paths:
            with store.open_input_file(path) as f:
                yield from self.records(f, f.size())

    def records(self, f, size: int) -> Iterator[tuple]:
        """Header first; a member that the predicates refuse is stepped over without inflating its payload."""
        at = 0
        while at < size:
            f.seek(at)
            data = f.read(HEAD_BYTES)
            if data[:4] != b"\x1f\x8b\x08\x04" or data[12:14] != EXTRA:
                raise ValueError(f"no record with a stated length at byte {at}")
            (total,) = struct.unpack_from("<Q", data, 16)
            inflate = zlib.decompressobj(-15)
            raw = inflate.decompress(data[24:total], HEAD_BYTES)
            read = min(len(data), total)
            while (end := raw.find(b"\r\n\r\n")) < 0:
                feed = inflate.unconsumed_tail
                if not feed:
                    feed = f.read(min(HEAD_BYTES, total - read))
                    read += len(feed)
                    if not feed:
                        raise ValueError(f"record at byte {at} has no header end")
                raw += inflate.decompress(feed, HEAD_BYTES)
            head = dict((k.lower(), v.strip()) for k, _, v in (ln.partition(":") for ln in raw[:end].decode().split("\r\n")[1:]))
            row = {
                "page_id": page_of(head.get("warc-record-id")), "record_type": head.get("warc-type"), "uri": head.get("warc-target-uri"),
                "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                "payload_bytes": int(head.get("x-payload-length", 0)), "refers_to": page_of(head.get("warc-refers-to")),
            }
            if all(row[n] is not None if v is None else row[n] in v for n, v in self.wanted):
                payload = None
                if self.payload and row["record_type"] != "revisit":
                    tail = inflate.unconsumed_tail + f.read(max(0, total - read))
                    whole = raw + inflate.decompress(tail)
                    block = whole[end + 4 : end + 4 + int(head["content-length"])]
                    payload = block[block.find(b"\r\n\r\n") + 4 :]
                yield (*row.values(), payload)
            at += total


class WarcSource(DataSource):
    """Format `warc`. Options: path; payload (true: decode payloads); part_bytes; roll_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("part_bytes", 32 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll_bytes", 256 << 20)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


#: Copies of a payload from which on it counts as very common.
MANY = 10_000


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A record for each row of pages (page_id, url, html), null html as an empty payload.

    Of payloads that occur more than once and have at least least_bytes bytes, the row with the
    largest page_id becomes the response and the others revisit it (rows that repeat a page_id
    all become responses); shorter ones are all responses. A null page_id never serves as the
    response of others unless it is alone.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload")).withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    repeated = (
        pages.select("page_id", payload.alias("payload")).select("page_id", base32_sha1(F.col("payload")).alias("key"), F.octet_length("payload").alias("n"))
        .filter(F.col("n") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1")
    )
    # very common payloads are settled before the shuffle; there are never more of them than pages / MANY
    common = repeated.filter(F.col("copies") > MANY).select(F.col("key").alias("payload_digest"), F.col("keeper").alias("known"))
    rows = rows.join(F.broadcast(common), "payload_digest", "left")
    again = lambda keeper: keeper.isNotNull() & ~F.col("page_id").eqNullSafe(keeper) & (F.col("payload_bytes") >= least_bytes)
    rows = rows.withColumns({
        "payload": F.when(~again(F.col("known")), F.col("payload")),
        "key": F.when(F.col("known").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))),  # no digest has this mark
    })
    rows = rows.join(repeated.drop("copies"), "key", "left").withColumn("keeper", F.coalesce("known", "keeper"))
    revisit = again(F.col("keeper"))
    return rows.select(
        "page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "uri", "payload_digest", "payload_bytes",
        F.when(revisit, F.col("keeper")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write pages as gzip WARC files below path, one or more a task."""
    register(pages.sparkSession)
    plan_records(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records below path with the columns of RECORD; filters on header columns reach the reader.

    Without payload, or for revisits, payload is null and its bytes are stepped over. A folder
    without archives gives no rows.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op9_warc(spark, sf_dir):
    """Every page through an archive and back; sizes and digests of responses are taken from the payload read."""
    path = new_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = read_warc(spark, path)
    whole = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


OP9_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS hex, octet_length(payload) AS n FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  {" || ".join(f"substr('{ALPHABET}', ((('0x' || substr(hex, {5 * g + 1}, 5))::INT >> {15 - 5 * i}) & 31) + 1, 1)" for g in range(8) for i in range(4))} AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
