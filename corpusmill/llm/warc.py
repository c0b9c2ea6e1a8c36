"""WARC archives: a writer with payload deduplication and a Python data source.

Writer: archives of up to ``file_bytes``, one gzip member per record, with the skip-length
extra field (``sl``: compressed and plain length of the member), so a reader
can pass over a record without inflating it.  Of records with equal payloads of
at least ``revisit_bytes``, the one with the largest id is a response, the
others are revisits that refer to it.  Smaller payloads aren't compared; larger
ones are shuffled by digest only if the repeated digests are measured to take
more than BROADCAST_BYTES.  Files appear under their final name when
whole, and a repeated task writes the same file.

Reader (``format("warc")``): plans whole files into partitions of about
``partition_bytes``; takes predicates on record_type, record_id, target_uri,
refers_to and payload_digest (equality and IN; prefix for target_uri), which are
judged on the header alone; inflates a record's head first, and its payload only
if the record passes and ``payload`` isn't false; a long member that isn't
wanted isn't read either.  Archives of other writers work too: members without
skip-lengths are inflated in order, and uncompressed ``.warc`` files are read by
Content-Length.  An archive that is cut off or damaged is an error.
``read_warc`` turns on spark.sql.python.filterPushdown.enabled in the session,
without which Spark passes no predicate to Python data sources.

Edge cases of the writer: null payload is empty, null URL is left out, a null
id is written as ``null``, read back as null, and never referred to; rows that
repeat the largest id of an equal payload are all responses; an empty table
writes no file and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .. import ship
from . import scratch

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary, path string, position long"
#: Repeated digests up to this size are broadcast.
BROADCAST_BYTES = 32 << 20
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(record: bytes, level: int = 3) -> bytes:
    """A gzip member with skip-lengths."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(number: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'null' if number is None else number}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, revisit_bytes: int = 1000, file_bytes: int = 1 << 30, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages as archives into folder; returns the manifest: path, records, revisits, bytes."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large, small = (rows.where(x) for x in (F.octet_length("payload") >= revisit_bytes, F.octet_length("payload") < revisit_bytes))
    # only payloads that occur again are joined back
    firsts = large.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    firsts = scratch.stored(firsts, "digests")
    if firsts.count() * 64 <= BROADCAST_BYTES:
        firsts = F.broadcast(firsts)
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    told = large.join(firsts, "digest", "left").select("id", "url", "payload", "digest", refers.alias("refers_to"))
    told = told.union(small.select("id", "url", "payload", "digest", F.lit(None).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        row, number = next(rows, None), 0
        while row is not None:
            path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{number:03d}.warc.gz"
            records = revisits = size = 0
            with scratch.written_whole(path) as out:
                while row is not None and size < file_bytes:
                    data = member(record(*row, date))
                    out.write(data)
                    records, revisits, size = records + 1, revisits + (row[4] is not None), size + len(data)
                    row = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "revisits": revisits, "bytes": size}])

    return scratch.stored(told.mapInArrow(run, "path string, records long, revisits long, bytes long"), "manifest")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = {"record_type", "record_id", "target_uri", "refers_to", "payload_digest"}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in known and isinstance(f, EqualTo):
                self.tests.append((name, "in", {f.value}))
            elif name in known and isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif name == "target_uri" and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = scratch.open_fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if fs.get_file_info(path).type != pafs.FileType.File else [fs.get_file_info(path)]
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        out: list[InputPartition] = []
        paths, size = [], 0
        for x in sorted(found, key=lambda x: x.path):
            if x.type != pafs.FileType.File or x.base_name[0] in "._" or not x.base_name.endswith((".warc", ".warc.gz")):
                continue
            if paths and size + x.size > self.partition_bytes:
                out.append(_Files(paths))
                paths, size = [], 0
            paths.append(prefix + x.path)
            size += x.size
        return [*out, _Files(paths)] if paths or not out else out

    def passes(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            have = row[name]
            if have is None or (have not in value if kind == "in" else not have.startswith(value)):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            fs, local = scratch.open_fs(path)
            with fs.open_input_file(local) as f:
                for position, head, rest in (_members if path.endswith(".gz") else _plain)(_Window(f, path)):
                    row = _parsed(head)
                    if not self.passes(row):
                        continue
                    row |= {"path": path, "position": position, "payload": None}
                    if self.payload and row["record_type"] != "revisit":
                        row["payload"] = _payload(row["headers"], rest())
                        row["payload_bytes"] = len(row["payload"])
                    elif row["headers"].get("content-type", "").startswith("application/http"):
                        row["payload_bytes"] = _http_length(rest(4096))
                    row["headers"] = list(row["headers"].items())
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("path", pa.string()), ("position", pa.int64()),
])


def _parsed(head: bytes) -> dict:
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        if name:
            headers[name.strip().lower()] = value.strip()
    bare = lambda x: x[1:-1] if x and x[0] == "<" else x
    return {"record_id": bare(headers.get("warc-record-id")), "record_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"), "refers_to": bare(headers.get("warc-refers-to")), "payload_digest": headers.get("warc-payload-digest"), "payload_bytes": None, "headers": headers}


def _http_length(start: bytes) -> int | None:
    for line in start.partition(b"\r\n\r\n")[0].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _payload(headers: dict, block: bytes) -> bytes:
    block = block[: int(headers.get("content-length", len(block)))]
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


class _Window:
    """A file by ranges, read ahead by a chunk; what lies between two ranges that are far apart isn't read."""

    def __init__(self, file: pa.NativeFile, name: str, chunk: int = 1 << 18):
        self.file, self.name, self.chunk, self.size = file, name, chunk, file.size()
        self.at, self.data = 0, b""

    def take(self, position: int, n: int) -> bytes:
        """The bytes there, fewer at the file's end."""
        n = max(0, min(n, self.size - position))
        if position < self.at or position + n > self.at + len(self.data):
            self.at, self.data = position, self.file.read_at(min(max(n, self.chunk), self.size - position), position)
        return self.data[position - self.at : position - self.at + n]

    def cut_off(self, position: int) -> ValueError:
        return ValueError(f"{self.name}: the record at {position} is cut off or damaged")


class _Inflated:
    """A member whose head is read and inflated first and whose block on demand."""

    def __init__(self, window: _Window, position: int, size: int):
        self.window, self.position, self.size, self.used = window, position, size, 0
        self.plain, have = zlib.decompressobj(31), b""
        while b"\r\n\r\n" not in have:
            more = self._more(4096)
            if not more and self.used == size and not self.plain.unconsumed_tail:
                raise window.cut_off(position)
            have += more
        self.head, _, self.start = have.partition(b"\r\n\r\n")

    def _more(self, most: int) -> bytes:
        data = self.plain.unconsumed_tail
        if not data:
            data = self.window.take(self.position + self.used, min(most, self.size - self.used))
            self.used += len(data)
        return self.plain.decompress(data, most)

    def rest(self, most: int = 0) -> bytes:
        """The block, or its first bytes."""
        while most and len(self.start) < most and (self.used < self.size or self.plain.unconsumed_tail):
            self.start += self._more(4096)
        if not most:
            data = self.plain.unconsumed_tail + self.window.take(self.position + self.used, self.size - self.used)
            self.used = self.size
            self.start += self.plain.decompress(data)
            if not self.plain.eof:
                raise self.window.cut_off(self.position)
        return self.start


def _members(window: _Window) -> Iterator[tuple]:
    """(position, head, rest) of each gzip member; with skip-lengths a member is read and inflated no further than asked for."""
    position = 0
    while position < window.size:
        held = window.take(position, 24)
        if held[:2] != b"\x1f\x8b":
            raise window.cut_off(position)
        if len(held) == 24 and held[3] & 4 and held[12:14] == b"sl":
            size = struct.unpack("<I", held[16:20])[0]
            if position + size > window.size or size < 32:
                raise window.cut_off(position)
            one = _Inflated(window, position, size)
            yield position, one.head, one.rest
            position += size
            continue
        plain, parts, end = zlib.decompressobj(31), [], position  # inflate to the member's end
        while not plain.eof:
            held = window.take(end, 1 << 16)
            if not held:
                raise window.cut_off(position)
            parts.append(plain.decompress(held))
            end += len(held) - len(plain.unused_data)
        head, found, start = b"".join(parts).partition(b"\r\n\r\n")
        if not found:
            raise window.cut_off(position)
        yield position, head, lambda most=0, start=start: start
        position = end


def _plain(window: _Window) -> Iterator[tuple]:
    position = 0
    while position < window.size:
        held = b""
        while b"\r\n\r\n" not in held:
            more = window.take(position + len(held), 4096)
            if not more:
                raise window.cut_off(position)
            held += more
        head = held.partition(b"\r\n\r\n")[0]
        begin, size = position + len(head) + 4, int(_parsed(head)["headers"].get("content-length", 0))
        if begin + size > window.size:
            raise window.cut_off(position)
        yield position, head, lambda most=0, begin=begin, size=size: window.take(begin, min(size, most or size))
        position = begin + size + 4


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, folder: str, **options) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(folder)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as archives and reads them back."""
    folder = scratch.folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    got = read_warc(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(substr({c}, {len(_ID) + 1}) AS bigint)")
    digest = F.coalesce(F.sha1("payload"), F.substr("payload_digest", F.lit(6)))
    return got.select(number("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN top <> page_id OR (top IS NOT NULL AND page_id IS NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id OR (top IS NOT NULL AND page_id IS NULL) THEN top END AS refers_to
FROM q
"""
