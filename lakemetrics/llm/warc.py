"""Operator 4: a WARC data source for Spark, with de-duplicated payloads written as revisit records."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import cut, shared_dir

#: A file holds records up to about this many compressed bytes; a read partition takes up about CHUNK of them.
FILE_BYTES, CHUNK = 256 << 20, 16 << 20
#: Shortest payload that a revisit record may stand for.
LEAST_SHARED = 100
#: Payloads with several rows whose digests (about 100 bytes each) may be broadcast.
MOST_GROUPS = 500_000
MANIFEST = "_manifest-"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, record_date string, refers_to string, content_type string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
#: Columns that a record's header alone gives, so that filters on them come before any payload is decoded.
HEADER_COLUMNS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "record_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def _filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def _member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field `sl` tells its own length and that of its content, so that a reader can skip it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: object) -> str:
    return " ".join(str(value).split())


def record_bytes(row: dict) -> bytes:
    """The serialized form of a record, without compression."""
    payload = row.get("payload")
    head = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row.get('record_date') or '1970-01-01T00:00:00Z'}"]
    for name, value in (("WARC-Target-URI", row.get("target_uri")), ("WARC-Refers-To", row.get("refers_to"))):
        if value is not None:
            head.append(f"{name}: {_clean(value)}")
    if row.get("payload_digest") is not None:
        head.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if row.get("payload_bytes") is not None:
        head.append(f"X-Payload-Length: {row['payload_bytes']}")
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
        block = b""
    else:
        block = payload or b""
    if row["record_type"] in ("response", "revisit"):
        head.append("Content-Type: application/http; msgtype=response")
        kind = row.get("content_type") or "text/html; charset=utf-8"
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {row.get('payload_bytes') or len(block)}\r\n\r\n".encode() + block
    elif row.get("content_type"):
        head.append(f"Content-Type: {row['content_type']}")
    head.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    """Fields of a record header by lower-case name; continued lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _column(name: str, header: dict[str, str]) -> str | None:
    value = header.get(HEADER_COLUMNS[name])
    return value.removeprefix("sha256:") if name == "payload_digest" and value else value


def _passes(filters: list[Filter], header: dict[str, str]) -> bool:
    for f in filters:
        value = _column(f.attribute[0], header)
        if isinstance(f, EqualTo):
            ok = value == f.value
        elif isinstance(f, In):
            ok = value in f.value
        elif isinstance(f, StringStartsWith):
            ok = value is not None and value.startswith(f.value)
        else:
            ok = value is not None
        if not ok:
            return False
    return True


def _payload(header: dict[str, str], block: bytes) -> bytes:
    if header.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class Chunk(InputPartition):
    """Records of one file from byte start up to end (to its end if negative)."""

    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcReader(DataSourceReader):
    """Plans a partition for each chunk of each committed file, and reads headers first.

    Filters on header columns (equality, IN, prefix, not null) are taken over. A record that fails them is skipped by
    the length in its gzip extra field (or by Content-Length in an uncompressed file), so its payload is never inflated;
    without that field it has to be inflated to find its end, but is not kept.
    """

    def __init__(self, options: dict):
        self.root, self.filters = options["path"], []
        self.with_payload = options.get("payload", "true").lower() != "false"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _filesystem(self.root)
        infos = fs.get_file_info(arrow_fs.FileSelector(root, recursive=False, allow_not_found=True))
        names = [i for i in infos if i.type == arrow_fs.FileType.File]
        manifests = [i for i in names if i.base_name.startswith(MANIFEST)]
        out: list[InputPartition] = []
        for m in manifests:
            for entry in json.loads(fs.open_input_stream(m.path).read()):
                marks = entry["marks"]
                out += [Chunk(f"{root}/{entry['name']}", a, b) for a, b in zip(marks, [*marks[1:], entry["bytes"]])]
        if not manifests:
            out += [Chunk(i.path, 0, -1) for i in names if i.base_name.endswith((".warc", ".warc.gz"))]
        return out or [Chunk("", 0, 0)]

    def read(self, part: Chunk) -> Iterator[tuple]:
        if not part.path:
            return
        fs, _ = _filesystem(self.root)
        with fs.open_input_file(part.path) as f:
            end = f.size() if part.end < 0 else part.end
            f.seek(part.start)
            records = _gzipped(f, end, self._wanted) if part.path.endswith(".gz") else _plain(f, end, self._wanted)
            for header, block in records:
                kind = header.get("warc-type")
                payload = _payload(header, block) if block is not None and kind != "revisit" else None
                size = header.get("x-payload-length")
                yield (
                    *[_column(c, header) for c in ("record_id", "record_type", "target_uri", "record_date", "refers_to")],
                    header.get("content-type"),
                    _column("payload_digest", header),
                    int(size) if size else len(payload) if payload is not None else None,
                    header,
                    payload,
                )

    def _wanted(self, header: dict[str, str]) -> tuple[bool, bool]:
        return _passes(self.filters, header), self.with_payload


def _plain(f, end: int, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    while f.tell() < end:
        head = b""
        while b"\r\n\r\n" not in head:
            got = f.read(4096)
            if not got:
                return
            head += got
        at = f.tell() - len(head) + head.index(b"\r\n\r\n") + 4
        header = parse_header(head.partition(b"\r\n\r\n")[0].lstrip())
        size = int(header.get("content-length", 0))
        keep, payload = wanted(header)
        if keep:
            f.seek(at)
            yield header, f.read(size) if payload else None
        f.seek(at + size + 4)


def _gzipped(f, end: int, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    while (start := f.tell()) < end:
        data = f.read(4096)
        if len(data) < 18:
            return
        length = 0
        if data[3] & 4 and data[12:14] == b"sl":
            length = struct.unpack("<I", data[16:20])[0]
        inflate, out = zlib.decompressobj(31), b""
        rest = data
        while b"\r\n\r\n" not in out and rest and not inflate.eof:
            out += inflate.decompress(rest, 4096)
            rest = inflate.unconsumed_tail or (b"" if inflate.eof else f.read(4096))
        head, _, block = out.partition(b"\r\n\r\n")
        header = parse_header(head)
        keep, payload = wanted(header)
        if length and not (keep and payload):
            if keep:
                yield header, None
            f.seek(start + length)
            continue
        parts = [block]
        while not inflate.eof and rest:
            parts.append(inflate.decompress(rest))
            rest = inflate.unconsumed_tail or (b"" if inflate.eof else f.read(1 << 16))
        f.seek(f.tell() - len(inflate.unused_data))
        if keep:
            yield header, b"".join(parts)[: int(header.get("content-length", 0))] if payload else None


class WarcWriter(DataSourceArrowWriter):
    """Each task writes gzipped files of its own; only files that commit() names in a manifest are ever read."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.root)
        fs.create_dir(root, recursive=True)
        files: list[dict] = []
        sink = None
        for batch in iterator:
            for row in batch.to_pylist():
                if sink is None:
                    files.append({"name": f"part-{uuid.uuid4().hex}.warc.gz", "bytes": 0, "marks": [0]})
                    sink = fs.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                data = _member(record_bytes(row))
                if files[-1]["bytes"] - files[-1]["marks"][-1] >= CHUNK:
                    files[-1]["marks"].append(files[-1]["bytes"])
                sink.write(data)
                files[-1]["bytes"] += len(data)
                if files[-1]["bytes"] >= FILE_BYTES:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.root)
        fs.create_dir(root, recursive=True)
        old = [i.path for i in fs.get_file_info(arrow_fs.FileSelector(root)) if i.base_name.startswith(MANIFEST)] if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.root)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{root}/{f['name']}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``; option payload=false reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def as_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """A WARC record for every row of pages: response, or revisit of the response with the same payload.

    Of the rows with an equal payload of at least `least` bytes, that with the smallest key is the response and the
    others revisit it. Rows that share the smallest key are all responses, and so are rows of a payload without any
    key. Shorter payloads, and null ones (no bytes), are always responses.

    Only digests and keys are shuffled to find the groups. Their table is broadcast where it has no more than MOST_GROUPS
    rows, so no payload is shuffled; beyond that payloads are joined by digest, and Spark splits digests that very many
    rows share, as the other side has one row for each.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("payload_digest").alias("_group"), "_first")
    # Rows that can't be a revisit get keys of their own, which spread over all tasks and meet nothing.
    group = F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("_key", "target_uri").cast("string")))
    first = cut(first)
    rows = rows.withColumn("_group", group).join(F.broadcast(first) if first.count() <= MOST_GROUPS else first, "_group", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first"))
    name = lambda c: F.concat(F.lit("<urn:x-key:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        name("_key").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(None).cast("string").alias("record_date"),
        F.when(revisit, name("_first")).alias("refers_to"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        "payload_digest",
        "payload_bytes",
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a WARC record for every row of pages to the folder path, and reads the archives back.

    Returns key, payload_bytes, payload_digest, record_type and refers_to, of responses from the payload that was read,
    of revisits from their headers. A null html is an empty payload, a null key comes back as null, repeated rows give a
    record each, an empty table an empty result; other columns of pages are ignored.
    """
    register(pages.sparkSession)
    as_records(pages, key, url, html).write.format("warc").mode("append").save(path)
    found = lambda: pages.sparkSession.read.format("warc").load(path)  # noqa: E731  a scan of its own for each filter: Spark keeps one reader a relation
    kind = pages.schema[key].dataType
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-key:(.*)>$", 1), F.lit("")).cast(kind)
    responses = found().where("record_type = 'response'").select(number("record_id").alias(key), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    revisits = found().where("record_type = 'revisit'").select(number("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
