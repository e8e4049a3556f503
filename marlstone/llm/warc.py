"""WARC archives: a Python data source that reads and writes them, and the pages query on top of it.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").load(folder).filter("record_type = 'response'").select("record_id", "payload_bytes")

Archives are gzip files of one member a record; the writer notes each member's length in the member's own header (the extra field "sl"), so a
reader passes records by without inflating them. Partitions are planned from the list of files, in bundles of about
bundle_bytes. Equality, IN, null and prefix tests on header columns are pushed into the reader: it inflates a record only up to the end of its headers,
and goes on to the payload for wanted records and, if the option payload is not false, no others. Archives without "sl"
are read as well, by inflating on.

Columns: record_type, record_id, target_uri, date, refers_to, payload_digest (lower-case hex SHA-1), payload_bytes,
payload (null for other than response records or with payload=false), file.

Defined cases: a null payload is an empty one; a null url writes no WARC-Target-URI; an empty table gives no archives; a record cut off at the end of
a file raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import bound_batches, new_path, staged, table
from .token_files import file_system

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLE, CHUNK = 64 << 20, 1 << 16
#: Characters that would end a header line, and the sign of the escapes written for them.
LINE_ENDS = re.compile("[%s]" % "".join(map(chr, (0x25, *range(10, 14), 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029))))


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member with its compressed and inflated lengths in the extra field "sl"."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(body) + 8 + 12 + 12, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """Bytes of a member from its first 24, where it says so."""
    if head[:4] == b"\x1f\x8b\x08\x04" and head[10:16] == b"\x0c\0sl\x08\0":
        return struct.unpack("<I", head[16:20])[0]
    return None


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response_block(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def one_line(value: str | None) -> str | None:
    """A header's value; line ends and percent signs in it are written as escapes."""
    return None if value is None else LINE_ENDS.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def full_line(value: str) -> str:
    return re.sub("(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), value)


class RecordStream:
    """The records of an archive one after the other: next_headers(), then payload() or nothing."""

    def __init__(self, stream):
        self.stream, self.held, self.whole = stream, b"", bytearray()
        self.inflater = None
        self.length = 0

    def _read(self, n: int) -> bytes:
        got = self.stream.read(n)
        return bytes(got) if got else b""

    def _more(self) -> bool:
        """Inflate another part of the member."""
        if self.inflater is None or self.inflater.eof:
            return False
        if not self.held:
            limit = CHUNK if self.left is None else min(CHUNK, self.left)
            self.held = self._read(limit) if limit else b""
            if self.left is not None:
                self.left -= len(self.held)
            if not self.held:
                raise ValueError("an archive ends inside a record")
        self.whole += self.inflater.decompress(self.held, CHUNK)
        self.held = self.inflater.unconsumed_tail or self.inflater.unused_data
        return True

    def _pass(self) -> None:
        """Go to the end of this member, without inflating where its length is known."""
        if self.inflater is None:
            return
        if self.left is not None:
            if self.left:
                self.stream.seek(self.stream.tell() + self.left)
            self.held = b""
        else:
            while not self.inflater.eof:
                self.whole.clear()
                self._more()
        self.inflater = None

    def next_headers(self) -> dict[str, str] | None:
        self._pass()
        head = self.held + self._read(max(0, 24 - len(self.held)))
        if not head:
            return None
        if head[:2] != b"\x1f\x8b":
            raise ValueError("not an archive of gzip members")
        length = member_length(head)
        self.left = None if length is None else length - len(head)
        self.held, self.whole, self.inflater = head, bytearray(), zlib.decompressobj(31)
        while (end := self.whole.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError("a record has no end of headers")
        lines = self.whole[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.at = end + 4
        return {k.strip().lower(): full_line(v.strip()) for k, _, v in (line.partition(":") for line in lines[1:])}

    def block(self, n: int) -> bytes:
        while len(self.whole) < self.at + n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        return bytes(self.whole[self.at : self.at + n])


def hex_digest(value: str | None) -> str | None:
    if value is None:
        return None
    kind, _, text = value.rpartition(":")
    return base64.b32decode(text).hex() if kind == "sha1" and len(text) == 32 else text.lower()


def accepts(test: tuple, value: str | None) -> bool:
    kind, _, wanted = test
    if kind == "null":
        return value is None
    if kind == "known":
        return value is not None
    if value is None:
        return False
    return value.startswith(wanted) if kind == "prefix" else value in wanted


def pushed(f: Filter) -> tuple | None:
    """A filter as (kind, column, values), if the reader can decide it from the headers."""
    name = getattr(f, "attribute", None)
    if not name or len(name) != 1 or name[0] not in HEADERS:
        return None
    match f:
        case EqualTo():
            return ("in", name[0], (f.value,))
        case In():
            return ("in", name[0], tuple(f.value))
        case IsNull():
            return ("null", name[0], None)
        case IsNotNull():
            return ("known", name[0], None)
        case StringStartsWith():
            return ("prefix", name[0], f.value)
    return None


@dataclass
class Bundle(InputPartition):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.bundle = int(options.get("bundle_bytes", BUNDLE))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            test = pushed(f)
            if test:
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        system, root = file_system(self.folder)
        out, held, n = [], [], 0
        for info in sorted(system.get_file_info(FileSelector(root, allow_not_found=True, recursive=True)), key=lambda i: i.path):
            if info.is_file and info.base_name.endswith(".warc.gz") and not info.base_name.startswith(("_", ".")):
                if held and n + info.size > self.bundle:
                    out.append(Bundle(tuple(held)))
                    held, n = [], 0
                held.append(info.path)
                n += info.size
        return [*out, Bundle(tuple(held))]  # an empty one where there are no files

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.folder)
        fields = [("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string())]
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

        for file in partition.files:
            with system.open_input_file(file) as stream:
                records = RecordStream(stream)
                while (headers := records.next_headers()) is not None:
                    found = {c: headers.get(h) for c, h in HEADERS.items()}
                    if not all(accepts(t, found[t[1]]) for t in self.tests):
                        continue
                    payload, n = None, None
                    digest = hex_digest(headers.get("warc-payload-digest"))
                    if found["record_type"] == "response" and self.with_payload:
                        block = records.block(int(headers["content-length"]))
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        n, size = len(payload), size + len(payload)
                        digest = hashlib.sha1(payload).hexdigest()
                    elif "warc-x-payload-length" in headers:
                        n = int(headers["warc-x-payload-length"])
                    rows.append((*found.values(), digest, n, payload, file))
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of (record_id, target_uri, date, refers_to, payload): a revisit where refers_to is set, else a response.

    A task writes a file of its own under a hidden name; commit gives it its name, abort deletes it.
    """

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.folder)
        system.create_dir(root, recursive=True)
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        for batch in batches:
            ids, uris, dates, refers, payloads = (batch.column(c) for c in ("record_id", "target_uri", "date", "refers_to", "payload"))
            for k in range(batch.num_rows):
                if out is None:
                    out = system.open_output_stream(f"{root}/.{name}", compression=None)  # the members are packed already
                payload, refer = payloads[k].as_py() or b"", refers[k].as_py()
                digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                common = [("WARC-Record-ID", ids[k].as_py()), ("WARC-Date", dates[k].as_py()), ("WARC-Target-URI", one_line(uris[k].as_py())), ("WARC-Payload-Digest", digest), ("WARC-X-Payload-Length", str(len(payload)))]
                if refer is None:
                    text = record([("WARC-Type", "response"), *common, ("Content-Type", "application/http; msgtype=response")], response_block(payload))
                else:
                    text = record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", refer), ("WARC-Profile", REVISIT_PROFILE), ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
                out.write(member(text))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.folder)
        for m in messages:
            if m is not None and m.file:
                system.move(f"{root}/.{m.file}", f"{root}/{m.file}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.folder)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/.{m.file}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archived(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as archives; payloads of LEAST_REVISIT bytes or more that were written for a larger page_id become revisits.

    Rows that share the largest page_id of a payload are all responses.
    """
    register(pages.sparkSession)
    bound_batches(pages.sparkSession, 500)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    read = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = read.filter(F.length("payload") >= LEAST_REVISIT)
    groups = staged(long.groupBy("digest", F.length("payload").alias("n")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("digest", "n", "last"), "repeated")
    marked = read.join(groups.withColumnRenamed("digest", "same"), (F.col("digest") == F.col("same")) & (F.length("payload") == F.col("n")), "left")
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    refers = F.when(~F.col("last").eqNullSafe(F.col("page_id")), name("last"))
    rows = marked.select(name("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.when(F.col("last").isNotNull(), refers).alias("refers_to"), "payload")
    rows.write.format("warc").mode("append").save(folder)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back from them."""
    folder = new_path(spark, "warc")
    archived(table(spark, sf_dir, "pages"), folder)
    number = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")
    back = spark.read.format("warc").load(folder)
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n < 1000 OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 1000 OR last = page_id THEN NULL ELSE last END AS refers_to
FROM q
"""
