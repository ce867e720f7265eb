"""WARC archives as a Spark data source, with revisit records for repeated payloads.

Reading plans one partition for each file. Records are parsed headers first: predicates on the record type and on other
headers are taken over from Spark and tested on the header block alone, and the payload of a record that
is not wanted is passed over by its length. Payloads are deflated one by one behind plain headers
(``Content-Encoding: gzip``), so passing over one costs no inflating; ``payload=false`` passes over them all.
Of equal payloads one record is a response and the others revisit it: they repeat its HTTP headers, length and
digest, but not its payload.

Archives as others write them are read too: ``.warc.gz`` with a gzip member for each record, record names that are no
UUIDs, and digests taken before or after the content coding; other digests than SHA-1 are passed on unchecked. The option
``gzip`` writes such files. In them a payload that is not wanted is inflated, but not decoded.

Writers leave files under passing names, and the driver renames those of the tasks that were committed, so tasks
that run again leave no half or double records. Folders are named by URIs of a store that all machines share, as
pyarrow opens them; ``s3a`` and ``s3n`` are read as ``s3``, and another scheme that it does not know is an error.

Cases: a null html is an empty payload; a null URL leaves its header out; a page without an id is a response of its
own; repeated rows with one id are one response and revisits of it; an empty table gives an archive without records;
other columns are not read; payloads of any length are kept whole. A payload that does not have its digest
raises an error, and so does a file in the folder that is no archive; names that begin with a dot or an underscore
are passed over, as Spark does.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from saldo.llm.stores import open_store
from saldo.sources.scratch import stored

SCHEMA = (
    "record_id string, record_type string, target_uri string, page_id bigint, payload_digest string, payload_length bigint, "
    "refers_to bigint, payload binary"
)
DATE = "2000-01-01T00:00:00Z"
#: Bytes after which a writer begins another file.
FILE_BYTES = 64 << 20
#: High half of the record names of pages, whose low half is the page's id.
_SPACE = 0x5D1C0A4E7B6D4C1A
_LOW = (1 << 64) - 1


def record_id(page_id: int | None) -> str:
    """A record name that holds the page's id, or a random one."""
    number = uuid.uuid4() if page_id is None else uuid.UUID(int=_SPACE << 64 | page_id & _LOW)
    return f"<urn:uuid:{number}>"


def page_of(name: str | None) -> int | None:
    """The page's id in a record name."""
    if not name:
        return None
    try:
        number = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    low = number & _LOW
    return (low - (1 << 64) if low >> 63 else low) if number >> 64 == _SPACE else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool, member: bool = False) -> bytes:
    """The bytes of a response or revisit record; as a member of a gzip file its payload is not coded once more."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"X-Payload-Length: %d" % len(payload)]
    if not member:
        http.insert(2, b"Content-Encoding: gzip")
    body = b"" if revisit else payload if member else gzip.compress(payload, 1, mtime=0)
    block = b"\r\n".join(http) + b"\r\n\r\n" + body
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if uri is not None:
        # Line ends and such must not break the header, so they are written as URLs write them.
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(record, 1, mtime=0) if member else record


def _headers(source) -> dict[str, str]:
    out = {}
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(source, wanted, payloads: bool) -> Iterator[tuple]:
    """Rows of SCHEMA; wanted tells by a row without payload whether the record is read on."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = _headers(source)
        end = source.tell() + int(head["content-length"])
        kind, name = head.get("warc-type"), head.get("warc-record-id")
        sha = re.sub("^sha-?1:", "", head.get("warc-payload-digest", ""), flags=re.IGNORECASE) or None
        row = (name, kind, head.get("warc-target-uri"), page_of(name), sha, page_of(head.get("warc-refers-to")))
        if not wanted(row):
            source.seek(end)
            continue
        length = payload = None
        if kind in ("response", "revisit") and "application/http" in head.get("content-type", ""):
            source.readline()
            http = _headers(source)
            length = int(http["x-payload-length"]) if "x-payload-length" in http else None
            if payloads and kind == "response":
                sent = source.read(end - source.tell())
                payload = gzip.decompress(sent) if sent and http.get("content-encoding", "").lower() in ("gzip", "x-gzip") else sent
                if sha and ":" not in sha and sha not in (digest(payload), digest(sent)):
                    raise ValueError(f"payload of {name} does not have its digest")
                length = len(payload)
        source.seek(end)
        yield (*row[:5], length, row[5], payload)


def _Buffered(raw) -> io.BufferedReader:
    return io.BufferedReader(raw, 1 << 18)


@dataclass
class WarcFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


_FILTERED = {"record_id": 0, "record_type": 1, "target_uri": 2, "page_id": 3, "payload_digest": 4, "refers_to": 5}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.payloads = options["path"], options.get("payload", "true") == "true"
        self.tests: list[tuple[int, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            column = getattr(test, "attribute", (None,))
            place = _FILTERED.get(column[0]) if len(column) == 1 else None
            if place is not None and isinstance(test, EqualTo):
                self.tests.append((place, (test.value,)))
            elif place is not None and isinstance(test, In):
                self.tests.append((place, tuple(test.value)))
            elif place is not None and isinstance(test, IsNotNull):
                self.tests.append((place, None))
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        system, root = open_store(self.folder)
        found = system.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.is_file and f.base_name[0] not in "._")
        if other := [name for name in names if not name.endswith((".warc", ".warc.gz"))]:
            raise ValueError(f"no archives: {other[:5]}")
        return [WarcFile(f"{self.folder}/{name}") for name in names] or [WarcFile("")]

    def read(self, partition: WarcFile) -> Iterator[tuple]:
        if not partition.path:
            return
        tests = self.tests

        def wanted(row: tuple) -> bool:
            return all(row[place] is not None if values is None else row[place] in values for place, values in tests)

        system, name = open_store(partition.path)
        with system.open_input_file(name) as raw, _Buffered(raw) as source:
            if name.endswith(".gz"):
                # Members follow each other as one stream.
                with gzip.GzipFile(fileobj=source) as plain, _Buffered(plain) as inflated:
                    yield from read_records(inflated, wanted, self.payloads)
            else:
                yield from read_records(source, wanted, self.payloads)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.folder, self.columns = options["path"], columns
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))
        self.member = options.get("gzip", "false") == "true"

    def write(self, iterator) -> Written:
        system, root = open_store(self.folder)
        system.create_dir(root, recursive=True)
        task, files, out, size = uuid.uuid4().hex, [], None, 0
        try:
            for row in iterator:
                if out is None or size > self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f".pages-{task}-{len(files):05d}.warc{'.gz' if self.member else ''}")
                    out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                record = write_record(row["page_id"], row["target_uri"], bytes(row["payload"] or b""), row["refers_to"], row["record_type"] == "revisit", self.member)
                out.write(record)
                size += len(record)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_store(self.folder)
        system.create_dir(root, recursive=True)
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{root}/{name}", f"{root}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_store(self.folder)
        for message in messages:
            for name in message.files if message else []:
                system.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take over predicates."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, target_uri, payload, record_type, refers_to) for pages (page_id, url, html).

    The digests are grouped without the payloads; only groups of two or more meet the pages again.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    sha = F.concat_ws("-", F.sha1("payload"), F.octet_length("payload"))
    groups = rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).groupBy(sha.alias("sha"), "page_id")
    last = groups.count().groupBy("sha").agg(
        F.max("page_id").alias("keep"), F.sum("count").alias("n"), F.max_by("count", "page_id").alias("twins")
    )
    repeated = stored(last.where("n > 1").select("sha", "keep", "twins"), "repeated-payloads")
    marked = rows.withColumn("sha", sha).join(repeated, "sha", "left")
    again = F.col("keep").isNotNull() & F.col("page_id").isNotNull() & (F.col("keep") != F.col("page_id"))
    twin = F.coalesce((F.col("twins") > 1) & (F.col("keep") == F.col("page_id")), F.lit(False))
    decided = marked.withColumn("again", again)
    if not repeated.where("twins > 1").isEmpty():
        # Rows that share the largest id of a payload are stored with a number, of which the smallest names the response.
        same = stored(marked.where(twin).withColumn("row", F.monotonically_increasing_id()), "repeated-pages")
        first = same.groupBy("sha").agg(F.min("row").alias("first"))
        told = same.join(first, "sha").withColumn("again", F.col("row") != F.col("first"))
        decided = decided.where(~twin).unionByName(told.select(*decided.columns))
    return decided.select(
        "page_id",
        "target_uri",
        "payload",
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("again"), F.col("keep")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, gzipped: bool = False) -> None:
    """Archive pages (page_id, url, html) below a folder, as ``.warc`` or as ``.warc.gz``."""
    register(pages.sparkSession)
    plan_records(pages, least_bytes).write.format("warc").option("fileBytes", file_bytes).option("gzip", str(gzipped).lower()).mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of a folder."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)
