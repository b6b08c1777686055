"""WARC archives as a PySpark Python data source, for reading and writing.

Reading plans partitions of whole files, packed to about `partition_bytes`: a file, of whatever size, is read by one task.
Filters on record_type and on header columns are pushed down: a record's
header is parsed first, and the payload of a record that fails, or of any
record if no payload column is asked for, is skipped by seeking past it.
Writing gives one file for each task, moved into place when the job commits,
so a lost executor leaves no half-written archive behind. Files are opened
through pyarrow's file systems, which take local and remote URIs alike.

The block of a record of type application/http is an HTTP head and the payload
behind it; any other block is the payload. A file that is cut short, or holds
what is no record, raises by default; with the option on_error=stop the
records before that place are returned and the rest of the file is left out.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_path, save

#: Header field of each column; the order is that of a written header.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "warc_date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
    "payload_length": "WARC-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS if c != "payload_length") + ", payload_length long, content_length long, http_head string, payload binary"
HTTP = "application/http"
#: A header of more bytes, or a line of more, is no WARC header.
HEADER_BYTES = 1 << 20
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Other names of schemes that pyarrow knows.
ALIASES = {"s3a": "s3", "s3n": "s3"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a URI, and the path in it. A bare path is a local one: qualified() tells what Spark takes it for."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.FileSystem.from_uri(f"file://{path}")
    try:
        return fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else f"{ALIASES.get(scheme, scheme)}:{rest}")
    except pa.ArrowInvalid as error:
        raise ValueError(f"WARC files can't be opened at {path}: {error}; mount the store, or give a URI that pyarrow knows") from error


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it: a bare one is of the default file system, not of each executor's disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString() if "://" not in path else path


def block(row: dict) -> bytes:
    """A record's content: the payload, behind its HTTP head if it has one."""
    head = row.get("http_head")
    return (b"" if head is None else head.encode() + b"\r\n\r\n") + bytes(row.get("payload") or b"")


def header(row: dict, length: int) -> bytes:
    """The header of one record, for a row of SCHEMA and the length of its content."""
    lines = [VERSION]
    for column, name in FIELDS.items():
        if row.get(column) is not None:
            lines.append(f"{name}: {str(row[column]).replace('\r', ' ').replace('\n', ' ')}".encode())
    lines.append(b"Content-Length: %d" % length)
    return b"\r\n".join(lines) + b"\r\n\r\n"


def number(text: str, name: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise ValueError(f"{name} is no length: {text[:40]!r}")
    return int(text)


def passed_over(source: io.BufferedIOBase, length: int) -> bool:
    """Moves past `length` bytes; False if there are fewer."""
    if not length:
        return True
    source.seek(length - 1, 1)
    return len(source.read(1)) == 1


def parse(source: io.BufferedIOBase, wanted: dict[str, set | None], payload: bool) -> Iterator[dict]:
    """Records whose header passes `wanted` (allowed values, or None for any value but null).

    Names of fields are matched without regard to case, unknown ones ignored,
    lines that begin with white space go on with the one before. Ends at the end of the file; a header that is no WARC header, one
    without a right Content-Length, and content that is cut short raise ValueError.
    """
    columns = {name.lower(): column for column, name in FIELDS.items()}
    while True:
        line = source.readline(HEADER_BYTES)
        while line in (b"\r\n", b"\n"):
            line = source.readline(HEADER_BYTES)
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        row: dict = dict.fromkeys(FIELDS)
        length, column, size = None, None, 0
        while True:
            line = source.readline(HEADER_BYTES)
            size += len(line)
            if not line.endswith(b"\n") or size > HEADER_BYTES:
                raise ValueError(f"a WARC header that doesn't end: {line[:60]!r}")
            line = line.rstrip(b"\r\n")
            if not line:
                break
            if line[:1] in b" \t":
                if column:
                    row[column] += " " + line.decode("utf-8", "replace").strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            column = columns.get(name.strip().lower())
            if name.strip().lower() == "content-length":
                length = number(value.strip(), "Content-Length")
            elif column:
                row[column] = value.strip()
        if length is None:
            raise ValueError("a WARC record without Content-Length")
        row["payload_length"] = number(row["payload_length"], FIELDS["payload_length"]) if row["payload_length"] is not None else length
        row |= {"content_length": length, "http_head": None, "payload": None}
        if not all(row[c] is not None and (values is None or row[c] in values) for c, values in wanted.items()):
            if not passed_over(source, length):
                raise ValueError("a WARC record that is cut short")
            continue
        if payload:
            content = source.read(length)
            if len(content) < length:
                raise ValueError("a WARC record that is cut short")
            head, found, rest = content.partition(b"\r\n\r\n") if (row["content_type"] or "").startswith(HTTP) else (b"", b"", content)
            row |= {"http_head": head.decode("utf-8", "replace"), "payload": rest} if found else {"payload": content}
        elif not passed_over(source, length):
            raise ValueError("a WARC record that is cut short")
        yield row


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.names, options["path"]
        self.size, self.wanted = int(options.get("partition_bytes", 64 << 20)), {}
        self.payload = bool({"payload", "http_head"} & set(self.columns)) and options.get("payload", "true") == "true"
        self.stop = {"raise": False, "stop": True}[options.get("on_error", "raise")]

    def pushFilters(self, filters: Sequence) -> Iterator:
        """Takes equality, IN and IS NOT NULL on header columns; Spark keeps the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in FIELDS or not isinstance(f, EqualTo | In | IsNotNull):
                yield f
            elif isinstance(f, IsNotNull):
                self.wanted.setdefault(column, None)
            else:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                old = self.wanted.get(column)
                self.wanted[column] = values if old is None else values & old

    def partitions(self) -> Sequence[InputPartition]:
        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.base_name.endswith((".warc", ".warc.gz")))
        plan: list[list[str]] = []
        left = 0
        for name, size in files:
            if size > left:
                plan.append([])
                left = self.size
            plan[-1].append(name)
            left -= size
        return [Files(tuple(x)) for x in plan] or [Files(())]

    def records(self, source: io.BufferedIOBase, name: str) -> Iterator[dict]:
        try:
            yield from parse(source, self.wanted, self.payload)
        except (ValueError, EOFError, OSError) as error:  # gzip tells of a cut with the latter two
            if not self.stop or isinstance(error, OSError) and not isinstance(error, gzip.BadGzipFile):
                raise ValueError(f"{name}: {error}") from error

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        types = {c: pa.int64() if c.endswith("_length") else pa.binary() if c == "payload" else pa.string() for c in self.columns}
        for name in partition.paths:
            raw = system.open_input_file(name)
            with gzip.open(raw) if name.endswith(".gz") else io.BufferedReader(raw, 1 << 16) as source:
                rows, size = [], 0
                for row in self.records(source, name):
                    rows.append(row)
                    size += 200 + (row["content_length"] if self.payload else 0)
                    if size > 4 << 20:
                        yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=self.columns)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex
        self.gz = options.get("compression", "none") == "gzip"

    def write(self, iterator: Iterator) -> Written:
        system, path = opened(self.path)
        name, out = None, None
        for row in iterator:
            row = row.asDict()
            if out is None:
                name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gz
                system.create_dir(f"{path}/_temporary-{self.job}", recursive=True)
                out = system.open_output_stream(f"{path}/_temporary-{self.job}/{name}", compression=None)  # else a .gz name would compress twice
            content = block(row)
            record = header(row, len(content)) + content + b"\r\n\r\n"
            out.write(gzip.compress(record, 1) if self.gz else record)
        if out is not None:
            out.close()
        return Written(name)

    def commit(self, messages: list) -> None:
        system, path = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{path}/_temporary-{self.job}/{m.name}", f"{path}/{m.name}")
        self.clear(system, path)

    def abort(self, messages: list) -> None:
        self.clear(*opened(self.path))

    def clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary-{self.job}")


class WarcSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Rows of SCHEMA, one for each row of pages(page_id, url, html).

    The payload is the html in UTF-8, null counting as empty. Of records with
    equal payloads of least_bytes or more, the one with the largest page_id is
    the response and the others revisit it, without a payload of their own;
    shorter ones are all responses. Rows without a page_id are responses under
    record ids of their own and are revisited by none; rows that repeat the largest
    page_id are responses, and share a record id. A response's content is an HTTP
    response: a status line, its type and length, and the payload.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    x = pages.select("page_id", "url", body.alias("payload")).withColumns({"payload_length": F.length("payload").cast("long"), "digest": F.sha1("payload")})
    long = x.where(F.col("payload_length") >= least_bytes)
    groups = long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_d"), "first")
    path = new_path(pages.sparkSession, "first")  # written, so that a digest with most pages can be split in the join
    groups.write.parquet(path)
    groups = pages.sparkSession.read.schema(groups.schema).parquet(path)
    x = x.join(groups, (F.col("digest") == F.col("_d")) & (F.col("payload_length") >= least_bytes), "left")
    again = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    return x.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn(F.col("page_id").cast("string")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).alias("record_id"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.col("url").alias("target_uri"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.when(again, F.lit(SAME_PAYLOAD)).alias("profile"),
        "payload_length",
        F.lit(0).cast("long").alias("content_length"),
        F.when(~again, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_length").cast("string"))).alias("http_head"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(records: DataFrame, path: str, compression: str = "none") -> None:
    """Writes rows of SCHEMA as WARC files under path."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("compression", compression).save(qualified(records.sparkSession, path))


def read(spark: SparkSession, path: str, payload: bool = True, on_error: str = "raise") -> DataFrame:
    """Rows of SCHEMA; without payloads, each is skipped by its length, never read."""
    register(spark)
    return spark.read.format("warc").options(payload=str(payload).lower(), on_error=on_error).load(qualified(spark, path))


def resolved(records: DataFrame) -> DataFrame:
    """record_id, record_type, refers_to, payload_bytes, payload_digest (bare hexadecimal SHA-1): a row for each response and revisit.

    Length and digest are of the payload that was read: a response's own, a
    revisit's from the response that it refers to, or null if that isn't there.
    The headers' figures are not looked at.
    """
    thin = records.where(F.col("record_type").isin("response", "revisit")).select("record_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    thin = save(thin, "read")  # payloads are read once; and a response with most revisits can be split in the join
    asked = thin.where("record_type = 'revisit'").select(F.col("refers_to").alias("_id")).distinct()
    own = thin.where("record_type = 'response'").groupBy(F.col("record_id").alias("_id")).agg(F.first("payload_bytes").alias("_bytes"), F.first("payload_digest").alias("_digest"))
    found = save(own.join(asked, "_id", "left_semi"), "resolved")
    x = thin.join(found, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("_id")), "left")
    again = F.col("record_type") == "revisit"
    return x.select("record_id", "record_type", "refers_to", *[F.when(again, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("_bytes", "payload_bytes"), ("_digest", "payload_digest"))])


def page_id_of(urn: str) -> F.Column:
    return F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
