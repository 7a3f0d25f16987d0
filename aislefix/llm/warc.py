"""WARC archives as a Python data source, written and read by tasks.

Writing: every task writes one archive, gzip members record by record, and beside
it an index of the members' offsets. Names are new for each attempt; on commit
the files of the successful attempts are listed in a manifest, which is what
readers go by.

Reading: partitions are planned from the indexes, runs of records of about
``split_bytes``. Of a record only the head of its member is inflated at first; its
named fields are held against the pushed predicates, and only records that
pass, and only if payloads are asked for, are inflated whole; of large members only the head is fetched before that.

Archives of others (``read_archives``) have neither manifest nor index: a task reads one ``.warc`` or ``.warc.gz`` file from its start, as a
stream, whether each record or the whole file is one gzip member. Blocks that are not wanted are passed
over piece by piece; in plain files long ones are not read at all.

Records with equal payloads: the one with the smallest id is a ``response``,
the others ``revisit`` it, naming it and carrying its payload's digest and length.

Defined results: a null page is an empty payload; rows that repeat the smallest id
of their payload are all responses; a null id is written as none and never is the
smallest; an empty table gives an archive without records; other columns do not matter.
Of records written by others: any type is read, ``record_id`` is the id as it stands, and ``page_id`` and ``refers_to`` are null unless
the id is of the form written here. The payload is what follows the HTTP head, or the whole block where the record
is not HTTP or its head has no end. Texts are decoded by the charset that the content type names, else as
UTF-8; transfer and content codings are left as they are. Digests other than SHA-1 keep their prefix and are not
verified, nor are payloads with a transfer coding. A file that is cut off, or that is not WARC, fails the job; an empty file has no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from aislefix.llm import files
from aislefix.operators.spread import spread_join
from aislefix.sources.tables import shared_folder

MANIFEST = "manifest.json"
#: Enough for the named fields of nearly every record; records with longer heads are inflated whole.
_HEAD_BYTES = 2048
#: Members up to this length are fetched at once: a second request would cost more than the bytes.
_AT_ONCE = 32 << 10
#: A head longer than this is taken for none, so that a block without an end of its head is not gathered in memory.
_LONGEST_HEAD = 1 << 20
_PIECE = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"

WRITTEN = "page_id bigint, url string, html string, digest string, first_id bigint, first_url string"
READ = (
    "page_id bigint, target_uri string, record_type string, refers_to bigint, refers_to_uri string, "
    "payload_digest string, payload_bytes bigint, payload string, record_id string, record_date string, content_type string"
)


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(value: str | None) -> str:
    """A field's value on one line."""
    return " ".join((value or "").split())


def _name(page_id: int | None) -> str:
    return f"<{_ID}{'none' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    """The page's id in a record's name; none in names that others gave."""
    value = (name or "").strip("<>")
    number = value.removeprefix(_ID)
    return int(number) if value.startswith(_ID) and number.removeprefix("-").isdecimal() else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None, first_url: str | None, date: str) -> bytes:
    """The bytes of one record; ``first_id`` names the response that a revisit refers to."""
    revisit = first_id is not None and first_id != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _plain(url)))
    if revisit:
        fields += [("WARC-Refers-To", _name(first_id)), ("WARC-Profile", _PROFILE)]
        if first_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", _plain(first_url)))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


@dataclass
class WarcFile(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, level: int):
        self.folder, self.level = folder, level
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcFile:
        name, at, offsets = f"part-{uuid.uuid4().hex}", 0, [0]
        with files.open_new(f"{self.folder}/{name}.warc.gz") as out:
            for batch in iterator:
                for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                    page_id, url, html, digest, first_id, first_url = row
                    data = record(page_id, url, (html or "").encode(), _base32(digest), first_id, first_url, self.date)
                    packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    member = packer.compress(data) + packer.flush()
                    out.write(member)
                    at += len(member)
                    offsets.append(at)
        with files.open_new(f"{self.folder}/{name}.idx") as out:
            out.write(np.array(offsets, "<i8").tobytes())
        return WarcFile(name, len(offsets) - 1)

    def commit(self, messages: list[WarcFile | None]) -> None:
        parts = [{"name": m.name, "records": m.records} for m in messages if m is not None]
        with files.open_new(f"{self.folder}/{MANIFEST}") as out:
            out.write(json.dumps(parts).encode())


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


@dataclass
class WarcSplit(InputPartition):
    """Some records of an archive, whose members lie at ``offsets``; all of a file at the place ``name`` without offsets."""

    name: str
    offsets: np.ndarray | None = None


def _passes(row: dict, filters: list[Filter]) -> bool:
    for f in filters:
        value = row[f.attribute[0]]
        if isinstance(f, EqualTo):
            ok = value == f.value
        elif isinstance(f, In):
            ok = value in f.value
        elif isinstance(f, IsNull):
            ok = value is None
        elif isinstance(f, IsNotNull):
            ok = value is not None
        else:
            ok = value is not None and value.startswith(f.value)
        if not ok:
            return False
    return True


class WarcReader(DataSourceReader):
    """Options: ``payload`` (false leaves payloads null and unread), ``verify`` (payloads must fit their digests),
    ``fields`` (JSON: for columns, the values to keep), ``pushdown`` (take over predicates of the query as well),
    ``foreign`` (the path is an archive, or a folder of archives, without manifest and index).
    """

    def __init__(self, schema: StructType, options: dict):
        self.folder = options["path"].rstrip("/")
        self.names = schema.fieldNames()
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.foreign = options.get("foreign", "false").lower() == "true"
        fields = json.loads(options.get("fields", "{}"))
        self.filters: list[Filter] = [In((name,), tuple(values)) for name, values in fields.items()]

    def partitions(self) -> list[WarcSplit]:
        if self.foreign:
            return [WarcSplit(name) for name in _archives(self.folder)]
        with files.open_read(f"{self.folder}/{MANIFEST}") as file:
            parts = json.loads(file.read())
        found = []
        for part in parts:
            offsets = files.mapped(f"{self.folder}/{part['name']}.idx", "<i8")
            first = 0
            while first < len(offsets) - 1:
                past = int(np.searchsorted(offsets, offsets[first] + self.split_bytes, side="right")) - 1
                past = min(max(past, first + 1), len(offsets) - 1)
                found.append(WarcSplit(part["name"], np.array(offsets[first : past + 1])))
                first = past
        return found

    def read(self, partition: WarcSplit | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        rows, size = [], 0
        for row in self._indexed(partition) if partition.offsets is not None else self._streamed(partition.name):
            rows.append(row)
            size += len(row["payload"] or "")
            if len(rows) >= 1000 or size >= 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _indexed(self, split: WarcSplit) -> Iterator[dict]:
        at_once = (self.payload or self.verify) and not self.filters
        with files.open_read(f"{self.folder}/{split.name}.warc.gz") as file:
            for start, end in zip(split.offsets[:-1].tolist(), split.offsets[1:].tolist(), strict=True):
                length = end - start
                file.seek(start)
                member = file.read(length if at_once or length <= _AT_ONCE else _HEAD_BYTES)
                rest = length - len(member)
                row = self._row(member, lambda rest=rest: file.read(rest))
                if row is not None:
                    yield row

    def _row(self, member: bytes, more: Callable[[], bytes] = bytes) -> dict | None:
        """The row of a record whose member begins with the given bytes; ``more`` fetches those that follow."""
        head = zlib.decompressobj(31).decompress(member, _HEAD_BYTES)
        # Two heads stand before the payload: the record's and that of HTTP.
        parts, whole = head.split(b"\r\n\r\n", 2), None
        if len(parts) < 3:
            whole = zlib.decompress(member + more(), 31)
            parts = whole.split(b"\r\n\r\n", 2)
        http = _fields(parts[1])
        row = _row_of(_fields(parts[0]), http, int(http.get("content-length", 0)))
        if not _passes(row, self.filters):
            return None
        if self._wants_payload(row):
            whole = whole or zlib.decompress(member + more(), 31)
            self._fill(row, http, whole.split(b"\r\n\r\n", 2)[2][: row["payload_bytes"]])
        return row

    def _streamed(self, name: str) -> Iterator[dict]:
        """The rows of a file by others, read once from its start."""
        with files.open_read(name) as file:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=file) if name.endswith(".gz") else file, _PIECE)
            while (head := _record_head(stream, name)) is not None:
                # Older versions of the format set targets in angle brackets, like names.
                fields = {k: _bare(v) if k.endswith("-uri") else v for k, v in _fields(head).items()}
                if "content-length" not in fields:
                    raise ValueError(f"record without a length in {name}")
                left = int(fields["content-length"])
                http, opening = {}, b""
                if _kind(fields) == "application/http":
                    opening, ended = _head(stream, left)
                    left -= len(opening)
                    if ended:
                        http, opening = _fields(opening), b""
                row = _row_of(fields, http, len(opening) + left)
                if _passes(row, self.filters):
                    if self._wants_payload(row):
                        payload = stream.read(left)
                        _whole(len(payload) == left, name)
                        left = 0
                        self._fill(row, http or {"content-type": fields.get("content-type", "")}, opening + payload)
                    yield row
                _pass_over(stream, left, name)

    def _wants_payload(self, row: dict) -> bool:
        return row["record_type"] != "revisit" and (self.payload or self.verify)

    def _fill(self, row: dict, http: dict[str, str], payload: bytes) -> None:
        digest = row["payload_digest"]
        known = digest is not None and ":" not in digest and "transfer-encoding" not in http
        if self.verify and known and (len(payload) != row["payload_bytes"] or bare_digest(payload) != digest):
            raise ValueError(f"payload of record {row['record_id']} does not fit its digest")
        if self.payload:
            row["payload"] = _decoded(payload, http)


class PushdownReader(WarcReader):
    """Apart from the plain reader, as Spark refuses a reader with this method in sessions that have not allowed it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Predicates on named fields are taken over; others are left to Spark."""
        for f in filters:
            known = isinstance(f, (EqualTo, In, IsNull, IsNotNull, StringStartsWith))
            if known and len(f.attribute) == 1 and f.attribute[0] != "payload":
                self.filters.append(f)
            else:
                yield f


def _archives(path: str) -> list[str]:
    """The archives at a path: itself, or those of a folder and its subfolders by name."""
    system, at = files.place(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    if system.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(scheme + f.path for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")))


def _whole(ok: bool, name: str) -> None:
    if not ok:
        raise ValueError(f"archive {name} is cut off")


def _head(stream: BinaryIO, most: int) -> tuple[bytes, bool]:
    """The lines up to an empty one, of at most ``most`` bytes in all, and whether the empty line was met."""
    most, lines = min(most, _LONGEST_HEAD), []
    while most > 0:
        line = stream.readline(most)
        lines.append(line)
        most -= len(line)
        if not line or not line.strip(b"\r\n"):
            return b"".join(lines), bool(line)
    return b"".join(lines), False


def _record_head(stream: BinaryIO, name: str) -> bytes | None:
    """The head of the next record; None at the end of the file."""
    line = stream.readline(_LONGEST_HEAD)
    while line and not line.strip(b"\r\n"):
        line = stream.readline(_LONGEST_HEAD)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record where one should begin in {name}")
    head, ended = _head(stream, _LONGEST_HEAD)
    _whole(ended, name)
    return line + head


def _pass_over(stream: io.BufferedReader, length: int, name: str) -> None:
    if length and not isinstance(stream.raw, gzip.GzipFile):
        # A plain file: what is passed over is not read, but for its last byte, which tells whether it is there.
        stream.seek(length - 1, io.SEEK_CUR)
        length = 1
    while length:
        piece = len(stream.read(min(length, _PIECE)))
        _whole(piece > 0, name)
        length -= piece


def _kind(fields: dict[str, str]) -> str:
    return fields.get("content-type", "").partition(";")[0].strip().lower()


def _decoded(payload: bytes, http: dict[str, str]) -> str:
    _, found, name = http.get("content-type", "").lower().partition("charset=")
    name = name.partition(";")[0].strip(" \"'")
    if found and name not in ("utf-8", "utf8"):
        try:
            # Some encodings give halves of surrogate pairs, which no text column can hold.
            return payload.decode(name, "replace").encode("utf-8", "replace").decode()
        except (LookupError, ValueError):
            pass
    return payload.decode("utf-8", "replace")


def _row_of(fields: dict[str, str], http: dict[str, str], payload_bytes: int) -> dict:
    """A record's row, its payload still open. A revisit carries no payload; its length is that which HTTP stated."""
    kind = fields.get("warc-type")
    if kind == "revisit":
        stated = http.get("content-length", "")
        payload_bytes = int(stated) if stated.isdecimal() else None
    digest = fields.get("warc-payload-digest", "")
    return {
        "page_id": _id(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"),
        "record_type": kind, "refers_to": _id(fields.get("warc-refers-to")),
        "refers_to_uri": fields.get("warc-refers-to-target-uri"),
        "payload_digest": (digest[5:] if digest[:5].lower() == "sha1:" else digest) or None,
        "payload_bytes": payload_bytes, "payload": None,
        "record_id": _bare(fields.get("warc-record-id")), "record_date": fields.get("warc-date"),
        "content_type": http.get("content-type") or fields.get("content-type"),
    }


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a head, without its first line; a line that begins with white space goes on with the one before."""
    found, name = {}, None
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


_ARROW = pa.schema([
    ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("refers_to_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.string()),
    ("record_id", pa.string()), ("record_date", pa.string()), ("content_type", pa.string()),
])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> WarcReader:
        pushdown = self.options.get("pushdown", "false").lower() == "true"
        return (PushdownReader if pushdown else WarcReader)(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"].rstrip("/"), int(self.options.get("level", 1)))


def with_first(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", least_bytes: int = 0) -> DataFrame:
    """The rows to write: each with its payload's digest and, where payloads repeat, the record that has it."""
    rows = df.select(
        df[key].cast("bigint").alias("page_id"), df[url].cast("string").alias("url"), F.coalesce(df[page], F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = rows.where(F.octet_length("html") >= least_bytes)
    # Partial minima first; only payloads that occur more than once go into the join, which splits hot ones.
    repeated = large.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"))
    repeated = repeated.where("n > 1").select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"))
    if least_bytes:
        small = rows.where(F.octet_length("html") < least_bytes)
        none = small.withColumn("first_id", F.lit(None).cast("bigint")).withColumn("first_url", F.lit(None).cast("string"))
        return spread_join(large, repeated, "digest", "left").unionByName(none).select("page_id", "url", "html", "digest", "first_id", "first_url")
    return spread_join(rows, repeated, "digest", "left").select("page_id", "url", "html", "digest", "first_id", "first_url")


def write_warc(df: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", page: str = "html", least_bytes: int = 0) -> str:
    """Archives of all pages, in a new folder."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "warc")
    spark.dataSource.register(WarcSource)
    with_first(df, key, url, page, least_bytes).write.format("warc").mode("append").option("path", folder).save()
    return folder


def read_warc(
    spark: SparkSession, folder: str, payload: bool = True, verify: bool = False, pushdown: bool = False,
    fields: dict[str, list] | None = None,
) -> DataFrame:
    """The records of a folder; of those that ``fields`` leaves out (values to keep, by column) only heads are read.

    With ``pushdown`` the predicates of the query itself are decided from heads too, on any column but
    ``payload``. Spark 4.1 keeps what it pushed with the frame, so use such a frame for one query.
    """
    return _load(spark, path=folder, payload=payload, verify=verify, pushdown=pushdown, fields=json.dumps(fields or {}))


def read_archives(
    spark: SparkSession, path: str, payload: bool = True, verify: bool = False, pushdown: bool = False,
    fields: dict[str, list] | None = None,
) -> DataFrame:
    """The records of archives that others wrote: a file, or all ``.warc`` and ``.warc.gz`` files under a folder.

    A task reads one file. The parameters are those of ``read_warc``.
    """
    return _load(spark, path=path, payload=payload, verify=verify, pushdown=pushdown, fields=json.dumps(fields or {}), foreign=True)


def _load(spark: SparkSession, pushdown: bool, **options: object) -> DataFrame:
    spark.dataSource.register(WarcSource)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options["pushdown"] = pushdown
    return spark.read.format("warc").options(**{k: str(v) for k, v in options.items()}).load()
