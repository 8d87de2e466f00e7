"""WARC archives as a PySpark data source.

``spark.read.format("warc").schema(...).load(folder)`` plans partitions from the
archive files, pushes record-type and header predicates into the reader, parses
headers first and inflates a payload only if a requested column needs it. Archives
of other writers are read too: gzip members without skip lengths (inflated, but not
kept, where nothing of them is wanted), members that hold several records, archives
that aren't compressed, and records of all types; header names are taken without regard
to case, and values that go on over several lines are joined by a blank. ``payload`` is
the block, without HTTP headers if it has them.
``df.write.format("warc").save(folder)`` writes one archive per task, each record
a gzip member whose ``sl`` extra field tells its length (WARC annex D), so a
reader can pass over it without inflating it.

Columns to write: record_id, record_type, target_uri, payload, payload_digest,
payload_bytes, refers_to. Columns to read: those and ``headers`` (map); the schema
given to the reader selects them.

Defined results: null payload and null URI count as empty; records with equal
payloads are told apart by id, the largest being the response (rows that repeat
this id are all responses); null ids sort lowest and are written as ``null``;
other columns are ignored; an empty table writes no archive and reads as empty; a
revisit that doesn't tell the length or digest of its payload has null there.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .storage import shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, payload binary, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>"
URN = "urn:shelfspark:record:"
MANIFEST = "_archives.json"
SPLIT_BYTES = 64 << 20
_HEAD = 4096  # bytes inflated at first to find the headers


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def member(data: bytes, level: int) -> bytes:
    """A gzip member with a skip-length extra field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = 10 + 2 + 12
    extra = b"sl" + struct.pack("<HII", 8, head + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and the place of the block, or None if the headers go on."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines: list[str] = []
    for x in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if x[:1] in (" ", "\t") and lines:
            lines[-1] += " " + x.strip()
        else:
            lines.append(x)
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def clean(value: str | None) -> str:
    """A header value on one line."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


@dataclass
class ArchiveMessage(WriterCommitMessage):
    name: str | None


@dataclass
class ArchivePartition(InputPartition):
    files: list[str]


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "WarcReader":
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> "WarcWriter":
        return WarcWriter(self.options)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.uri, self.level = options["path"], int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ArchiveMessage:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                payload = bytes(row["payload"] or b"")
                revisit = row["record_type"] == "revisit"
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                fields = {
                    "WARC-Type": row["record_type"],
                    "WARC-Record-ID": f"<{URN}{row['record_id']}>",
                    "WARC-Date": "1970-01-01T00:00:00Z",
                    "WARC-Target-URI": clean(row["target_uri"]),
                    "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
                    "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
                    "WARC-Refers-To": f"<{URN}{row['refers_to']}>" if revisit else None,
                    "X-Payload-Length": str(row["payload_bytes"]),
                    "Content-Type": "application/http; msgtype=response",
                }
                out.write(member(record(fields, http if revisit else http + payload), self.level))
        if out is not None:
            out.close()
        return ArchiveMessage(name if out is not None else None)

    def commit(self, messages: list[ArchiveMessage | None]) -> None:
        """Name the archives of the successful attempts; readers see no others."""
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps([m.name for m in messages if m is not None and m.name]).encode())

    def abort(self, messages: list[ArchiveMessage | None]) -> None:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{path}/{m.name}")


class Stream:
    """A seekable source with bytes that can be put back."""

    def __init__(self, source):
        self.source, self.back = source, b""

    def read(self, n: int) -> bytes:
        out, self.back = self.back[:n], self.back[n:]
        return out + self.source.read(n - len(out)) if len(out) < n else out

    def unread(self, data: bytes) -> None:
        self.back = data + self.back

    def skip(self, n: int) -> None:
        held = min(n, len(self.back))
        self.back = self.back[held:]
        if n > held:
            self.source.seek(n - held, 1)


class Record:
    """A record as it lies in an archive that isn't compressed."""

    def __init__(self, stream: Stream):
        self.stream, self.held, self.left = stream, b"", 0

    def more(self, limit: int) -> bytes:
        """Some more bytes, at most ``limit``; none at the end."""
        return self.stream.read(limit)

    def block(self, begun: bytes, size: int) -> None:
        """Tell the size of the block, of which ``begun`` has been read."""
        self.held, self.left = begun[:size], size - len(begun[:size])
        self.stream.unread(begun[size:])

    def rest(self) -> bytes:
        """The whole block."""
        parts = [self.held]
        while self.left and (data := self.more(min(self.left, 1 << 20))):
            parts.append(data)
            self.left -= len(data)
        return b"".join(parts)

    def close(self, head: int = 0) -> "Record | None":
        """Pass over what is left of the record, whose headers took ``head`` bytes; returns what holds the next record, if it is the same member."""
        self.stream.skip(self.left)
        return None


class Member(Record):
    """A gzip member and the record in it that is being read.

    With a skip length, what is not wanted is passed over, unless the member's own length
    tells that it holds more than this record.
    """

    def __init__(self, stream: Stream, size: int | None, length: int | None = None):
        super().__init__(stream)
        self.size, self.length, self.z, self.waiting, self.after = size, length, zlib.decompressobj(31), b"", b""

    def more(self, limit: int) -> bytes:
        if self.after:
            out, self.after = self.after[:limit], self.after[limit:]
            return out
        while not self.z.eof:
            data = self.waiting
            if not data:
                data = self.stream.read(_HEAD if self.size is None else min(_HEAD, self.size))
                if not data:
                    raise ValueError("a gzip member ends early")
                if self.size is not None:
                    self.size -= len(data)
            out = self.z.decompress(data, limit)  # no more than that, however far the data would inflate
            self.waiting = self.z.unconsumed_tail
            if out:
                return out
        return b""

    def block(self, begun: bytes, size: int) -> None:
        self.whole, self.held, self.left = size, begun[:size], size - len(begun[:size])
        self.after = begun[size:] + self.after

    def close(self, head: int = 0) -> "Record | None":
        if self.size is not None and self.length in (None, head + self.whole + 4):
            self.stream.skip(self.size)
            return None
        while self.left and (data := self.more(min(self.left, 1 << 16))):
            self.left -= len(data)
        while data := self.more(1 << 16):  # another record, or the end of the member
            data = data.lstrip(b"\r\n")
            if data:
                self.after = data + self.after
                return self
        if self.size is not None:
            self.stream.skip(self.size)
        else:
            self.stream.unread(self.z.unused_data)
        return None


def next_record(stream: Stream) -> Record | None:
    """The record that begins at the stream's place, after blank lines."""
    while True:
        head = stream.read(24)
        stream.unread(head)
        if not head:
            return None
        if head[:2] == b"\x1f\x8b":
            sl = len(head) == 24 and head[3] & 4 and head[12:14] == b"sl"
            return Member(stream, *(struct.unpack_from("<II", head, 16) if sl else (None,)))
        if head[:5].upper() == b"WARC/":
            return Record(stream)
        if head[:1] not in b"\r\n":
            raise ValueError("neither a WARC record nor a gzip member")
        stream.read(1)


#: Columns that headers alone answer, and how.
HEADER_OF = {"record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To"}


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.uri, self.columns = options["path"], [f.name for f in schema.fields]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and IN on header columns; hand back the rest."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                have = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = set(values) if have is None else have & set(values)
            else:
                yield f

    def partitions(self) -> list[ArchivePartition]:
        """Archives are dealt out by size; one archive is never divided."""
        fs, path = pafs.FileSystem.from_uri(self.uri)
        if fs.get_file_info(path).is_file:
            return [ArchivePartition([self.uri])]
        if fs.get_file_info(f"{path}/{MANIFEST}").is_file:
            with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
                infos = fs.get_file_info([f"{path}/{n}" for n in json.loads(f.read())])
        else:  # a folder that this source has not written
            infos = [i for i in fs.get_file_info(pafs.FileSelector(path)) if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))]
        parts, held, size = [], [], 0
        for info in sorted(infos, key=lambda i: i.base_name):
            if held and size + info.size > self.split_bytes:
                parts, held, size = [*parts, ArchivePartition(held)], [], 0
            held, size = [*held, f"{self.uri.rstrip('/')}/{info.base_name}"], size + info.size
        return [*parts, ArchivePartition(held)] if held else parts or [ArchivePartition([])]

    def values(self, fields: dict[str, str]) -> dict[str, str | None]:
        out = {c: fields.get(h.lower()) for c, h in HEADER_OF.items()}
        return out | {c: out[c].strip("<>").removeprefix(URN) if out[c] else None for c in ("record_id", "refers_to")}

    def records(self, source) -> Iterator[dict]:
        need = bool({"payload", "payload_digest", "payload_bytes"} & set(self.columns))
        stream, body = Stream(source), None
        while (body := body or next_record(stream)) is not None:
            data = b""
            while (parsed := parse_head(data)) is None:
                more = body.more(_HEAD)
                if not more:
                    raise ValueError("a WARC record ends within its headers")
                data += more
            fields, at = parsed
            named = {k.lower(): v for k, v in fields.items()}
            body.block(data[at:], int(named.get("content-length", 0)))
            row = self.values(named)
            if any(row[c] not in v for c, v in self.wanted.items()):
                body = body.close(at)
                continue
            if need and row["record_type"] != "revisit":
                payload = body.rest()
                if named.get("content-type", "").lower().startswith("application/http"):
                    payload = payload.partition(b"\r\n\r\n")[2]
                row |= {"payload": payload, "payload_digest": b32(hashlib.sha1(payload).digest()), "payload_bytes": len(payload)}
            else:  # a revisit tells digest and length of the payload that it leaves out
                size = named.get("x-payload-length")
                row |= {"payload": None, "payload_digest": named.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": int(size) if size else None}
            body = body.close(at)
            yield row | {"headers": fields}

    def read(self, partition: ArchivePartition) -> Iterator[tuple]:
        for uri in partition.files:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as source:
                for row in self.records(source):
                    yield tuple(row[c] for c in self.columns)


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", uri: str | None = None) -> str:
    """One record per page; equal payloads of at least ``min_revisit_bytes`` are stored once. Returns the folder."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    folder = uri or shared_dir(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id_"), F.col(url_col).alias("target_uri"), payload.alias("payload")).withColumns({"hex_": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    # only digests that repeat take part in the join; counts are combined before the shuffle
    copies = rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("hex_").agg(F.max("id_").alias("keep_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    revisit = F.col("keep_").isNotNull() & ~F.col("id_").eqNullSafe(F.col("keep_"))
    out = rows.join(copies, "hex_", "left").select(
        F.coalesce(F.col("id_").cast("string"), F.lit("null")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.rtrim(F.translate(base32_of_hex(F.col("hex_")), "=", "")).alias("payload_digest"),
        "payload_bytes",
        F.when(revisit, F.col("keep_").cast("string")).alias("refers_to"),
    )
    out.write.format("warc").mode("append").save(folder)
    return folder


def base32_of_hex(hexes) -> F.col:
    """Upper-case base32 of a 40-digit hex string: eight groups of 20 bits, each four characters of five bits."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexes, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda g, shift: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(g, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda g: F.concat(*(letter(g, s) for s in (15, 10, 5, 0)))), "")


def read_archives(spark, folder: str, columns: str) -> DataFrame:
    """Read archives with the given columns only, for example "record_id string, record_type string"."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).load(folder)
