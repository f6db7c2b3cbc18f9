"""WARC archives as a PySpark Python data source, and an archive writer without repeated payloads.

Reading (format ``warc``): files are planned as partitions; a record's headers are
parsed first, and predicates on its type or any header column decide whether its
payload is looked at. Where the payload is not wanted - the record is filtered out,
or the given schema has no ``payload`` - it is skipped: by a seek in plain files and in
gzip members that carry their length (the ``SL`` extra field that the writer sets),
else by reading past it. Wanted payloads are checked against their digest.

Writing: each record is a gzip member. Files are only seen once their job commits: a
manifest of the job names them, so a lost or repeated task leaves nothing that is
read. A job that appends adds its manifest to those there; one that overwrites
takes theirs, and the files they name, away once its own is written.

Malformed input (a header block that isn't one, no length or one that is no number,
a record that ends early, a payload that doesn't match its digest) ends the job with
an error, or with the option ``malformed = skip`` is left out: reading goes on at the
next record that can be found.

A null payload is written as an empty one. A null key or address is written without
that header and comes back null; line ends in an address are percent-encoded.
Repeated rows are written each; of equal payloads (ties) the smallest key's rows are
the responses. A very long payload is held whole by the task that writes or wants
it, and by no other. An empty table gives an archive without records. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from skein.llm.common import slices, written

#: Columns that come from headers, and those headers' names.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "payload_bytes": "WARC-Payload-Length", "content_type": "Content-Type", "content_length": "Content-Length",
}
NUMBERS = ("payload_bytes", "content_length")
SCHEMA = ", ".join(f"{c} {'long' if c in NUMBERS else 'string'}" for c in HEADERS) + ", payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_MANIFEST"
HEAD, BATCH_BYTES, BATCH_RECORDS = 4096, 4 << 20, 512
#: Longest header block, and most payloads whose copies are found by a broadcast.
MOST_HEAD, HOT_PAYLOADS = 1 << 20, 1000


class Malformed(ValueError):
    """Input that is no record."""


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(values: dict[str, str | None], payload: bytes, with_payload: bool) -> bytes:
    """A WARC record's bytes."""
    known = values | {"payload_digest": "sha1:" + digest(payload), "payload_bytes": str(len(payload)), "content_length": str(len(payload) if with_payload else 0)}
    lines = ["WARC/1.1", *(f"{name}: {known[c]}" for c, name in HEADERS.items() if known.get(c) is not None)]
    if values.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (payload if with_payload else b"") + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member that says how long it is."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"SL" + struct.pack("<HII", 8, len(body), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def headers(block: bytes) -> dict[str, str]:
    """Names in lower case, and values, of a header block; continued lines are joined."""
    out: dict[str, str] = {}
    last = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class Source:
    """Records of an open file: ``head()`` gives the next one's headers or None, then ``payload(n)`` or ``skip(n)``."""

    def __init__(self, file, packed: bool):
        self.file, self.rest, self.sized, self.end = file, b"", False, -1
        if packed:
            start = file.read(16)
            self.sized = start[3:4] == b"\x04" and start[12:14] == b"SL"
            file.seek(0)
            if not self.sized:
                self.file = io.BufferedReader(gzip.GzipFile(fileobj=file))
        self.seekable = not packed

    def head(self) -> dict[str, str] | None:
        return self._member_head() if self.sized else self._stream_head()

    def payload(self, n: int) -> bytes:
        if self.sized:
            while len(self.data) < self.at + n:
                more = self.file.read(min(1 << 20, self.end - self.file.tell()))
                if not more:
                    raise Malformed("a record ends early")
                self.data += self.unpack.decompress(more)
            out = self.data[self.at : self.at + n]
            self.skip(n)
            return out
        out = self.rest[:n]
        self.rest = self.rest[len(out) :]
        while len(out) < n:
            more = self.file.read(n - len(out))
            if not more:
                raise Malformed("a record ends early")
            out += more
        return out

    def skip(self, n: int) -> None:
        if self.sized:
            self.file.seek(self.end + 8)
            self.end = -1
            return
        gone = min(n, len(self.rest))
        self.rest, n = self.rest[gone:], n - gone
        if self.seekable:
            self.file.seek(self.file.tell() + n)
        while n and not self.seekable:
            more = self.file.read(min(n, 1 << 20))
            if not more:
                raise Malformed("a record ends early")
            n -= len(more)

    def _member_head(self) -> dict[str, str] | None:
        start = self.file.read(24)
        if not start:
            return None
        if start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != b"SL":
            raise Malformed("a gzip member doesn't say how long it is, though the first one does")
        self.end = self.file.tell() + struct.unpack("<I", start[16:20])[0]
        self.unpack, self.data = zlib.decompressobj(-15), b""
        while (at := self.data.find(b"\r\n\r\n")) < 0:
            more = self.file.read(min(HEAD, self.end - self.file.tell()))
            if not more:
                raise Malformed("a record ends within its headers")
            self.data += self.unpack.decompress(more)
        self.at = at + 4
        return self._headers(self.data[:at])

    def _stream_head(self) -> dict[str, str] | None:
        data = self.rest
        while True:
            data = data.lstrip(b"\r\n")  # what ends the record before
            if (at := data.find(b"\r\n\r\n")) >= 0:
                self.rest = data[at + 4 :]
                return self._headers(data[:at])
            more = self.file.read(HEAD)
            if not more:
                if data:
                    self.rest = b""
                    raise Malformed("a record ends within its headers")
                return None
            data += more
            if len(data) > MOST_HEAD:
                self.rest = data
                raise Malformed("a header block doesn't end")

    def _headers(self, block: bytes) -> dict[str, str]:
        if not block.startswith(b"WARC/"):
            raise Malformed("a header block doesn't begin as one")
        return headers(block)

    def resync(self) -> bool:
        """After malformed input: goes on to the next record; false if there is none."""
        if self.sized and self.end >= 0:
            self.skip(0)
            return True
        mark = b"\x1f\x8b\x08\x04" if self.sized else b"\nWARC/"
        data = b"" if self.sized else self.rest
        while True:
            at = data.find(mark)
            if at >= 0 and self.sized:
                self.file.seek(self.file.tell() - len(data) + at)
                if self.file.read(16)[12:14] == b"SL":
                    self.file.seek(self.file.tell() - 16)
                    return True
                self.file.seek(self.file.tell() - 15)  # a chance match
                data = b""
            elif at >= 0:
                self.rest = data[at + 1 :]
                return True
            try:
                more = self.file.read(1 << 16)
            except (OSError, EOFError, zlib.error):  # a gzip stream that is broken from here on
                more = b""
            if not more:
                return False
            data = data[-len(mark) :] + more


TESTS = {
    EqualTo: lambda f: lambda v: v is not None and v == f.value, EqualNullSafe: lambda f: lambda v: v == f.value, In: lambda f: lambda v: v is not None and v in f.value,
    GreaterThan: lambda f: lambda v: v is not None and v > f.value, GreaterThanOrEqual: lambda f: lambda v: v is not None and v >= f.value,
    LessThan: lambda f: lambda v: v is not None and v < f.value, LessThanOrEqual: lambda f: lambda v: v is not None and v <= f.value,
    IsNull: lambda f: lambda v: v is None, IsNotNull: lambda f: lambda v: v is not None, StringStartsWith: lambda f: lambda v: v is not None and v.startswith(f.value),
}


def located(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), path)


def manifests(fs: pf.FileSystem, path: str) -> dict[str, list[str]]:
    """The manifests in a folder, and the files that each names."""
    out = {}
    for info in fs.get_file_info(pf.FileSelector(path, allow_not_found=True)):
        if info.base_name.startswith(MANIFEST):
            with fs.open_input_stream(info.path) as f:
                out[info.path] = json.loads(f.read())
    return out


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, skip: bool = False):
        self.path, self.columns, self.predicates, self.lenient = path, schema.names, [], skip
        self.schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in NUMBERS else pa.string()) for n in schema.names])
        if unknown := set(schema.names) - {*HEADERS, "payload"}:
            raise ValueError(f"no such columns: {sorted(unknown)}")

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in TESTS and name in HEADERS:
                self.predicates.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, path = located(self.path)
        info = fs.get_file_info(path)
        if info.type == pf.FileType.File:
            return [InputPartition(path)]
        if info.type == pf.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if held := manifests(fs, path):
            names = [f"{path}/{n}" for names in held.values() for n in names]
        else:
            names = [f.path for f in fs.get_file_info(pf.FileSelector(path, recursive=True)) if f.path.endswith((".warc", ".warc.gz"))]
        return [InputPartition(n) for n in sorted(names)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        tests = [(f.attribute[0], TESTS[type(f)](f)) for f in self.predicates]
        fs, _ = located(self.path)
        rows: list[list] = []
        size = 0
        with fs.open_input_file(partition.value) as file:
            source = Source(file, partition.value.endswith(".gz"))
            while True:
                try:
                    row = self._next(source, tests)
                except (Malformed, EOFError, zlib.error, gzip.BadGzipFile):
                    if not self.lenient:
                        raise
                    if not source.resync():
                        break
                    continue
                if row is None:
                    break
                if row:
                    rows.append([row[c] for c in self.columns])
                    size += len(row.get("payload") or b"")
                if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _next(self, source: Source, tests: list) -> dict | None:
        """The next record's values: none if a predicate rejects it, None at the end."""
        found = source.head()
        if found is None:
            return None
        values: dict = {c: found.get(name.lower()) for c, name in HEADERS.items()}
        length = values["content_length"]
        if length is None or not (length.isascii() and length.isdigit()):
            raise Malformed(f"{values['record_id']}: a record's length is {length}")
        told = values["payload_bytes"]
        values |= {"content_length": int(length), "payload_bytes": int(told) if told is not None and told.isascii() and told.isdigit() else None}
        if not all(test(values[c]) for c, test in tests):
            source.skip(int(length))
            return {}
        if "payload" not in self.columns:
            source.skip(int(length))
            return values
        values["payload"] = source.payload(int(length))
        told = values["payload_digest"]
        if told and told.startswith("sha1:") and values["record_type"] != "revisit" and told[5:] != digest(values["payload"]):
            raise Malformed(f"{values['record_id']}: the payload doesn't match its digest")
        return values

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.schema.types, strict=True)], schema=self.schema)


class Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceArrowWriter):
    """Takes header columns and ``payload``; a revisit's payload is hashed and left out."""

    def __init__(self, path: str, level: int, most_bytes: int, overwrite: bool = False):
        self.path, self.level, self.most, self.overwrite = path, level, most_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = located(self.path)
        fs.create_dir(path, recursive=True)
        names: list[str] = []
        file, written = None, 0
        for batch in slices(iterator, 256):
            for row in batch.to_pylist():
                if file is None or written >= self.most:
                    if file:
                        file.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    file, written = fs.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                values = {c: row[c] for c in HEADERS if c in row and c not in ("payload_digest", *NUMBERS)}
                if values.get("target_uri") is not None:
                    values["target_uri"] = values["target_uri"].replace("\r", "%0D").replace("\n", "%0A")
                data = member(record(values, row["payload"] or b"", values["record_type"] != "revisit"), self.level)
                file.write(data)
                written += len(data)
        if file:
            file.close()
        return Files(names)

    def commit(self, messages: list) -> None:
        fs, path = located(self.path)
        fs.create_dir(path, recursive=True)
        old = manifests(fs, path) if self.overwrite else {}
        with fs.open_output_stream(f"{path}/{MANIFEST}-{uuid.uuid4().hex}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        for manifest in old:
            fs.delete_file(manifest)
        self._delete(fs, [f"{path}/{n}" for names in old.values() for n in names])

    def abort(self, messages: list) -> None:
        fs, path = located(self.path)
        self._delete(fs, [f"{path}/{n}" for m in messages if m for n in m.names])

    @staticmethod
    def _delete(fs: pf.FileSystem, files: list[str]) -> None:
        for name in files:
            with contextlib.suppress(OSError):  # what no manifest names is not read
                fs.delete_file(name)


class Warc(DataSource):
    """Format ``warc``; options: path, malformed (``fail`` or ``skip``), level (of compression, 1), most_bytes (of a file before the next begins)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        malformed = self.options.get("malformed", "fail")
        if malformed not in ("fail", "skip"):
            raise ValueError(f"malformed is 'fail' or 'skip', not {malformed!r}")
        return Reader(self.options["path"], schema, malformed == "skip")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], int(self.options.get("level", 1)), int(self.options.get("most_bytes", 64 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known; predicates only reach Python sources where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def read(spark: SparkSession, path: str, schema: str = SCHEMA, malformed: str = "fail") -> DataFrame:
    """The records of an archive file or folder; leave ``payload`` out of the schema to read headers only."""
    register(spark)
    return spark.read.format("warc").schema(schema).option("malformed", malformed).load(path)


def archive(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", body: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", mode: str = "append") -> None:
    """Writes a record for each row: of equal payloads of at least ``least_bytes`` the row of smallest key as response, the others as revisits of it; smaller ones as responses.

    Only keys and digests are grouped; payloads are shuffled once, by key, so that many copies of one payload meet in no task. The copies
    of the ``HOT_PAYLOADS`` commonest payloads find their response by a broadcast, so that the join of the others has no key with more
    than one in so many rows. ``mode``: append or overwrite; copies of payloads in what is there already are not looked for.
    """
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(F.col(key).alias("_k"), F.col(uri).cast("string").alias("target_uri"), F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_d", F.sha1("payload")).withColumn("_n", F.octet_length("payload"))
    small = written(rows.filter(F.col("_n") >= least_bytes).select("_k", "_d", "_n"), "warc-digests")
    firsts = written(small.groupBy("_d", "_n").agg(F.min("_k").alias("_first"), F.count("*").alias("_c")).filter("_c > 1"), "warc-firsts")
    # at most HOT_PAYLOADS rows: a proven bound
    hot = F.broadcast(firsts.orderBy(F.desc("_c"), "_d", "_n").limit(HOT_PAYLOADS).drop("_c"))
    rare = small.join(hot.drop("_first"), ["_d", "_n"], "left_anti").join(firsts.drop("_c"), ["_d", "_n"])
    copies = small.join(hot, ["_d", "_n"]).unionByName(rare).filter(F.col("_first").isNotNull() & ~F.col("_k").eqNullSafe(F.col("_first"))).select(F.col("_k").alias("_ck"), F.col("_d").alias("_cd"), "_first").distinct()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    joined = rows.join(copies, F.col("_k").eqNullSafe(F.col("_ck")) & (F.col("_d") == F.col("_cd")), "left")
    kind = F.when(F.col("_first").isNull(), "response").otherwise("revisit").alias("record_type")
    out = joined.select(kind, urn("_k").alias("record_id"), "target_uri", urn("_first").alias("refers_to"), F.lit(date).alias("date"), F.lit("text/html").alias("content_type"), "payload")
    out.write.format("warc").option("path", path).mode(mode).save()


def records(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """What an archive written by ``archive`` holds: key, payload_bytes, payload_digest, record_type and refers_to.

    Responses are read with their payloads, which are checked against their digests; of revisits only the headers are parsed. That is two
    scans, each of which seeks past the members that its predicate on the type rejects.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1).cast("long")
    names = lambda n: [number("record_id").alias(key), n.cast("long").alias("payload_bytes"), F.substring("payload_digest", 6, 64).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")]
    full = read(spark, path, "record_type string, record_id string, refers_to string, payload_digest string, payload binary").filter("record_type = 'response'")
    bare = read(spark, path, "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long").filter("record_type = 'revisit'")
    return full.select(*names(F.octet_length("payload"))).unionAll(bare.select(*names(F.col("payload_bytes"))))
