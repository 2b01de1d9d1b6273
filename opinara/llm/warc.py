"""WARC archives as a Python data source of Spark, and archives that store equal payloads once.

``write_archive`` and ``read_archive`` use the format ``warc``: a folder of ``.warc.gz`` files with one gzip member a
record. The driver plans: it lists the files, and where a manifest written with them names places to cut, it
makes several partitions of a file (files without a manifest, also plain ``.warc``, are one partition each). Filters
on header columns are pushed into the reader. A task parses the headers of a record first; if they do not satisfy the
filters, or no column of the schema needs the content, it goes on with the next record. Members written
here tell their own compressed length in the extra field ``sl`` of the gzip header, so the content is not
even read; in other files it is inflated and thrown away, or skipped by its Content-Length.

``archive_texts`` stores each payload once: of records with equal payloads of at least ``least`` bytes the one with the
largest id is a response, the others are revisits of it, which carry headers only.

A task writes files of its own names and the manifest, written last, lists those of the tasks that counted, so
that what lost executors left behind is never read. Paths are those that Arrow's file systems know: local, ``s3://``,
``gs://``, or ``hdfs://`` with its client library on the executors.

Defined results: a null text is an empty payload. Rows that repeat id and payload get the same type: all are
responses, or all revisits. A null id is smaller than any other. A null URL is left out. Empty tables make an archive without records. Records
with a broken header or end, or a payload unlike its digest, are never dropped silently: reading raises, and ``intact`` tells of digests.
Further columns of the input play no part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from .common import Scratch, marked_by_sieve, sieve

SCHEMA = ("record_id string, record_type string, target_uri string, date string, content_type string, content_length long, "
          "payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary, intact boolean")
FILE_BYTES, CUT_BYTES = 1 << 30, 32 << 20  # a new file after so many bytes; a place to cut the file after so many
CHUNK, BATCH_BYTES, BATCH_ROWS = 64 << 10, 8 << 20, 2_000
HEADER_STEP, HEADER_LIMIT = 1 << 10, 1 << 20
_NAMES = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
          "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "_manifest-"


# -- files -----------------------------------------------------------------------------------


def _file_system(path: str):
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)
    if re.match(r"file:/+", path):  # Hadoop writes file:/x for file:///x; its paths are not percent-encoded
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def _plan(path: str) -> list[tuple[str, int, int]]:
    """(file, start, end) of every partition."""
    from pyarrow import fs

    files, root = _file_system(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(info.path, 0, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no archive at {path}")
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    manifests = [f for f in found if f.base_name.startswith(_MANIFEST)]
    if not manifests:
        return [(f.path, 0, f.size) for f in sorted(found, key=lambda f: f.path)
                if f.base_name.endswith((".warc", ".warc.gz")) and f.size]
    parts = []
    for manifest in sorted(manifests, key=lambda f: f.path):
        with files.open_input_stream(manifest.path) as stream:
            for name, cuts in json.loads(stream.read()):
                parts += [(f"{root.rstrip('/')}/{name}", a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    return parts


# -- reading ---------------------------------------------------------------------------------


class _Bytes:
    """A file read forward through one buffer; skipped bytes are not read."""

    def __init__(self, file, at: int):
        self._file, self._buffer, self._from, self.at = file, b"", at, at

    def peek(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end of the file."""
        inside = self.at - self._from
        if not 0 <= inside <= len(self._buffer):
            self._buffer, self._from, inside = b"", self.at, 0
        if len(self._buffer) - inside < n:
            rest = self._buffer[inside:]
            self._file.seek(self.at + len(rest))
            self._buffer, self._from, inside = rest + self._file.read(max(n - len(rest), CHUNK)), self.at, 0
        return self._buffer[inside : inside + n]

    def take(self, n: int) -> bytes:
        got = self.peek(n)
        self.at += len(got)
        return got


class _Plain:
    """Uncompressed records one after another."""

    def __init__(self, source: _Bytes, end: int):
        self._source, self._end = source, end

    def more(self) -> bool:
        """Go past line ends; whether another record follows."""
        while self._source.at < self._end and self._source.peek(1) in (b"\r", b"\n"):
            self._source.at += 1
        return self._source.at < self._end

    def read(self, n: int) -> bytes:
        return self._source.take(n)

    def back(self, data: bytes) -> None:
        self._source.at -= len(data)

    def skip(self, n: int) -> None:
        self._source.at += n


class _Member:
    """A gzip member: one record, or several where its own length is not told."""

    def __init__(self, source: _Bytes):
        self._source, self._start, self._length = source, source.at, _skip_length(source)
        self._inflate, self._pending, self._ahead = zlib.decompressobj(31), b"", b""
        self._left = False

    def more(self) -> bool:
        while not self._left and (byte := self.read(1)):
            if byte not in (b"\r", b"\n"):
                self.back(byte)
                return True
        return False

    def read(self, n: int) -> bytes:
        got, self._ahead = bytearray(self._ahead[:n]), self._ahead[n:]
        while len(got) < n and not self._inflate.eof:
            # Little is fed for a header, so that it does not cost the inflation of a whole chunk.
            chunk = self._pending or self._source.take(1 << 10 if n <= HEADER_STEP else CHUNK)
            if not chunk:
                raise ValueError("a gzip member ends early")
            got += self._inflate.decompress(chunk, n - len(got))
            self._pending = self._inflate.unconsumed_tail
            if self._inflate.eof:
                self._source.at -= len(self._inflate.unused_data)
        return bytes(got)

    def back(self, data: bytes) -> None:
        self._ahead = data + self._ahead

    def skip(self, n: int) -> None:
        """Go past content; if the member's length is known, to its end, without reading or inflating."""
        if self._length:
            self._source.at, self._left = self._start + self._length, True
            return
        while n > 0:
            n -= len(self.read(min(n, CHUNK))) or n


def _skip_length(source: _Bytes) -> int:
    """Compressed length of a member as its ``sl`` field tells it, or 0."""
    head = source.peek(12)
    if len(head) < 12 or not head[3] & 4:
        return 0
    extra = source.peek(12 + struct.unpack_from("<H", head, 10)[0])[12:]
    while len(extra) >= 4:
        size = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"sl" and size == 8:
            return struct.unpack_from("<I", extra, 4)[0]
        extra = extra[4 + size :]
    return 0


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with a blank continues the one before."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        elif line:
            lines.append(line)
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _until_blank_line(stream: _Plain | _Member, limit: int) -> bytes | None:
    """A header, read with the blank line that ends it; None, and nothing read, if there is none within the limit."""
    got, end = b"", -1
    while end < 0:
        more = stream.read(min(HEADER_STEP, limit - len(got)))
        if not more:
            stream.back(got)
            return None
        end = (got := got + more).find(b"\r\n\r\n", max(len(got) - len(more) - 3, 0))
    stream.back(got[end + 4 :])
    return got[:end]


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + size + 4
    return b"".join(out)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(stream: _Plain | _Member, wanted: Callable[[dict], bool], columns: set[str]) -> dict | None:
    """The next record of a stream as a row; None if its header columns are not wanted."""
    head = _until_blank_line(stream, HEADER_LIMIT)
    fields = _fields(head or b"")
    if head is None or not head.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
        raise ValueError("no record header")
    left = size = int(fields["content-length"])
    row = {column: fields.get(name) for column, name in _NAMES.items()}
    row |= {"content_length": size, "payload_length": size, "headers": fields, "payload": None, "intact": None}
    if not wanted(row) or not columns & {"payload", "payload_length", "intact"}:
        stream.skip(left)
        return row if wanted(row) else None
    web: dict[str, str] = {}
    if (row["content_type"] or "").lower().startswith("application/http"):
        http = _until_blank_line(stream, min(size, HEADER_LIMIT))
        if http is not None:
            web, left = _fields(http), size - len(http) - 4
            told = web.get("content-length", "")
            row["payload_length"] = int(told) if told.isdigit() else left
    if row["record_type"] == "revisit" or not columns & {"payload", "intact"}:
        stream.skip(left)
        return row
    payload = stream.read(left)
    if len(payload) < left:
        raise ValueError("a record ends early")
    if web.get("transfer-encoding", "").lower() == "chunked":
        payload = _dechunked(payload)
    row |= {"payload": payload, "payload_length": len(payload)}
    if "intact" in columns and (row["payload_digest"] or "").lower().startswith("sha1:"):
        row["intact"] = row["payload_digest"][5:].upper() == sha1_base32(payload)
    return row


def read_records(source: _Bytes, end: int, zipped: bool, wanted: Callable[[dict], bool], columns: set[str]) -> Iterator[dict]:
    """Rows of the records that begin before ``end``; content is decoded only of wanted ones and for ``columns``."""
    while source.at < end:
        begin = source.at
        stream = _Member(source) if zipped else _Plain(source, end)
        try:
            while stream.more():
                begin = source.at
                row = _record(stream, wanted, columns)
                if row is not None:
                    yield row
        except (ValueError, zlib.error) as error:
            raise ValueError(f"{error}, near byte {begin}") from error


_TESTS = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt,
          ds.LessThanOrEqual: operator.le, ds.In: lambda x, among: x in among, ds.StringStartsWith: str.startswith,
          ds.StringEndsWith: str.endswith, ds.StringContains: lambda x, part: part in x}
_HEADER_COLUMNS = {*_NAMES, "content_length"}


def _test(filter_) -> Callable[[dict], bool] | None:
    """A pushed filter as a test of header columns; None where Spark has to apply it."""
    if isinstance(filter_, ds.Not):
        inner = _test(filter_.child)
        # Spark's three-valued logic: a null header satisfies neither a comparison nor its negation.
        if inner is None or isinstance(filter_.child, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)):
            return inner and (lambda row: not inner(row))
        column = filter_.child.attribute[0]
        return lambda row: row[column] is not None and not inner(row)
    if len(filter_.attribute) != 1 or filter_.attribute[0] not in _HEADER_COLUMNS:
        return None
    column = filter_.attribute[0]
    if isinstance(filter_, ds.IsNull):
        return lambda row: row[column] is None
    if isinstance(filter_, ds.IsNotNull):
        return lambda row: row[column] is not None
    value = filter_.value
    if isinstance(filter_, ds.EqualNullSafe):
        return lambda row: row[column] == value
    compare = _TESTS.get(type(filter_))
    if compare is None or value is None or isinstance(filter_, ds.In) and None in value:
        return None
    return lambda row: row[column] is not None and compare(row[column], value)


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self._path, self._schema, self._filters = path, schema, []

    def pushFilters(self, filters):  # noqa: N802
        for filter_ in filters:
            if _test(filter_) is None:
                yield filter_
            else:
                self._filters.append(filter_)

    def partitions(self):
        return [ds.InputPartition(part) for part in _plan(self._path)]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # an archive without records
            return
        (path, start, end), tests = partition.value, [_test(f) for f in self._filters]
        schema = to_arrow_schema(self._schema)
        names = self._schema.fieldNames()
        files, _ = _file_system(self._path)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            cells = [[list(r[n].items()) if n == "headers" else r[n] for r in rows] for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, schema.types, strict=True)], schema=schema)

        with files.open_input_file(path) as file:
            try:
                for row in read_records(_Bytes(file, start), end, path.endswith(".gz"), lambda r: all(t(r) for t in tests), set(names)):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows, held = [], 0
            except ValueError as error:
                raise ValueError(f"{path}: {error}") from error
        if rows:
            yield batch()


# -- writing ---------------------------------------------------------------------------------


def _member(record: bytes) -> bytes:
    """A gzip member of one record; its extra field tells its own length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 12 + 12 + len(body) + 8
    known = total < 1 << 32 and len(record) < 1 << 32
    extra = b"sl" + struct.pack("<HII", 8, total, len(record)) if known else b""
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBBH", 0, 0, 255, len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    """Header lines; line breaks and other controls inside a value are percent-encoded."""
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    return "".join(f"{name}: {clean(str(value))}\r\n" for name, value in fields if value is not None).encode("utf-8", "replace")


def record_bytes(row: dict, now: str) -> bytes:
    """One record: a response with its payload, or a revisit that keeps the length and digest of the payload it leaves out."""
    payload, revisit = row.get("payload"), row.get("record_type") == "revisit"
    digest, length = row.get("payload_digest"), row.get("payload_length")
    if not revisit:
        payload = payload or b""
        digest, length = digest or f"sha1:{sha1_base32(payload)}", len(payload)
    block = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", row.get("content_type") or "text/html; charset=utf-8"),
                                              ("Content-Length", length)]) + b"\r\n" + (b"" if revisit else payload)
    head = _header([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", row.get("record_id") or f"<{uuid.uuid4().urn}>"),
        ("WARC-Date", row.get("date") or now), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", digest),
        ("WARC-Profile", _PROFILE if revisit else None), ("WARC-Refers-To", row.get("refers_to") if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self._path, self._overwrite = path, overwrite

    def write(self, iterator):
        files, root = _file_system(self._path)
        files.create_dir(root, recursive=True)
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        done, out, cuts, at = [], None, [], 0
        for batch in iterator:
            columns = [(name, batch.column(i)) for i, name in enumerate(batch.schema.names)]
            for i in range(batch.num_rows):
                if out is None:
                    name, cuts, at = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)  # the members are compressed already
                member = _member(record_bytes({n: c[i].as_py() for n, c in columns}, now))
                out.write(member)
                at += len(member)
                if at - cuts[-1] >= CUT_BYTES:
                    cuts.append(at)
                if at >= FILE_BYTES:
                    out.close()
                    out = done.append((name, cuts if cuts[-1] == at else [*cuts, at]))
        if out is not None:
            out.close()
            done.append((name, cuts if cuts[-1] == at else [*cuts, at]))
        message = ds.WriterCommitMessage()
        message.files = done
        return message

    def commit(self, messages):
        files, root = _file_system(self._path)
        files.create_dir(root, recursive=True)
        written = [f for m in messages if m is not None for f in m.files]
        if self._overwrite:
            from pyarrow import fs

            keep = {name for name, _ in written}
            for old in files.get_file_info(fs.FileSelector(root)):
                if old.base_name not in keep and (old.base_name.startswith(_MANIFEST) or old.base_name.endswith((".warc", ".warc.gz"))):
                    files.delete_file(old.path)
        with files.open_output_stream(f"{root}/{_MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(written).encode())

    def abort(self, messages):
        files, root = _file_system(self._path)
        for message in messages:
            for name, _ in getattr(message, "files", ()):
                files.delete_file(f"{root}/{name}")


class WarcSource(ds.DataSource):
    """The format ``warc``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        unknown = set(schema.fieldNames()) - {*_HEADER_COLUMNS, "payload_length", "headers", "payload", "intact"}
        if unknown:
            raise ValueError(f"no such columns in an archive: {sorted(unknown)}")
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def read_archive(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Records of the archives at ``path``: a file, or a folder of them. Only content that ``columns`` need is decoded.

    Sets ``spark.sql.python.filterPushdown.enabled`` in the session, without which Spark pushes no filters to it.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    kinds = [(f, f.split()[0]) for f in SCHEMA.split(", ")]
    wanted = ", ".join(f for f, name in kinds if not columns or name in columns)
    return spark.read.format("warc").schema(wanted).load(path)


def write_archive(records: DataFrame, path: str, mode: str = "append") -> None:
    """Write records: ``payload`` (binary) and, as far as given, the header columns of the schema."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode(mode).save(path)


# -- payloads stored once --------------------------------------------------------------------


def base32_of_hex(digits: Column) -> Column:
    """Upper-case base32 of a digest given as 40 hexadecimal digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    chars = []
    for group in range(8):  # five hexadecimal digits are four of base32
        value = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        chars += [F.substring(alphabet, F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*chars)


def _record_id(id_: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(F.url_encode(id_.cast("string")), F.lit("")), F.lit(">"))


def id_of(record_id: Column) -> Column:
    """The id that a record id was made of; null for other record ids and for the record of a null id."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, "^<urn:record:(.*)>$", 1), F.lit("")))


def archive_texts(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url",
                  text_col: str = "html") -> None:
    """Write a record for every row, equal payloads of at least ``least`` bytes once."""
    scratch = Scratch(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"name": F.coalesce(F.col("id").cast("string"), F.lit("")), "key": F.unhex(F.sha2("payload", 256))})
    narrow = scratch.write(rows.select("id", "url", "name", "key", F.octet_length("payload").cast("long").alias("length"),
                                       base32_of_hex(F.sha1("payload")).alias("digest")), "narrow")
    groups = narrow.filter(F.col("length") >= least).groupBy("key").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    groups = scratch.write(groups.filter("n > 1").select("key", "keep"), "groups")
    # The hot side is a plain scan, so Spark may split a payload that many rows share.
    later = narrow.join(groups, "key").filter(~F.col("id").eqNullSafe(F.col("keep")))
    later = scratch.write(later.select("id", "url", "name", "key", "length", "digest", "keep"), "revisits")
    known = scratch.write(later.select("name", "key").distinct(), "known")

    # Payloads are read again, and only rows that may be revisits are shuffled to make sure of it.
    pair = F.xxhash64("name", "key")
    marked = marked_by_sieve(rows, sieve(known, pair), pair, "maybe")
    first = marked.filter(~F.col("maybe")).unionByName(marked.filter("maybe").join(known, ["name", "key"], "left_anti"))
    first = first.select(_record_id(F.col("id")).alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("target_uri"),
                         "payload", F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("long").alias("payload_length"),
                         F.lit(None).cast("string").alias("refers_to"))
    again = later.select(_record_id(F.col("id")).alias("record_id"), F.lit("revisit").alias("record_type"), F.col("url").alias("target_uri"),
                         F.lit(None).cast("binary").alias("payload"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
                         F.col("length").alias("payload_length"), _record_id(F.col("keep")).alias("refers_to"))
    write_archive(first.unionByName(again), path)


def page_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """What the archives at ``path`` hold of every page: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Payloads of responses are read and digested; of revisits the headers are enough, and nothing else is decoded.
    """
    whole = read_archive(spark, path, "record_id", "record_type", "payload", "payload_digest").filter("record_type = 'response'")
    digest = base32_of_hex(F.sha1("payload"))
    whole = whole.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
                         "record_type", F.lit(None).cast("string").alias("refers_to"),
                         F.col("payload_digest").eqNullSafe(F.concat(F.lit("sha1:"), digest)).alias("intact"))
    brief = read_archive(spark, path, "record_id", "record_type", "payload_digest", "payload_length", "refers_to").filter(
        "record_type = 'revisit'")
    brief = brief.select("record_id", F.col("payload_length").alias("payload_bytes"),
                         F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", "refers_to",
                         F.lit(None).cast("boolean").alias("intact"))
    both = whole.unionByName(brief)
    return both.select(id_of(F.col("record_id")).cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       id_of(F.col("refers_to")).cast(id_type).alias("refers_to"), "intact")
