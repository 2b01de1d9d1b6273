"""WARC archives: round trips, foreign files, filters in the reader, payloads stored once."""

import base64
import gzip
import hashlib
import io
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinara.llm import queries, warc
from compare import connect, difference

SF = "/root/testdata/sf0.001"
ALL = {"payload", "intact", "payload_length"}


def foreign(kind, block, **extra):
    head = [f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in extra.items()], f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
FOREIGN = [
    foreign("warcinfo", b"software: x\r\n"),
    foreign("response", HTTP + b"<p>one</p>", Content_Type="application/http", WARC_Target_URI="http://a"),
    foreign("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
    foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n", Content_Type="application/http"),
    foreign("resource", b"WARC/1.0\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n", Content_Type="text/plain"),
    foreign("resource", b"", WARC_Folded="a\r\n\tb"),
    foreign("response", b"HTTP/1.1 500 no blank line", Content_Type="application/http"),
]
PAYLOADS = [b"software: x\r\n", b"<p>one</p>", b"", b"abcde", b"WARC/1.0\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n", b"",
            b"HTTP/1.1 500 no blank line"]


class Counted(io.BytesIO):
    """A file that counts what is read of it."""

    got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


def rows_of(blob, zipped, wanted=lambda r: True, columns=ALL):
    return list(warc.read_records(warc._Bytes(io.BytesIO(blob), 0), len(blob), zipped, wanted, columns))


@pytest.mark.parametrize("blob, zipped", [(b"".join(FOREIGN), False), (b"\r\n".join(FOREIGN), False),
                                          (b"".join(map(gzip.compress, FOREIGN)), True), (gzip.compress(b"".join(FOREIGN)), True)],
                         ids=["plain", "more line ends", "a member a record", "one member"])
def test_foreign_files(blob, zipped):
    rows = rows_of(blob, zipped)
    assert [r["payload"] for r in rows] == PAYLOADS
    assert [r["payload_length"] for r in rows] == [len(p) for p in PAYLOADS]
    assert rows[1]["target_uri"] == "http://a" and rows[5]["headers"]["warc-folded"] == "a b"
    for kind in ("response", "resource", "none"):
        for columns in (ALL, {"record_id"}, {"payload_length"}):
            some = rows_of(blob, zipped, lambda r: r["record_type"] == kind, columns)
            assert [r["headers"] for r in some] == [r["headers"] for r in rows if r["record_type"] == kind]


@pytest.mark.parametrize("blob, zipped", [(FOREIGN[1][:-20], False), (gzip.compress(FOREIGN[1])[:-12], True), (b"hello" * 500, False),
                                          (gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"), True)])
def test_broken_files_are_not_read_silently(blob, zipped):
    with pytest.raises(ValueError):
        rows_of(blob, zipped)


def test_members_tell_their_length():
    """Unwanted records are passed over without reading them; the members stay ordinary gzip."""
    records = [warc.record_bytes({"record_id": f"<urn:{i}>", "payload": os.urandom(300_000)}, "2020-01-01T00:00:00Z") for i in range(9)]
    members = [warc._member(r) for r in records]
    assert gzip.decompress(b"".join(members)) == b"".join(records)
    file = Counted(b"".join(members))
    got = [r["record_id"] for r in warc.read_records(warc._Bytes(file, 0), len(file.getvalue()), True, lambda r: r["record_id"] == "<urn:4>", ALL)]
    assert got == ["<urn:4>"] and file.got < 1_200_000 < len(file.getvalue())
    # Every place to cut gives the records that begin before it, each once.
    for cut in (len(members[0]), sum(map(len, members[:5]))):
        blob, both = b"".join(members), []
        for a, b in ((0, cut), (cut, len(blob))):
            both += [r["record_id"] for r in warc.read_records(warc._Bytes(io.BytesIO(blob), a), b, True, lambda r: True, {"record_id"})]
        assert both == [f"<urn:{i}>" for i in range(9)]


def test_round_trip_and_filters(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/some archive"
    rows = [(f"<urn:{i}>", "revisit" if i % 5 == 4 else "response", f"http://h/{i}\r\nx: y" if i else None, bytearray(os.urandom(i * 40)) if i % 5 < 4 else None,
             f"<urn:{i - 1}>", 77) for i in range(60)]
    frame = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, payload binary, refers_to string, payload_length long")
    warc.write_archive(frame.repartition(3), path)
    back = {r.record_id: r for r in warc.read_archive(spark, path).collect()}
    assert len(back) == 60
    for id_, kind, url, payload, refers, _ in rows:
        r = back[id_]
        assert (r.record_type, r.target_uri) == (kind, url and url.replace("\r\n", "%0D%0A"))
        assert (r.payload, r.refers_to, r.payload_length) == ((payload, None, len(payload)) if kind == "response" else (None, refers, 77))
        assert r.intact is (True if kind == "response" else None)
        assert r.headers["warc-record-id"] == id_ and r.content_length == int(r.headers["content-length"])
    conditions = ["record_type = 'revisit'", "record_type <> 'revisit'", "target_uri IS NULL", "target_uri IS NOT NULL", "target_uri LIKE '%/1%'",
                  "record_id IN ('<urn:3>', '<urn:9>')", "NOT record_id IN ('<urn:3>')", "content_length > 900 AND record_type = 'response'",
                  "target_uri <=> NULL", "refers_to <> '<urn:3>'", "octet_length(payload) > 900", "record_type = 'response' OR content_length < 9",
                  "startswith(target_uri, 'http://h/2')", "NOT (target_uri = 'http://h/2%0D%0Ax: y')", "content_length <= 500", "payload IS NULL"]
    whole = spark.createDataFrame(list(back.values()), warc.SCHEMA)
    for condition in conditions:
        want = Counter(r.record_id for r in whole.filter(condition).collect())
        assert Counter(r.record_id for r in warc.read_archive(spark, path).filter(condition).collect()) == want, condition
    brief = warc.read_archive(spark, path, "record_id", "record_type")
    assert brief.columns == ["record_id", "record_type"] and brief.filter("record_type = 'revisit'").count() == 12
    # A second write adds to the archive, overwriting replaces it; files no manifest names are not read.
    (tmp_path / "some archive" / "part-lost.warc.gz").write_bytes(b"left behind")
    warc.write_archive(frame.limit(5), path)
    assert warc.read_archive(spark, path).count() == 65
    warc.write_archive(frame.limit(0), path, "overwrite")
    assert warc.read_archive(spark, path).count() == 0
    with pytest.raises(Exception, match="no archive"):
        warc.read_archive(spark, f"{path}/none").count()


def test_foreign_folders(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(FOREIGN))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, FOREIGN)))
    (tmp_path / "note.txt").write_text("not an archive")
    got = warc.read_archive(spark, str(tmp_path), "record_type", "payload")
    assert got.rdd.getNumPartitions() == 2
    assert Counter(bytes(r.payload) for r in got.collect()) == Counter(PAYLOADS * 2)
    assert warc.read_archive(spark, str(tmp_path / "a.warc")).filter("record_type = 'request'").count() == 1


def test_large_files_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CUT_BYTES", 20_000)
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    frame = spark.range(300).coalesce(1).select(F.concat(F.lit("<urn:"), "id", F.lit(">")).alias("record_id"),
                                                F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.md5((F.col("id") * 100 + i).cast("string")))).cast("binary").alias("payload"))
    warc.write_archive(frame, str(tmp_path / "w"))
    parts = warc._plan(str(tmp_path / "w"))
    assert len(parts) > 15 and len({p[0] for p in parts}) > 3
    got = warc.read_archive(spark, str(tmp_path / "w"), "record_id", "intact")
    assert Counter(r.record_id for r in got.collect()) == Counter(f"<urn:{i}>" for i in range(300))
    assert got.filter("intact").count() == 300


def brute(rows, least):
    payloads = [(i, (t or "").encode()) for i, t in rows]
    best = {}
    for i, p in payloads:
        if p not in best or best[p] is None or (i is not None and i > best[p]):
            best[p] = i
    out = []
    for i, p in payloads:
        again = len(p) >= least and i != best[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", best[p] if again else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 3])
def test_equal_payloads_are_stored_once(spark, tmp_path, least):
    rows = [(i, f"<p>{i % 7}</p>é") for i in range(40)] + [(i, None if i % 2 else "") for i in range(40, 46)] + [(i, "ab") for i in range(46, 49)]
    rows += [(50, "x" * 3_000_000), (51, "x" * 3_000_000), (52, "\x00\r\n\r\nWARC/1.1"), (53, "only"), (53, "only"), (54, "twice"), (54, "twice"), (55, "twice"),
             (None, "alone"), (None, "<p>1</p>é"), (-4, "minus"), (None, "two"), (None, "two"), (53, "other")]
    frame = spark.createDataFrame([(i, t, None if (i or 0) % 3 else "http://ü", 1, "k", 2) for i, t in rows],
                                  "page_id long, html string, url string, length int, key string, digest int")
    path = str(tmp_path / "a")
    warc.archive_texts(frame.repartition(4), path, least)
    got = warc.page_records(spark, path).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows, least)
    assert all(r.intact is (True if r.record_type == "response" else None) for r in got)
    files = sum(f.stat().st_size for f in (tmp_path / "a").iterdir())
    assert files < 100_000  # three million bytes are stored compressed, and once


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive_texts(empty, str(tmp_path / "e"))
    assert warc.page_records(spark, str(tmp_path / "e")).count() == 0


def test_ids_of_any_kind(spark, tmp_path):
    names = ["a b/ü%>", "é", "x"]
    warc.archive_texts(spark.createDataFrame([(n, None, "t") for n in names], "page_id string, url string, html string"), str(tmp_path / "s"))
    got = {r.page_id: r.refers_to for r in warc.page_records(spark, str(tmp_path / "s"), "string").collect()}
    assert got == {"a b/ü%>": "é", "x": "é", "é": None}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_matches_sql(spark):
    assert difference(spark, connect(SF), SF, queries.QUERIES["op11_warc"], queries.ORACLES["op11_warc"]) == ""
