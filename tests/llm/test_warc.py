import gzip
import hashlib
import io
import random

import pytest

from tessellate.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, file string, number int, head string, digest string, __size int"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, "h", "d", 0) for r in rows], SCHEMA)


def _rows():
    rnd = random.Random(2)
    big = ["<p>" + "".join(rnd.choice("abcdé \r\n") for _ in range(n)) for n in (1500, 998, 4000)]
    odd = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nHTTP/1.1 200 OK\n\nfiledesc://x 0.0.0.0 19960923142103 text/plain 3\n" * 20
    rows = [(1, "http://a.com/x", big[0]), (2, "http://a.com/x", big[0]), (3, None, big[0]), (4, "http://b.com/a b\nc", big[1]),
            (5, "http://b.com/", big[1]), (6, "", ""), (7, "x", None), (8, "http://é.com/漢", odd), (9, "u", odd), (10, "v", odd + "!"),
            (11, "w", "a" * 999), (12, "w", "a" * 999), (13, "w", "a" * 1000), (14, "w", "a" * 1000), (1 << 60, "z", "b" * 2000), ((1 << 60) + 1, "z", "b" * 2000)]
    return rows + [(100 + i, f"http://c.com/{i}", big[2]) for i in range(50)] + [(200 + i, "http://d.com/", f"{i} " * 400) for i in range(40)]


def _expected(rows):
    body = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i, b in body.items():
        if len(b) >= 1000:
            first[b] = max(first.get(b, i), i)
    return sorted((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if first.get(b, i) != i else "response",
                   first[b] if first.get(b, i) != i else None) for i, b in body.items())


def test_query_equals_brute_force(spark, tmp_path):
    rows = _rows()
    _pages(spark, rows).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in W.op13_legacy_archives(spark, str(tmp_path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == _expected(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions_keep_every_byte(spark, tmp_path, version):
    rows = _rows()
    W.pages_to_arc(_pages(spark, rows).repartition(2), str(tmp_path / "arc"), version, roll=2000)
    W.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), order=W.page_id(), roll=3000)
    files = [p for p in (tmp_path / "warc").iterdir() if p.name.startswith("part")]
    assert len(files) > 4
    for f in files:  # ordinary gzip files, each beginning with its description
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    out = W.read_warc(spark, str(tmp_path / "warc")).withColumn("page_id", W.page_id()).collect()
    assert all(r.intact for r in out) and len({r.record_id for r in out}) == len(out)
    body = {i: (h or "").encode() for i, _, h in rows}
    assert {r.page_id: bytes(r.payload) for r in out if r.type == "response"} == {
        i: body[i] for i, *_, t, _ in _expected(rows) if t == "response"}
    revisits = [r for r in out if r.type == "revisit"]
    assert revisits and all(r.size == 0 and r.head.startswith("HTTP/1.1 200 OK") and r.refers_to for r in revisits)
    assert sum(r.type == "warcinfo" for r in out) >= 2 * 2
    url = {r.page_id: r.url for r in out}
    assert url[4] == "http://b.com/a%20b%0Ac" and url[6] == "unknown:" and url[8] == "http://é.com/漢"


def test_old_files_as_they_are_found(spark, tmp_path):
    one = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhello world"
    v1 = (b"filedesc://IA-001.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\n"
          b"URL IP-address Archive-date Content-type Archive-length\n\n\n"
          b"http://a.com/with blank 1.2.3.4 199701010203 text/html %d\n%s\n"
          b"dns:a.com 1.2.3.4 19970101020304 text/dns 7\n1.2.3.4\n"
          b"a line that is no header\nhttp://a.com/cut 1.2.3.4 19970101020305123 text/html; charset=x 500\nshort" % (len(one), one))
    v2 = (b"filedesc://IA-002.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 IA-002.arc 122\n2 0 Alexa Internet\n"
          b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n\n"
          b"http://b.com/ 1.2.3.4 19980101020304 text/html 200 abc - 150 IA-002.arc %d\n%s\n" % (len(one), one))
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "one.arc").write_bytes(v1)
    (tmp_path / "arc" / "two.arc.gz").write_bytes(gzip.compress(v2[:200]) + gzip.compress(v2[200:]))
    (tmp_path / "arc" / "empty.arc").write_bytes(b"")
    got = {r.url: r for r in W.read_arc(spark, str(tmp_path / "arc")).collect()}
    assert len(got) == 6
    assert got["http://a.com/with blank"].payload == b"hello world" and got["http://b.com/"].payload == b"hello world"
    assert got["dns:a.com"].head == "" and got["http://a.com/cut"].truncated and got["http://a.com/cut"].payload == b"short"
    W.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), least=5)
    out = {(r.type, r.url): r for r in W.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert out["revisit", "http://a.com/with blank"].refers_to == out["response", "http://b.com/"].record_id
    assert out["resource", "dns:a.com"].payload == b"1.2.3.4" and out["resource", "http://a.com/cut"].date == "1997-01-01T02:03:05Z"
    assert out["response", "http://b.com/"].date == "1998-01-01T02:03:04Z" and out["revisit", "http://a.com/with blank"].date == "1997-01-01T02:03:00Z"


def test_odd_rows_and_empty_table(spark, tmp_path):
    _pages(spark, [(None, None, None), (None, "u", "x" * 1200), (5, "u", "x" * 1200), (5, "u", "x" * 1200)]).write.parquet(str(tmp_path / "a/pages.parquet"))
    got = W.op13_legacy_archives(spark, str(tmp_path / "a")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == [
        ("5", 1200, "response", None), ("5", 1200, "revisit", 5), ("None", 0, "response", None), ("None", 1200, "revisit", 5)]
    _pages(spark, []).write.parquet(str(tmp_path / "b/pages.parquet"))
    assert W.op13_legacy_archives(spark, str(tmp_path / "b")).count() == 0


def test_stream_of_plain_and_packed_archives():
    block = W.arc_version_block("n", 2) + W.arc_record("u", b"HTTP/1.1 200 OK\r\n\r\nx", 2) + W.arc_record("v", b"", 2)
    for content in (block, gzip.compress(block), gzip.compress(block[:50]) + gzip.compress(block[50:]) + gzip.compress(b"")):
        assert [r["url"] for r in W.arc_records(W._open(content))] == ["filedesc://n.arc", "u", "v"]
    assert list(W.warc_records(io.BufferedReader(io.BytesIO(b"junk\n")))) == []
