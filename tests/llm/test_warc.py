import gzip
import hashlib
from pathlib import Path

import pytest

from epistride.llm import queries, warc
from tests.oracle import compare, connect

PAGES = "page_id long, url string, html string, id string, payload string, first string, refers_to string, payload_digest string"


def test_query(spark, folder):
    name = "op2_warc_transactions"
    assert compare(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLES[name]) is None


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], PAGES)


def test_round_trip_of_odd_payloads(spark, tmp_path):
    mark = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
    long = "é" * 60
    html = {1: None, 2: "", 3: mark * 3, 4: long, 5: long, 6: "x" * 99, 7: "x" * 99, 8: "\r\n\r\n", 9: "y" * 3_000_000, 10: "a\u0000b\n\r", 11: long}
    path = str(tmp_path / "warc")
    warc.write_archive(pages(spark, [(i, None if i == 2 else f"http://h/{i}\r\nx", t) for i, t in html.items()]), path)
    records = warc.read_archive(spark, path)
    assert records.count() == 3 * len(html)
    got = {r.page_id: r for r in warc.captures(records).collect()}
    for i, t in html.items():
        data = (t or "").encode()
        again = i in (5, 11)
        assert (got[i].response.record_type, got[i].refers_to_page_id) == (("revisit", 4) if again else ("response", None))
        assert bytes(got[i].response.payload) == (b"" if again else data)
        assert got[i].declared_bytes == len(data) and got[i].declared_digest == "sha256:" + hashlib.sha256(data).hexdigest()
        assert got[i].request.record_id and len(got[i].metadata) == 1
    assert got[5].response.refers_to == got[4].capture_id
    assert got[3].request.target == "http://h/3  x" and got[2].request.target == ""


def test_archives_are_plain_warc(spark, tmp_path):
    path = tmp_path / "warc"
    warc.write_archive(pages(spark, [(1, "http://h/1", "<p>")]), str(path))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path).glob("*.gz"))
    at, kinds = 0, []
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        kinds.append(fields[b"WARC-Type"])
        at += len(head) + 4 + int(fields[b"Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
    assert sorted(kinds) == [b"metadata", b"request", b"response"]


def record(kind, name, concurrent, body=b"", extra=b""):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + name]
    if concurrent:
        lines.append(b"WARC-Concurrent-To: " + concurrent)
    return b"\r\n".join([*lines, *extra.split(b"\n")] if extra else lines) + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    first = [
        record(b"warcinfo", b"<i>", None, b"software: x"),
        record(b"response", b"<a>", None, b"HTTP/1.1 404 Gone\r\nX: \xff\r\n\r\n\xff\xfe", b"Content-Type: application/http;\n msgtype=response"),
        record(b"metadata", b"<m2>", b"<a>", b"k: 2"),
        record(b"metadata", b"<m1>", b"<a>", b"k: 1"),
        record(b"request", b"<q2>", b"<a>"),
        record(b"request", b"<q1>", b"<a>"),
        record(b"request", b"<q3>", b"<nowhere>"),
    ]
    # Members of their own, as crawlers write them; the second file ends inside a record.
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in first))
    cut = record(b"response", b"<c>", None, b"0123456789")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(b"response", b"<b>", None, b"whole") + cut[:-8]))
    got = {r.capture_id: r for r in warc.captures(warc.read_archive(spark, str(tmp_path))).collect()}
    assert set(got) == {"<a>", "<b>"}
    a, b = got["<a>"], got["<b>"]
    assert a.response.status == "HTTP/1.1 404 Gone" and bytes(a.response.payload) == b"\xff\xfe" and a.page_id is None
    assert a.request.record_id == "<q1>" and [bytes(m.payload) for m in a.metadata] == [b"k: 1", b"k: 2"]
    assert bytes(b.response.payload) == b"whole" and b.request is None and b.metadata == []


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archive(pages(spark, [(1, "u", "x")]).limit(0), path)
    assert warc.captures(warc.read_archive(spark, path)).count() == 0


def test_pieces_that_hold_several_records():
    import pyarrow as pa

    records = [record(b"metadata", b"<%d>" % i, b"<a>", body) for i, body in enumerate([b"x", b"", b"a\r\n\r\nWARC/1.0 b", b"c\r\n", b"d"])]
    pieces = b"".join(records).split(warc._BETWEEN.encode())
    joined = [warc._BETWEEN.encode().join(pieces[a:b]) for a, b in ((0, 2), (2, 3), (3, 6), (6, 9))]
    for parts in (pieces, [p for p in joined if p]):
        batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(parts)), pa.array(parts, pa.binary())], names=["file", "piece"])
        out = pa.Table.from_batches(list(warc._records(iter([batch]))))
        assert out.column("payload").to_pylist() == [b"x", b"", b"a\r\n\r\nWARC/1.0 b", b"c\r\n", b"d"]


def test_repeated_rows_come_back_once_each(spark, tmp_path):
    page, other = "x" * 150, "y" * 150
    rows = [(1, "u", page), (2, "v", page), (2, "v", page), (2, "w", other), (3, "t", other), (None, "n", page), (None, "m", "short"), (4, None, None), (4, None, None)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "warc"))
    found = warc.captures(warc.read_archive(spark, str(tmp_path / "warc"))).collect()
    got = sorted(((r.page_id, r.response.record_type, r.refers_to_page_id, r.response.target) for r in found), key=str)
    assert got == sorted(
        [(1, "response", None, "u"), (2, "revisit", 1, "v"), (2, "revisit", 1, "v"), (2, "response", None, "w"), (3, "revisit", 2, "t"),
         (None, "response", None, "n"), (None, "response", None, "m"), (4, "response", None, ""), (4, "response", None, "")], key=str,
    )
    assert len({r.response.record_id for r in found}) == len(rows)
    assert all(r.request is not None and len(r.metadata) == 1 for r in found)
