import base64
import hashlib

from ticketloom.llm import warc

PAGES = [(1, "http://a.example/x?q=1", "<html>one</html>"), (2, "http://b.example/", "<html>one</html>"), (3, None, None),
         (4, "http://c.example", ""), (5, "http://d.example/\r\nX: y", "a\r\n\r\nWARC/1.1\r\n\r\nb é"), (6, "ftp:odd", "x" * 200_000),
         (7, "http://e.example/é", "<html>one</html>"), (-8, "http://neg.example/", "minus")]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    got = {r.page_id: r for r in warc.archive_digest(frame(spark)).collect()}
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", i), i)
    for i, _, h in PAGES:
        data, r = (h or "").encode(), got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        chief = last[h or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if chief == i else ("revisit", chief)) and r.has_request


def test_nested_rows_and_files(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(frame(spark), path, file_bytes=1000)
    rows = {r.page_id: r for r in warc.captures(warc.read_records(spark, path)).collect()}
    assert rows[5].response.payload == PAGES[4][2] and rows[5].request.uri == "http://d.example/%0D%0AX: y"
    assert rows[1].response.payload is None and rows[1].response.refers_to == rows[7].response.record_id
    assert rows[3].response.uri is None and rows[6].response.payload_bytes == 200_000
    import gzip
    import glob

    data = b"".join(gzip.open(f).read() for f in glob.glob(path + "/*.gz"))
    assert data.count(b"WARC-Type: request") == len(PAGES)


def test_edges(spark):
    assert warc.archive_digest(frame(spark, [])).count() == 0
    rows = warc.archive_digest(frame(spark, [PAGES[0], PAGES[0], (None, "http://n.example", "z")])).collect()
    assert sorted((r.page_id is None, r.record_type) for r in rows) == [(False, "response"), (False, "response"), (True, "response")]
