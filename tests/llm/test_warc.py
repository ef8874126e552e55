import gzip
import hashlib
import io

import pytest

from symlattice.llm import warc


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = len(b) >= 100 and f is not None and i != f
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


ROWS = [(5, "http://a b/\n?q=é", "x" * 99), (6, None, "x" * 99), (7, "http://c", "é" * 50), (8, "http://c", "é" * 50), (8, "http://c", "é" * 50), (9, "http://c", None), (10, "u", ""), (None, "u", "é" * 50), (None, "n", "y" * 200), (11, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nhttp://x 0.0.0.0 2020 text/html 5\n" * 20), (12, "u", "\r\n\r\n" * 100 + "\x00\x1f "), (13, "u", "long " * 400_000), (14, "v", "long " * 400_000)]


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    df = spark.createDataFrame([(*r, "c") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.convert(df, version).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS)
    assert warc.convert(df.limit(0), version).count() == 0


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_arc(df, f"{tmp_path}/arc", 2)
    arc = warc.read_arc(spark, f"{tmp_path}/arc")
    warc.write_warc(arc, f"{tmp_path}/warc", min_revisit=1 << 40)
    got = warc.read_warc(spark, f"{tmp_path}/warc").collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got if r["page_id"] is not None) == sorted((i, h or "") for i, _, h in ROWS if i is not None)
    assert {r["date"] for r in got} == {"2020-01-01T00:00:00Z"} and {r["record_type"] for r in got} == {"response"}
    ids = [r["record_id"] for r in got]
    assert all(x.startswith("<urn:uuid:") for x in ids) and len(set(ids)) == len(ids)


def test_binary_payloads(spark, tmp_path):
    """Bytes that are no UTF-8, among them line feeds, from an archive of two images and a revisit."""
    image = bytes(range(256)) * 3
    head = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\nContent-Length: 768\r\nX-Page-Id: %d\r\n\r\n"
    arc = b"filedesc://x 0.0.0.0 20200101 text/plain 10\n1 0 pages\n"
    for i, payload in ((1, image), (2, image[::-1]), (3, image)):
        block = head % i + payload
        arc += b"\nhttp://a/%d 1.2.3.4 19990102030405 image/png %d\n" % (i, len(block)) + block
    (tmp_path / "x.arc").write_bytes(arc + b"\n")
    warc.write_warc(warc.read_arc(spark, f"{tmp_path}/x.arc"), f"{tmp_path}/warc")
    got = {r["page_id"]: r for r in warc.read_warc(spark, f"{tmp_path}/warc").collect()}
    assert bytes(got[1]["payload"]) == image and bytes(got[2]["payload"]) == image[::-1]
    assert got[3]["record_type"] == "revisit" and got[3]["refers_to"] == 1 and got[3]["payload_bytes"] == 768
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz"))
    assert raw.count(b"WARC-IP-Address: 1.2.3.4\r\n") == 3 and b"WARC-Refers-To: " + got[1]["record_id"].encode() in raw
    assert b"WARC-Refers-To-Target-URI: http://a/1\r\nWARC-Refers-To-Date: 1999-01-02T03:04:05Z" in raw


def test_versions_and_damage():
    one = "filedesc://x 0.0.0.0 20200101 text/plain 77\n".encode() + b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n".ljust(77, b"\n") + b"\nhttp://a b 1.2.3.4 19990102030405 text/plain 5\nhello\n"
    got = list(warc.arc_records(io.BytesIO(one)))
    assert got[1] == ({"URL": "http://a b", "IP-address": "1.2.3.4", "Archive-date": "19990102030405", "Content-type": "text/plain", "Archive-length": "5"}, b"hello")
    with pytest.raises(ValueError, match="ends early"):
        list(warc.arc_records(io.BytesIO(one[:-4])))
    with pytest.raises(ValueError, match="not an ARC header"):
        list(warc.arc_records(io.BytesIO(one[:-40])))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.warc_records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(b"hello\n")))))
    assert warc._iso("1999") == "1999-01-01T00:00:00Z" and warc._iso("199911") == "1999-11-01T00:00:00Z" and warc._iso("19990102030405") == "1999-01-02T03:04:05Z"


def test_foreign_archives(spark, tmp_path):
    """Page ids of other servers aren't ours, sizes don't rest on HTTP heads, and heads may end in bare line feeds."""
    body = b"\x00\xff\n\n" * 50
    heads = [b"HTTP/1.1 200 OK\r\nX-Page-Id: home\r\nTransfer-Encoding: chunked\r\n\r\n", b"HTTP/1.0 200 OK\nX-Page-Id: 7\nServer: a\n\n", b"HTTP/1.0 200 OK\nContent-Length: many\r\n\n", b"HTTP/1.0 204 No Content\r\nServer: a"]
    arc = b"filedesc://x 0.0.0.0 20200101 text/plain 14\n1 0 Elsewhere\n"
    for i, h in enumerate(heads):
        block = h + body * (i < 3)
        arc += b"\nhttp://a/%d 1.2.3.4 19990102030405 text/html %d\n" % (i, len(block)) + block
    (tmp_path / "x.arc").write_bytes(arc)
    records = warc.read_arc(spark, f"{tmp_path}/x.arc")
    want = [(None, len(body), hashlib.sha256(body).hexdigest())] * 3 + [(None, 0, hashlib.sha256(b"").hexdigest())]
    pages = records.filter("kind = 'page'").orderBy("place").collect()
    assert [(r["page_id"], r["n"], bytes(r["digest"]).hex()) for r in pages] == want
    warc.write_warc(records, f"{tmp_path}/all")
    got = warc.read_warc(spark, f"{tmp_path}/all").orderBy("url").collect()
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got] == want and bytes(got[1]["payload"]) == body
    # the same with ids: chunked payloads are revisited with their size
    (tmp_path / "y.arc").write_bytes(b"filedesc://y 0.0.0.0 20200101 text/plain 10\n1 0 pages\n" + b"".join(b"\nhttp://a/%d 1.2.3.4 1999 text/html %d\n" % (i, len(h + body)) + h + body for i, h in enumerate(b"HTTP/1.1 200 OK\nX-Page-Id: %d\nTransfer-Encoding: chunked\n\n" % i for i in (1, 2))))
    warc.write_warc(warc.read_arc(spark, f"{tmp_path}/y.arc"), f"{tmp_path}/ours")
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(spark, f"{tmp_path}/ours").collect()}
    assert found == {1: ("response", None, len(body)), 2: ("revisit", 1, len(body))}


def test_revisits_of_others():
    """A revisit that says no size has none; numbers that aren't, or that no long holds, are nothing."""
    assert warc._number("12") == 12 and all(warc._number(x) is None for x in (None, "", "home", "1.5", "9" * 19, "9" * 30))
    assert warc._http(b"HTTP/1.1 200 OK\n\n")[1:] == (b"HTTP/1.1 200 OK\n\n", b"")
