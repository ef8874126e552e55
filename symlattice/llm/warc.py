"""Legacy archives to WARC and back.

ARC files of version 1 and 2 are parsed by the header line of their version and
by declared lengths, never by searching for delimiters. Each record becomes a
WARC record with a name-based identifier, an ISO timestamp, a type (warcinfo
for the file's own record, response, or revisit for a payload that another
record holds) and digests. Archives are gzip files of plain records, written
and read by Spark; one file holds what one task wrote.

Null html counts as an empty payload, a null url becomes ``about:blank``, a
null id makes a record without one. Of records with equal payloads of at least
MIN_REVISIT bytes, those with the smallest id are responses and the others
revisit it; null ids count as largest, and without any id all are responses. An
empty table makes empty archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.session import checkpoint, shared_dir

MIN_REVISIT = 100
#: Rows of a digest, an id, a place, a url and a date that may be broadcast: some 30 MB.
BROADCAST_ROWS = 100_000
#: Field names of the two versions' header lines; fixed values of the format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_SAFE = "%:/?#[]@!$&'()*+,;=~-._"
_FLUSH = 1 << 22
_BLANK = re.compile(rb"\r?\n\r?\n")
_WHOLE = re.compile(r"-?[0-9]{1,19}")
#: Origin code of the archives written here; only theirs name page ids.
ORIGIN = "pages"


def _emit(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weight(r)
        if size >= _FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_LINE = pa.schema([("value", pa.binary())])


def _write(rows: DataFrame, path: str) -> None:
    """Records as they are, each followed by a line feed; Spark's text files take any bytes. Deflate at its fastest: pages of sf0.1 take 13 % more room and half the time."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


# ---- ARC


def arc_head(version: int, date: str) -> str:
    body = f"{version} 0 {ORIGIN}\n{' '.join(FIELDS[version])}\n"
    fixed = {"URL": "filedesc://pages.arc", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "pages.arc", "Archive-length": str(len(body))}
    return " ".join(fixed[f] for f in FIELDS[version]) + "\n" + body


def arc_record(version: int, page_id: int | None, url: str | None, html: str, date: str) -> str:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n"
    block = head + html
    values = {"URL": quote(url, safe=_SAFE) if url else "about:blank", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "pages.arc", "Archive-length": str(len(block.encode()))}
    return " ".join(values[f] for f in FIELDS[version]) + "\n" + block


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20200101000000") -> None:
    """An ARC file for each task's rows of (page_id, url, html)."""

    def run(batches):
        def rows():
            yield (arc_head(version, date).encode(),)
            for b in batches:
                for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield (arc_record(version, i, u, h or "", date).encode(),)

        yield from _emit(rows(), _LINE, lambda r: len(r[0]))

    _write(pages.mapInArrow(run, "value binary"), path)


def arc_records(data: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of each record. The first record names the version; its lengths are obeyed, whatever the blocks hold."""
    version = 1
    while True:
        line = data.readline()
        if not line:
            return
        if not line.strip():
            continue
        words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        first = words[0].startswith("filedesc:")
        names = FIELDS[next((v for v, f in FIELDS.items() if len(f) == len(words)), version)] if first else FIELDS[version]
        if len(words) < len(names) or not words[-1].isdigit():
            raise ValueError(f"not an ARC header of version {version}: {line[:200]!r}")
        # a stray space can only stand in the URL
        fields = dict(zip(names, [" ".join(words[: len(words) - len(names) + 1]), *words[len(words) - len(names) + 1 :]], strict=True))
        block = data.read(int(fields["Archive-length"]))
        if len(block) < int(fields["Archive-length"]):
            raise ValueError(f"ARC record ends early: {line[:200]!r}")
        if first:
            version = int(block.split(b" ", 1)[0] or 1)
        yield fields, block


def _http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers by lower-case name, their bytes with the blank line, and the payload. Lines may end in a bare line feed; without a blank line there is no payload."""
    end = _BLANK.search(block)
    head, payload = (block[: end.end()], block[end.end() :]) if end else (block, b"")
    lines = head.decode("utf-8", "replace").split("\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head, payload


def _number(text: str | None) -> int | None:
    """A whole number that a long holds, or nothing."""
    return int(text) if text and _WHOLE.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63 else None


_ARC = pa.schema([("kind", pa.string()), ("place", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("mime", pa.string()), ("digest", pa.binary()), ("n", pa.int64()), ("block", pa.binary())])
_ARC_DDL = "kind string, place string, page_id long, url string, date string, ip string, mime string, digest binary, n long, block binary"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the ARC files; digest and n are those of the payload, place is the file's name with the record's number.

    page_id is null in archives of another origin, whatever headers their servers sent.
    """

    def rows(batches):
        for b in batches:
            for content, file in zip(*b.columns, strict=True):
                raw, file, ours = content.as_buffer(), file.as_py().rsplit("/", 1)[-1], False
                for k, (f, block) in enumerate(arc_records(gzip.GzipFile(fileobj=pa.BufferReader(raw)) if bytes(raw[:2]) == b"\x1f\x8b" else io.BytesIO(raw))):
                    if f["URL"].startswith("filedesc:"):
                        ours = block.split(b"\n", 1)[0].split()[2:] == [ORIGIN.encode()]
                        yield "filedesc", f"{file}#{k}", None, f["URL"], f["Archive-date"], None, f["Content-type"], None, len(block), block
                    else:
                        headers, _, payload = _http(block) if block.startswith(b"HTTP/") else ({}, b"", block)
                        yield "page", f"{file}#{k}", _number(headers.get("x-page-id")) if ours else None, f["URL"], f["Archive-date"], f["IP-address"], f["Content-type"], hashlib.sha256(payload).digest(), len(payload), block

    return spark.read.format("binaryFile").load(path).select("content", "path").mapInArrow(lambda bs: _emit(rows(bs), _ARC, lambda r: len(r[-1]) + 200), _ARC_DDL)


# ---- WARC


def _iso(date: str) -> str:
    """Fourteen digits or fewer; what is missing is the least there is."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(place: str, url: str, date: str, digest: bytes | None) -> str:
    """Named by the record's place, so that equal records of a file, or of two, have ids of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place} {url} {date} {(digest or b"").hex()}')}>"


def warc_record(kind: str, place: str, page_id: int | None, url: str, date: str, ip: str | None, mime: str, digest: bytes | None, n: int, block: bytes, first: dict | None) -> bytes:
    """A WARC record without its last line feed. first: page_id, place, url and date of the record that holds the same payload, if this one revisits it."""
    fields = [("WARC-Record-ID", record_id(place, url, date, digest)), ("WARC-Date", _iso(date))]
    if kind == "filedesc":
        block = b"software: symlattice\r\nformat: WARC File Format 1.1\r\ndescription: " + block.split(b"\n", 1)[0].strip() + b"\r\n"
        fields = [("WARC-Type", "warcinfo"), *fields, ("WARC-Filename", url.removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")]
    else:
        http = block.startswith(b"HTTP/")
        fields = [("WARC-Type", "response" if http else "resource"), *fields, ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest.hex()}"), ("Content-Type", "application/http; msgtype=response" if http else mime)]
        if page_id is not None:
            fields.append(("WARC-Page-Id", str(page_id)))
        if ip and ip != "0.0.0.0":
            fields.append(("WARC-IP-Address", ip))
        if first is not None and http:
            block = _http(block)[1]
            fields[0] = ("WARC-Type", "revisit")
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first["place"], first["url"], first["date"], digest)), ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", _iso(first["date"])), ("WARC-Refers-To-Page", str(first["page_id"])), ("WARC-Payload-Length", str(n))]
    fields += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r"


def write_warc(records: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """A WARC file for each task's records of read_arc(). WARC-Page-Id, WARC-Refers-To-Page and WARC-Payload-Length, beside the standard fields, name the page, the page that it revisits and the full payload's size."""
    pages = records.filter(f"kind = 'page' and n >= {min_revisit} and page_id is not null")
    shared = pages.groupBy("digest").agg(F.min(F.struct("page_id", "place", "url", "date")).alias("first"), F.min("page_id").alias("least"), F.max("page_id").alias("most"), F.count("*").alias("times"))
    # records without an id revisit a page too, so digests of one page are needed where those exist
    nameless = records.filter(f"kind = 'page' and n >= {min_revisit} and page_id is null").select("digest").distinct().withColumn("nameless", F.lit(True))
    shared = checkpoint(shared.join(nameless, "digest", "left").filter("least < most or nameless").select("digest", "first"))
    if shared.count() <= BROADCAST_ROWS:  # else by a shuffle
        shared = F.broadcast(shared)
    known = records.join(shared, "digest", "left").withColumn("first", F.when((F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first")))

    def run(batches):
        rows = ((warc_record(*r),) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _emit(rows, _LINE, lambda r: len(r[0]))

    _write(known.select("kind", "place", "page_id", "url", "date", "ip", "mime", "digest", "n", "block", "first").mapInArrow(run, "value binary"), path)


def warc_records(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record, by declared lengths."""
    while True:
        line = data.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        fields = {}
        while (line := data.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        block = data.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("WARC record ends early")
        yield fields, block


_WARC = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record but warcinfo; sizes and digests are those of the full payload, which a revisit only names.

    A revisit of another's archive without WARC-Payload-Length has the length its
    HTTP head declares, or null; its digest is null if it isn't a SHA-256. Page ids are WARC-Page-Id only.
    """

    def rows(batches):
        for b in batches:
            for content in b.column(0):
                raw = content.as_buffer()
                for f, block in warc_records(gzip.GzipFile(fileobj=pa.BufferReader(raw)) if bytes(raw[:2]) == b"\x1f\x8b" else io.BytesIO(raw)):
                    kind = f["warc-type"]
                    if kind == "warcinfo":
                        continue
                    headers, _, payload = _http(block) if block.startswith(b"HTTP/") else ({}, b"", block)
                    algorithm, _, named = f.get("warc-payload-digest", "").partition(":")
                    named = named if algorithm == "sha256" else None
                    digest = named if kind == "revisit" else hashlib.sha256(payload).hexdigest()
                    if named and digest != named:
                        raise ValueError(f"payload of {f.get('warc-record-id')} doesn't have its digest")
                    size = _number(f.get("warc-payload-length") or headers.get("content-length")) if kind == "revisit" else len(payload)
                    yield kind, f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-date"), _number(f.get("warc-page-id")), size, digest, _number(f.get("warc-refers-to-page")), payload if payloads and kind != "revisit" else None

    ddl = "record_type string, record_id string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lambda bs: _emit(rows(bs), _WARC, lambda r: len(r[-1] or b"") + 300), ddl)


def convert(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages through an ARC archive and its conversion, read back from the WARC archive; both lie in the shared folder."""
    spark = pages.sparkSession
    at = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages.select(F.col("page_id").cast("long"), "url", "html"), f"{at}/arc", version)
    write_warc(read_arc(spark, f"{at}/arc"), f"{at}/warc")
    return read_warc(spark, f"{at}/warc", payloads=False)
