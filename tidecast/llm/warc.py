"""WARC archives: writer, and normaliser of monolithic gzip (operator 5).

``write_archives`` writes one archive per task, compressed as one gzip stream, as crawlers' plain ``gzip`` leaves it: no record can be
reached without inflating all before it. ``normalise`` inflates such a file once, as a stream, and rewrites every record as its own
gzip member, with a sidecar index of offsets beside it. ``read_records`` then fetches single records by offset.

Files go to a folder that executors share, through Arrow's file systems (local paths, hdfs, s3, gs). A task names its
file by itself and reports it in a row; only files in the stored report are ever read, so a repeated or lost task leaves at
most an orphan. A task holds one record and a window of the stream.

Duplicates: of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is the response, the others
are revisit records without a body that name it. Defined results: null html is an empty payload; rows that share the largest
page_id of their payload are all responses; a null page_id is smaller than any other, and where all are null all are responses; a null url
leaves its header out, line ends in a url are percent-encoded; an empty table writes no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tidecast.llm.common import query, scan, stored
from tidecast.session import shared_folder

CHUNK = 1 << 20
LEVEL = 4
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, records bigint, bytes bigint"
INDEX = ("file string, offset bigint, length bigint, record_type string, page_id bigint, url string, payload_digest string, "
         "payload_bytes bigint, refers_to bigint")


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; a path without scheme is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit without a body."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    safe = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    return header([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", safe), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload)),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(body))]) + body + b"\r\n\r\n"


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to). Copies are counted on digests alone, pre-aggregated; the join with them is a
    plain sort-merge join, whose hot keys Spark splits."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    top = (p.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
           .where("n > 1").select("digest", "top"))
    other = F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id")) & (F.length("payload") >= least)
    return p.join(top, "digest", "left").select("page_id", "url", "payload", F.when(other, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Monolithic archives in ``folder``; the stored report (file, records, bytes)."""
    def run(batches):
        fsys = root = sink = name = None
        records = 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    fsys, root = store(folder)
                    fsys.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, pack = fsys.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                sink.write(pack.compress(record(page_id, url, payload, sha1_base32(payload), refers_to)))
                records += 1
        if sink is not None:
            sink.write(pack.flush())
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], ["file", "records", "bytes"])

    return stored(decided(pages, least).mapInArrow(run, FILES), "warc-report")


def inflated(source):
    """The bytes of a gzip file, piece by piece; further members follow on."""
    unpack = zlib.decompressobj(wbits=31)
    while piece := source.read(CHUNK):
        while piece:
            yield unpack.decompress(piece)
            piece = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(wbits=31)
    if not unpack.eof and (rest := unpack.flush()):
        yield rest


def split_records(pieces):
    """(header fields, whole record) one by one from a stream of bytes."""
    buffer, at = bytearray(), 0
    pieces = iter(pieces)

    def fill(n: int) -> bool:
        nonlocal at
        if at > CHUNK:
            del buffer[:at]
            at = 0
        while len(buffer) - at < n:
            more = next(pieces, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while fill(1):
        end = buffer.find(b"\r\n\r\n", at)
        while end < 0:
            have = len(buffer) - at
            if not fill(have + 1):
                raise ValueError("cut off within a header")
            end = buffer.find(b"\r\n\r\n", at + max(0, have - 3))
        fields = dict(line.split(": ", 1) for line in buffer[at:end].decode().split("\r\n")[1:])
        size = end + 4 - at + int(fields["Content-Length"]) + 4
        if not fill(size):
            raise ValueError("cut off within a record")
        yield fields, bytes(buffer[at:at + size])
        at += size


def page_of(urn: str | None):
    return int(urn[len("<urn:page:"):-1]) if urn and urn != "<urn:page:>" else None


def rows_of(values: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, (_, k) in zip(zip(*values), kinds)],
                                      [n for n, _ in kinds])


def normalise(report: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each reported archive of ``source`` in ``target`` with one gzip member per record and a sidecar ``.index`` (JSON lines);
    the stored index."""
    def run(batches):
        (fsys, root), (to, out) = store(source), store(target)
        to.create_dir(out, recursive=True)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                offset, index = 0, []
                with fsys.open_input_stream(f"{root}/{file}", compression=None) as f, to.open_output_stream(f"{out}/{name}", compression=None) as sink, \
                        to.open_output_stream(f"{out}/{name}.index") as sidecar:
                    for fields, whole in split_records(inflated(f)):
                        pack = zlib.compressobj(LEVEL, wbits=31)
                        member = pack.compress(whole) + pack.flush()
                        sink.write(member)
                        row = (name, offset, len(member), fields["WARC-Type"], page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"),
                               fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), page_of(fields.get("WARC-Refers-To")))
                        sidecar.write(json.dumps(row).encode() + b"\n")
                        index.append(row)
                        offset += len(member)
                        if len(index) >= 10_000:
                            yield rows_of(index, INDEX)
                            index = []
                if index:
                    yield rows_of(index, INDEX)

    archives = report.select("file").repartition(max(1, min(10_000, report.count())), "file")
    return stored(archives.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of each index row, by its offset alone. What the record says of
    itself is checked against the payload."""
    out = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"

    def run(batches):
        fsys, root = store(folder)
        now = source = None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if file != now:
                    now, source = file, fsys.open_input_file(f"{root}/{file}")
                source.seek(offset)
                (fields, whole), = split_records(inflated(io.BytesIO(source.read(length))))
                body = whole[len(whole) - 4 - int(fields["Content-Length"]):-4]
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (digest != sha1_base32(body) or int(fields["X-Payload-Length"]) != len(body)):
                    raise ValueError(f"{file} at {offset}: the payload is not what its header says")
                rows.append((page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, int(fields["X-Payload-Length"]), digest,
                             page_of(fields.get("WARC-Refers-To")), body))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in out.split(", ")])

    return index.select("file", "offset", "length").mapInArrow(run, out)


#: Five hex digits' worth of 20 bits are four characters; 40 bits at a time fit a number.
BASE32_SQL = " || ".join(f"translate(to_base(CAST('0x' || substr(h, {1 + 10 * k}, 10) AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for k in range(4))


@query("op5_warc_normaliser", f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
    SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {BASE32_SQL} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> top THEN top END AS refers_to FROM p""")
def op5_warc_normaliser(spark, folder):
    """All pages, written as monolithic archives, normalised, and read back record by record."""
    place = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    report = write_archives(scan(spark, folder, "pages"), f"{place}/whole")
    index = normalise(report, f"{place}/whole", f"{place}/members")
    return read_records(index, f"{place}/members").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
