"""WARC archives with an index first: every record's offset, length, URL and digest, then ranged reads.

Each task writes one archive after another to the shared folder (gzip member per record, so a record can be read by
its byte range) and returns the index rows. Only the index of the attempt that ended is kept, so an archive of a
lost attempt is never read. Reading sorts the selected index rows by place, joins neighbouring ranges into one read
and cuts the records out of it.

Of records with equal payloads of at least ``min_bytes`` the one with the largest page_id is a response, the others
are revisits that refer to it; smaller payloads are always responses. Null html is an empty payload, a null or
empty URL gives a record without target. Rows that repeat a page_id are separate records: a repeat of the row with
the largest page_id is a response too. A row without page_id is a response unless its group has one with page_id.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.runtime import hot_join, scratch_dir, stage

INDEX = "archive string, offset bigint, length bigint, url string, digest string, page_id bigint"
RECORD = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "payload binary"
)
DATE = "2000-01-01T00:00:00Z"


def _store(uri: str):
    """Filesystem and path of a folder given as URI (``file:``, ``hdfs:``, ``s3a:``, ...) or plain path."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]|", encoding="utf-8"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(member: bytes) -> dict:
    """Fields of one gzipped record; the payload digest is computed again where there is a payload."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    written = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != written):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return {
        "page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
        "payload_digest": written, "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers), "payload": payload if response else None,
    }


def revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages whose payload is kept by a page with a larger page_id."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sizes = pages.select("page_id", F.sha1(html).alias("digest"), F.sha2(html, 256).alias("strong"), F.octet_length(html).alias("size"))
    large = stage(sizes.filter(F.col("size") >= min_bytes).drop("size"), "payloads")
    groups = large.groupBy("digest", "strong").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups.filter("n > 1 and refers_to is not null").drop("n"), "groups")
    found = hot_join(large, groups, ["digest", "strong"]).filter("page_id < refers_to")
    return found.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, min_bytes: int = 1000, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); return the index.

    The page table is shuffled once, by (page_id, digest), which no common payload can make uneven.
    """
    spark = pages.sparkSession
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload"), F.sha1(html).alias("digest"))
    rows = rows.join(revisits(pages, min_bytes), ["page_id", "digest"], "left").select(
        "page_id", "url", "payload", "digest", "refers_to"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        sink, name, offset, index = None, "", 0, []

        def flush():
            columns = list(zip(*index)) or [()] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["archive", "offset", "length", "url", "digest", "page_id"]
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                packer = zlib.compressobj(6, wbits=31)
                member = packer.compress(_record(page_id, url, payload, digest, len(payload), refers_to)) + packer.flush()
                if sink is None or offset >= roll_bytes:
                    if sink is not None:
                        sink.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                sink.write(member)
                index.append((f"{folder}/{name}", offset, len(member), url, digest, page_id))
                offset += len(member)
            yield flush()
        if sink is not None:
            sink.close()

    return stage(rows.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """The records that ``index`` names. Ranges at most ``gap`` bytes apart are read together, up to ``most`` bytes.

    ``index`` may be any selection of index rows. Memory: one read and its records at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        opened: dict = {}

        def cut(archive, ranges):
            if archive not in opened:
                for _, source in opened.values():
                    source.close()
                opened.clear()
                fs, path = _store(archive)
                opened[archive] = (fs, fs.open_input_file(path))
            source = opened[archive][1]
            start = ranges[0][0]
            data = source.read_at(max(o + n for o, n, _ in ranges) - start, start)
            records = []
            for offset, length, digest in ranges:
                record = parse_record(data[offset - start: offset - start + length])
                if record["payload_digest"] != digest:
                    raise ValueError(f"index and record differ at {archive}:{offset}")
                records.append(record)
            return pa.RecordBatch.from_pylist(records, schema)

        last, ranges = None, []
        for batch in batches:
            for archive, offset, length, digest in zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length", "digest"))):
                if ranges and (archive != last or offset > ranges[-1][0] + ranges[-1][1] + gap or offset + length > ranges[0][0] + most):
                    yield cut(last, ranges)
                    ranges = []
                last = archive
                ranges.append((offset, length, digest))
        if ranges:
            yield cut(last, ranges)

    placed = index.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return placed.mapInArrow(read, RECORD)
