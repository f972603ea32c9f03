"""Deterministic sharded WARC writer and reader.

Records are sorted by page id into shards with boundaries taken from the ids alone, written
as one gzip member each and rolled into a new file once ``roll_bytes`` compressed bytes are
reached. Headers and digests are made anew from the rows, dates are a parameter and gzip
headers hold no time, so equal rows give equal files. Files get their final names after all
are complete; a manifest lists them.

Of equal payloads of at least ``revisit_bytes`` the one with the largest id is a response and
the others are revisits that refer to it. A null html is an empty payload, a null url has no
target address. Null ids come first; they refer but are never referred to. Repeated rows with
equal ids are equal records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import pieces_of, saved, shard_of
from shelfrank.llm.store import NewFile, commit, manifest_batch, one_task_each, opened, read_manifest

REVISIT_BYTES = 1000
SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
RECORDS = (
    "page_id bigint, record_type string, url string, payload_digest string, "
    "payload_bytes bigint, refers_to bigint, payload binary"
)


def digest_value(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    data = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    return pack.compress(data) + pack.flush()


def page_record(row: dict, date: str, level: int) -> bytes:
    payload = row["payload"] or b""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    revisit = row["refers_to"] is not None
    block = http if revisit else http + payload
    sha1 = bytes.fromhex(row["payload_digest"])
    if not revisit and hashlib.sha1(payload).digest() != sha1:
        raise ValueError(f"digest of page {row['page_id']} does not fit its payload")
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID}{'' if row['page_id'] is None else row['page_id']}>"),
        ("WARC-Date", date),
    ]
    if row["url"] is not None:
        # Control characters and blanks would end the header line.
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
        headers.append(("WARC-Target-URI", safe))
    headers += [
        ("WARC-Payload-Digest", digest_value(sha1)),
        ("WARC-Block-Digest", digest_value(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID}{row['refers_to']}>")]
    return member(headers, block, level)


def prepared(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows to write: digest, size and what a row refers to; payloads of revisits are left out."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    copies = (
        rows.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("kept").isNotNull())
        .drop("n")
    )
    copies = saved(copies, "copies")
    joined = rows.join(copies, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return joined.select(
        "page_id",
        "url",
        F.when(refers.isNull(), F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        refers.alias("refers_to"),
    )


def write_warc(
    pages: DataFrame,
    folder: str,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    date: str = DATE,
    level: int = 6,
) -> DataFrame:
    """Archives of all rows in ``folder``; returns the manifest."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint") + 400
    sizes = saved(pages.select("page_id", size.alias("size")), "page-sizes")
    bounds = pieces_of(sizes, "page_id", "size", shard_bytes)
    rows = prepared(pages).withColumn("shard", shard_of(bounds)("page_id"))
    dealt = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(
        "shard", "page_id", "payload_digest", "url"
    )

    def run(batches):
        done, file, shard, roll = [], None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if file and (row["shard"] != shard or file.bytes >= roll_bytes):
                    done.append(file.close())
                    file = None
                if row["shard"] != shard:
                    shard, roll = row["shard"], 0
                if file is None:
                    name = f"{shard:06d}-{roll:05d}.warc.gz"
                    file, roll = NewFile(folder, name), roll + 1
                    info = [
                        ("WARC-Type", "warcinfo"),
                        ("WARC-Record-ID", f"<urn:x-file:{name}>"),
                        ("WARC-Date", date),
                        ("WARC-Filename", name),
                        ("Content-Type", "application/warc-fields"),
                    ]
                    file.write(member(info, b"format: WARC File Format 1.1\r\n", level), 0)
                file.write(page_record(row, date, level))
        if file:
            done.append(file.close())
        yield manifest_batch(done)

    return commit(dealt.mapInArrow(run, "name string, temporary string, bytes bigint, records bigint, sha1 string"), folder)


def records(stream):
    """Headers (lower-case names) and block of each record of a gzipped archive."""
    with gzip.GzipFile(fileobj=stream) as data:
        while line := data.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a record: {line[:40]!r}")
            headers = {}
            while (line := data.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                headers[name.strip().lower()] = value.strip()
            block = data.read(int(headers["content-length"]))
            if data.read(4) != b"\r\n\r\n":
                raise ValueError("record does not end where its length says")
            yield headers, block


def parsed(headers: dict, block: bytes) -> tuple:
    """A page record as a row of ``RECORDS``, with its digests checked."""
    if headers["warc-block-digest"] != digest_value(hashlib.sha1(block).digest()):
        raise ValueError(f"block of {headers['warc-record-id']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\ncontent-length: *(\d+)", http, re.I)[1])
    digest = headers["warc-payload-digest"]
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or digest != digest_value(hashlib.sha1(payload).digest())):
        raise ValueError(f"payload of {headers['warc-record-id']} is damaged")

    def number(name):
        value = headers.get(name, "").strip("<>").removeprefix(ID)
        return int(value) if value else None

    return (
        number("warc-record-id"),
        headers["warc-type"],
        headers.get("warc-target-uri"),
        base64.b32decode(digest.removeprefix("sha1:")).hex(),
        length,
        number("warc-refers-to"),
        None if revisit else payload,
    )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Page records of all archives that the manifest of ``folder`` lists."""
    names = RECORDS.replace(",", "").split()[0::2]
    kinds = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.int64(), pa.binary()]

    def batch_of(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
        )

    def run(batches):
        store, root = opened(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        rows.append(parsed(headers, block))
                        size += len(block)
                        if size > BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return one_task_each(read_manifest(spark, folder)).mapInArrow(run, RECORDS)
