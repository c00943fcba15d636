"""WARC archives: written one gzip member per record, read again record by record.

Files go through pyarrow's file systems, so the shared folder may be local, HDFS or an object
store. A reader holds one record and one block of compressed bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialise, scratch_path

#: Payloads from this size on are stored once.
LEAST_SHARED = 1000
BLOCK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]+")
#: A header's line that goes on in the next one.
FOLDED = re.compile(r"\r\n[ \t]+")
NAMES = {x.lower(): x for x in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Refers-To", "WARC-Profile", "Content-Type", "Content-Length")}


PAGE = re.compile(r"<urn:page:(-?\d+):")


class WarcError(ValueError):
    """A record that breaks the format or whose digest is wrong."""


def one_line(uri: str) -> str:
    """A URI as a header can hold it: blanks and control characters are percent-encoded."""
    return CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), uri)


def record(kind: str, uri: str, own_id: str, payload: bytes, digest: bytes, refers_to: str | None) -> bytes:
    """One record as one gzip member. A revisit has the HTTP head alone, whose Content-Length is the whole payload's."""
    uri = one_line(uri)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    b32 = lambda d: "sha1:" + base64.b32encode(d).decode()
    fields = {"WARC-Type": kind, "WARC-Record-ID": own_id, "WARC-Date": DATE, "WARC-Target-URI": uri, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": b32(digest), "WARC-Block-Digest": b32(hashlib.sha1(block).digest())}
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to}
    fields["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode() + block + b"\r\n\r\n") + squeeze.flush()


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, str]]:
    """(fields, block, digest of its payload in hex) of each record of an archive, in order.

    Compressed bytes are read a block at a time and inflated step by step; the content length
    frames each record, and its block and payload digests are verified.
    """
    ahead, number = b"", 0
    while ahead or (ahead := source.read(BLOCK)):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not ahead and not (ahead := source.read(BLOCK)):
                raise WarcError(f"record {number}: the archive ends inside it")
            try:
                parts.append(inflate.decompress(ahead))
            except zlib.error as e:
                raise WarcError(f"record {number}: {e}") from e
            ahead = inflate.unused_data if inflate.eof else b""
        whole = b"".join(parts)
        cut = whole.find(b"\r\n\r\n")
        lines = FOLDED.sub(" ", whole[: max(cut, 0)].decode("utf-8", "replace")).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"record {number}: no WARC version line")
        # Names of fields are the same in any case.
        fields = {NAMES.get(k.strip().lower(), k.strip()): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not fields.get("Content-Length", "").isdigit() or "WARC-Type" not in fields:
            raise WarcError(f"record {number}: no content length or type")
        size = int(fields["Content-Length"])
        block = whole[cut + 4 : cut + 4 + size]
        if len(block) != size or whole[cut + 4 + size :] != b"\r\n\r\n":
            raise WarcError(f"record {number}: its content length is {size}")
        if not matches(fields.get("WARC-Block-Digest"), block):
            raise WarcError(f"record {number}: block digest")
        # Of HTTP messages the payload is what stands behind the head; other blocks are payloads whole.
        payload = block[block.find(b"\r\n\r\n") + 4 :] if "application/http" in fields.get("Content-Type", "") and b"\r\n\r\n" in block else block
        if fields["WARC-Type"] != "revisit" and not matches(fields.get("WARC-Payload-Digest"), payload):
            raise WarcError(f"record {number}: payload digest")
        told = digest_of(fields.get("WARC-Payload-Digest"))
        yield fields, block, told[1].hex() if told and told[0] == "sha1" else None if fields["WARC-Type"] == "revisit" else hashlib.sha1(payload).hexdigest()
        number += 1


def digest_of(field: str | None) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a field like sha1:..., in base 16 or 32; None if there is none or it is of another form."""
    name, _, value = (field or "").partition(":")
    name = name.strip().lower().replace("-", "")
    size = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}.get(name)
    value = value.strip()
    if size and len(value) == 2 * size:
        return name, bytes.fromhex(value)
    if size and len(value.rstrip("=")) == -(-8 * size // 5):
        value = value.rstrip("=").upper()
        return name, base64.b32decode(value + "=" * (-len(value) % 8))
    return None


def matches(field: str | None, data: bytes) -> bool:
    """Whether data has the digest of a field; true where there is none that is known."""
    own = digest_of(field)
    return own is None or hashlib.new(own[0], data).digest() == own[1]


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_digest and refers_to: the largest page_id of equal
    payloads of at least LEAST_SHARED bytes where that is another, else null.

    Only ids and digests are grouped, combined before the shuffle; a hot payload's rows are
    joined to one row. Equal page_ids with equal payloads all refer to none. A null page_id is
    never referred to and refers to none.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("payload_digest"))
    shared = F.octet_length("html") >= LEAST_SHARED
    last = pages.where(shared & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    pages = lookup(pages, last, ["payload_digest"])
    return pages.select("page_id", "url", "html", "payload_digest", F.when(shared & (F.col("last") > F.col("page_id")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row to gzipped archives under folder, an archive for each task;
    (archive, records) of those written. An archive of a lost or repeated task is in no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name, n = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
        out = None
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or fs.open_output_stream(name, compression=None)
                kind = "response" if refers_to is None else "revisit"
                out.write(record(kind, url or "", f"<urn:page:{page_id}:{digest}>", html.encode(), bytes.fromhex(digest), f"<urn:page:{refers_to}:{digest}>"))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name.removeprefix(path + "/")], "records": [n]})

    return materialise(pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, "archive string, records long"), "warc-list")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives, of any type: page_id (of write_archives()' ids, else null), url, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for revisits). Archives are dealt out one by one."""

    def page(urn: str | None) -> int | None:
        own = PAGE.match(urn or "")
        return int(own[1]) if own else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for fields, block, digest in read_records(source):
                        http = "application/http" in fields.get("Content-Type", "")
                        head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
                        whole = fields["WARC-Type"] != "revisit"
                        told = next((int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
                        length = len(payload) if whole else told
                        rows.append((page(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), length, digest, fields["WARC-Type"], page(fields.get("WARC-Refers-To")), payload if whole else None))
                        size += len(block)
                        if size > 1 << 22 or len(rows) >= 4096:
                            yield batch()
                            rows, size = [], 0
        if rows:
            yield batch()

    own = archives.select("archive").repartition(max(1, archives.count()))
    return own.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as archives in the shared folder, read back."""
    folder = scratch_path(spark, "warc")
    archives = write_archives(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE strlen(body) >= 1000 GROUP BY 1)
SELECT p.page_id, strlen(body) AS payload_bytes, payload_digest,
       CASE WHEN last > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last > p.page_id THEN last END AS refers_to
FROM p LEFT JOIN last USING (payload_digest)
"""
