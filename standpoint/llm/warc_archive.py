"""WARC archives with a dictionary: records are compressed one by one with a Zstandard dictionary that stands in front.

An archive is a leading skippable frame (magic 0x184D2A5D) with a dictionary trained on records of that archive, then one
Zstandard frame per WARC/1.1 record, so any record can be read alone. Pages lie as the join with their roles leaves them; a
task closes an archive at ``ARCHIVE_BYTES`` and never holds more than one. The dictionary is trained on at most
``SAMPLE_BYTES`` of records, taken evenly over the archive; archives with too little for training use those records
themselves as a raw dictionary, so the layout is always the same. Archives have names of their own and are listed in a written manifest,
which a failed or repeated task cannot enter: files of such tasks are never read.

Equal payloads are stored once: of each group the record of the page with the largest id is the ``response``, the others are
``revisit`` records that refer to it; the groups are made of hashes, and pages move at most once, to meet their roles.

Defined cases: a null html is an empty payload; a null url leaves the target out; pages of a null id are ``response`` only if
all of their group are, else they are revisits; repeated rows of the largest id are all ``response``; empty tables make an empty
manifest; other columns are not read. Reading checks every payload against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standpoint.llm.common import id_key, partitions
from standpoint.llm.shared_files import read_file, write_file
from standpoint.session import cut_lineage, shared_dir

MAGIC = (0x184D2A5D).to_bytes(4, "little")
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, READ_BYTES = 32 << 20, 2 << 20, 64 << 10, 16 << 10
DATE = "2024-01-01T00:00:00Z"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, and with it the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields of a record, its payload (None for a revisit) and the payload's length; checks the digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != length or f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"fields": fields, "payload": payload if fields["WARC-Type"] == "response" else None, "length": length}


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> list[bytes]:
    d = dictionary(records)
    body = d.as_bytes()
    compressor = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=True)
    return [MAGIC, len(body).to_bytes(4, "little"), body, *map(compressor.compress, records)]


def records_of(data: bytes):
    """The records of an archive, one after the other."""
    if data[:4] != MAGIC:
        raise ValueError("no dictionary frame in front")
    at = 8 + int.from_bytes(data[4:8], "little")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:at]))
    view = memoryview(data)
    while at < len(data):
        one, parts = decompressor.decompressobj(), []
        while not one.eof:  # what is handed over past the end of a frame is copied, so it is handed over in slices
            if at >= len(data):
                raise ValueError("an archive ends inside a record")
            some = view[at:at + READ_BYTES]
            parts.append(one.decompress(some))
            at += len(some)
        at -= len(one.unused_data)
        yield b"".join(parts)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives into ``folder`` and returns the manifest (path, records, bytes), itself a written table."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = p.select("page_id", F.sha2("html", 256).alias("hash"))
    top = keyed.groupBy("hash").agg(F.max("page_id").alias("top"))
    roles = (keyed.distinct().join(top, "hash").where(~F.col("page_id").eqNullSafe(F.col("top")))
             .select(id_key(F.col("page_id")).alias("rk"), F.col("hash").alias("rh"), "top"))
    dealt = p.withColumn("k", id_key(F.col("page_id"))).withColumn("h", F.sha2("html", 256))
    dealt = (dealt.join(roles, (F.col("k") == F.col("rk")) & (F.col("h") == F.col("rh")), "left")
             .select("page_id", "url", "html", "top"))

    def run(batches):
        held, size = [], 0
        for b in batches:
            for page, url, html, refers_to in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(record(page, url, html.encode("utf-8", "surrogatepass"), refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    def close(records):
        parts = archive(records)
        path = write_file(folder, f"{uuid.uuid4().hex}.warc.zst", *parts)
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(records)], pa.int64()), pa.array([sum(map(len, parts))], pa.int64())], names=["path", "records", "bytes"])

    return cut_lineage(dealt.mapInArrow(run, "path string, records long, bytes long"))


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives in a manifest: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def page(urn: str | None) -> int | None:
        value = None if urn is None else urn.removeprefix("<urn:page:").removesuffix(">")
        return None if value in (None, "None") else int(value)

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for raw in records_of(read_file(path)):
                    r = parse(raw)
                    f = r["fields"]
                    rows.append((page(f["WARC-Record-ID"]), r["length"], f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], page(f.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i in (0, 1, 4) else pa.string()) for i in range(5)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("path").repartition(partitions(manifest), "path").mapInArrow(run, ROWS)


def round_trip(pages: DataFrame) -> DataFrame:
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder))
