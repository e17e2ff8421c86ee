"""Operator 6: web archives packaged in ZIP files, read by range without extraction.

``write_archives`` writes a WARC record per page, gzipped one by one, into the
stored member ``archive/data.warc.gz`` of ZIP files in the shared folder (one
or more per task, about ``MAX_ARCHIVE_BYTES`` each), with the stored index
``indexes/index.cdxj`` of record offsets, and returns the manifest.  Of pages
with equal payloads (SHA-1) of ``min_revisit_bytes`` or more, the one with the
smallest id is a response; the others are revisits without a body.  Digests
are grouped apart from the payloads, with a partial ``min``, so a payload that
a third of all pages share is one small row there; pages then meet only their
own decision, by id.

``read_archives`` parses the ZIP directories (``zip_reader``), turns the
indexes into one row per record, deals these out in runs of ``RUN_BYTES``
neighbouring bytes, and reads each record by its range.  Digests of read
payloads are compared with their headers.

A file's name is new in each task attempt and the manifest lists those of
committed attempts, so a lost executor leaves at most an unlisted file.

Defined cases: null html is an empty payload; a null id is no smallest id (such
a page is a response only if no page with its payload has an id); rows with
equal id and payload are all responses or all revisits; a null URL gives no
target header; an empty table gives an empty manifest; other columns are not
looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm.common import fresh_path, query, table, text_slices, written
from carrisk.llm.shared_files import filesystem, open_input, open_output
from carrisk.llm.zip_reader import members, read_range, stored_range

MAX_ARCHIVE_BYTES = 256 << 20
RUN_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:carrisk:page:"

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = ("id string, target_uri string, record_type string, payload_digest string, payload_bytes long, "
           "refers_to string, payload binary, path string, offset long")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(id, url, payload, digest, refers_to): ids as text; ``refers_to`` is null for responses."""
    page = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    light = page.where(F.length("payload") >= min_revisit_bytes).select("id", "digest")
    first = light.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = light.join(first.select("digest", "first"), "digest").where("not (id <=> first)").distinct()
    again = again.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "first")
    both = page.join(again, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    return both.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.col("first").cast("string").alias("refers_to"))


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzipped WARC record; ``digest`` is bare base 32."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub("[\x00-\x20\x7f%]", lambda m: f"%{ord(m.group()):02X}", url))
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse_record(packed: bytes) -> dict:
    """Headers and payload of one gzipped record; ValueError where a digest or length does not hold."""
    data = zlib.decompress(packed, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[:int(headers["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    said = int(re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http).group(1))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(body) != said or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError("payload does not match its headers")
    own = lambda name: headers[name].strip("<>").removeprefix(ID) or None if name in headers else None
    uri = headers.get("warc-target-uri")
    uri = uri if uri is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), uri)
    return {"id": own("warc-record-id"), "target_uri": uri, "record_type": kind, "payload_digest": digest, "payload_bytes": said,
            "refers_to": own("warc-refers-to"), "payload": body if kind == "response" else None}


class _Archive:
    """A ZIP file being written: the data member first, its index when it is closed."""

    def __init__(self, path: str):
        self.path, self.file = path, open_output(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, record: bytes, page_id: str | None, kind: str) -> None:
        self.data.write(record)
        self.index.append((self.size, len(record), page_id, kind))
        self.size += len(record)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as out:
            for k, (offset, length, page_id, kind) in enumerate(self.index):
                entry = json.dumps({"id": page_id, "offset": offset, "length": length, "mime": "warc/revisit" if kind == "revisit" else "text/html", "filename": DATA})
                out.write(f"{k:010d} 20240101000000 {entry}\n".encode())
        self.zip.close()
        self.file.close()
        return self.path, len(self.index), self.size


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit_bytes: int = 0, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """Write the pages' records; returns the manifest (path, n_records, n_bytes), itself a written table."""
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]):
        archive, done = None, []
        for part in text_slices(batches, "payload", 8 << 20):
            for page_id, url, payload, hex_digest, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                if archive is None:
                    archive = _Archive(f"{folder}/{uuid.uuid4().hex}.wacz")
                digest = base64.b32encode(bytes.fromhex(hex_digest)).decode()
                archive.add(record_bytes(page_id, url, payload, digest, refers_to), page_id, "response" if refers_to is None else "revisit")
                if archive.size >= max_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "n_records", "n_bytes"])

    return written(plan_records(pages, id_col, url_col, html_col, min_revisit_bytes).mapInArrow(run, MANIFEST), "warc-manifest")


def read_index(manifest: DataFrame) -> DataFrame:
    """(path, offset, length) of every record, offsets in the ZIP file, from the archives' directories and indexes."""
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, inner = filesystem(path)
                with open_input(path) as file:
                    found = {m.name: m for m in members(file, files.get_file_info(inner).size)}
                    base = stored_range(file, found[DATA])[0]
                    lines = read_range(file, *stored_range(file, found[INDEX])).splitlines()
                entries = [json.loads(line.split(b" ", 2)[2]) for line in lines]
                for k in range(0, len(entries), 50_000):
                    some = entries[k:k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([base + e["offset"] for e in some], pa.int64()),
                                                      pa.array([e["length"] for e in some], pa.int64())], names=["path", "offset", "length"])

    return manifest.select("path").mapInArrow(run, "path string, offset long, length long")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives whose ``path`` the manifest lists."""
    spark = manifest.sparkSession
    total = manifest.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (4 * RUN_BYTES) + 1)
    runs = read_index(manifest).repartition(tasks, "path", F.floor(F.col("offset") / RUN_BYTES)).sortWithinPartitions("path", "offset")
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}

    def run(batches):
        opened, file = None, None
        rows, held = [], 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != opened:
                    if file is not None:
                        file.close()
                    opened, file = path, open_input(path)
                record = parse_record(read_range(file, offset, length))
                rows.append(record | {"path": path, "offset": offset})
                held += len(record["payload"] or b"")
                if held > 4 << 20 or len(rows) >= 5000:
                    yield batch_of()
                    rows, held = [], 0
        if file is not None:
            file.close()
        if rows:
            yield batch_of()

    return runs.mapInArrow(run, RECORDS)


@query("op6_zip_warc")
def op6_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))
