"""ZIP-packaged archives: round trip, the reader against zipfile, ZIP64, edge rows."""

import base64
import hashlib
import io
import random
import zipfile

import pytest

from carrisk.llm import warc, zip_reader
from carrisk.llm.queries import QUERIES
from tests.conftest import SF001


def plain(pages):
    """{page_id: (bytes, digest, type, refers_to)}."""
    first = {}
    for i, _, html in pages:
        p = (html or "").encode()
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = {}
    for i, _, html in pages:
        p = (html or "").encode()
        f = first.get(p)
        same = f is None or f == i
        out[i, p] = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if same else "revisit", None if same else f)
    return out


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url", "html").collect()]
    want = {i: v for (i, _), v in plain(pages).items()}
    rows = QUERIES["op6_zip_warc"](spark, SF001).collect()
    assert len(rows) == len(pages)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want


def test_edges(spark, tmp_path):
    pages = [(4, "http://a/ b%\n", "x"), (2, None, "x"), (9, "u", None), (7, "u", ""), (5, "u", "é😀" * 20_000), (6, "u", "é😀" * 20_000),
             (None, "n", "x"), (None, "n", "only here"), (2, None, "x"), (11, "c", "a\r\n\r\nb")]
    frame = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(frame.repartition(2), folder=str(tmp_path / "w"), max_bytes=300)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(pages) and manifest.count() > 2
    rows = warc.read_archives(manifest).collect()
    assert len(rows) == len(pages)
    want = plain(pages)
    for r in rows:
        i = None if r.id is None else int(r.id)
        payload = next(h or "" for p, _, h in pages if p == i and hashlib.sha1((h or "").encode()).digest() == base64.b32decode(r.payload_digest)).encode()
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) == want[i, payload]
        assert (bytes(r.payload) == payload) if r.record_type == "response" else r.payload is None
        assert r.target_uri == next(u for p, u, _ in pages if p == i)
    none = warc.write_archives(frame.limit(0), folder=str(tmp_path / "none"))
    assert none.count() == 0 and warc.read_archives(none).count() == 0
    longer = {int(r.id): r.record_type for r in warc.read_archives(warc.write_archives(frame.where("page_id in (4, 2, 5, 6)"), min_revisit_bytes=2)).collect()}
    assert longer == {4: "response", 2: "response", 5: "response", 6: "revisit"}


@pytest.mark.parametrize("force", [False, True])
def test_directory_equals_zipfile(force):
    rng = random.Random(1)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.comment = b"a comment"
        for k in range(40):
            info = zipfile.ZipInfo(f"földer/{k}.bin")
            info.compress_type = zipfile.ZIP_STORED if k % 3 else zipfile.ZIP_DEFLATED
            with z.open(info, "w", force_zip64=force) as out:
                out.write(rng.randbytes(rng.randint(0, 500)))
    data = buffer.getvalue()
    found = zip_reader.members(io.BytesIO(data), len(data))
    with zipfile.ZipFile(buffer) as z:
        assert [(m.name, m.method, m.crc, m.size, m.header) for m in found] == [(i.filename, i.compress_type, i.CRC, i.file_size, i.header_offset) for i in z.infolist()]
        for m in found:
            if m.method:
                with pytest.raises(ValueError):
                    zip_reader.stored_range(io.BytesIO(data), m)
            else:
                assert zip_reader.read_range(io.BytesIO(data), *zip_reader.stored_range(io.BytesIO(data), m)) == z.read(m.name)


def test_zip64_end_record(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 200)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for k in range(8):
            z.writestr(f"m{k}", bytes([k]) * 150)
    data = buffer.getvalue()
    assert zip_reader.END64 in data
    found = zip_reader.members(io.BytesIO(data), len(data))
    assert [zip_reader.read_range(io.BytesIO(data), *zip_reader.stored_range(io.BytesIO(data), m)) for m in found] == [bytes([k]) * 150 for k in range(8)]
    with pytest.raises(ValueError):
        zip_reader.members(io.BytesIO(b"no zip here"), 11)


def test_damaged_payload():
    record = warc.record_bytes("1", "u", b"abc", base64.b32encode(hashlib.sha1(b"abd").digest()).decode(), None)
    with pytest.raises(ValueError):
        warc.parse_record(record)
