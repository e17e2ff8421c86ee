"""Range coder and id files: exact round trips, the library's own ids, damage, edge rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from carrisk.llm import id_files, range_coder
from carrisk.llm.queries import QUERIES
from carrisk.llm.shared_files import filesystem
from tests.conftest import SF001

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("shape", [(1, 1), (3, 50), (7, 300)])
@pytest.mark.parametrize("high", [1, 2, 60, 50_257, 200_000, range_coder.MAX_ID + 1])
def test_round_trip(shape, high):
    rng = np.random.default_rng(high)
    ids = np.minimum(rng.integers(0, high, shape), rng.integers(0, high, shape))
    lengths = np.sort(rng.integers(1, shape[1] + 1, shape[0]))[::-1].copy()
    lengths[0] = shape[1]
    blocks = range_coder.encode_blocks(ids, lengths)
    got = range_coder.decode_blocks(blocks, lengths)
    for i, n in enumerate(lengths):
        assert (got[i, :n] == ids[i, :n]).all()
        alone = np.array([n])
        assert (range_coder.decode_blocks([blocks[i]], alone)[0] == ids[i, :n]).all()  # blocks are independent


def test_long_carries_and_predictions():
    rng = np.random.default_rng(1)
    runs = np.repeat(rng.integers(0, 50_000, 40), 100)[None, :]
    cycle = np.tile(rng.integers(0, 50_000, 37), 110)[None, :4000]
    top = np.full((1, 4000), range_coder.MAX_ID)
    for ids in (runs, cycle, top):
        lengths = np.array([4000])
        data = range_coder.encode_blocks(ids, lengths)
        assert (range_coder.decode_blocks(data, lengths) == ids).all()
    assert len(range_coder.encode_blocks(cycle, lengths)[0]) < 4000 // 2  # predictions pay
    assert len(range_coder.encode_blocks(np.zeros((0, 0), np.int64), np.zeros(0, np.int64))) == 0
    with pytest.raises(ValueError):
        range_coder.encode_blocks(np.array([[range_coder.MAX_ID + 1]]), np.array([1]))


def test_mixing_pays_and_no_interval_is_empty():
    rng = np.random.default_rng(2)
    habits = rng.integers(0, 50_000, (300, 2))
    mixed = np.array([[habits[k][i] for k in rng.integers(0, 300, 256) for i in (0, 1)] for _ in range(20)])
    lengths = np.full(20, 512)
    order0 = sum(map(len, range_coder.encode_blocks(rng.permuted(mixed, axis=1), lengths)))  # the same ids without context
    data = range_coder.encode_blocks(mixed, lengths)
    assert sum(map(len, data)) < 0.95 * order0
    assert (range_coder.decode_blocks(data, lengths) == mixed).all()
    sure = np.tile(np.arange(8), 600)[None, :]  # every order is sure, then ids of classes never seen
    sure[0, 4000::97] = range_coder.MAX_ID
    sure[0, 4001::97] = 1 << 20
    lengths = np.array([sure.shape[1]])
    assert (range_coder.decode_blocks(range_coder.encode_blocks(sure, lengths), lengths) == sure).all()


def expected(docs):
    start, out = 0, []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_id_range_coder"](spark, SF001).collect())
    assert rows == [e[:4] for e in expected(docs)]


def test_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_files, "LANES", 3)
    monkeypatch.setattr(id_files, "BLOCK_IDS", 16)
    docs = [(5, "'s don't \n\n  x"), (-3, None), (9, ""), (None, "null id"), (7, "a" * 4000), (8, "Ünïcode 中文 😀 " * 300), (1, "<|endoftext|> x"), (10, "<|endoftext|><|endoftext|>"), (11, "a <|endoftext|>b<|endoftext|"), (2, " \t ")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, start int")
    manifest = id_files.write_id_files(frame, PATH, folder=str(tmp_path / "ids"), file_bytes=900)
    got = [(r.id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in id_files.read_id_files(manifest, with_ids=True).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(docs) and manifest.count() > 1
    twice = id_files.write_id_files(frame.union(frame), PATH)
    assert id_files.read_id_files(twice).count() == 2 * len(docs)
    none = id_files.write_id_files(frame.limit(0), PATH)
    assert none.count() == 0 and id_files.read_id_files(none).count() == 0


def test_damage(spark, tmp_path):
    frame = spark.createDataFrame([(1, "some words here to damage " * 50)], "doc_id long, text string")
    path = id_files.write_id_files(frame, PATH, folder=str(tmp_path / "ids")).first().path
    _, inner = filesystem(path)
    data = bytearray(open(inner, "rb").read())
    data[len(id_files.MAGIC) + 5] ^= 64
    with open(inner, "r+b") as file:
        file.write(data)
        file.flush()
        file.seek(0)
        blocks, _ = id_files.file_tables(file, len(data))
        with pytest.raises(ValueError):
            list(id_files.block_groups(file, blocks))
    with pytest.raises(ValueError), open(__file__, "rb") as file:
        id_files.file_tables(file, 500)
