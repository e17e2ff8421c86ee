"""Operator 10: token-id files by an adaptive context-mixing range coder.

``write_id_files`` encodes every whole text with the ``tokenizers`` library,
appends the end id to each document and writes the ids, in ascending document
order, to files in the shared folder (range partitions of the id, one file
each).  Ids are cut in blocks of ``BLOCK_IDS``; ``range_coder`` codes up to
``LANES`` blocks side by side, each independently reset and with a CRC-32 of
its ids.  Pieces are split by ``pretok`` and encoded by the library once per
worker cache; the library splits a piece no further, so the ids are those of
the whole text (tested).  Names of the vocabulary's added tokens are cut out of
a text first and become their own ids, as the library does by default.

File: ``MAGIC``, the blocks' bytes, an Arrow stream of blocks (offset, n_bytes,
n_ids, crc), an Arrow stream of documents (id, first, n_tokens), and a tail
with the places of both and ``MAGIC`` again.

``read_id_files`` decodes files from their own tables, checks every block and
gives each document its ids' CRC-32 and its start in the whole order, from the
manifest's running sum (one row a file).  Tasks hold one group of blocks at a
time, in both directions.  Files of failed attempts are never listed.

Defined cases: null and empty texts have only the end id; a null id comes
first; rows with equal ids follow each other in any order; an empty table
writes and gives nothing; extra columns are not looked at.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carrisk.llm.bpe import CACHE_PIECES, CACHED_BYTES
from carrisk.llm.common import fresh_path, query, table, text_slices, written
from carrisk.llm.shared_files import filesystem, open_input, open_output

MAGIC = b"CARIDS1\n"
TAIL = "<5Q8s"  # blocks table at, bytes; documents table at, bytes; ids; magic
BLOCK_IDS, LANES = 512, 2048
FILE_BYTES, LARGE_FILE_BYTES, MANY_FILES = 32 << 20, 1 << 30, 4096
END_ID = 2

MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"


class _Encoder:
    """The library's tokenizer with a cache of pieces."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = {token.content: i for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that look at their neighbours are not supported")
        names = sorted(self.added, key=len, reverse=True)  # the longest of those that begin at a place
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else lambda text: [text]
        self.cache: dict[bytes, bytes] = {}

    def encode(self, texts: list[str], end_id: int):
        """(ids of all texts one after another, each with the end id; ids per text)."""
        import numpy as np

        from carrisk.llm.pretok import pieces

        owners, segments, closing = [], [], []  # added tokens cut a text into segments; what ends a segment: their id or the end id
        for i, text in enumerate(texts):
            cut = self.split(text)
            owners += [i] * (len(cut) // 2 + 1)
            segments += cut[::2]
            closing += [*(self.added[name] for name in cut[1::2]), end_id]
        distinct, codes, firsts = pieces(segments)
        found = list(map(self.cache.get, distinct))
        new = [k for k, x in enumerate(found) if x is None]
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
        encoded = self.tokenizer.encode_batch_fast([distinct[k].decode() for k in new], add_special_tokens=False)
        for k, e in zip(new, encoded):
            found[k] = np.array(e.ids, np.int32).tobytes()
            if len(distinct[k]) <= CACHED_BYTES:
                self.cache[distinct[k]] = found[k]
        width = np.fromiter(map(len, found), np.int64, len(found)) // 4
        store = np.frombuffer(b"".join(found), np.int32)
        begin = np.cumsum(width) - width
        count = width[codes]
        per_segment = np.bincount(np.repeat(np.arange(len(segments)), np.diff(firsts)), count, len(segments)).astype(np.int64) + 1
        ends = np.cumsum(per_segment)
        out = np.zeros(ends[-1] if len(ends) else 0, np.int32)
        place = np.ones(len(out), bool)
        place[ends - 1] = False
        out[ends - 1] = closing
        before = np.cumsum(count) - count
        out[place] = store[np.arange(int(count.sum())) + np.repeat(begin[codes] - before, count)]
        return out, np.bincount(owners, per_segment, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


class _IdFile:
    """A file being written: ids are buffered until a group of blocks is full."""

    def __init__(self, path: str):
        self.path, self.file = path, open_output(path)
        self.file.write(MAGIC)
        self.at, self.waiting, self.n_waiting, self.n_ids = len(MAGIC), [], 0, 0
        self.blocks = array("q")  # offset, bytes, ids and CRC of each block

    def add(self, ids) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= LANES * BLOCK_IDS:
            self._code(self.n_waiting // (LANES * BLOCK_IDS) * LANES * BLOCK_IDS)

    def _code(self, n: int) -> None:
        import numpy as np

        from carrisk.llm.range_coder import encode_blocks

        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int32)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n
        for first in range(0, n, LANES * BLOCK_IDS):
            group = ids[first:min(first + LANES * BLOCK_IDS, n)]
            rows = -(-len(group) // BLOCK_IDS)
            lengths = np.full(rows, BLOCK_IDS)
            lengths[-1] = len(group) - (rows - 1) * BLOCK_IDS
            grid = np.zeros(rows * BLOCK_IDS, np.int64)
            grid[:len(group)] = group
            grid = grid.reshape(rows, BLOCK_IDS)
            for data, row, size in zip(encode_blocks(grid, lengths), grid, lengths.tolist()):
                self.file.write(data)
                self.blocks.extend((self.at, len(data), size, zlib.crc32(row[:size].astype("<u4").tobytes())))
                self.at += len(data)

    def close(self, docs: pa.Table) -> int:
        self._code(self.n_waiting)
        kinds = (("offset", pa.int64()), ("n_bytes", pa.int32()), ("n_ids", pa.int32()), ("crc", pa.int64()))
        columns = [self.blocks[k::4] for k in range(4)]
        places = []
        for out in (pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns)}), docs):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, out.schema) as writer:
                writer.write_table(out)
            data = sink.getvalue()
            places += [self.at, data.size]
            self.file.write(data)
            self.at += data.size
        self.file.write(struct.pack(TAIL, *places, self.n_ids, MAGIC))
        self.file.close()
        return self.at + struct.calcsize(TAIL)


def write_id_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = END_ID, file_bytes: int | None = None) -> DataFrame:
    """Write the ids of ``docs`` in order of ``id_col``; returns the manifest, itself a written table.

    A file takes ``file_bytes`` of text; by default that grows with the input, from 32 MB to 1 GB, so that
    there are some 4,096 files before there are more (100 TB: 100,000).
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    file_bytes = file_bytes or min(max(FILE_BYTES, total // MANY_FILES), LARGE_FILE_BYTES)
    parts = max(int(total // file_bytes) + 1, 1)
    ordered = source.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())

    def run(batches):
        from pyspark import TaskContext

        file, tables, first = None, [], 0
        for part in text_slices(batches, "__text"):
            import numpy as np

            if file is None:
                file = _IdFile(f"{folder}/{uuid.uuid4().hex}.ids")
            ids, count = _encoder(tokenizer_path).encode(part.column(1).to_pylist(), end_id)
            file.add(ids)
            tables.append(pa.table({"id": part.column(0), "first": pa.array(first + np.cumsum(count) - count), "n_tokens": pa.array(count)}))
            first += len(ids)
        if file is not None:
            listed = pa.concat_tables(tables)
            size = file.close(listed)
            row = [[TaskContext.get().partitionId()], [file.path], [len(listed)], [file.n_ids], [size]]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["part", "path", "n_docs", "n_ids", "n_bytes"])

    return written(ordered.mapInArrow(run, MANIFEST), "ids-manifest")


def file_tables(file, length: int) -> tuple[pa.Table, pa.Table]:
    """(blocks, documents) of an id file."""
    from carrisk.llm.zip_reader import read_range

    tail = struct.calcsize(TAIL)
    blocks_at, blocks_size, docs_at, docs_size, _, magic = struct.unpack(TAIL, read_range(file, length - tail, tail))
    if magic != MAGIC or read_range(file, 0, len(MAGIC)) != MAGIC:
        raise ValueError("not an id file")
    return tuple(pa.ipc.open_stream(read_range(file, at, size)).read_all() for at, size in ((blocks_at, blocks_size), (docs_at, docs_size)))


def block_groups(file, blocks: pa.Table):
    """Ids of the file, group of blocks after group; ValueError where a CRC does not hold."""
    import numpy as np

    from carrisk.llm.range_coder import decode_blocks
    from carrisk.llm.zip_reader import read_range

    offset, size, count, crc = (blocks.column(c).to_numpy() for c in ("offset", "n_bytes", "n_ids", "crc"))
    for a in range(0, len(offset), LANES):
        b = min(a + LANES, len(offset))
        data = read_range(file, int(offset[a]), int(offset[b - 1] + size[b - 1] - offset[a]))
        rows = decode_blocks([data[o:o + n] for o, n in zip((offset[a:b] - offset[a]).tolist(), size[a:b].tolist())], count[a:b].astype(np.int64))
        ids = rows.astype("<u4")
        for row, n, want in zip(ids, count[a:b].tolist(), crc[a:b].tolist()):
            if zlib.crc32(row[:n].tobytes()) != want:
                raise ValueError("block does not match its CRC")
        yield ids.reshape(-1)[:int(count[a:b].sum())]  # only the file's last block may be short


def read_id_files(manifest: DataFrame, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """One row per document of the listed files: id, start, n_tokens, ids_crc32 and, if wanted, its ids."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("part", "path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    files = manifest.count()
    based = based.repartitionByRange(max(files, 1), "part")  # a file a task; hashes would put several into one
    schema = f"id {id_type}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        import numpy as np

        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                files_, inner = filesystem(path)
                with open_input(path) as file:
                    blocks, docs = file_tables(file, files_.get_file_info(inner).size)
                    first, count = docs.column("first").to_numpy(), docs.column("n_tokens").to_numpy()
                    ends = first + count
                    crc, lists = np.zeros(len(docs), np.int64), [[] for _ in range(len(docs) if with_ids else 0)]
                    at, doc = 0, 0
                    for ids in block_groups(file, blocks):
                        last = at + len(ids)
                        while doc < len(ends):
                            part = ids[max(first[doc] - at, 0):min(ends[doc], last) - at]
                            crc[doc] = zlib.crc32(part.tobytes(), int(crc[doc]))
                            if with_ids:
                                lists[doc] += part.tolist()
                            if ends[doc] > last:
                                break
                            doc += 1
                        at = last
                    if doc != len(ends):
                        raise ValueError("the file holds fewer ids than its documents")
                columns = [docs.column("id").combine_chunks(), pa.array(base + first), pa.array(count), pa.array(crc)]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int64())))
                out = pa.Table.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])
                yield from out.to_batches(max_chunksize=20_000)

    return based.mapInArrow(run, schema)


@query("op10_id_range_coder")
def op10_id_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_id_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_id_files(manifest).withColumnRenamed("id", "doc_id")
