"""Operator 7: byte-level BPE encoding and decoding.

Method: vectorised pre-tokenisation (``pretok``: class arrays and a
transition-function scan, no regex); the distinct byte slices go through pair
merging once, many side by side, and are then answered from a per-worker cache.  Token byte
offsets are kept and place the bytes again when decoding.

Nothing is shuffled: both directions are ``mapInArrow`` over the input
partitions, in slices of about a million bytes of text, so a task's memory
does not grow with its partition.  The cache is emptied when it holds
``CACHE_PIECES`` pieces; that changes cost only.  The vocabulary (50k ranks)
is read from ``vocab_path`` by each worker.

Defined cases: a null text gives null ids, and the query reads it as empty;
an empty text gives an empty list; rows are kept one to one with their
ties and repeats, and an empty table gives no rows.  Any other input column
may be carried with ``keep``; one with an output's name is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrisk.llm.common import not_replaced, query, table, text_slices

CACHE_PIECES = 200_000
CACHED_BYTES = 64
SCAN_BYTES = 48
NO_PAIR = 1 << 30


@lru_cache(maxsize=4)
def load_ranks(vocab_path: str) -> dict[bytes, int]:
    """Token bytes -> rank (= id) of a rank file: one base64 token and its rank a line."""
    with open(vocab_path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


@lru_cache(maxsize=4)
def token_widths(vocab_path: str):
    """Bytes of every token, by id."""
    import numpy as np

    ranks = load_ranks(vocab_path)
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        width[rank] = len(token)
    return width


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the adjacent pair of lowest rank, leftmost first, until none is in ``ranks``.

    A heap of (rank, position) over a linked list: O(n log n) for a long piece.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is piece[i:end[i]]; end 0: merged away

    def candidate(i: int) -> tuple[int, int, int] | None:
        j = end[i]
        rank = ranks.get(piece[i:end[j]]) if j < n else None
        return None if rank is None else (rank, i, end[j])

    heap = [c for i in range(n) if (c := candidate(i))]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            left[stop] = i
        for k in (i, left[i]):
            if k >= 0 and (c := candidate(k)):
                heapq.heappush(heap, c)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class PieceMerger:
    """Pair merging of many pieces side by side: each turn merges the best pair of every piece at once."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.np, self.ranks = np, ranks
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        keys, values = zip(*pairs) if pairs else ((), ())
        self.keys = np.append(np.array(keys, np.int64), 1 << 62)
        self.values = np.append(np.array(values, np.int32), 0)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.cache: dict[bytes, object] = {}

    def pair_rank(self, left, right):
        """Rank of the token that two ids make, NO_PAIR where they make none (or one is missing)."""
        key = left << 32 | right
        at = self.np.searchsorted(self.keys, key)
        return self.np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NO_PAIR)

    def merge_all(self, words: list[bytes]):
        """A list of id arrays."""
        np = self.np
        size = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        for low, high in ((0, 8), (8, 16), (16, SCAN_BYTES)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if not len(rows):
                continue
            ids = np.full((len(rows), high + 1), -1, np.int64)
            inside = np.arange(high + 1) < size[rows, None]
            ids[inside] = self.byte[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)]
            rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
            live = np.arange(len(rows))
            columns = np.arange(high)
            while len(live):
                r = rank[live]
                j = r.argmin(1)
                best = r[np.arange(len(live)), j]
                more = best < NO_PAIR
                live, j, best = live[more], j[more], best[more]
                if not len(live):
                    break
                moved = ids[live]
                moved[np.arange(len(live)), j] = best
                moved = np.take_along_axis(moved, np.minimum(np.arange(high + 1) + (np.arange(high + 1) > j[:, None]), high), 1)
                moved[:, -1] = -1
                r = np.take_along_axis(rank[live], np.minimum(columns + (columns > j[:, None]), high - 1), 1)
                r[:, -1] = NO_PAIR
                k = np.arange(len(live))
                r[k, j] = self.pair_rank(moved[k, j], moved[k, j + 1])
                b = np.flatnonzero(j > 0)
                r[b, j[b] - 1] = self.pair_rank(moved[b, j[b] - 1], moved[b, j[b]])
                ids[live], rank[live] = moved, r
            flat = ids[ids >= 0].astype(np.int32)
            ends = np.cumsum((ids >= 0).sum(1))
            for i, part in zip(rows.tolist(), np.split(flat, ends[:-1])):
                out[i] = part
        for i in np.flatnonzero((size == 0) | (size > SCAN_BYTES)).tolist():
            out[i] = np.array(merge_piece(words[i], self.ranks), np.int32)
        return out

    def encode(self, texts: Sequence[str]):
        """(ids of all texts one after another, ends): text ``i`` has ``ids[ends[i]:ends[i + 1]]``."""
        from carrisk.llm.pretok import pieces

        np, cache = self.np, self.cache
        distinct, codes, firsts = pieces(list(texts))
        merged = list(map(cache.get, distinct))
        new = [k for k, ids in enumerate(merged) if ids is None]
        if len(cache) + len(new) > CACHE_PIECES:
            cache.clear()
        for k, ids in zip(new, self.merge_all([distinct[k] for k in new])):
            merged[k] = ids
            if len(distinct[k]) <= CACHED_BYTES:
                cache[distinct[k]] = ids.tobytes()
        store = b"".join([x if isinstance(x, bytes) else x.tobytes() for x in merged])
        store = np.frombuffer(store, np.int32)
        width = np.array([len(x) // 4 if isinstance(x, bytes) else len(x) for x in merged], np.int64)
        begin = np.cumsum(width) - width
        count = width[codes]
        ends = np.append(0, np.cumsum(count))
        ids = store[np.arange(ends[-1]) + np.repeat(begin[codes] - ends[:-1], count)]
        return ids, ends[firsts]


_MERGERS: dict[str, PieceMerger] = {}


def merger(vocab_path: str) -> PieceMerger:
    """This worker's merger of a vocabulary, with its cache."""
    if vocab_path not in _MERGERS:
        _MERGERS[vocab_path] = PieceMerger(load_ranks(vocab_path))
    return _MERGERS[vocab_path]


def byte_offsets(ids, ends, width):
    """Where each token's bytes begin in its text; text ``i`` has ``ids[ends[i]:ends[i + 1]]``."""
    import numpy as np

    after = np.cumsum(width[ids], dtype=np.int64)
    base = np.append(0, after)[ends[:-1]]
    return (after - width[ids] - np.repeat(base, np.diff(ends))).astype(np.int32)


def writer(vocab_path: str):
    """A function (ids, offsets) -> bytes, each token written at its offset."""
    import numpy as np

    ranks, width = load_ranks(vocab_path), token_widths(vocab_path)
    first = np.cumsum(width) - width
    store = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

    def write(ids, offsets) -> bytes:
        size = width[ids]
        got = np.zeros(int(offsets[-1] + size[-1]) if len(ids) else 0, np.uint8)
        source = first[ids]
        while len(ids):  # the first byte of every token, the second of those that have one, ...
            got[offsets] = store[source]
            more = np.flatnonzero(size > 1)
            ids, offsets, source, size = ids[more], offsets[more] + 1, source[more] + 1, size[more] - 1
        return got.tobytes()

    return write


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
           ids_col: str = "token_ids", offsets_col: str = "token_offsets") -> DataFrame:
    """``keep`` + ids and the byte offset of every token in the UTF-8 text; null text: null lists."""
    keep = not_replaced(keep, (ids_col, offsets_col))
    schema = T.StructType([*(docs.schema[k] for k in keep),
                           T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)),
                           T.StructField(offsets_col, T.ArrayType(T.IntegerType(), False))])
    n_keep = len(keep)

    def run(batches):
        import numpy as np

        merge = merger(vocab_path)
        width = token_widths(vocab_path)
        for part in text_slices(batches, "__text"):
            texts = part.column(n_keep).to_pylist()
            ids, ends = merge.encode([t or "" for t in texts])
            ends = ends.astype(np.int32)
            offsets = byte_offsets(ids, ends, width)
            null = pa.array([t is None for t in texts], pa.bool_())
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x), mask=null) for x in (ids, offsets)]
            yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *arrays], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab_path: str, keep: Sequence[str] = ("doc_id",), ids_col: str = "token_ids",
           offsets_col: str = "token_offsets", bytes_col: str = "decoded") -> DataFrame:
    """``keep`` + the bytes of the ids, each token written at its offset; null ids: null bytes."""
    keep = not_replaced(keep, (bytes_col,))
    schema = T.StructType([*(encoded.schema[k] for k in keep), T.StructField(bytes_col, T.BinaryType())])
    n_keep = len(keep)

    def run(batches):
        import numpy as np

        write = writer(vocab_path)
        for batch in batches:
            for r in range(0, batch.num_rows, 256):
                part = batch.slice(r, 256)
                out = []
                for ids, offsets in zip(part.column(n_keep), part.column(n_keep + 1)):
                    if not ids.is_valid:
                        out.append(None)
                        continue
                    out.append(write(ids.values.to_numpy(), offsets.values.to_numpy().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], pa.array(out, pa.binary())], names=schema.names)

    return encoded.select(*keep, ids_col, offsets_col).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocab_path: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), ids_col: str = "token_ids",
               digest_col: str = "decoded_sha256") -> DataFrame:
    """``keep`` + ids and the SHA-256 of what they decode to, both directions in one pass; null text: nulls.

    Ids and offsets stay in the worker between the two directions.
    """
    keep = not_replaced(keep, (ids_col, digest_col))
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(digest_col, T.StringType())])
    n_keep = len(keep)

    def run(batches):
        import numpy as np

        merge, width, write = merger(vocab_path), token_widths(vocab_path), writer(vocab_path)
        for part in text_slices(batches, "__text", 1 << 19):
            texts = part.column(n_keep).to_pylist()
            ids, ends = merge.encode([t or "" for t in texts])
            offsets = byte_offsets(ids, ends, width)
            digests = [None if t is None else hashlib.sha256(write(ids[a:b], offsets[a:b].astype(np.int64))).hexdigest() for t, a, b in zip(texts, ends[:-1], ends[1:])]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], lists, pa.array(digests, pa.string())], names=schema.names)
        merge.cache.clear()  # the worker may go on with another stage

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text (null: empty), decode the ids, digest both."""
    import public_tokenizers

    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = encode(docs, vocab).withColumns({
        "n_tokens": F.size("token_ids").cast("long"),
        "ids_sha256": F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256)})
    decoded = decode(encoded, vocab, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
