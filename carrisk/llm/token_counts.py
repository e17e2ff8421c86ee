"""Operator 1: token counts under a unigram model by trie-shared dynamic programming.

A piece's unigram score follows from its rank in a public vocabulary file:
``ln p = -ln(rank + 1) - ln H`` (Zipf's law, H the harmonic number of the
vocabulary's size), as an integer in millionths so that sums are exact.  A
pre-token's best segmentation is the forward (Viterbi) recursion over its
prefixes; of equal scores the one with fewer tokens wins.

Each worker inserts the distinct pre-tokens it meets in a trie.  A node is a
prefix: its forward score and token count are computed once, when the node
is made, from its ancestors' scores, and shared by every pre-token below it.
The count at a pre-token's last node is kept by the pre-token, so a repeat is
one lookup.  The trie starts anew at ``MAX_NODES`` nodes (cost only).

Counts are summed within the task that holds the text: no shuffle, no join,
and a text's memory is bounded by its own length.

Defined cases: null and empty texts count 0; every input row gives one row,
repeats included; an empty table gives none; a kept input column with an
output's name is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrisk.llm.bpe import load_ranks
from carrisk.llm.common import not_replaced, query, table, text_slices

MAX_NODES = 500_000
MAX_COUNTS = 500_000
TRIE_BYTES = 128


def unigram_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Piece -> score in millionths of ln p, from its rank."""
    log_h = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -round(1e6 * (math.log(rank + 1) + log_h)) for piece, rank in ranks.items()}


@lru_cache(maxsize=2)
def suffix_scores(vocab_path: str) -> dict[bytes, int | None]:
    """Every suffix of a piece: its score where it is a piece itself, else None."""
    scores = unigram_scores(load_ranks(vocab_path))
    out: dict[bytes, int | None] = dict(scores)
    for piece in scores:
        for i in range(1, len(piece)):
            out.setdefault(piece[i:], None)
    return out


class ForwardTrie:
    def __init__(self, scores: dict[bytes, int | None]):
        self.scores = scores
        self.counts: dict[bytes, int] = {}  # terminal counts
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.best, self.tokens = [0], [0]

    def count(self, word: bytes) -> int:
        """Tokens of ``word``: walk its prefixes, making the nodes that are new."""
        known = self.counts.get(word)
        if known is not None:
            return known
        if len(self.best) > MAX_NODES or len(word) > TRIE_BYTES:
            self.clear()
        if len(self.counts) >= MAX_COUNTS:
            self.counts.clear()
        child, best, tokens, score_of = self.child, self.best, self.tokens, self.scores.get
        path = [0]
        for d, byte in enumerate(word, 1):
            key = path[-1] * 256 + byte
            node = child.get(key)
            if node is None:
                top, least = -math.inf, 0
                for first in range(d - 1, -1, -1):
                    score = score_of(word[first:d], 0)
                    if score == 0:  # no piece ends like this, so no longer one does
                        break
                    if score is not None:
                        before = path[first]
                        s, n = best[before] + score, tokens[before] + 1
                        if s > top or s == top and n < least:
                            top, least = s, n
                node = child[key] = len(best)
                best.append(top)
                tokens.append(least)
            path.append(node)
        n = tokens[path[-1]]
        if len(word) > TRIE_BYTES:
            self.clear()  # one long pre-token's nodes are not worth keeping
        else:
            self.counts[word] = n
        return n


_TRIES: dict[str, ForwardTrie] = {}


def token_counts(docs: DataFrame, vocab_path: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` + ``n_pretokens`` and ``n_tokens`` of every whole text."""
    new = ("n_pretokens", "n_tokens")
    keep = not_replaced(keep, new)
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(n, T.LongType(), False) for n in new)])
    n_keep = len(keep)

    def run(batches):
        import numpy as np

        from carrisk.llm.pretok import pieces

        trie = _TRIES.get(vocab_path)
        if trie is None:
            trie = _TRIES[vocab_path] = ForwardTrie(suffix_scores(vocab_path))
        for part in text_slices(batches, "__text"):
            distinct, codes, firsts = pieces([t or "" for t in part.column(n_keep).to_pylist()])
            counts = np.array([trie.count(w) for w in distinct], np.int64)[codes]
            sums = np.append(0, np.cumsum(counts))[firsts]
            yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], pa.array(np.diff(firsts), pa.int64()),
                                              pa.array(np.diff(sums), pa.int64())], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
