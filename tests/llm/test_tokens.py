"""Pre-tokenisation, BPE and unigram counts against plain versions."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from carrisk.llm import bpe, pretok, token_counts
from carrisk.llm.queries import QUERIES
from tests.conftest import SF001

VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", "'s", " 's", "  's", "x's'set'", "\n\n a", " \n", "'ll", "a b", " x", "<|endoftext|>", "\x00\x1c", "é中😀 12½"]


def split(texts):
    distinct, codes, first = pretok.pieces(texts)
    return [[distinct[c].decode() for c in codes[first[i]:first[i + 1]]] for i in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab's tre vlmd\n\t éß12¾!?.中😀", max_size=50), min_size=1, max_size=5))
def test_pieces_equal_the_pattern(texts):
    assert split(texts) == [PATTERN.findall(t) for t in texts]


def test_pieces_of_long_and_odd_texts():
    texts = [*ODD, "a" * 5000, " " * 700 + "b", "x y\n" * 900]
    assert split(texts) == [PATTERN.findall(t) for t in texts]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "é中a😀", " "])
@pytest.mark.parametrize("n", [1, 7, 48, 49, 400, 3000])
def test_merge_piece(alphabet, n):
    rng = random.Random(n)
    piece = "".join(rng.choice(alphabet) for _ in range(n)).encode()
    assert bpe.merge_piece(piece, RANKS) == ENCODING._encode_single_piece(piece)


def test_merging_side_by_side():
    rng = random.Random(8)
    words = ["".join(rng.choice("theaion é😀 ") for _ in range(rng.randint(1, 60))).encode() for _ in range(3000)] + [b"a", b" " * 300]
    merged = bpe.PieceMerger(RANKS).merge_all(words)
    assert [m.tolist() for m in merged] == [ENCODING._encode_single_piece(w) for w in words]


def plain_count(word: bytes, scores: dict) -> int:
    best = [(0, 0)]
    for d in range(1, len(word) + 1):
        best.append(max((best[a][0] + scores[word[a:d]], best[a][1] - 1) for a in range(max(0, d - 130), d) if word[a:d] in scores))
    return -best[-1][1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="theaionrs 'é", min_size=1, max_size=12), min_size=1, max_size=20))
def test_trie_counts(words):
    scores = token_counts.unigram_scores(RANKS)
    trie = token_counts.ForwardTrie(token_counts.suffix_scores(VOCAB))
    for w in [*words, "the" * 60, *words]:
        assert trie.count(w.encode()) == plain_count(w.encode(), scores)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}


def test_op7_query(spark, texts):
    rows = QUERIES["op7_byte_bpe"](spark, SF001).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = ENCODING.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op1_query(spark, texts):
    scores = token_counts.unigram_scores(RANKS)
    known = {}
    rows = QUERIES["op1_token_counts"](spark, SF001).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        words = [w.encode() for w in PATTERN.findall(texts[r.doc_id])]
        for w in words:
            if w not in known:
                known[w] = plain_count(w, scores)
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(known[w] for w in words))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, "a" * 20_000, "b c " * 9000])]
    return spark.createDataFrame([*rows, rows[2], (None, "t", None)], "doc_id long, text string, n_tokens_ string")


def test_edge_rows(spark, odd):
    out = bpe.decode(bpe.encode(odd, VOCAB, keep=("doc_id", "text")), VOCAB, keep=("doc_id", "text", "token_ids")).collect()
    assert len(out) == odd.count()
    for r in out:
        assert (r.decoded is None and r.token_ids is None) if r.text is None else r.decoded.decode() == r.text
        assert r.text is None or r.token_ids == ENCODING.encode_ordinary(r.text)
    counts = token_counts.token_counts(odd, VOCAB, keep=("doc_id", "text")).collect()
    assert len(counts) == odd.count() and all(r.n_tokens == 0 for r in counts if not r.text)
    none = odd.where("doc_id < 0")
    assert bpe.encode(none, VOCAB).count() == 0 and token_counts.token_counts(none, VOCAB).count() == 0


def test_clashing_names(odd):
    """An output replaces a kept column of its name."""
    named = odd.withColumnRenamed("n_tokens_", "TOKEN_IDS")
    out = bpe.encode(named, VOCAB, keep=("doc_id", "TOKEN_IDS"))
    assert out.columns == ["doc_id", "token_ids", "token_offsets"] and out.count() == odd.count()
    out = token_counts.token_counts(odd.withColumnRenamed("n_tokens_", "n_tokens"), VOCAB, keep=("doc_id", "n_tokens"))
    assert out.columns == ["doc_id", "n_pretokens", "n_tokens"] and out.count() == odd.count()
