"""Spelling variants against brute force over all word pairs, with cells and blocks of every size."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrisk.llm import spelling as S
from carrisk.llm.queries import ORACLE, QUERIES
from tests import harness
from tests.conftest import SF001

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, near = {}, {}
    for w in words:
        near[w] = [v for v in words if v != w and one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def texts(seed, stems=12, docs=60):
    """Documents of frequent words, of which some are misspelt, anagrams and words with accents."""
    rng = random.Random(seed)
    letters = "abcdeé"
    base = ["".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(stems)]
    variants = []
    for w in base:
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            variants.append(rng.choice([w[:i] + c + w[i + 1:], w[:i] + w[i + 1:], w[:i] + c + w[i:], "".join(rng.sample(w, len(w)))]))
    rows = []
    for d in range(docs):
        words = rng.choices(base, k=120) + rng.choices(variants, k=80) + rng.choices(["the", "x", "Ab1cdefgh", "ÀÉtoile", "naïveté"], k=10)
        rng.shuffle(words)
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words)))
    return rows


def check(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = sorted((tuple(r) for r in S.spelling_groups(df).collect()))
    assert got == brute(rows)
    return got


def test_plain(spark):
    got = check(spark, texts(1))
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) or r[1] for r in got)


@pytest.mark.parametrize("cell, sample", [(16, 1 << 16), (8, 40), (3, 1 << 16)])
def test_many_cells_and_blocks(spark, monkeypatch, cell, sample):
    monkeypatch.setattr(S, "CELL", cell)
    monkeypatch.setattr(S, "SAMPLE", sample)
    monkeypatch.setattr(S, "QUERIES_A_CELL", 2)
    check(spark, texts(2, stems=20))


def test_odd_rows(spark):
    long = "ab" * 30_000
    rows = [(1, None), (2, ""), (3, "word7word " * 9), (None, "nulling nulling nulling nulling nulling"), (4, "twice once"), (4, "nullinq " * 30), (5, "ßßßßßß ÿÿÿÿÿÿ " * 6),
            (6, "łabcdef×ghijkl÷mnopqr " * 7), (7, (long + " ") * 6 + (long[:-1] + " ") * 40), (8, "ÀBCDEF àbcdef " * 8)]
    check(spark, rows)


def test_empty_text_ids_and_clashing_columns(spark):
    assert S.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = texts(3, docs=20)
    df = spark.createDataFrame([(f"n{i}", t) for i, t in rows], "name string, body string")
    noisy = df.select("*", *[F.lit(1).alias(c) for c in ("id", "text", "word", "n", "cell", "length")])
    assert sorted(map(tuple, S.spelling_groups(noisy, "name", "body").collect())) == brute([(f"n{i}", t) for i, t in rows])


def test_chains_of_forms(spark):
    """A word whose form has a form: the root is the last one."""
    rows = [(1, "abcdefgh " * 700 + "abcdefgx " * 100 + "abcdefyx " * 10)]
    got = {r[0]: r for r in check(spark, rows)}
    assert got["abcdefyx"][1] == "abcdefgx" and got["abcdefyx"][2] == "abcdefgh"


def test_words_are_the_pattern_s(spark):
    text = "".join(chr(c) for c in list(range(32, 400)) + [0x2019, 0x1F600, 0xD7, 0xF7]) * 2
    assert [w.decode("latin-1") for w in S.words_of(text)] == [w.translate(LOWER) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]


@pytest.mark.parametrize("most", [1, 2])
def test_range_search_finds_all(most):
    rng = np.random.default_rng(most)
    points, asks = (rng.integers(0, 3, (n, S.AXES)).astype(np.int8) * (rng.random((n, S.AXES)) < 0.06).astype(np.int8) for n in (900, 700))
    asks[:300] = points[:300]
    for row in asks[:200]:
        row[rng.integers(0, S.AXES)] += 1
    found = set(zip(*(x.tolist() for x in S.range_search(points, asks, most))))
    gap = np.abs(points[:, None, :].astype(int) - asks[None]).sum(2)
    assert found == set(zip(*(x.tolist() for x in np.nonzero(gap <= most))))


def test_no_cell_within_reach_is_left_out():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 4, (500, S.AXES)).astype(np.int8)
    nodes = S.split_tree(points, 40)
    home = {int(r): cell for cell, rows in S.reached(nodes, points, 0, 0) for r in rows}
    assert len(home) == 500 and len(set(home.values())) > 20
    moved = points.copy()
    for row in moved:
        i, j = rng.choice(S.AXES, 2, replace=False)
        row[i] += 1
        row[j] = max(row[j] - 1, 0)
    seen = {(cell, int(r)) for cell, rows in S.reached(nodes, moved, 1, 1) for r in rows}
    assert all((home[r], r) in seen for r in range(500))


def test_sql(spark):
    con = harness.duck(SF001)
    found = con.sql(ORACLE["op11_spelling_groups"]).arrow()
    found = found.read_all() if hasattr(found, "read_all") else found
    assert harness.compare(QUERIES["op11_spelling_groups"](spark, SF001).toArrow(), found) == []
