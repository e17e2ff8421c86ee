"""Jaccard join against brute force over all pairs, with buckets of every kind."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrisk.llm import ngram_join as J
from carrisk.llm.queries import ORACLE, QUERIES
from tests import harness
from tests.conftest import SF001

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gram_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    """[(id, text)] -> [(id, size, component)] with components over rows; a component's name is its least id."""
    sets = [gram_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), doc if not sets[i] else min(ids, default=None)))
    return sorted(out, key=repr)


def check(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=repr) == brute(rows)


def families(seed, sizes, words=120):
    """Texts in families whose members differ from their base in 0 to 6 words, the base itself not always there."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for size in sizes:
        base = [word() for _ in range(rng.randint(words // 2, words * 2))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 6])):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.2:
                text = text[:-rng.randint(1, 5)]
            texts.append(" ".join(text))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_small_families(spark):
    check(spark, families(1, [1] * 20 + [2] * 15 + [5] * 8))


@pytest.mark.parametrize("small, block, counters", [(32, 1 << 20, 1 << 20), (4, 1 << 20, 1 << 20), (3, 2500, 1 << 10), (1, 900, 64)])
def test_large_families(spark, monkeypatch, small, block, counters):
    """Buckets above ``SMALL``, in one block and in many; counters so few that the order says little."""
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "COUNTERS", counters)
    check(spark, families(2, [90, 40, 7, 2, 2, 1, 1, 1]))


def test_blocks_hold_several_rounds(spark, monkeypatch):
    """The second round has work: a bucket's components meet across blocks."""
    monkeypatch.setattr(J, "SMALL", 2)
    monkeypatch.setattr(J, "BLOCK", 600)
    seen = []
    real = J.other_blocks
    monkeypatch.setattr(J, "other_blocks", lambda *a: (seen.append(real(*a)), seen[-1])[1])
    check(spark, families(3, [60, 30], words=60))
    assert seen[0].select("gram", "low", "high").distinct().count() > seen[0].select("gram").distinct().count()


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO\n"), (6, "one two three"), (7, "solo"), (7, "Solo"), (7, "a b c d"),
            (None, "a b c d"), (8, "a\x0bb\x0cc\rd"), (None, "only here with a null id"), (9, "Ärger über Öl"), (10, "ärger über öl"), (11, "a b c d e"),
            (12, long), (13, long + " end"), (14, "x " * 500), (15, "x x x"), (16, "\x1cx y z"), (17, "x y z")]
    check(spark, rows)


def test_threshold_is_exact(spark):
    """Sets of 19 that share 18: 18 / 20 = 0.9 links; of 19 and 18 that share 17: 0.85 does not."""
    base = [f"a{i}" for i in range(21)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["zz"])), (3, " ".join(base[1:-1] + ["yy"]))]
    assert len(gram_set(rows[0][1])) == 19
    check(spark, rows)
    assert brute(rows)[1][2] == 1


def test_text_ids_extra_columns_and_an_empty_table(spark):
    rows = families(5, [4, 3, 1])
    df = spark.createDataFrame([(f"d{i:02}", t) for i, t in rows], "name string, body string")
    noisy = df.select("*", *[F.lit(1).alias(c) for c in ("id", "node", "n", "part", "component", "text", "gram")])
    got = sorted((int(r[0][1:]), r[1], int(r[2][1:])) for r in J.jaccard_components(noisy, "name", "body").collect())
    assert got == brute(rows)
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_and_filters_lose_no_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = rng.choice(2 ** 40, n, replace=False).astype(np.uint64)
        m = int(rng.integers(0, max(n // 8, 1) + 1))
        b = np.concatenate([a[m:], rng.choice(2 ** 40, int(rng.integers(0, m + 2))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        assert J.common(a, b) == both
        if len(b) and 100 * both >= 90 * (len(a) + len(b) - both):
            counts = rng.integers(0, 3, J.COUNTERS)
            x, y = J.rare_first(a, counts), J.rare_first(b, counts)
            assert J.first_common(x[:J.prefix_length(len(x))], y[:J.prefix_length(len(y))]) is not None
            assert np.abs(J.part_counts(a).astype(int) - J.part_counts(b)).sum() <= J.most_apart(len(a), len(b))
            assert len(a) + len(b) - 2 * both <= J.most_apart(len(a), len(b))


def test_counts_are_added_over_levels(spark, monkeypatch):
    monkeypatch.setattr(J, "FAN_IN", 2)
    rows = families(6, [3] * 20)
    df = spark.createDataFrame([(i, t) for i, t in rows], "id long, text string").repartition(9)
    found = J.digests_and_counts(df).where("node is null")
    total = J.total_counts(found.select("part", "row", "counts"))
    assert total.sum() == sum(len(gram_set(t)) for _, t in rows)


def test_sql(spark):
    con = harness.duck(SF001)
    found = con.sql(ORACLE["op12_ngram_jaccard"]).arrow()
    found = found.read_all() if hasattr(found, "read_all") else found
    assert harness.compare(QUERIES["op12_ngram_jaccard"](spark, SF001).toArrow(), found) == []
