"""Benchmark decontamination against brute force, planted copies and paraphrases, edge rows."""

import random

import numpy as np
import pyarrow as pa

from carrisk.llm import decontaminate as dc
from carrisk.llm.queries import QUERIES
from tests.conftest import SF001


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        where = {}
        for k, x in enumerate(a):
            where[x] = where.get(x, 0) | 1 << k
        places = dc.common_places(a, b)
        assert dc.common_length(where, len(a), b) == plain_lcs(a, b) == len(places) and places == sorted(set(places))


def brute(docs, bench):
    """{(doc, item): share} by judging every region of every document, without any retrieval."""
    items = dc.Items(sorted((r.item_id, r.text) for r in bench))
    vocab = {w: k for k, w in enumerate(items.vocab.to_pylist())}
    texts = []
    for r in docs:
        flat, _ = dc.word_lists(pa.array([r.text or ""]))
        texts.append((r.doc_id, [vocab.get(w, -1) for w in flat.to_pylist()]))
    passages = [set(w[max(a, 0):a + dc.WINDOW]) - {-1} for _, w in texts for a in range(-dc.STRIDE, max(len(w), 1), dc.STRIDE)]
    df = np.zeros(len(vocab))
    for p in passages:
        df[list(p)] += 1
    items.fit(df, len(passages))
    out = {}
    for doc, words in texts:
        have = np.bincount([w for w in words if w >= 0], minlength=len(vocab))
        for k, item in enumerate(items.words):
            if np.minimum(have, np.bincount(item, minlength=len(vocab))).sum() < dc.PARAPHRASE * len(item):
                continue
            reach = len(item) + dc.STRIDE
            for middle in range(0, len(words) + dc.STRIDE, dc.STRIDE):
                region = [w for w in words[max(0, middle - dc.STRIDE - reach):middle + dc.STRIDE + reach] if w >= 0]
                verdict = dc.judge_match(items, k, region)
                if verdict:
                    out[doc, items.ids[k]] = max(out.get((doc, items.ids[k]), ("", 0)), verdict, key=lambda v: v[1])
    return out


def test_query_recall(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    want = brute(docs, bench)
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op2_benchmark_lsi"](spark, SF001).collect()}
    copies = {k for k, v in want.items() if v[0] == "copy"}
    print(len(want), len(copies), len(got), len(set(want) - set(got)))
    assert set(got) <= set(want) and len(copies) > 5
    assert copies <= set(got)
    assert len(set(got) & set(want)) >= 0.9 * len(want)


def make(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_planted_and_edges(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst" for d in "aeiouy"] + ["the", "of", "and"] * 100
    items = [(k, make(rng, rng.randint(12, 40), words)) for k in range(30)]
    docs = [(k, make(rng, rng.randint(5, 400), words)) for k in range(200)]
    want = set()
    for k, (item, text) in enumerate(items):
        copy = text.upper().replace(" ", ",  ", 3)
        docs.append((1000 + k, f"{make(rng, rng.randint(0, 90), words)} {copy}. {make(rng, 30, words)}"))
        w = text.split()
        for at in rng.sample(range(len(w) - 6), max(1, len(w) // 8)):
            w[at] = "replaced"
        docs.append((2000 + k, f"{make(rng, 33, words)} {' '.join(w)}"))
        want |= {(1000 + k, item), (2000 + k, item)}
    docs += [(3000, None), (3001, ""), (3002, make(rng, 30_000, words) + " " + items[3][1]), (None, items[4][1]), (1000, docs[200][1])]
    want |= {(3002, 3), (None, 4)}
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, share int")
    bench = spark.createDataFrame([*items, (90, None), (91, " .,"), (None, "some words of no item at all")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dc.contaminated(frame, bench).collect()]
    assert want <= set(got)
    assert len(got) == len(set(got)) + 1  # the repeated row
    clean = {d for d, _ in docs if d is not None and d < 1000}
    assert not clean & {d for d, _ in got}
    assert dc.contaminated(frame.limit(0), bench).count() == 0 and dc.contaminated(frame, bench.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "one two three four five six seven eight"), (6, "gamma delta epsilon zeta eta theta iota")], "item_id string, text string")
    monkeypatch.setattr(dc, "BLOCK_CHARS", 20)
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()} == {(1, "5"), (2, "6")}


def test_basis_spans_the_leading_directions(spark):
    """With one power step the randomised basis holds most of what the exact singular vectors hold, on a flat spectrum."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    items = dc.Items([(r.item_id, r.text) for r in bench])
    encoded = dc.encode_documents(docs, items, "doc_id", "text")
    items.fit(*dc.document_frequencies(encoded, len(items.vocab)))
    gram = dc.gram_times(encoded, items.idf, np.eye(len(items.vocab)))
    basis = dc.latent_basis(encoded, items.idf, rank=20)
    exact = np.sort(np.linalg.eigvalsh((gram + gram.T) / 2))[::-1][:20].sum()
    assert np.allclose(basis.T @ basis, np.eye(20), atol=1e-6)
    assert np.trace(basis.T @ gram @ basis) > 0.85 * exact


def test_matches_do_not_hang_on_the_cosine(spark):
    """Every place that can hold a match is judged, whatever the latent space says of it."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = dc.Items(sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()))
    encoded = dc.encode_documents(docs, items, "doc_id", "text")
    items.fit(*dc.document_frequencies(encoded, len(items.vocab)))
    items.project(dc.latent_basis(encoded, items.idf, rank=4, items=items))
    want = brute(docs.select("doc_id", "text").collect(), spark.read.parquet(f"{SF001}/benchmark.parquet").collect())
    got = {(r.id, items.ids[r.item]): (r.kind, r.share) for r in dc.find_matches(encoded, items, cosine=2.0).collect()}
    assert {k: v[1] for k, v in want.items()} == {k: v[1] for k, v in got.items()} and len(want) > 5


def test_every_item_has_a_direction(spark):
    """An item that no document holds still lies in the latent space."""
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    docs = spark.createDataFrame([(k, make(rng, 100, words[:100])) for k in range(60)], "doc_id long, text string")
    items = dc.Items([(k, make(rng, 20, words)) for k in range(5)] + [(5, "only here " + make(rng, 10, words[100:]))])
    encoded = dc.encode_documents(docs, items, "doc_id", "text")
    items.fit(*dc.document_frequencies(encoded, len(items.vocab)))
    basis = dc.latent_basis(encoded, items.idf, rank=8, items=items)
    for w in items.words:
        row = np.bincount(w, minlength=len(items.idf)) * items.idf
        assert np.linalg.norm(row @ basis) > 0.9 * np.linalg.norm(row)


def test_items_of_common_words(spark):
    """An item of words that stand in most passages is found as well, and weighs something."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(12)]
    item = make(rng, 14, common)
    docs = spark.createDataFrame([(k, make(rng, 200, common)) for k in range(300)] + [(900, "before it " + item + " behind it")], "doc_id long, text string")
    got = {r.doc_id: r for r in dc.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[900].kind == "copy" and got[900].share == 1 and got[900].cosine > 0


def test_column_names_of_the_caller(spark):
    """Id and item columns of any name, those of the operator's own columns too."""
    item = "the quick survey of " + " ".join(f"zeta{k}" for k in range(30))
    docs = spark.createDataFrame([(7, "before " + item + " after"), (8, "nothing " * 60)], "i long, t string")
    bench = spark.createDataFrame([(3, item)], "b long, t string")
    for name, other in (("item", "kind_of"), ("kind", "item"), ("item_id", "id"), ("__doc", "share_of"), ("id", "item_id")):
        found = dc.contaminated(docs.withColumnRenamed("i", name), bench.withColumnRenamed("b", other), name, "t", other, "t")
        assert found.columns[:2] == [name, other]
        assert [tuple(r)[:2] for r in found.collect()] == [(7, 3)]
