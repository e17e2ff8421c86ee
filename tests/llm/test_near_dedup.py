"""Order MinHash near-dedup against all pairs, alignment against plain DP, edge rows."""

import random
from collections import Counter
from itertools import combinations

import pytest

from carrisk.llm import near_dedup as nd
from carrisk.llm.queries import QUERIES
from tests.conftest import SF001


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    rng = random.Random(4)
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        b = list(a) if rng.random() < 0.7 else [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 2)] = [rng.choice("abcd") for _ in range(rng.randint(0, 2))]
        for most in (1, 2, 5, 12, 30):
            assert nd.banded_distance(a, b, most) == min(plain_distance(a, b), most + 1), (a, b, most)


def kmers(text):
    w = nd.normalised(text).split()
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def test_query_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op5_order_minhash"](spark, SF001).collect()}
    assert set(rows) == set(texts)
    sets = {i: kmers(t) for i, t in texts.items()}
    at = {}
    for i, s in sets.items():
        for k in s:
            at.setdefault(k, []).append(i)
    candidates = {p for ids in at.values() if len(ids) < 200 for p in combinations(sorted(ids), 2)}
    linked = 0
    for a, b in candidates:
        both = sum((sets[a] & sets[b]).values())
        if both >= 0.8 * sum((sets[a] | sets[b]).values()):
            linked += 1
            assert rows[a].class_id == rows[b].class_id, (a, b)
    assert linked > 20
    classes = {}
    for i, r in rows.items():
        classes.setdefault(r.class_id, []).append(i)
    for c, ids in classes.items():  # every class hangs together by similar pairs
        assert c == min(ids)
        words = {i: nd.normalised(texts[i]).split() for i in ids}
        reached, todo = {c}, [c]
        while todo:
            i = todo.pop()
            for j in ids:
                if j not in reached and nd.edit_similarity(words[i], words[j], 0.8) >= 0.8:
                    reached.add(j)
                    todo.append(j)
        assert reached == set(ids)


def test_stars_leave_no_link(spark, monkeypatch):
    """A bucket whose least member is like nobody: the others still meet, block by block."""
    monkeypatch.setattr(nd, "BLOCK", 3)
    rng = random.Random(6)
    shared = [f"s{k}" for k in range(60)]
    base = {g: [f"g{g}w{k}" for k in range(40)] for g in range(6)}
    rows = []
    for g in range(6):
        for c in range(5):
            words = shared + base[g]
            words[rng.randrange(60, 100)] = f"x{g}{c}"
            rows.append((g * 10 + c, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert got == {i: i - i % 10 for i, _ in rows}


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "Two  words"), (6, "two words more"), (7, long), (8, long + " end"), (None, "two words"),
            (None, "alone here"), (9, "a a a a a a a a a a a a"), (10, "a a a a a a a a a a a a a"), (4, "two words")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, class_id int")
    out = nd.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.class_id for r in out if r.doc_id is not None}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9}
    assert sorted(str(r.class_id) for r in out if r.doc_id is None) == ["4", "None"]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [[], [""], ["a"], ["", "a b c d e f", ""], ["a b c d e"] * 3])
def test_sketch_shapes(texts):
    import pyarrow as pa

    keys, n = nd.order_sketches(pa.array(texts, pa.large_string()))
    assert keys.shape == (len(texts), nd.ENTRIES) and n.tolist() == [len(t.split()) for t in texts]
    assert (len(set(map(tuple, keys.tolist()))) == 1) or len(set(texts)) != 1


def test_few_common_keys(spark, monkeypatch):
    """A text whose best hub is not similar still meets its near copy, if they share a single key."""
    import pyarrow as pa

    monkeypatch.setattr(nd, "ENTRIES", 20)
    monkeypatch.setattr(nd, "TAKEN", 3)

    rng = random.Random(8)
    rows, want, cases = [], {}, 0
    while cases < 6:
        base = [f"c{cases}w{rng.randrange(10**6)}" for _ in range(80)]
        variant = list(base)
        for at in rng.sample(range(80), 9):
            variant[at] = f"v{rng.randrange(10**6)}"
        hub = variant[:52] + [f"h{rng.randrange(10**6)}" for _ in range(28)]
        texts = [" ".join(t) for t in (hub, base, variant)]
        keys, _ = nd.order_sketches(pa.array(texts, pa.large_string()), entries=20, taken=3)
        agree = lambda a, b: int((keys[a] == keys[b]).sum())
        if not 1 <= agree(1, 2) <= 2 or agree(0, 2) <= agree(1, 2) or ((keys[0] == keys[1]) & (keys[1] == keys[2])).any():
            continue
        rows += [(cases * 10 + k, t) for k, t in enumerate(texts)]
        want |= {cases * 10: cases * 10, cases * 10 + 1: cases * 10 + 1, cases * 10 + 2: cases * 10 + 1}
        cases += 1
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_bags_set_no_link_aside():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    for _ in range(200):
        a = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 700))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5)):
            at = rng.randrange(len(b))
            b[at:at + 1] = rng.choice(([], [f"w{rng.randrange(300)}"], [b[at], "new"]))
        word, owner, n = nd.word_hashes(pa.array([" ".join(a), " ".join(b)], pa.large_string()))
        assert n.tolist() == [len(a), len(b)]
        bags = nd.word_bags(word, owner, 2).astype(np.int64)
        assert max(np.maximum(bags[0] - bags[1], 0).sum(), np.maximum(bags[1] - bags[0], 0).sum()) <= plain_distance(a, b)


@pytest.mark.parametrize("similar", [0.8, 0.85, 0.9, 0.95])
def test_recall_at_edit_similarity(similar):
    """Of pairs whose words are replaced here and there, nine of ten or more share a key, by brute force."""
    import pyarrow as pa

    rng = random.Random(int(similar * 100))
    texts = []
    for pair in range(250):
        base = [f"w{rng.randrange(20_000)}" for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(200), round(200 * (1 - similar))):
            other[at] = f"v{rng.randrange(10**6)}"
        assert nd.edit_similarity(base, other, 0.5) >= similar - 1e-9
        texts += [" ".join(base), " ".join(other)]
    keys, _ = nd.order_sketches(pa.array(texts, pa.large_string()))
    met = (keys[0::2] == keys[1::2]).any(1).mean()
    assert met >= 0.9


def test_similar_pairs_are_of_one_class(spark):
    """Whole runs on pairs of edit similarity 0.8 to 0.95: recall of 0.9 or more, and no stranger joins."""
    rng = random.Random(77)
    rows, pairs = [], {}
    for pair in range(160):
        similar = (0.8, 0.85, 0.9, 0.95)[pair % 4]
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(200), round(200 * (1 - similar))):
            other[at] = f"v{rng.randrange(10**6)}"
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(other))]
        pairs.setdefault(similar, []).append(pair)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c // 2 == i // 2 for i, c in got.items())
    for similar, which in pairs.items():
        assert sum(got[2 * p + 1] == 2 * p for p in which) >= 0.85 * len(which), similar


def test_group_of_near_copies_is_settled_in_tasks(spark, monkeypatch):
    """A hundred texts of one passage and endings of their own: blocks of every kind, classes as by brute force."""
    monkeypatch.setattr(nd, "BLOCK", 20)
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for i in range(100):
        rows.append((i, " ".join(passage + [f"e{rng.randrange(12)}x{k}" for k in range(rng.choice([10, 14, 18, 30]))])))
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = [nd.normalised(t).split() for _, t in rows]
    parent = list(range(100))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(100), 2):
        if nd.edit_similarity(words[i], words[j], 0.8) >= 0.8 and find(i) != find(j):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in range(100)}


def test_joins_make_a_row_a_text(spark):
    """A text of many buckets meets its sketch and words in one row; its buckets come out of it after the joins."""
    rows = spark.createDataFrame([(k, i, i % 2 == 0) for i in range(5) for k in range(40)], "key long, node long, rare boolean")
    side, other = (spark.createDataFrame([(i, f"{c}{i}") for i in range(5)], f"node long, {c} string") for c in "xy")
    full = nd._once_a_node(rows, side, other)
    assert sorted((r.key, r.node, r.rare, r.x, r.y) for r in full.collect()) == sorted((k, i, i % 2 == 0, f"x{i}", f"y{i}") for i in range(5) for k in range(40))
    grouped = nd._once_a_node(rows, side.limit(0))
    assert grouped.count() == 0
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("collect_list")


def test_rows_of_one_id_are_one_document(spark):
    """The near copies of both texts of an id are of its class."""
    base = [" ".join(f"{c}{k}" for k in range(60)) for c in "xyz"]
    rows = [(1, base[0]), (5, base[0] + " end"), (5, base[1]), (5, base[1]), (7, base[1] + " end"), (8, base[2])]
    got = {r.doc_id: (r.copy_of, r.class_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 5: (5, 1), 7: (7, 1), 8: (8, 8)}


def test_only_the_result_stays_on_disk(spark):
    from carrisk.llm.shared_files import filesystem
    from carrisk.session import ensure_checkpoint_dir
    from pyarrow import fs

    def tables():
        files, path = filesystem(f"{ensure_checkpoint_dir(spark)}/llm")
        return {f.path for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True))}

    before = tables()
    shared = [f"s{k}" for k in range(60)]
    rows = [(i, " ".join(shared + [f"g{i // 3}w{k}" for k in range(40)] + [f"e{i}"])) for i in range(12)]
    classes = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in tables() - before] == ["classes"]
    assert {r.doc_id: r.class_id for r in classes.collect()} == {i: i - i % 3 for i in range(12)}
