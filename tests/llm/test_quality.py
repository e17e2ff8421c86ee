"""Quality cascade: SQL, order independence, edge rows."""

import random

from carrisk.llm import quality
from carrisk.llm.queries import ORACLE, QUERIES
from tests import harness
from tests.conftest import SF001


def test_sql(spark):
    want = harness.duck(SF001).sql(ORACLE["op8_quality_cascade"]).to_arrow_table()
    assert harness.compare(QUERIES["op8_quality_cascade"](spark, SF001).toArrow(), want) == [] and want.num_rows


def plain_repeat(text):
    w = text.encode().split()
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_repeat_words_and_lines():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", "a", "a b", "x y z", "\n\n"]
    f = quality.Figures(texts)
    assert f["n_repeat_words"].tolist() == [plain_repeat(t) for t in texts]
    lines = ["a\na\nb", "\n\n \n", "a\r\na", " a\na", "", "x\nx\nx"]
    assert quality.Figures(lines)["n_dup_lines"].tolist() == [1, 0, 0, 0, 0, 2]
    assert quality.Figures(["a b c", "\x1cx"])["n_words"].tolist() == [2, 1]


def test_order_changes_no_verdict(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rules = quality.default_rules()
    found = []
    for order in (rules, rules[::-1]):
        monkeypatch.setattr(quality, "order_rules", lambda *a, o=order: [r.name for r in o])
        found.append({r.doc_id: (r.kept, r.failed_rule is None) for r in quality.apply_rules(docs, with_base=False).collect()})
    assert found[0] == found[1]


def test_edges(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(60))
    rows = [(1, None, 5), (2, "", 5), (3, good, None), (3, good, None), (None, "*** " * 80, 1), (5, "w" * 50_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words_ int")
    out = quality.apply_rules(docs, keep=("doc_id", "n_words_")).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in out) == [(0, False), (1, False), (2, False), (3, True), (3, True), (5, False)]
    assert quality.apply_rules(docs.limit(0)).count() == 0
    named = docs.withColumnRenamed("n_words_", "kept")
    assert [r.kept for r in quality.apply_rules(named, keep=("doc_id", "kept")).collect()] == [r.kept for r in out]
    assert set(quality.order_rules(docs, quality.default_rules())) == {r.name for r in quality.default_rules()}


def test_sample_at_every_size(spark):
    """The share of rows in the sample holds for any total, past 2e9 rows too; copies are sampled row by row."""
    for total in (1, 2000, 10**6, 10**9, 3 * 10**9, 10**13):
        limit = quality.sample_limit(total, 2000)
        assert abs((limit + 1) / 2**63 * total - min(total, 2000)) < 1e-3 * min(total, 2000)
        assert limit >= 0
    assert quality.sample_limit(0, 2000) == -1
    hashes = spark.range(400_000).selectExpr("xxhash64(id, 'same text') & 9223372036854775807 as h")
    share = hashes.where(f"h <= {quality.sample_limit(3 * 10**9, 15 * 10**6)}").count()
    assert 1700 < share < 2300  # half a percent
    docs = spark.range(30_000).selectExpr("id as doc_id", "'one text, many rows' as text", "map('a', 1) as m")
    assert set(quality.order_rules(docs, quality.default_rules(), sample_rows=500)) == {r.name for r in quality.default_rules()}
