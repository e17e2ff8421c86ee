"""The pipeline against plain versions of its stages; edge rows through every stage."""

import hashlib

import corpus_pipeline
import pytest
from carrisk.llm import near_dedup, quality
from carrisk.llm.common import table
from carrisk.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.test_decontaminate import brute
from tests.llm.test_pii import plain_text
from tests.llm.test_tokens import ENCODING

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark):
    docs = table(spark, SF001, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    rules = quality.default_rules()
    figures = quality.Figures(list(texts.values()))
    rejected = [r.rejects(figures) for r in rules]
    good = {i for k, i in enumerate(texts) if not any(r[k] for r in rejected)}
    kept = stages["quality_rules"](spark, docs, SF001)
    assert kept.columns == docs.columns == COLUMNS
    assert {r.doc_id for r in kept.collect()} == good
    # each later stage, with what its predecessor kept, as run() does it
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(kept).collect()}
    single = {i for i, c in classes.items() if i == c}
    assert {r.doc_id for r in stages["near_duplicates"](spark, kept, SF001).collect()} == single
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    left = kept.where(kept.doc_id.isin(list(single))).collect()
    clean = single - {d for d, _ in brute(left, bench)}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF001).collect()}
    assert set(rows) == clean
    for i, r in rows.items():
        text = plain_text(texts[i])
        assert r.token_ids == ENCODING.encode_ordinary(text) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "word " * 5), (5, "x" * 30_000), (6, " ".join(f"w{chr(97 + k % 26)}{k}" for k in range(80))),
         (6, " ".join(f"w{chr(97 + k % 26)}{k}" for k in range(80))), (7, " ".join(f"w{chr(97 + k % 26)}{k}" for k in range(80)) + " end"),
         (None, "null id with some words " * 3), (8, " ".join(f"v{k}a" for k in range(20_000))), (9, "+1 (988) 555-2485 " + " ".join(f"q{k}z" for k in range(70)))]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_edge_rows(spark, name):
    names = ["kept", "failed_rule", "class_id", "found", "token_ids", "id", "share", "n_words"]
    docs = spark.createDataFrame([(*r, "en", None, 1, *[2] * len(names)) for r in EDGES], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} int" for n in names))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF001)
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    every = sorted((r[0] for r in EDGES), key=str)
    want = {"quality_rules": [6, 6, 7, 8, 9], "near_duplicates": [1, 4, 5, 6, 8, 9, None]}.get(name, every)
    assert ids == sorted(want, key=str)
    if name != "byte_bpe":
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), SF001).count() == 0


def test_registered():
    import __spark_entry__
    found = __spark_entry__.queries()
    assert "pipeline" in found and set(QUERIES) <= set(found) and len({n.split("_")[0] for n in QUERIES if n.startswith("op")}) == 13
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_one_id_with_several_texts(spark):
    """Each text of a repeated id is judged by itself: the near copy goes, the other ones stay."""
    base = [" ".join(f"{c}{chr(97 + k % 26)}{k}" for k in range(80)) for c in "xyz"]
    rows = [(1, base[0]), (5, base[0] + " end"), (5, base[1]), (5, base[2]), (5, base[2]), (7, base[1] + " end"), (8, base[2].upper())]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        got = sorted(tuple(r) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF001).collect())
        assert got == [(1, base[0]), (5, base[1]), (5, base[2])]


def test_one_contaminated_text_takes_no_other_with_it(spark):
    """Rows without an id, or of one id, are judged each by its own text."""
    item = next(r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect() if len(r.text.split()) > 30)
    clean = [" ".join(f"{c}{chr(97 + k % 26)}{k}" for k in range(90)) for c in "xyz"]
    dirty = clean[0] + " " + item
    rows = [(None, dirty), (None, clean[0]), (None, None), (4, dirty), (4, clean[1]), (5, clean[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in dict(corpus_pipeline.STAGES)["decontaminated"](spark, docs, SF001).collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)
