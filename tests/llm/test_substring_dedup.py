"""Substring dedup against a plain version; edge rows."""

from carrisk.llm import substring_dedup as sd
from carrisk.llm.queries import QUERIES
from tests.conftest import SF001


def plain(docs):
    """{id: (spans, rest)} of documents that lose something."""
    kept, out = {}, {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        spans = []
        for start, length, unit in sorted(sd.text_units(text or "")):
            where = kept.setdefault(unit, (i, start))
            if where != (i, start):
                spans.append((start, length, *where))
        if spans:
            gone = {k for s in spans for k in range(s[0], s[0] + s[1])}
            out[i] = (sorted(spans), "".join(c for k, c in enumerate(text) if k not in gone))
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = plain(docs)
    rows = QUERIES["op3_line_dedup"](spark, SF001).collect()
    assert {r.doc_id for r in rows} == set(want) and len(rows) == len(want) > 50
    for r in rows:
        assert ([tuple(s) for s in r.removed], r.text) == want[r.doc_id]
        assert r.kept_doc_ids == sorted({s[2] for s in want[r.doc_id][0]}) and r.n_removed == len(r.removed)


LONG = "One two three four five six seven."


def test_edges(spark):
    inner = "Alpha beta gamma delta epsilon zeta. Second sentence has also got six words."
    rows = [(5, LONG + "\nshort line"), (2, LONG.upper() + "  \n" + LONG), (7, f"start of it {inner} The end is over here"), (8, f"Other words {inner} tail"),
            (9, None), (10, ""), (11, "short line\nshort line"), (12, "x" * 50_000), (13, "x" * 50_000 + "\n" + "y " * 20_000), (None, LONG), (14, "\n\n  \n")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, id string")
    want = plain(rows)
    got = {r.doc_id: ([tuple(s) for s in r.removed], r.text) for r in sd.dedup(docs).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, text in rows:
        assert got[i] == want.get(i, ([], text)), i
    assert {5, 2, 8, 13} <= set(want) and None not in want and sd.dedup(docs).columns == [*docs.columns, "removed"]
    assert sd.dedup(docs.limit(0)).count() == 0
    assert sd.dedup(docs.withColumnRenamed("id", "removed")).columns == ["doc_id", "text", "removed"]
    twice = docs.where("doc_id = 11 or doc_id = 5").union(docs.where("doc_id = 5"))
    assert all(r.removed == [] for r in sd.dedup(twice).collect())  # one document given twice


def test_short_whole_lines(spark):
    """A short line that stands whole in several documents is kept once; the same words inside a line are not looked at."""
    rows = [(1, "All rights reserved.\nof its own 1"), (2, "Of its own 2\n  all rights  reserved."), (3, "All rights reserved. Released under it. " + "And more of it 3 " * 5)]
    got = {r.doc_id: (r.text, [tuple(s) for s in r.removed]) for r in sd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], []), 2: ("Of its own 2\n  ", [(15, 21, 1, 0)]), 3: (rows[2][1], [])}
