"""Vector codes against a plain version that measures every distance, and the bounds against a full search."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrisk.llm import vector_codes as V
from carrisk.llm.queries import ORACLE, QUERIES
from tests import harness
from tests.conftest import SF001


def plain(rows, parts=16, entries=64, rounds=2):
    """[(id, label, vector)] -> ({position in rows: (code, error)}, digest), in Python integers."""
    kept = [(i, r) for i, r in enumerate(rows) if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    kept.sort(key=lambda t: (t[1][0] is None, t[1][0] if t[1][0] is not None else 0, t[1][2]))
    if not kept:
        return {}, None
    dims = len(kept[0][1][2])
    kept = [k for k in kept if len(k[1][2]) == dims]
    ints = [[math.floor(256 * x) for x in r[2]] for _, r in kept]
    at = [p * dims // parts for p in range(parts + 1)]
    books = [[v[at[p]:at[p + 1]] for v in ints[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in ints:
                members.setdefault(nearest(p, v[at[p]:at[p + 1]])[1], []).append(v[at[p]:at[p + 1]])
            for e, vs in members.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    out = {}
    for (i, _), v in zip(kept, ints):
        found = [nearest(p, v[at[p]:at[p + 1]]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return out, digest


def check(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"vec_id {kind}, label int, embedding array<double>")
    got = sorted((tuple(r) for r in V.vector_codes(df).collect()), key=repr)
    want, digest = plain(rows)
    sums = {}
    for i, (_, error) in want.items():
        sums[rows[i][1]] = sums.get(rows[i][1], 0) + error
    assert got == sorted(((rows[i][0], rows[i][1], code, error, sums[rows[i][1]], digest) for i, (code, error) in want.items()), key=repr)
    return got


def vectors(n, dims, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return [(int(i), int(i % 5) if i % 11 else None, (centres[i % 7] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


def test_clustered_vectors(spark):
    assert len(check(spark, vectors(600, 32))) == 600


def test_odd_rows(spark):
    rows = vectors(150, 32)
    rows += [(900, 1, None), (901, 1, [None] * 32), (902, 1, [float("nan")] + [0.0] * 31), (903, 2, [float("inf")] * 32), (904, 2, [0.5] * 31), (905, 2, [])]
    rows += [(5, 3, rows[5][2]), (None, None, [0.25] * 32), (None, 4, [-0.25] * 32), (7, 0, [1e-300] * 32)]
    assert len(check(spark, rows)) == 154


@pytest.mark.parametrize("n, dims", [(1, 16), (3, 32), (40, 20), (70, 5), (80, 48)])
def test_few_rows_and_lengths_that_16_does_not_divide(spark, n, dims):
    check(spark, vectors(n, dims))


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, i % 2, [float((i * 7 + j) % 3 - 1) for j in range(16)]) for i in range(200)]
    check(spark, rows)


def test_very_large_components(spark):
    rows = [(i, None, [float(2 ** 40 * (i % 9 - 4) + i), float(-i)] * 8) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want, digest = plain(rows)
    got = {r.vec_id: r for r in V.vector_codes(df).collect()}
    for i, (code, error) in want.items():
        assert got[i].code == code and got[i].codebooks_sha256 == digest and got[i].error == (error if error < 2 ** 63 else None)


def test_empty_extra_columns_and_text_ids(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert V.vector_codes(empty).count() == 0
    rows = vectors(100, 16)
    df = spark.createDataFrame([(f"v{i:03}", str(label), v) for i, label, v in rows], "name string, tag string, v array<double>")
    noisy = df.select("*", *[F.lit(1).alias(c) for c in ("id", "label", "kind", "vector", "code", "error", "__label", "vec_id")])
    got = {r.name: r.code for r in V.vector_codes(noisy, "name", "v", "tag").collect()}
    assert got == {f"v{i:03}": code for i, (code, _) in plain(rows)[0].items()}


def test_label_sums_beyond_the_broadcast(spark):
    codes = spark.createDataFrame([(i, None if i % 3 == 0 else i % 4, "00", i) for i in range(100)], "id long, label int, code string, error long")
    a, b = (sorted(map(tuple, V.with_label_errors(codes, n).select("id", "label_error").collect())) for n in (V.SMALL_LABELS, 0))
    assert a == b and len(a) == 100


def test_bounds_leave_out_work_and_change_nothing():
    rng = np.random.default_rng(3)
    book = rng.integers(-90, 90, (64, 6))
    x = book[rng.integers(0, 64, 4000)] + rng.integers(-12, 13, (4000, 6))
    _, _, tracked, bounds = V.full_search(x, book, 8)
    left_out = []
    for step in (3, 2, 1, 0):
        new = book + rng.integers(-step, step + 1, book.shape)
        moves = V.root(V.own_distances(new, book), up=True)
        bounds = V.unpacked(V.packed(bounds))
        best, distance, tracked, bounds, searched, place = V.bounded_search(x, new, moves, tracked, bounds)
        want = V.distances(x, new)
        assert (best == want.argmin(1)).all() and (distance == want.min(1)).all()
        for j in range(tracked.shape[1]):  # bounds hold
            assert (bounds[:, j] <= np.sqrt(want[np.arange(len(x)), tracked[:, j]]) + 1e-9).all()
        others = np.ones(want.shape, bool)
        np.put_along_axis(others, tracked, False, 1)
        assert (bounds[:, -1] <= np.sqrt(np.where(others, want, np.iinfo(np.int64).max).min(1)) + 1e-9).all()
        left_out.append(1 - searched.mean())
        b = V.adapted(tracked.shape[1], searched, place)
        assert V.LEAST <= b <= V.MOST
        tracked, bounds = V.resized(tracked, bounds, b)
        book = new
    assert min(left_out) > 0.8


def test_packed_bounds_are_lower():
    values = np.concatenate([np.random.default_rng(1).uniform(0, 1e6, 10_000), [0, 1e-40, 1e38, 3e39, np.inf]])
    low = V.unpacked(V.packed(values))
    assert (low <= values).all() and (low[:10_000] >= values[:10_000] * 0.99).all()


def test_sql(spark):
    con = harness.duck(SF001)
    found = con.sql(ORACLE["op13_vector_codes"]).arrow()
    found = found.read_all() if hasattr(found, "read_all") else found
    assert harness.compare(QUERIES["op13_vector_codes"](spark, SF001).toArrow(), found) == []
