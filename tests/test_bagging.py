"""Bagged forests: bags, out-of-bag counters and importance against plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from carrisk.operators import bagging, metrics, model
from tests.test_model import FEATURES, frame, split  # noqa: F401

TREES, STEPS = 30, (1, 7, 30)


@pytest.fixture(scope="module")
def data(frame):  # noqa: F811
    return frame.withColumn("weight", F.when(F.col("label") == 1, 1.5).otherwise(0.6)).persist()


@pytest.fixture(scope="module")
def forest(data):
    return bagging.fit(data, FEATURES, 2, 10, TREES, max_depth=6)


def plain_votes(forest, data):
    """{key: (label, {tree: P})} of the trees that left the row out, one tree at a time."""
    found = {r.dot_number: (r.label, {}) for r in data.collect()}
    rows = bagging.assembler(FEATURES).transform(data)
    for t in range(1, TREES + 1):
        counts = rows.select("dot_number", "features", bagging.bag_count(F.col("dot_number"), t, 42, forest.rate(F.col("weight"))).alias("n"))
        for r in forest.with_tree_scores(counts, [t], ["dot_number", "n"], {"p": F.col(f"_p{t}")}).collect():
            if r.n == 0:
                found[r.dot_number][1][t] = r.p
    return found


@pytest.fixture(scope="module")
def plain(forest, data):
    return plain_votes(forest, data)


def test_bags_follow_the_weights(spark):
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 4 == 0, 2.5).otherwise(0.5).alias("rate"))
    for rate, mean, out in rows.groupBy("rate").agg(F.avg(bagging.bag_count(F.col("k"), 3, 42, F.col("rate"))),
                                                    F.avg(bagging.is_out_of_bag(F.col("k"), 3, 42, F.col("rate")).cast("double"))).collect():
        assert abs(mean - rate) < 0.05 * math.sqrt(rate) and abs(out - math.exp(-rate)) < 0.02
    both = rows.where(bagging.is_out_of_bag(F.col("k"), 3, 42, F.col("rate")) != (bagging.bag_count(F.col("k"), 3, 42, F.col("rate")) == 0))
    assert both.isEmpty()
    large = spark.range(5000).select(bagging.bag_count(F.col("id"), 1, 42, F.lit(400.0)).alias("n")).agg(F.avg("n"), F.stddev("n")).first()
    assert abs(large[0] - 400) < 2 and abs(large[1] - 20) < 1.5


def test_bags_of_a_chunk_are_one_expression(spark):
    """The counts of many trees equal those of ``bag_count``, large rates and missing weights too; the plan does not grow with the trees."""
    rate = F.col("weight") / F.lit(2.0)
    rows = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") % 10 == 0, F.lit(500.0)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        F.col("id") % 5).cast("double").alias("weight"))
    found = bagging.with_bags(rows, range(26, 51), "key", 42, rate)
    assert found.columns == ["key", "weight", "_bags"]
    for t in (26, 37, 50):
        pairs = found.select(F.get("_bags", F.lit(t - 26)).alias("a"), bagging.bag_count(F.col("key"), t, 42, rate).alias("b"), "weight").collect()
        assert all(r.a == r.b for r in pairs) and all((r.a or 0) <= 0 for r in pairs if r.weight is None)
        assert {r.a for r in pairs if r.weight == 0} == {0} and min(r.a for r in pairs if r.weight == 500) > 200
    size = lambda last: len(bagging.with_bags(rows, range(1, last), "key", 42, rate)._jdf.queryExecution().analyzed().toString())
    assert size(1000) < size(3) + 50


def test_fit_draws_in_chunks(data, forest, monkeypatch):
    """The trees do not depend on how many share a pass over the rows."""
    monkeypatch.setattr(bagging, "CHUNK", 7)
    again = bagging.fit(data, FEATURES, 2, 10, TREES, max_depth=6)
    text = lambda f: [t.toDebugString.split("\n", 1)[1] for t in f.trees]
    assert len(again.trees) == TREES and text(again) == text(forest)


def test_class_shares_in_the_bags(data):
    """A case weight is a row's share of the draw: classes stand in a bag as weight x rows."""
    mean = data.agg(F.avg("weight")).first()[0]
    got = {}
    for t in range(1, 21):
        n = bagging.bag_count(F.col("dot_number"), t, 42, F.col("weight") / F.lit(mean))
        for label, s in data.groupBy("label").agg(F.sum(n)).collect():
            got[label] = got.get(label, 0) + s
    want = {label: s for label, s in data.groupBy("label").agg(F.sum("weight")).collect()}
    assert abs(got[1.0] / sum(got.values()) - want[1.0] / sum(want.values())) < 0.01


def test_counters_equal_a_plain_loop(forest, data, plain):
    counters = bagging.oob_counters(forest, data, STEPS)
    assert counters.count() <= len(STEPS) * data.count()
    kept = {k: v for k, v in plain.items() if v[1]}
    error = bagging.oob_error(counters).first()
    assert error.n_rows == len(kept)
    brier = sum((sum(p.values()) / len(p) - y) ** 2 for y, p in kept.values()) / len(kept)
    wrong = sum((sum(x > 0.5 for x in p.values()) / len(p) >= 0.5) != (y == 1) for y, p in kept.values()) / len(kept)
    assert abs(error.brier - brier) < 1e-9 and abs(error.error - wrong) < 1e-12
    curve = {r.num_trees: r.oob_error for r in bagging.oob_curve(counters, STEPS).collect()}
    for n in STEPS:
        seen = [(y, [x > 0.5 for t, x in p.items() if t <= n]) for y, p in plain.values()]
        seen = [(y, v) for y, v in seen if v]
        assert abs(curve[n] - sum((sum(v) / len(v) >= 0.5) != (y == 1) for y, v in seen) / len(seen)) < 1e-12
    assert curve[30] <= curve[1] and curve[30] < 0.25


def test_scores_are_the_mean_of_the_trees(forest, data):
    rows = bagging.assembler(FEATURES).transform(data)
    sums = {}
    for t in range(1, TREES + 1):
        for r in forest.with_tree_scores(rows, [t], ["dot_number"], {"p": F.col(f"_p{t}")}).collect():
            sums[r.dot_number] = sums.get(r.dot_number, 0.0) + r.p
    got = {r.dot_number: r.prob for r in forest.score(data).collect()}
    assert set(got) == set(sums) and all(abs(got[k] - sums[k] / TREES) < 1e-12 for k in got)
    assert metrics.auc(forest.score(data), "oos_flag", "prob", "OOS") > 0.85


@pytest.mark.parametrize("case_weights", ["bootstrap", "impurity"])
def test_oob_importance(data, case_weights):
    forest = bagging.fit(data, FEATURES, 2, 10, TREES, case_weights=case_weights, max_depth=6)
    rows = model.permutation_importance(forest, data).collect()
    rise = {r.feature: r.importance for r in rows}
    assert rows[0].feature == "signal" and rise["signal"] > 0.15
    assert abs(rise["noise_a"]) < 0.03 and abs(rise["noise_b"]) < 0.03
    assert abs(sum(r.impurity_importance for r in rows) - 1) < 1e-9


def test_moved_values_and_plan_size(forest, data):
    """One feature moves in each copy, its values stay the same ones; the plan does not grow with the features squared."""
    buckets = bagging.gathered(data, forest, 100)
    found = {}
    for r in bagging.oob_copies(buckets, forest, 3).collect():
        found.setdefault(r.j, []).append((r.label, tuple(r.x)))
    assert set(found) == {-1, 0, 1, 2} and len({len(v) for v in found.values()}) == 1
    left_out = data.where(forest.leaves_out(3, F.col("dot_number"), F.col("weight")))
    assert sorted(found[-1]) == sorted((r.label, tuple(r[f] for f in FEATURES)) for r in left_out.collect())
    column = lambda j, k: [x[k] for _, x in found[j]]
    for j in range(3):
        for k in range(3):
            assert sorted(column(j, k)) == sorted(column(-1, k)) and (column(j, k) == column(-1, k)) == (j != k)
    wide = data.withColumns({f"f{i}": F.col("signal") for i in range(16)})
    sizes = []
    for n in (4, 16):
        many = bagging.BaggedForest([], tuple(f"f{i}" for i in range(n)), "dot_number", 42, forest.mean_weight)
        plan = bagging.oob_copies(bagging.gathered(wide, many, 100), many, 3)
        sizes.append(len(plan._jdf.queryExecution().analyzed().toString()))
    assert sizes[1] < 4 * sizes[0]


def test_a_bag_of_one_class_or_no_row(spark):
    few = spark.createDataFrame([("a", 0.0, 1.0, 1.0), ("b", 0.0, 2.0, 1.0)], "dot_number string, label double, weight double, x double")
    forest = bagging.fit(few, ["x"], 1, 1, 8)
    assert [r.prob for r in forest.score(few).collect()] == [0.0, 0.0]
    assert bagging.oob_error(bagging.oob_counters(forest, few)).first().brier in (0.0, None)
