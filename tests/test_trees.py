"""The trees' NumPy work against Spark ML's own trees, Spark's hashes and plain loops."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from carrisk.operators import bagging, trees
from tests.test_model import FEATURES, frame  # noqa: F401

WIDE = (*FEATURES, "few", "flag")


@pytest.fixture(scope="module")
def data(spark):
    """Rows with continuous, tied and two-valued features, and weights of their own."""
    uniform = lambda tag: F.pmod(F.xxhash64(F.col("id"), F.lit(tag)), F.lit(1_000_003)) / 1_000_003.0
    df = spark.range(1500).select(F.col("id").cast("string").alias("dot_number"), uniform("s").alias("signal"), uniform("a").alias("noise_a"),
                                  F.log1p(F.floor(uniform("b") * 200)).alias("noise_b"), F.floor(uniform("c") * 7).alias("few"),
                                  (uniform("d") < 0.3).alias("flag"), uniform("y").alias("u"))
    df = df.withColumn("label", (F.col("u") < F.when(F.col("signal") > 0.5, 0.8).otherwise(0.3)).cast("double")).drop("u")
    df = df.withColumn("oos_flag", F.when(F.col("label") == 1, "OOS").otherwise("Clean"))
    return df.withColumn("weight", F.when(F.col("label") == 1, 1.25).otherwise(0.75)).withColumn("fold", F.pmod(F.xxhash64("dot_number"), F.lit(3)).cast("int")).coalesce(2).persist()


def shape(tree):
    """((depth, feature, threshold) or (depth, P)) of all nodes, the first child first."""
    out, todo = [], [(0, 0)]
    while todo:
        at, depth = todo.pop()
        child, feature, split = int(tree.code[at]) >> 32, int(tree.code[at]) >> 16 & 0xFFFF, int(tree.code[at]) & 0xFFFF
        if tree.is_leaf()[at]:
            out.append((depth, round(float(tree.prob[at]), 9)))
        else:
            out.append((depth, feature, round(float(tree.splits[feature][split]), 12)))
            todo += [(child + 1, depth + 1), (child, depth + 1)]
    return out


def spark_shape(model):
    out, todo = [], [(model.trees[0]._java_obj.rootNode(), 0)]
    while todo:
        node, depth = todo.pop()
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            out.append((depth, round(stats[1] / sum(stats), 9)))
        else:
            out.append((depth, node.split().featureIndex(), round(node.split().threshold(), 12)))
            todo += [(node.rightChild(), depth + 1), (node.leftChild(), depth + 1)]
    return out


@pytest.mark.parametrize("node_size, max_depth, max_bins", [(1, 30, 64), (20, 30, 64), (60, 30, 16), (5, 4, 64)])
def test_a_tree_is_that_of_spark(data, node_size, max_depth, max_bins):
    """The same rows, weights and features give the same nodes, probabilities and importances."""
    rows = bagging.assembler(WIDE).transform(data)
    theirs = bagging.detached(RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=1, bootstrap=False, featureSubsetStrategy="all",
                                                     minInstancesPerNode=node_size, maxDepth=max_depth, maxBins=max_bins, seed=7).fit(rows))
    held = bagging.rows_for_trees(data, WIDE, "dot_number")
    splits = bagging.thresholds(held, 1500, len(WIDE), max_bins, 42)
    r = bagging.brought(bagging.packed(held, splits), splits)
    every = (np.arange(1500), r["w"], np.ones(1500, np.int64))
    ours = trees.grow([1], r["x"], r["y"], [every], trees.Rules(len(WIDE), len(WIDE), node_size, max_bins, max_depth, 42), splits)[0]
    assert shape(ours) == spark_shape(theirs) and ours.numNodes == theirs.trees[0].numNodes > 5
    assert np.allclose(ours.importance, theirs.featureImportances.toArray(), atol=1e-9)
    scored = theirs.transform(rows).select(F.xxhash64("dot_number").alias("h"), vector_to_array("probability")[1].alias("p")).collect()
    p = dict(zip(r["h"].view(np.int64).tolist(), ours.prob[trees.leaves(ours.code, r["x"])].tolist()))
    assert all(abs(p[s.h] - s.p) < 1e-12 for s in scored)


def test_bags_are_those_of_the_columns(spark):
    """Counts and left-out rows in tasks are those of the column expressions: large and zero rates, a NULL key."""
    rate = F.when(F.col("id") % 10 == 0, 500.0).when(F.col("id") % 7 == 0, 0.0).otherwise((F.col("id") % 5).cast("double") / 2)
    rows = spark.range(400).select(F.when(F.col("id") != 3, F.concat(F.lit("k"), "id")).alias("key"), rate.alias("rate"))
    rows = rows.select("*", bagging.key_hash("key").alias("h"), *[f(F.col("key"), t, 42, F.col("rate")).alias(f"{n}{t}") for t in (1, 77) for n, f in (
        ("count", bagging.bag_count), ("out", bagging.is_out_of_bag))]).collect()
    for rates in (np.array([r.rate for r in rows]), np.full(400, 1.0)):
        bags = trees.Bags(np.array([r.h for r in rows]).view(np.uint64), rates, 42)
        for t in (1, 77):
            if rates[0] == 500.0:
                assert bags.counts(t).tolist() == [r[f"count{t}"] for r in rows] and bags.left_out(t).tolist() == [r[f"out{t}"] for r in rows]
            assert ((bags.counts(t) == 0) == bags.left_out(t)).all()


def test_features_of_a_node():
    """Each feature stands in its share of the subsets; a subset has no feature twice."""
    found = trees.subsets(trees.roots(np.arange(20_000), 42), 16, 4)
    assert (np.diff(found, axis=1) > 0).all()
    assert np.abs(np.bincount(found.reshape(-1), minlength=16) / 20_000 - 0.25).max() < 0.015


@pytest.mark.parametrize("case_weights", ["bootstrap", "impurity"])
def test_rows_left_in_their_blocks_give_the_same_trees(data, monkeypatch, case_weights):
    """Cells that are added up over blocks and levels grow the trees that a task grows whole, whatever the size of a job."""
    text = lambda f: [t.toDebugString for t in f.trees]
    whole = bagging.fit(data, WIDE, 2, 15, 12, case_weights=case_weights, max_depth=8)
    monkeypatch.setattr(trees, "CELLS", 200)
    small = bagging.fit(data, WIDE, 2, 15, 12, case_weights=case_weights, max_depth=8)
    monkeypatch.setattr(bagging, "LOCAL_BYTES", 0)
    monkeypatch.setattr(bagging, "JOB_NODES", 40)
    apart = bagging.fit(data, WIDE, 2, 15, 12, case_weights=case_weights, max_depth=8)
    assert text(whole) == text(small) == text(apart) and len(set(text(whole))) == 12


def test_fold_scores_are_those_of_forests_of_the_other_folds(data, monkeypatch):
    """All (configuration, fold) forests score each row once; pieces and blocks do not change a score."""
    configs = [(2, 20), (5, 100)]
    scores = lambda **more: sorted(tuple(r) for r in bagging.fold_scores(data, WIDE, configs, 3, 6, max_depth=5, **more).select(
        "mtry", "min_node_size", "fold", "positive", F.round("prob", 9)).collect())
    found = scores()
    assert len(found) == len(configs) * data.count() and scores(piece=4) == found
    held = bagging.rows_for_trees(data, WIDE, "dot_number", F.col("fold"))
    for k in range(3):
        others = held.where(F.col("fold") != k)
        splits = bagging.thresholds(others, others.count(), len(WIDE), 64, 42)
        r = bagging.brought(bagging.packed(held, splits, "fold"), splits)
        fitted, kept = r["fold"] != k, r["fold"] == k
        bags, rules = trees.Bags(r["h"][fitted], np.ones(fitted.sum()), 42), trees.Rules(5, 2, 20, 64, 5, 42)
        p = sum(trees.probabilities(t, r["x"][kept]) for t in bagging.grown(range(1, 7), r["x"][fitted], r["y"][fitted], r["w"][fitted], bags, rules, splits, False, True)) / 6
        assert sorted(np.round(p, 9).tolist()) == [x[4] for x in sorted(found, key=lambda x: x[4]) if x[:3] == (2, 20, k)]
    monkeypatch.setattr(bagging, "LOCAL_BYTES", 0)
    monkeypatch.setattr(bagging, "CHUNK", 3)
    assert scores() == found


def test_importance_is_that_of_the_copies(data):
    """Scores summed in tasks equal those of ``oob_copies``, tree by tree."""
    forest = bagging.fit(data, WIDE, 2, 15, 5, max_depth=6)
    got = {r.feature: r.importance for r in bagging.oob_importance(forest, data, 200).collect()}
    buckets, rise = bagging.gathered(data, forest, 200), {f: [] for f in WIDE}
    for t in range(1, 6):
        rows, loss = bagging.oob_copies(buckets, forest, t).collect(), {}
        p = trees.probabilities(forest.trees[t - 1], trees.binned(np.array([r.x for r in rows]), forest.splits))
        for r, score in zip(rows, p.tolist()):
            loss.setdefault(r.j, []).append((score - r.label) ** 2)
        for j, f in enumerate(WIDE):
            rise[f].append(np.mean(loss[j]) - np.mean(loss[-1]))
    assert all(abs(got[f] - np.mean(rise[f])) < 1e-9 for f in WIDE)


def test_missing_values_go_with_the_largest(spark):
    """A missing feature value stands above every threshold, in the fit and in all scores."""
    rows = spark.range(200).select(F.col("id").cast("string").alias("dot_number"), F.when(F.col("id") % 4 != 0, (F.col("id") % 4).cast("double")).alias("x"),
                                   F.lit(1.0).alias("weight"), (F.col("id") % 4 == 0).cast("double").alias("label"))
    forest = bagging.fit(rows, ["x"], 1, 1, 5)
    found = {r.x: r.prob for r in forest.score(rows).collect()}
    assert found[None] == found[3.0] > found[1.0] == found[2.0]
