"""Forests, importance and OOB curve on a frame with a planted signal."""

import pytest
from pyspark.sql import functions as F

from carrisk.operators import metrics, model

FEATURES = ("signal", "noise_a", "noise_b")


@pytest.fixture(scope="module")
def frame(spark):
    """P(OOS) rises with ``signal``; the other two features say nothing."""
    uniform = lambda tag: (F.pmod(F.xxhash64(F.col("id"), F.lit(tag)), F.lit(1_000_003)) / 1_000_003.0)
    df = spark.range(900).select(F.col("id").cast("string").alias("dot_number"), uniform("s").alias("signal"),
                                 uniform("a").alias("noise_a"), uniform("b").alias("noise_b"), uniform("y").alias("u"))
    df = df.withColumn("label", (F.col("u") < F.when(F.col("signal") > 0.5, 0.9).otherwise(0.1)).cast("double"))
    df = df.withColumn("oos_flag", F.when(F.col("label") == 1, "OOS").otherwise("Clean")).withColumn("weight", F.lit(1.0)).drop("u")
    return df.coalesce(1).persist()


def split(frame):
    test = F.pmod(F.xxhash64("dot_number"), F.lit(3)) == 0
    return frame.where(~test), frame.where(test)


def test_signal_beats_noise(frame):
    train, test = split(frame)
    auc = {}
    for name, features in (("with", FEATURES), ("without", FEATURES[1:])):
        forest = model.fit_forest(train, features, 2, 10, 20, max_depth=6)
        auc[name] = metrics.auc(model.score(forest, test, features), "oos_flag", "prob", "OOS")
    assert auc["with"] > 0.8 and auc["with"] > auc["without"] + 0.2 and abs(auc["without"] - 0.5) < 0.15


def test_reruns_are_equal(frame):
    train, test = split(frame)
    scores = []
    for _ in range(2):
        forest = model.fit_forest(train, FEATURES, 2, 10, 10, seed=7, max_depth=5)
        scores.append(sorted((r.dot_number, r.prob) for r in model.score(forest, test, FEATURES).collect()))
    assert scores[0] == scores[1]


def test_a_fit_makes_no_tree_objects(frame):
    """Python objects of a forest's trees are made when asked for, not in every fit and copy of the model."""
    forest = model.fit_forest(split(frame)[0], FEATURES, 2, 10, 4, max_depth=4)
    assert "trees" not in vars(forest) and "trees" not in vars(forest.copy())
    assert forest.params and "trees" not in vars(forest)
    assert len(forest.trees) == forest.getNumTrees == 4


def test_grid_cv_finds_a_model(frame):
    cv = model.grid_cv(split(frame)[0], FEATURES, trees=5, folds=2, frac=0.8, max_depth=5)
    rows = cv.collect()
    assert len(rows) == 3 * len(model.mtry_grid(3)) and all(r.mean_auc is not None for r in rows)
    mtry, nodes, auc = model.best_params(cv)
    assert auc == max(r.mean_auc for r in rows) and auc > 0.75
    assert (mtry, nodes) in {(r.mtry, r.min_node_size) for r in rows}


def test_permutation_keeps_the_values(frame):
    shuffled = model.permute_columns(frame.select("dot_number", *FEATURES), "dot_number", FEATURES, bucket_rows=100)
    before = {r.dot_number: r for r in frame.collect()}
    after = {r.dot_number: r for r in shuffled.collect()}
    assert set(after) == set(before)
    for f in FEATURES:
        assert sorted(r[f"perm_{f}"] for r in after.values()) == sorted(r[f] for r in before.values())
        moved = sum(after[k][f"perm_{f}"] != before[k][f] for k in before)
        assert moved > 0.9 * len(before)
        assert all(after[k][f] == before[k][f] for k in before)


def test_permuted_auc_ranks_the_signal_first(frame):
    train, test = split(frame)
    forest = model.fit_forest(train, FEATURES, 2, 10, 20, max_depth=6)
    rows = model.auc_importance(forest, test, FEATURES).collect()
    drop = {r.feature: r.importance for r in rows}
    assert rows[0].feature == "signal" and drop["signal"] > 0.2
    assert abs(drop["noise_a"]) < 0.06 and abs(drop["noise_b"]) < 0.06


@pytest.mark.parametrize("size", [1, 2, 11, 37])
def test_no_value_stays_in_a_bucket(spark, size):
    df = spark.range(size).select(F.col("id").cast("string").alias("k"), *[F.col("id").cast("double").alias(f"f{i}") for i in range(5)])
    rows = model.permute_columns(df, "k", [f"f{i}" for i in range(5)], bucket_rows=size).collect()
    assert len(rows) == size
    assert all((r[f"perm_f{i}"] != r[f"f{i}"]) == (size > 1) for r in rows for i in range(5))
