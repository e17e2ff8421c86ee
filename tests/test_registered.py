"""Every registered query without SQL gives rows, in one session that has built the master first."""

from pyspark.sql import functions as F

from carrisk.operators import bagging
from carrisk.plans import master as M
from carrisk.plans import queries_model, queries_segment
from carrisk.plans.registry import ORACLE, QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"


def test_queries_without_sql_run_after_the_master(spark, monkeypatch):
    for module, name, value in ((queries_model, "TREES_FINAL", 12), (queries_model, "TREES_CV", 3),
                                (queries_segment, "SEARCH_STARTS", 1), (queries_segment, "FINAL_STARTS", 2), (queries_segment, "K_MAX", 4)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(queries_model, "_CACHE", {})
    monkeypatch.setattr(queries_segment, "_CACHE", {})
    assert M.master_for(spark, SF).count() > 0
    empty = [name for name in sorted(set(QUERIES) - set(ORACLE)) if QUERIES[name](spark, SF).isEmpty()]
    assert empty == []
    table = {r.metric: r for r in QUERIES["ablation"](spark, SF).collect()}
    assert 0 < table["OOB Error"]["Strict (8)"] < 1 and table["OOB Error"]["delta"] is not None
    curve = [r.num_trees for r in QUERIES["oob_curve"](spark, SF).collect()]
    assert curve == [10]
    assert {r.model for r in QUERIES["roc_both_models"](spark, SF).select("model").distinct().collect()} == {e.name for e in queries_model.evaluations(spark, SF)}


def test_forests_score_after_an_observation(spark):
    """A session that has observed something still ships fitted forests to its tasks."""
    from pyspark.sql import Observation

    from carrisk.operators import model
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    rows = spark.range(60).select(F.col("id").cast("string").alias("dot_number"), (F.col("id") % 2).cast("double").alias("label"),
                                  F.lit(1.0).alias("weight"), (F.col("id") % 7).cast("double").alias("x"))
    assert model.score(model.fit_forest(rows, ["x"], 1, 2, 3), rows, ["x"]).count() == 60
    assert bagging.fit(rows, ["x"], 1, 2, 3).score(rows).count() == 60
