"""Quantiles and ranks on per-value counts: exact, and no task holds a hot value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrisk.operators import metrics, rank


def _hot(spark, n=1200):
    """A third of the rows tie at 0; there is no tie-break key."""
    rows = [("OOS" if i % 3 else "Clean", 0.0 if i % 3 == 0 else float(i % 97) / 7, "g%d" % (i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "y string, v double, g string").repartition(8)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_equal_type_7(spark, by):
    df = _hot(spark).withColumn("w", F.when(F.col("v") > 3, F.col("v") ** 2))
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    rows = rank.quantiles(df, {"v": "v", "w": "w"}, probs, by).collect()
    data = df.toPandas()
    assert len(rows) == 2 * (2 if by else 1)
    for r in rows:
        part = data[data.g == r.g] if by else data
        values = part[r["column"]].dropna().to_numpy()
        assert r.n == len(values) and np.allclose(r.q, np.quantile(values, probs))


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, v double")
    got = {r.g: (r.n, r.q) for r in rank.quantiles(df, {"v": "v"}, [0.5], ["g"]).collect()}
    assert got == {"a": (0, [None]), "b": (1, [2.0])}
    assert rank.quantiles(df.limit(0), {"v": "v"}, [0.5]).count() == 0


def test_no_task_holds_the_tied_rows(spark):
    df = _hot(spark)
    ranked = rank.row_number(df, [F.col("v").asc()], num_partitions=8)
    per_task = [r["count"] for r in ranked.df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) < 400 and sorted(r.rn for r in ranked.df.collect()) == list(range(1, 1201))
    counts = rank.value_mid_ranks(df, "v")
    assert counts.count() == df.select("v").distinct().count()  # a hot value is one row from the aggregate on
    assert counts.agg(F.sum("cnt")).first()[0] == 1200


def test_auc_roc_and_kruskal_on_ties(spark):
    data = _hot(spark).toPandas()
    pos, neg = data[data.y == "OOS"].v.to_numpy(), data[data.y == "Clean"].v.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    df = _hot(spark)
    assert abs(metrics.auc(df, "y", "v") - want) < 1e-12
    roc = {r.threshold: (r.tp, r.fp) for r in metrics.roc_points(df, "y", "v").collect()}
    assert roc == {t: (int((pos >= t).sum()), int((neg >= t).sum())) for t in set(data.v)}
    ranks = data.v.rank().to_numpy()
    n = len(data)
    ties = data.v.value_counts().to_numpy().astype(float)
    h = 12 / (n * (n + 1)) * sum(ranks[data.g == g].sum() ** 2 / (data.g == g).sum() for g in ("g0", "g1")) - 3 * (n + 1)
    assert abs(metrics.kruskal_wallis(df, "v", "g").first().H - h / (1 - (ties ** 3 - ties).sum() / (n ** 3 - n))) < 1e-9


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), F.lit(2).alias("c"))
    rows = rank.cumulate(df, [F.col("k").desc()], ["g"], {"c": "before"}, {"c": "all"}, num_partitions=7).collect()
    for r in rows:
        later = [k for k in range(500) if k % 3 == r.g and k > r.k]
        assert r.before == 2 * len(later) and r["all"] == 2 * len([k for k in range(500) if k % 3 == r.g])
