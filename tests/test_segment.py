"""Segmentation on planted blobs: k recovered, labels stable, SS identity."""

import random

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from carrisk.operators import segment


def _blobs(spark, n=400):
    rnd = random.Random(7)
    centers = [(0, 0), (10, 0), (0, 10), (10, 10)]
    sizes = [160, 120, 80, 40]
    rows = []
    i = 0
    for (cx, cy), m in zip(centers, sizes):
        for _ in range(m):
            rows.append((str(i), cx + rnd.gauss(0, 0.5), cy + rnd.gauss(0, 0.5)))
            i += 1
    return spark.createDataFrame(rows, "dot_number string, a double, b double")


def test_blobs_recovered_and_labels_stable(spark):
    df = _blobs(spark)
    x = segment.scaled(df, ("a", "b")).persist()
    search, best = segment.k_search(x, k_max=6, starts=2, max_iter=50)
    sil = {r.k: r.avg_silhouette for r in search.collect() if r.k >= 2}
    assert max(sil, key=sil.get) == 4
    wss = {r.k: r.wss for r in search.collect()}
    assert abs(wss[1] - (x.count() - 1) * 2) < 1e-6            # TSS on z-scores = (n-1) p
    m1 = segment.fit_kmeans(x, 4, 2, 50, seed=1)
    m2 = segment.fit_kmeans(x, 4, 2, 50, seed=99)
    l1 = m1.transform(x).withColumn("c", segment.label_column(segment.relabel_map(m1))).select("dot_number", "c")
    l2 = m2.transform(x).withColumn("c", segment.label_column(segment.relabel_map(m2))).select("dot_number", "c")
    assert sorted(l1.collect()) == sorted(l2.collect())
    sizes = {r.c: r["count"] for r in l1.groupBy("c").count().collect()}
    assert sizes == {"C1": 160, "C2": 120, "C3": 80, "C4": 40}


def test_zscore_mean0_sd1_and_constant_column(spark):
    df = spark.createDataFrame([(str(i), float(i), 5.0) for i in range(50)], "dot_number string, a double, c double")
    x = segment.scaled(df, ("a", "c"))
    arr = x.select(segment.vector_to_array("features").alias("z"))
    st = arr.agg(F.avg(F.col("z")[0]).alias("m"), F.stddev_samp(F.col("z")[0]).alias("s"),
                 F.max(F.abs(F.col("z")[1])).alias("c")).first()
    assert abs(st.m) < 1e-9 and abs(st.s - 1) < 1e-9 and st.c == 0.0


def test_shared_rounds_equal_single_fits(spark):
    """Starts of several k that iterate together end where Spark's own fit of each ends."""
    x = segment.scaled(_blobs(spark), ("a", "b")).coalesce(2).persist()
    tasks = [(k, seed) for k in (2, 5, 7) for seed in (1, 2, 3)]
    got = segment.lloyd(x, segment.seeded(x, tasks, 4), 40)
    for (k, seed), m in zip(tasks, got):
        want = KMeans(k=k, seed=seed, maxIter=40, featuresCol="features", predictionCol="cluster_id").fit(x)
        assert np.allclose(m.clusterCenters(), want.clusterCenters(), atol=1e-9)
        assert abs(m.cost - want.summary.trainingCost) < 1e-8
        ours = {r.dot_number: r.cluster_id for r in m.transform(x).collect()}
        assert ours == {r.dot_number: r.cluster_id for r in want.transform(x).collect()}
    x.unpersist()


def test_seeding_unpacks_the_rows_once(spark, monkeypatch):
    """Spark's ``KMeans`` keeps the vectors of a frame that is not persisted; the centers are those of the persisted one."""
    x = segment.scaled(_blobs(spark), ("a", "b")).coalesce(2).persist()
    given = []

    class Noted(KMeans):
        def fit(self, dataset, params=None):
            given.append((dataset.columns, dataset.storageLevel.useMemory))
            return super().fit(dataset, params)

    monkeypatch.setattr(segment, "KMeans", Noted)
    got = segment.seeded(x, [(3, 1), (4, 2)], 2)
    assert given == [(["features"], False)] * 2 and x.storageLevel.useMemory
    for (k, seed), centers in zip([(3, 1), (4, 2)], got):
        want = KMeans(k=k, seed=seed, maxIter=0, featuresCol="features", predictionCol="cluster_id").fit(x)
        assert np.array_equal(centers, want.clusterCenters())
    x.unpersist()


def test_starts_share_their_jobs(spark):
    """More starts cost no more jobs: one per round."""
    x = segment.scaled(_blobs(spark), ("a", "b")).coalesce(1).persist()
    starts = [c for k in (3, 4, 6) for c in segment.seeded(x, [(k, s) for s in range(6)], 4)]
    sc = spark.sparkContext
    sc.setJobGroup("lloyd-jobs", "rounds of all starts")
    try:
        found = segment.lloyd(x, starts, 15)
        jobs = len(sc.statusTracker().getJobIdsForGroup("lloyd-jobs"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        x.unpersist()
    assert len(found) == 18 and all(m.cost >= 0 for m in found)
    assert 0 < jobs <= 15


def test_a_center_without_rows_stays(spark):
    x = segment.scaled(_blobs(spark), ("a", "b")).persist()
    far = np.array([[0.0, 0.0], [1e6, 1e6]])
    m = segment.lloyd(x, [far], 10)[0]
    assert m.clusterCenters()[1].tolist() == [1e6, 1e6]
    assert abs(m.cost - segment.total_ss(x)) < 1e-6
    x.unpersist()
