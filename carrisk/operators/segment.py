"""Segmentation (K1-K13): clustering frame, z-scores, K-means with k selection,
deterministic labels, profiles, tests, PCA projection, centroids, write-back.

Spark ML does the heavy parts (``StandardScaler``, ``KMeans``, ``PCA``,
``ClusteringEvaluator``); the scaled feature vectors are persisted once and
every fit reads them.  Spark ML seeds every start (k-means||, submitted from
driver threads so that small jobs overlap); the iterations of all starts and
all k then share their passes over the rows (``lloyd``).

Differences from the analysed pipeline, stated once:

* K-means is Lloyd's algorithm with k-means|| seeding (not Hartigan-Wong with
  random starts); the best of ``starts`` seeds by within-SS is kept.  A start
  ends, and its within-SS is taken, as in Spark's ``KMeans``.
* k = 1 is solved in closed form (Spark rejects k < 2): WSS = total SS.
* Silhouette uses Spark's exact squared-Euclidean form on all rows (O(n k)
  from cluster aggregates).  The Euclidean form needs every pair of points,
  which does not scale and is not built.
* Cluster numbers are made deterministic: C1 is the largest cluster, ties by
  centroid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrisk.functions import scalar as S
from carrisk.operators import clean, rank

# The 15 clustering features, raw outcome columns kept beside
# them, and the report labels of the features.
FEATURE_COLS = ("fleet_size_log", "is_interstate", "is_intra_hazmat", "is_intra_nonhaz", "hm_flag",
                "rate_unsafe", "rate_fatigued", "rate_dr_fitness", "rate_subt_alc", "rate_vh_maint", "rate_hm",
                "crashes_log", "severity_log", "fatalities_log", "injuries_log")
RAW_COLS = ("oos_rate_raw", "total_crashes_raw", "severity_weight_raw", "total_fatalities_raw",
            "total_injuries_raw", "carrier_operation", "hm_flag_raw")
CENTROID_LABELS = {
    "fleet_size_log": "Fleet Size (log)",
    "is_interstate": "Interstate Op.",
    "is_intra_hazmat": "Intrastate Hazmat Op.",
    "is_intra_nonhaz": "Intrastate Non-Haz Op.",
    "hm_flag": "Hazmat Flag",
    "rate_unsafe": "Unsafe Driving Rate",
    "rate_fatigued": "Fatigued Driving Rate",
    "rate_dr_fitness": "Driver Fitness Rate",
    "rate_subt_alc": "Substance/Alcohol Rate",
    "rate_vh_maint": "Vehicle Maint. Rate",
    "rate_hm": "Hazmat Compliance Rate",
    "crashes_log": "Total Crashes (log)",
    "severity_log": "Severity Weight (log)",
    "fatalities_log": "Total Fatalities (log)",
    "injuries_log": "Total Injuries (log)",
}
RATES = {"rate_unsafe": "viol_unsafe", "rate_fatigued": "viol_fatigued", "rate_dr_fitness": "viol_dr_fitness",
         "rate_subt_alc": "viol_subt_alcohol", "rate_vh_maint": "viol_vh_maint", "rate_hm": "viol_hm"}


def cluster_frame(master: DataFrame) -> DataFrame:
    """K1: inspected carriers; key, 15 features, 7 raw labels; complete rows only."""
    df = clean.inspected_universe(master).select(
        "dot_number",
        S.log1p_floor("nbr_power_unit").alias("fleet_size_log"),
        F.col("is_interstate").cast("double").alias("is_interstate"),
        F.col("is_intra_hazmat").cast("double").alias("is_intra_hazmat"),
        F.col("is_intra_nonhaz").cast("double").alias("is_intra_nonhaz"),
        F.col("hm_flag").cast("double").alias("hm_flag"),
        *[S.safe_div(src, "total_inspections").alias(out) for out, src in RATES.items()],
        S.log1p_plain("total_crashes").alias("crashes_log"),
        S.log1p_plain("sum_severity_weight").alias("severity_log"),
        S.log1p_plain("total_fatalities").alias("fatalities_log"),
        S.log1p_plain("total_injuries").alias("injuries_log"),
        F.col("oos_rate").alias("oos_rate_raw"),
        F.col("total_crashes").alias("total_crashes_raw"),
        F.col("sum_severity_weight").alias("severity_weight_raw"),
        F.col("total_fatalities").alias("total_fatalities_raw"),
        F.col("total_injuries").alias("total_injuries_raw"),
        "carrier_operation",
        F.col("hm_flag").alias("hm_flag_raw"),
    )
    return clean.drop_na_rows(df)


def zscore_stage(features=FEATURE_COLS):
    """K2 stages: assemble -> z-score with the sample sd (n - 1).  A constant
    column scales to 0 (Spark) where the analysed pipeline would get NaN."""
    return [VectorAssembler(inputCols=list(features), outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]


def scaled(base: DataFrame, features=FEATURE_COLS) -> DataFrame:
    asm, scaler = zscore_stage(features)
    assembled = asm.transform(base)
    return scaler.fit(assembled).transform(assembled).drop("raw_features")


def total_ss(x: DataFrame) -> float:
    """Total sum of squares of the z-scored features (= WSS at k = 1), one aggregate pass."""
    first = x.select("features").first()
    if first is None:
        return 0.0
    arr = x.select(vector_to_array("features").alias("v"))
    aggs = [F.var_samp(F.col("v")[i]) * (F.count(F.lit(1)) - 1) for i in range(len(first[0]))]
    row = arr.agg(*[a.alias(f"s{i}") for i, a in enumerate(aggs)]).first()
    return float(sum(v or 0.0 for v in row))


TOL = 1e-4  # a start ends when no center moves further, as with Spark's ``KMeans``
SLICE = 2048  # rows whose distances to all centers are held at a time


@dataclass
class Clustering:
    """A fitted K-means: its centers, and the within-SS of its last iteration."""
    centers: np.ndarray
    cost: float = float("nan")
    sizes: list[int] = field(default_factory=list)  # set for the model that is kept

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 - as Spark's models name it
        return list(self.centers)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` + ``cluster_id``, the nearest center (ties: the first)."""
        v = F.col("_v")
        far = [reduce(add, [(v[i] - F.lit(float(c))) * (v[i] - F.lit(float(c))) for i, c in enumerate(center)]) for center in self.centers]
        near = df.withColumn("_v", vector_to_array("features")).withColumn("_d", F.array(*far))
        return near.withColumn("cluster_id", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_v", "_d")


def _blocks(x: DataFrame) -> RDD:
    """The feature vectors as packed blocks of doubles, kept for all rounds."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["block"])
    packed = x.select(vector_to_array("features").alias("v")).mapInArrow(pack, "block binary")
    return packed.rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _assign(stacks: Sequence[np.ndarray]) -> Callable[[Iterable[bytes]], Iterator[np.ndarray]]:
    """Per partition, for each stack of starts (starts, k, features): sums and counts of each center's rows, and the
    squared distances of each start, in one vector."""
    def of(blocks: Iterable[bytes]) -> Iterator[np.ndarray]:
        width = stacks[0].shape[2]
        sums = [np.zeros((c.shape[0] * c.shape[1], width)) for c in stacks]
        counts = [np.zeros(c.shape[0] * c.shape[1]) for c in stacks]
        costs = [np.zeros(c.shape[0]) for c in stacks]
        for block in blocks:
            rows = np.frombuffer(block).reshape(-1, width)
            for x in (rows[at:at + SLICE] for at in range(0, len(rows), SLICE)):
                norms, each = (x * x).sum(axis=1), np.arange(len(x))[:, None]
                for g, c in enumerate(stacks):
                    starts, k, _ = c.shape
                    flat = c.reshape(starts * k, width)
                    far = ((flat * flat).sum(axis=1) - 2.0 * (x @ flat.T)).reshape(len(x), starts, k)
                    near = far.argmin(axis=2)
                    costs[g] += np.maximum(np.take_along_axis(far, near[:, :, None], 2)[:, :, 0] + norms[:, None], 0.0).sum(axis=0)
                    member = np.zeros((len(x), starts * k))
                    member[each, near + np.arange(starts) * k] = 1.0
                    sums[g] += member.T @ x
                    counts[g] += member.sum(axis=0)
        yield np.concatenate([part.ravel() for g in zip(sums, counts, costs) for part in g])
    return of


def lloyd(x: DataFrame, starts: Sequence[np.ndarray], max_iter: int, tol: float = TOL) -> list[Clustering]:
    """Lloyd's iterations from each of ``starts``, all of them in one pass over the rows per round.

    The number of jobs is that of the longest start's iterations, not their sum.  The driver holds the centers only.
    A center without rows stays; a start ends when no center has moved further than ``tol``.
    """
    found = [Clustering(np.asarray(c, dtype=float)) for c in starts]
    active = list(range(len(found)))
    blocks = _blocks(x)
    try:
        for _ in range(max_iter):
            if not active:
                break
            by_k: dict[int, list[int]] = {}
            for r in active:
                by_k.setdefault(len(found[r].centers), []).append(r)
            stacks = [np.stack([found[r].centers for r in members]) for members in by_k.values()]
            total, at, active = blocks.mapPartitions(_assign(stacks)).treeReduce(np.add), 0, []

            def part(*shape):
                nonlocal at
                at += (size := int(np.prod(shape)))
                return total[at - size:at].reshape(shape)

            for members, old in zip(by_k.values(), stacks):
                sums, counts, costs = part(*old.shape), part(*old.shape[:2], 1), part(old.shape[0])
                new = np.where(counts > 0, sums / np.maximum(counts, 1.0), old)
                moved = ((new - old) ** 2).sum(axis=2).max(axis=1)
                for r, centers, cost, step in zip(members, new, costs, moved):
                    found[r].centers, found[r].cost = centers, float(cost)
                    if step > tol * tol:
                        active.append(r)
    finally:
        blocks.unpersist()
    return found


def seeded(x: DataFrame, tasks: Sequence[tuple[int, int]], parallelism: int) -> list[np.ndarray]:
    """Spark ML's k-means|| centers for each (k, seed), before any iteration.

    A seeding passes over the rows several times.  Spark's ``KMeans`` keeps the vectors itself unless its frame is
    persisted, when every pass unpacks them again from the cached columns; so it gets a frame that is not.
    """
    rows = x.select("features")

    def one(task: tuple[int, int]) -> np.ndarray:
        model = KMeans(k=task[0], seed=task[1], maxIter=0, initMode="k-means||", featuresCol="features", predictionCol="cluster_id").fit(rows)
        return np.array(model.clusterCenters())
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(one, tasks))


def fit_kmeans(x: DataFrame, k: int, starts: int, max_iter: int, seed: int = 42,
               parallelism: int = 8) -> Clustering:
    """Best of ``starts`` k-means|| fits by within-SS."""
    fitted = lloyd(x, seeded(x, [(k, seed + s) for s in range(starts)], parallelism), max_iter)
    best = min(fitted, key=lambda m: m.cost)
    sizes = {r["cluster_id"]: r["count"] for r in best.transform(x).groupBy("cluster_id").count().collect()}
    best.sizes = [sizes.get(i, 0) for i in range(len(best.centers))]
    return best


def k_search(x: DataFrame, k_max: int = 10, starts: int = 25, max_iter: int = 300, seed: int = 42,
             parallelism: int = 8, silhouette: bool = True) -> tuple[DataFrame, dict[int, Clustering]]:
    """K3 + K4: within-SS for k = 1..k_max (best of starts) and the mean
    silhouette (squared Euclidean) for k >= 2; all starts of all k iterate together."""
    tasks = [(k, seed + s) for k in range(2, k_max + 1) for s in range(starts)]
    fitted = lloyd(x, seeded(x, tasks, parallelism), max_iter)
    best: dict[int, Clustering] = {}
    for (k, _), m in zip(tasks, fitted):
        if k not in best or m.cost < best[k].cost:
            best[k] = m
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster_id", metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        widths = dict(zip(best, pool.map(lambda k: ev.evaluate(best[k].transform(x)) if silhouette else None, best)))
    rows = [(1, total_ss(x), None)] + [(k, best[k].cost, widths[k]) for k in sorted(best)]
    out = x.sparkSession.createDataFrame(rows, "k int, wss double, avg_silhouette double")
    return out, best


def relabel_map(model: Clustering) -> dict[int, str]:
    """Deterministic labels: by cluster size (desc), then centroid (asc) -> C1..Ck."""
    sizes = model.sizes
    centers = [tuple(float(v) for v in c) for c in model.clusterCenters()]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], centers[i]))
    return {old: f"C{new + 1}" for new, old in enumerate(order)}


def label_column(mapping: dict[int, str], col: str = "cluster_id"):
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), F.col(col))


@dataclass
class Segmentation:
    base: DataFrame          # cluster frame + scaled features, persisted
    model: Clustering
    labels: dict[int, str]
    labelled: DataFrame      # base + cluster label
    wss: float
    tss: float

    @property
    def between_ratio(self) -> float:
        return 1.0 - self.wss / self.tss if self.tss else float("nan")


def segment(base: DataFrame, k: int = 4, starts: int = 50, max_iter: int = 500, seed: int = 42,
            parallelism: int = 8) -> Segmentation:
    """K5 + K6: final K-means, deterministic labels, between-SS / total-SS."""
    x = scaled(base).persist()
    model = fit_kmeans(x, k, starts, max_iter, seed, parallelism)
    mapping = relabel_map(model)
    labelled = model.transform(x).withColumn("cluster", label_column(mapping)).drop("cluster_id")
    return Segmentation(x, model, mapping, labelled, model.cost, total_ss(x))


def profile(df: DataFrame, group: str = "cluster") -> DataFrame:
    """K7: per group n, median fleet size, two percents and nine means."""
    median = rank.quantiles(df, {"fleet": F.expm1("fleet_size_log")}, [0.5], [group]).select(
        F.col(group).alias("_g"), F.col("q")[0].alias("med_fleet_size"))
    means = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_carriers"),
        (F.avg("is_interstate") * 100).alias("pct_interstate"),
        (F.avg("hm_flag_raw") * 100).alias("pct_hazmat"),
        F.avg("oos_rate_raw").alias("avg_oos_rate"),
        F.avg("rate_unsafe").alias("avg_rate_unsafe"),
        F.avg("rate_fatigued").alias("avg_rate_fatigue"),
        F.avg("rate_vh_maint").alias("avg_rate_vhmaint"),
        F.avg("rate_hm").alias("avg_rate_hm"),
        F.avg("total_crashes_raw").alias("avg_crashes"),
        F.avg("severity_weight_raw").alias("avg_severity_wt"),
        F.avg("total_fatalities_raw").alias("avg_fatalities"),
        F.avg("total_injuries_raw").alias("avg_injuries"),
    )
    return means.join(median, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def centroids(seg: Segmentation, features=FEATURE_COLS) -> DataFrame:
    """Centroids (z units) long, relabelled clusters and feature names."""
    rows = []
    for old, center in enumerate(seg.model.clusterCenters()):
        for f, v in zip(features, center):
            rows.append((seg.labels[old], f, CENTROID_LABELS.get(f, f), float(v)))
    return seg.base.sparkSession.createDataFrame(rows, "cluster string, feature string, label string, z_score double")


def pca_projection(x: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """K9: PCA on all scaled rows; component signs fixed so the largest |loading| is positive.

    Returns (frame with PC1..PCk, explained variance shares).
    """
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(x)
    pcs = model.pc.toArray()
    signs = []
    for j in range(k):
        col = pcs[:, j]
        i = int(abs(col).argmax())
        signs.append(1.0 if col[i] >= 0 else -1.0)
    out = model.transform(x).withColumn("_pa", vector_to_array("_pc"))
    out = out.withColumns({f"PC{j + 1}": F.col("_pa")[j] * F.lit(signs[j]) for j in range(k)}).drop("_pc", "_pa")
    return out, [float(v) for v in model.explainedVariance.toArray()]
