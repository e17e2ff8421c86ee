"""Registered queries: Q2 (segmentation) and the operators under it."""

from __future__ import annotations

import threading

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.operators import aggregates as A
from carrisk.operators import dist, metrics, segment
from carrisk.plans import master as M
from carrisk.plans.oracle import r6, safe_div, with_master
from carrisk.plans.registry import query
from carrisk.sources import files

_LOCK = threading.Lock()
_CACHE: dict = {}

SEARCH_STARTS = 25
FINAL_STARTS = 50
K_MAX = 10
K_FINAL = 4


def _key(spark, sf_dir, what):
    return (spark.sparkContext.applicationId, sf_dir, what)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.cluster_frame(M.master_for(spark, sf_dir))


def final(spark: SparkSession, sf_dir: str) -> segment.Segmentation:
    with _LOCK:
        k = _key(spark, sf_dir, "seg")
        if k not in _CACHE:
            _CACHE[k] = segment.segment(base(spark, sf_dir), K_FINAL, FINAL_STARTS, 500)
        return _CACHE[k]


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = final(spark, sf_dir)
    with _LOCK:
        k = _key(spark, sf_dir, "search")
        if k not in _CACHE:
            _CACHE[k] = segment.k_search(seg.base, K_MAX, SEARCH_STARTS, 300)[0]
        return _CACHE[k]


# ---------------------------------------------------------------- SQL
def _l1p(c: str) -> str:
    return f"ln(1 + {c})"


_CB = ("cb", f"""select * from (select dot_number, ln(1 + greatest(nbr_power_unit, 0.0)) as fleet_size_log,
  cast(is_interstate as double) as is_interstate, cast(is_intra_hazmat as double) as is_intra_hazmat,
  cast(is_intra_nonhaz as double) as is_intra_nonhaz, cast(hm_flag as double) as hm_flag,
  {', '.join(f"{safe_div(src, 'total_inspections')} as {out}" for out, src in segment.RATES.items())},
  {_l1p('total_crashes')} as crashes_log, {_l1p('sum_severity_weight')} as severity_log,
  {_l1p('total_fatalities')} as fatalities_log, {_l1p('total_injuries')} as injuries_log,
  oos_rate as oos_rate_raw, total_crashes as total_crashes_raw, sum_severity_weight as severity_weight_raw,
  total_fatalities as total_fatalities_raw, total_injuries as total_injuries_raw, carrier_operation,
  hm_flag as hm_flag_raw from master where total_inspections >= 1) t
where {' and '.join(f'{c} is not null' for c in list(segment.FEATURE_COLS) + list(segment.RAW_COLS))}""")
_CB_DOUBLES = [c for c in segment.FEATURE_COLS] + ["oos_rate_raw", "severity_weight_raw", "total_fatalities_raw",
                                                   "total_injuries_raw"]


@query("cluster_matrix", with_master(
    "select * replace (" + ", ".join(f"{r6(c)} as {c}" for c in _CB_DOUBLES) + ") from cb", [_CB]))
def q_cluster_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the clustering frame (key, 15 features, 7 raw labels, complete rows)."""
    return base(spark, sf_dir)


@query("zscore", with_master(f"""
select dot_number, feature, {r6('case when sd = 0 or sd is null then 0.0 else (v - mu) / sd end')} as z from (
  select dot_number, feature, v, avg(v) over (partition by feature) as mu,
         stddev_samp(v) over (partition by feature) as sd
  from (unpivot (select dot_number, {', '.join(segment.FEATURE_COLS)} from cb)
        on {', '.join(segment.FEATURE_COLS)} into name feature value v))""", [_CB]))
def q_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: z-scores (sample sd) of the 15 features, long."""
    x = segment.scaled(base(spark, sf_dir))
    arr = x.select("dot_number", vector_to_array("features").alias("z"))
    names = F.array(*[F.lit(c) for c in segment.FEATURE_COLS])
    return arr.select("dot_number", F.inline(F.arrays_zip(names.alias("feature"), F.col("z").alias("z"))))


@query("cluster_profile", with_master(f"""
select carrier_operation, count(*) as n_carriers, {r6('median(exp(fleet_size_log) - 1)')} as med_fleet_size,
  {r6('avg(is_interstate) * 100')} as pct_interstate, {r6('avg(hm_flag_raw) * 100')} as pct_hazmat,
  {r6('avg(oos_rate_raw)')} as avg_oos_rate, {r6('avg(rate_unsafe)')} as avg_rate_unsafe,
  {r6('avg(rate_fatigued)')} as avg_rate_fatigue, {r6('avg(rate_vh_maint)')} as avg_rate_vhmaint,
  {r6('avg(rate_hm)')} as avg_rate_hm, {r6('avg(total_crashes_raw)')} as avg_crashes,
  {r6('avg(severity_weight_raw)')} as avg_severity_wt, {r6('avg(total_fatalities_raw)')} as avg_fatalities,
  {r6('avg(total_injuries_raw)')} as avg_injuries
from cb group by carrier_operation""", [_CB]))
def q_cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7 on a deterministic grouping (operation type): the same profile columns as per cluster."""
    return segment.profile(base(spark, sf_dir), "carrier_operation")


@query("ellipse_params", with_master(f"""
select carrier_operation, {r6('avg(x)')} as cx, {r6('avg(y)')} as cy, {r6('var_samp(x)')} as var_x,
  {r6('var_samp(y)')} as var_y, {r6('covar_samp(x, y)')} as cov_xy, count(*) as n,
  case when count(*) >= 4 then {r6('sqrt((count(*) - 1.0) * (pow(0.1, -2.0 / (count(*) - 1.0)) - 1.0))')} end as radius
from (select carrier_operation, fleet_size_log as x, crashes_log as y from cb) group by carrier_operation""", [_CB]))
def q_ellipse_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 on a deterministic grouping: 90% normal ellipse of (fleet size, crashes) per operation."""
    return dist.ellipse_params(base(spark, sf_dir), "fleet_size_log", "crashes_log", ["carrier_operation"])


def _t_round(i: int) -> tuple[str, str]:
    """Round ``i`` of the multivariate-t weights in SQL: the groups still moving, and those that ended before."""
    def weight(s):
        dx, dy = f"(x - {s}mx)", f"(y - {s}my)"
        return f"7.0 / (5.0 + ({s}vy * {dx} * {dx} - 2.0 * {s}c * {dx} * {dy} + {s}vx * {dy} * {dy}) / ({s}vx * {s}vy - {s}c * {s}c))"
    return f"t{i}", f"""select *, moved < 0.01 or not coalesce(vx * vy - c * c > {dist.FLAT!r} * vx * vy, false) as ended from (
  select k, n, mx + ax as mx, my + ay as my, xx / sw - ax * ax as vx, yy / sw - ay * ay as vy, xy / sw - ax * ay as c, mx as omx, my as omy,
    vx as ovx, vy as ovy, c as oc, mx + ax as fx, my + ay as fy, xx / n as fvx, yy / n as fvy, xy / n as fc, {i} as rounds, moved from (
    select k, count(*) as n, any_value(mx) as mx, any_value(my) as my, any_value(vx) as vx, any_value(vy) as vy, any_value(c) as c,
      sum(w) as sw, sum(w * (x - mx)) / sum(w) as ax, sum(w * (y - my)) / sum(w) as ay, sum(w * (x - mx) * (x - mx)) as xx,
      sum(w * (y - my) * (y - my)) as yy, sum(w * (x - mx) * (y - my)) as xy, max(abs(w - ow)) as moved
    from (select *, {weight('')} as w, {'1.0' if i == 1 else weight('o')} as ow from tp join (select * exclude (n) from t{i - 1} where not ended) s using (k))
    group by k))
union all by name select * from t{i - 1} where ended"""


_T_ROUNDS = 25
_T = [("tp", "select coalesce(carrier_operation, chr(0)) as k, fleet_size_log as x, crashes_log as y from cb"),
      ("t0", f"""select *, n < 4 or not coalesce(vx * vy - c * c > {dist.FLAT!r} * vx * vy, false) as ended from (
  select k, count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) as vx, var_pop(y) as vy, covar_pop(x, y) as c,
    {', '.join(f'cast(null as double) as {c}' for c in ('omx', 'omy', 'ovx', 'ovy', 'oc', 'moved'))},
    avg(x) as fx, avg(y) as fy, var_samp(x) as fvx, var_samp(y) as fvy, covar_samp(x, y) as fc, 0 as rounds
  from tp group by k)"""), *map(_t_round, range(1, _T_ROUNDS + 1))]


@query("ellipse_t_params", with_master(f"""
select nullif(k, chr(0)) as carrier_operation, {r6('fx')} as cx, {r6('fy')} as cy, {r6('fvx')} as var_x, {r6('fvy')} as var_y, {r6('fc')} as cov_xy,
  n, rounds, case when n >= 4 then {r6('sqrt((n - 1.0) * (pow(0.1, -2.0 / (n - 1.0)) - 1.0))')} end as radius from t{_T_ROUNDS}""", [_CB, *_T]))
def q_ellipse_t_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 on a deterministic grouping: 90% multivariate-t ellipse of (fleet size, crashes) per operation."""
    return dist.t_ellipse(base(spark, sf_dir), "fleet_size_log", "crashes_log", ["carrier_operation"], max_iter=_T_ROUNDS)


# ---------------------------------------------------------------- R: K-means outputs
@query("elbow_wss")
def q_elbow_wss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: total within-SS for k = 1..10 (best of 25 starts; k = 1 closed form)."""
    return search(spark, sf_dir).select("k", "wss")


@query("silhouette_k")
def q_silhouette_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: mean silhouette (squared Euclidean, all rows) for k = 2..10, best k flagged."""
    s = search(spark, sf_dir).where(F.col("k") >= 2).select("k", "avg_silhouette")
    best = s.agg(F.max_by("k", "avg_silhouette").alias("b")).first()["b"]
    return s.withColumn("is_best", F.col("k") == F.lit(best))


@query("kmeans_labels")
def q_kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: final k = 4 labels (C1 = largest cluster)."""
    return final(spark, sf_dir).labelled.select("dot_number", "cluster")


@query("between_ratio")
def q_between_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: between-SS / total-SS of the final model."""
    seg = final(spark, sf_dir)
    rows = [(K_FINAL, seg.wss, seg.tss, seg.tss - seg.wss, seg.between_ratio)]
    return spark.createDataFrame(rows, "k int, within_ss double, total_ss double, between_ss double, ratio double")


@query("segment_profile")
def q_segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the cluster profile table."""
    return segment.profile(final(spark, sf_dir).labelled, "cluster")


@query("cluster_tests")
def q_cluster_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: Kruskal-Wallis of OOS rate, crashes and severity across clusters (descriptive: the
    clusters were formed from closely related inputs)."""
    lab = final(spark, sf_dir).labelled
    out = None
    for v in ("oos_rate_raw", "total_crashes_raw", "severity_weight_raw"):
        part = metrics.kruskal_wallis(lab, v, "cluster")
        out = part if out is None else out.unionByName(part)
    return out


@query("pca_projection")
def q_pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: first two principal components of the scaled features, with the cluster label."""
    seg = final(spark, sf_dir)
    proj, var = segment.pca_projection(seg.labelled)
    return proj.select("dot_number", "cluster", "PC1", "PC2")


@query("pca_variance")
def q_pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: variance share of PC1, PC2."""
    _, var = segment.pca_projection(final(spark, sf_dir).base)
    return spark.createDataFrame([(f"PC{i + 1}", v) for i, v in enumerate(var)], "component string, var_share double")


@query("cluster_ellipses")
def q_cluster_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90% multivariate-t ellipse of each cluster in the PC1/PC2 plane."""
    proj, _ = segment.pca_projection(final(spark, sf_dir).labelled)
    return dist.t_ellipse(proj, "PC1", "PC2", ["cluster"])


@query("centroid_table")
def q_centroid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised centroids, long, with cluster and feature labels."""
    return segment.centroids(final(spark, sf_dir))


@query("cluster_op_mix")
def q_cluster_op_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation mix inside each cluster (n and share)."""
    lab = final(spark, sf_dir).labelled
    return A.share_within(A.freq_count(lab, "cluster", "carrier_operation"), "n", ["cluster"])


@query("cluster_outcomes")
def q_cluster_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome box statistics per cluster: OOS rate within [0, p99]; crashes and
    severity (> 0) on log10 axes."""
    lab = final(spark, sf_dir).labelled
    q99 = dist.quantile_limits(lab, {"oos_rate_raw": 0.99})["oos_rate_raw"]
    oos = lab.where((F.col("oos_rate_raw") >= 0) & (F.col("oos_rate_raw") <= F.lit(float(q99))))
    parts = {
        "oos_rate": dist.box_stats(oos, "oos_rate_raw", ["cluster"]),
        "total_crashes_log10": dist.box_stats(lab.where(F.col("total_crashes_raw") > 0), "total_crashes_raw",
                                              ["cluster"], log10=True),
        "severity_weight_log10": dist.box_stats(lab.where(F.col("severity_weight_raw") > 0),
                                                "severity_weight_raw", ["cluster"], log10=True),
    }
    return A.stack_labelled(parts, label="outcome")


#: Outcome -> (column, log10 axis, axis limits) of the violins' bodies.
OUTCOME_AXES = {"oos_rate": ("oos_rate_raw", False, (0.0, 1.0)), "total_crashes_log10": ("total_crashes_raw", True, None),
                "severity_weight_log10": ("severity_weight_raw", True, None)}


def outcome_densities(df: DataFrame, key: str) -> DataFrame:
    """The violins' bodies, a density of each outcome per group, kept inside the group's own range.

    Log axes leave out values of 0 or less; a group without a value has no rows.
    """
    parts = {}
    for name, (column, log, limits) in OUTCOME_AXES.items():
        x = dist.prepare(df, column, [key], log, limits)
        ends = x.groupBy(F.col(key).alias("_key")).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
        body = dist.kde(df, column, [key], log10=log, keep_between=limits)
        parts[name] = body.join(ends, F.col(key).eqNullSafe(F.col("_key"))).where("x >= _lo and x <= _hi").drop("_key", "_lo", "_hi")
    return A.stack_labelled(parts, label="outcome")


@query("cluster_outcome_density")
def q_cluster_outcome_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of OOS rate (axis 0 to 1), crashes and severity (log10 axes) per cluster."""
    return outcome_densities(final(spark, sf_dir).labelled, "cluster")


@query("cluster_output")
def q_cluster_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13 + S6: inspected master rows in the clustering frame, with their label, written and read back."""
    m = M.master_for(spark, sf_dir)
    lab = final(spark, sf_dir).labelled.select("dot_number", "cluster")
    out = (m.where(F.col("total_inspections") >= 1)
           .join(lab.select("dot_number"), "dot_number", "left_semi")
           .join(lab, "dot_number", "left"))
    path = M.scratch_path(spark, "clustered-" + M.hashlib.sha1(sf_dir.encode()).hexdigest()[:12])
    files.write_checkpoint(out, path)
    return files.read_checkpoint(spark, path)
