"""Registered queries: Q1 (random-forest comparison) and the operators under it."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.functions import scalar as S
from carrisk.operators import aggregates as A
from carrisk.operators import bagging, dist, metrics, model, sampling
from carrisk.plans import master as M
from carrisk.plans.oracle import r6, safe_div, with_master
from carrisk.plans.registry import query

RATE_COLS = list(model.RATE_SOURCES)
NUMERIC_FEATURES = [f for f in model.FEATURES_B if f != "state_risk_tier"]
ROC_SCORE = "rate_vh_maint"
TREES_FINAL, TREES_CV = 500, 300


# ---------------------------------------------------------------- SQL building blocks
def _ln1p0(c: str) -> str:
    return f"ln(1 + greatest({c}, 0.0))"


_MFE = ("mfe", f"""
select dot_number, oos_flag, phy_state, hm_flag, is_interstate, is_intra_hazmat, is_intra_nonhaz,
  {_ln1p0('nbr_power_unit')} as fleet_size_log, {_ln1p0('driver_total')} as log_driver_total,
  case when nbr_power_unit is null then null when nbr_power_unit > 0
       then cast(driver_total as double) / nbr_power_unit else cast(0.0 as double) end as drivers_per_unit,
  {_ln1p0('total_crashes')} as log_total_crashes, {_ln1p0('sum_severity_weight')} as log_severity_weight,
  {', '.join(f"{safe_div(src, 'total_inspections')} as {out}" for out, src in model.RATE_SOURCES.items())}
from master where total_inspections >= 1""")
_REQ = [c for c in model.MODEL_REQUIRED]
_MF = ("mf", "select * from mfe where phy_state is not null and phy_state <> '' and "
       + " and ".join(f"{c} is not null" for c in _REQ))
_SP = ("sp", """select *, case when row_number() over (partition by oos_flag order by md5(dot_number || '|42'), dot_number)
  <= floor(cast(0.7 as double) * count(*) over (partition by oos_flag)) then 'train' else 'test' end as split from mf""")
_TRAIN = ("tr", "select * from sp where split = 'train'")
_RATES = ("st", """select phy_state, count(*) as n, avg(case when oos_flag = 'OOS' then 1.0 else 0.0 end) as state_oos_rate
  from tr group by phy_state having count(*) >= 30""")
_CUTS = ("cuts", """select quantile_cont(state_oos_rate, 0.0) as q0,
  quantile_cont(state_oos_rate, cast(1 as double) / 3) as q1,
  quantile_cont(state_oos_rate, cast(2 as double) / 3) as q2, quantile_cont(state_oos_rate, 1.0) as q3 from st""")
_TIERS = ("tiers", """select st.*, case when q0 = q1 or q1 = q2 or q2 = q3 then 'MED'
  when state_oos_rate >= q0 and state_oos_rate <= q1 then 'LOW' when state_oos_rate <= q2 then 'MED' else 'HIGH' end
  as state_risk_tier from st, cuts""")
MODEL_CTES = [_MFE, _MF, _SP, _TRAIN, _RATES, _CUTS, _TIERS]


def msql(select: str, extra=()) -> str:
    return with_master(select, MODEL_CTES + list(extra))


# ---------------------------------------------------------------- shared fitted state
_LOCK = threading.Lock()
_CACHE: dict = {}


def _key(spark: SparkSession, sf_dir: str, what: str):
    return (spark.sparkContext.applicationId, sf_dir, what)


def prepared(spark: SparkSession, sf_dir: str) -> model.Prepared:
    with _LOCK:
        k = _key(spark, sf_dir, "prep")
        if k not in _CACHE:
            _CACHE[k] = model.prepare(M.master_for(spark, sf_dir))
        return _CACHE[k]


def evaluations(spark: SparkSession, sf_dir: str) -> list[model.Evaluation]:
    """Both feature sets tuned, fitted and evaluated once per application."""
    prep = prepared(spark, sf_dir)
    with _LOCK:
        k = _key(spark, sf_dir, "evals")
        if k not in _CACHE:
            # the two feature sets are independent: run them side by side so one model's
            # final fit and rank passes overlap with the other's grid
            sets = [("Strict (8)", model.FEATURES_A), (f"Fingerprint ({len(model.FEATURES_B)})", model.FEATURES_B)]
            with ThreadPoolExecutor(max_workers=2) as pool:
                _CACHE[k] = list(pool.map(
                    lambda nf: model.evaluate_feature_set(prep, nf[0], nf[1], TREES_FINAL, TREES_CV), sets))
        return _CACHE[k]


def mframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.model_frame(M.master_for(spark, sf_dir))


# ---------------------------------------------------------------- E: features and encoders
_MF_DOUBLES = ["fleet_size_log", "log_driver_total", "drivers_per_unit", "log_total_crashes", "log_severity_weight",
               *RATE_COLS]


@query("model_features", msql(
    "select * replace (" + ", ".join(
        f"{r6('least(drivers_per_unit, (select quantile_cont(drivers_per_unit, 0.99) from mfe))')} as drivers_per_unit"
        if c == "drivers_per_unit" else f"{r6(c)} as {c}" for c in _MF_DOUBLES) + ") from mf"))
def q_model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 + P16 (cap fitted on all inspected carriers, the analysed pipeline's order)."""
    feats = model.model_features(M.master_for(spark, sf_dir))
    w = model.Winsorizer().fit(feats)
    return w.transform(model.complete_rows(feats))


@query("winsorize_p99", msql(f"""
select dot_number, {r6('drivers_per_unit')} as raw_value,
  {r6('least(drivers_per_unit, (select quantile_cont(drivers_per_unit, 0.99) from mfe))')} as capped
from mfe"""))
def q_winsorize_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = model.model_features(M.master_for(spark, sf_dir))
    w = model.Winsorizer().fit(feats)
    return w.transform(feats.select("dot_number", F.col("drivers_per_unit").alias("raw_value"),
                                    "drivers_per_unit")).withColumnRenamed("drivers_per_unit", "capped")


@query("strat_split", msql("select dot_number, oos_flag, split from sp"))
def q_strat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: exact 70/30 split per class in md5(key|42) order."""
    return sampling.strat_split(mframe(spark, sf_dir), "oos_flag", "dot_number", 0.7, 42) \
        .select("dot_number", "oos_flag", "split")


_TUNE = ("tune", """select * from (select *, row_number() over (partition by oos_flag order by md5(dot_number || '|42|tune'),
  dot_number) as rn, count(*) over (partition by oos_flag) as nc from tr) where rn <= floor(cast(0.1 as double) * nc)""")


@query("strat_fraction", msql("select dot_number, oos_flag from tune", [_TUNE]))
def q_strat_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: stratified 10% of the training rows (the tuning subset)."""
    tr = sampling.strat_split(mframe(spark, sf_dir), "oos_flag", "dot_number").where(F.col("split") == "train")
    return sampling.strat_fraction(tr, "oos_flag", "dot_number", 0.1, "42|tune").select("dot_number", "oos_flag")


@query("strat_folds", msql("""
select dot_number, oos_flag, cast((row_number() over (partition by oos_flag order by md5(dot_number || '|42|fold'),
  dot_number) - 1) % 5 as integer) as fold from tune""", [_TUNE]))
def q_strat_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: stratified 5-fold assignment of the tuning subset."""
    tr = sampling.strat_split(mframe(spark, sf_dir), "oos_flag", "dot_number").where(F.col("split") == "train")
    tune = sampling.strat_fraction(tr, "oos_flag", "dot_number", 0.1, "42|tune")
    return sampling.strat_folds(tune, "oos_flag", "dot_number", 5, "42|fold").select("dot_number", "oos_flag", "fold")


@query("capped_sample", msql("""
select dot_number, oos_flag from (select *, row_number() over (partition by oos_flag
  order by md5(dot_number || '|42|cap'), dot_number) as rn from tr) where rn <= 25000"""))
def q_capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: at most 25,000 training rows per class (the train-AUC sample)."""
    tr = sampling.strat_split(mframe(spark, sf_dir), "oos_flag", "dot_number").where(F.col("split") == "train")
    return sampling.capped_sample(tr, "oos_flag", "dot_number", 25000, "42|cap").select("dot_number", "oos_flag")


@query("class_weights", msql(f"""
select oos_flag, count(*) as n, {r6('(select count(*) from tr) / (2.0 * count(*))')} as weight
from tr group by oos_flag"""))
def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: balanced class weights n / (2 n_c) on the training rows."""
    tr = sampling.strat_split(mframe(spark, sf_dir), "oos_flag", "dot_number").where(F.col("split") == "train")
    w = sampling.class_weights(tr, "oos_flag")
    return A.freq_count(tr, "oos_flag").withColumn("weight", sampling.weight_column("oos_flag", w))


@query("state_tier", msql(f"""
select phy_state, n, {r6('state_oos_rate')} as state_oos_rate, state_risk_tier from tiers"""))
def q_state_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the train-fitted state tier table (states with n >= 30)."""
    tr = sampling.strat_split(mframe(spark, sf_dir), "oos_flag", "dot_number").where(F.col("split") == "train")
    enc = model.StateTierEncoder().fit(tr)
    return enc.table()


@query("tier_lookup", msql("""
select sp.dot_number, sp.split, coalesce(t.state_risk_tier, 'MED') as state_risk_tier,
  case coalesce(t.state_risk_tier, 'MED') when 'LOW' then 0 when 'MED' then 1 else 2 end as tier_level
from sp left join tiers t on sp.phy_state = t.phy_state"""))
def q_tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every modelling row gets its state's tier, unseen states -> MED."""
    sp = sampling.strat_split(mframe(spark, sf_dir), "oos_flag", "dot_number")
    enc = model.StateTierEncoder().fit(sp.where(F.col("split") == "train"))
    out = enc.transform(sp, "state_risk_tier")
    return out.select("dot_number", "split", "state_risk_tier",
                      S.level_index("state_risk_tier", model.TIER_LEVELS).alias("tier_level"))


@query("anti_complement", msql("select dot_number, oos_flag from mf where dot_number not in (select dot_number from tr)"))
def q_anti_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """test = modelling rows without a training row (left anti join)."""
    mf = mframe(spark, sf_dir)
    tr = sampling.strat_split(mf, "oos_flag", "dot_number").where(F.col("split") == "train").select("dot_number")
    return mf.join(tr, "dot_number", "left_anti").select("dot_number", "oos_flag")


@query("semi_join", msql("select dot_number, phy_state, total_inspections from master "
                         "where dot_number in (select dot_number from tr)"))
def q_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master rows that are training carriers (left semi join)."""
    m = M.master_for(spark, sf_dir)
    tr = sampling.strat_split(model.model_frame(m), "oos_flag", "dot_number").where(F.col("split") == "train")
    return m.join(tr.select("dot_number"), "dot_number", "left_semi").select("dot_number", "phy_state",
                                                                             "total_inspections")


@query("attach_label", msql("select m.dot_number, sp.split from master m left join sp on m.dot_number = sp.dot_number"))
def q_attach_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join attaching a per-carrier label (the split) to every master row."""
    m = M.master_for(spark, sf_dir)
    sp = sampling.strat_split(model.model_frame(m), "oos_flag", "dot_number").select("dot_number", "split")
    return m.select("dot_number").join(sp, "dot_number", "left")


@query("recode_labels", msql(
    "select feature, case feature " + " ".join(f"when '{k}' then '{v}'" for k, v in model.FEATURE_LABELS.items())
    + f" else feature end as label, {r6('avg(v)')} as mean_value from (unpivot (select "
    + ", ".join(f"cast({c} as double) as {c}" for c in NUMERIC_FEATURES)
    + " from mf) on " + ", ".join(NUMERIC_FEATURES) + " into name feature value v) group by feature"))
def q_recode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature means with their report labels (fixed map; unknown names kept)."""
    long = A.unpivot_long(mframe(spark, sf_dir), [], NUMERIC_FEATURES, "feature", "v")
    means = long.groupBy("feature").agg(F.avg("v").alias("mean_value"))
    return means.withColumn("label", S.recode("feature", model.FEATURE_LABELS))


# ---------------------------------------------------------------- E: metrics on fixed scores
_LONG = ("lf", "unpivot (select dot_number, oos_flag, " + ", ".join(f"cast({c} as double) as {c}" for c in NUMERIC_FEATURES)
         + " from mf) on " + ", ".join(NUMERIC_FEATURES) + " into name feature value v")
_MR = ("mr", """select feature, oos_flag, v, rank() over (partition by feature order by v)
  + (count(*) over (partition by feature, v) - 1) / 2.0 as mr from lf""")


@query("auc_midrank", msql(f"""
select feature, cast(n_pos as bigint) as n_pos, cast(n_neg as bigint) as n_neg,
  {r6('case when n_pos > 0 and n_neg > 0 then (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) end')} as auc
from (select feature, sum(case when oos_flag = 'OOS' then 1 else 0 end) as n_pos,
        sum(case when oos_flag = 'OOS' then 0 else 1 end) as n_neg,
        sum(case when oos_flag = 'OOS' then mr else 0 end) as rs from mr group by feature)""", [_LONG, _MR]))
def q_auc_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Univariate Mann-Whitney AUC of every numeric model feature for the OOS target."""
    long = A.unpivot_long(mframe(spark, sf_dir), ["dot_number", "oos_flag"], NUMERIC_FEATURES, "feature", "v")
    return metrics.auc_frame(long, "oos_flag", "v", "OOS", by=["feature"])


_ROC = [("rd", f"""select cast({ROC_SCORE} as double) as s, sum(case when oos_flag = 'OOS' then 1 else 0 end) as p,
  sum(case when oos_flag = 'OOS' then 0 else 1 end) as q from mf group by 1"""),
        ("rc", """select s, sum(p) over (order by s desc rows between unbounded preceding and current row) as tp,
  sum(q) over (order by s desc rows between unbounded preceding and current row) as fp from rd"""),
        ("rt", "select sum(p) as np, sum(q) as nn from rd"),
        ("roc", "select s as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, "
                "cast(tp as double) / np as tpr, cast(fp as double) / nn as fpr from rc, rt")]


@query("roc_points", msql(f"select threshold, tp, fp, {r6('tpr')} as tpr, {r6('fpr')} as fpr from roc", _ROC))
def q_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC points of the vehicle-maintenance violation rate as a score."""
    return metrics.roc_points(mframe(spark, sf_dir), "oos_flag", ROC_SCORE)


_YOUDEN = ("yj", "select threshold, tpr, fpr from roc order by tpr - fpr desc, threshold asc limit 1")


@query("youden_threshold", msql(f"""
select {r6('threshold')} as threshold, {r6('tpr')} as sensitivity, {r6('1 - fpr')} as specificity,
  {r6('tpr - fpr')} as youden_j from yj""", _ROC + [_YOUDEN]))
def q_youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Youden-optimal threshold of that score (first maximum = lowest threshold)."""
    return metrics.youden(metrics.roc_points(mframe(spark, sf_dir), "oos_flag", ROC_SCORE))


@query("confusion_kappa", msql(f"""
select tp, fp, tn, fn, {r6('tp / (tp + fn)')} as sensitivity, {r6('tn / (tn + fp)')} as specificity,
  {r6('(tp / (tp + fn) + tn / (tn + fp)) / 2')} as balanced_accuracy,
  {r6('((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n))')} as kappa
from (select count(case when oos_flag = 'OOS' and s >= t then 1 end) as tp,
        count(case when oos_flag <> 'OOS' and s >= t then 1 end) as fp,
        count(case when oos_flag <> 'OOS' and s < t then 1 end) as tn,
        count(case when oos_flag = 'OOS' and s < t then 1 end) as fn,
        cast(count(*) as double) as n
      from (select oos_flag, cast({ROC_SCORE} as double) as s, (select threshold from yj) as t from mf))""",
    _ROC + [_YOUDEN]))
def q_confusion_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix, sensitivity, specificity, balanced accuracy, kappa at the Youden threshold."""
    mf = mframe(spark, sf_dir)
    thr = metrics.youden(metrics.roc_points(mf, "oos_flag", ROC_SCORE)).first()["threshold"]
    return metrics.confusion(mf, "oos_flag", ROC_SCORE, thr)


@query("kruskal_wallis", with_master(f"""
select 'oos_rate' as variable, {r6('h')} as H, cast(k - 1 as integer) as df, {r6('exp(-h / 2)')} as p_value, n from (
  select (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tt / (cast(n as double) * n * n - n)) as h, k, n from (
    select (select count(*) from kw) as n, (select sum(c * c * c - c) from (select cast(count(*) as double) as c
            from kw group by v)) as tt, sum(rj * rj / nj) as s, count(*) as k
    from (select g, count(*) as nj, sum(mr) as rj from (
            select g, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as mr from kw) group by g)))""",
    [("kw", "select carrier_operation as g, cast(oos_rate as double) as v from rv "
            "where has_inspection and oos_rate is not null and carrier_operation is not null")]))
def q_kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 on a fixed grouping: OOS rate across operation types (3 groups, so p = exp(-H/2))."""
    from carrisk.operators.features import report_view
    df = report_view(M.master_for(spark, sf_dir)).where(F.col("has_inspection"))
    return metrics.kruskal_wallis(df, "oos_rate", "carrier_operation")


# ---------------------------------------------------------------- R: forests (rows-only checks)
@query("rf_fit_score")
def q_rf_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 + M10: the tuned Model B forest's P(OOS) for every test carrier."""
    return evaluations(spark, sf_dir)[1].test_scores


@query("rf_grid_cv")
def q_rf_grid_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: CV grid (mean and sd AUC over 5 folds) for both feature sets."""
    evs = evaluations(spark, sf_dir)
    out = None
    for e in evs:
        part = e.cv.withColumn("model", F.lit(e.name))
        out = part if out is None else out.unionByName(part)
    return out


@query("ablation")
def q_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same pipeline over feature sets A and B; metric deltas B - A."""
    long = model.comparison_long(evaluations(spark, sf_dir))
    names = [e.name for e in evaluations(spark, sf_dir)]
    wide = A.pivot_table(long, "metric", "model", "value", names)
    return wide.withColumn("delta", F.col(f"`{names[1]}`") - F.col(f"`{names[0]}`"))


@query("model_comparison")
def q_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric x model table, values formatted like the report (%.4f)."""
    long = model.comparison_long(evaluations(spark, sf_dir))
    names = [e.name for e in evaluations(spark, sf_dir)]
    txt = long.withColumn("value", F.when(F.col("metric").isin("Features", "mtry", "min.node.size"),
                                          F.format_string("%.0f", "value")).otherwise(S.fixed_text("value", 4)))
    return A.pivot_table(txt, "metric", "model", "value", names)


@query("perm_importance")
def q_perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-bag permutation importance of both models, sorted and labelled, stacked by model."""
    prep = prepared(spark, sf_dir)
    parts = {ev.name: model.permutation_importance(ev.model, prep.train) for ev in evaluations(spark, sf_dir)}
    return A.stack_labelled(parts, label="model")


@query("prob_density")
def q_prob_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of predicted P(OOS) by class for each model (512-point grid)."""
    evs = evaluations(spark, sf_dir)
    stacked = A.stack_labelled({e.name: e.test_scores for e in evs}, label="model")
    return dist.kde(stacked, "prob", ["model", "oos_flag"], keep_between=(0.0, 1.0))


@query("oob_curve")
def q_oob_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OOB misclassification error vs number of trees (10..500) for Model B's tuned settings."""
    ev = evaluations(spark, sf_dir)[1]
    return bagging.oob_curve(ev.oob_counters, [s for s in model.TREE_STEPS if s <= len(ev.model.trees)])


@query("roc_both_models")
def q_roc_both_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 on the fitted models: the test ROC curves of both, stacked by model."""
    return A.stack_labelled({e.name: e.roc for e in evaluations(spark, sf_dir)}, label="model")
