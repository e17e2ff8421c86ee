"""Supervised model: features (M7), train-only encoders (P16, M5), random
forests with grid search (M8-M10), evaluation and ablation (M17), permutation
importance (M15) and the OOB error curve (M16).

Spark ML does the fitting; every evaluation metric is an exact rank-based
aggregate from ``metrics``.  The final forests are bagged by ``bagging``, so
that out-of-bag error, importance and curve are those of the model that is
reported; the many small forests of the grid search are Spark ML's own.
Differences from the analysed pipeline's forest library, stated once:

* case weights: the final forests draw their bags by them; the grid's forests
  weight impurity and leaf counts (``weightCol``);
* node size: ``minInstancesPerNode`` bounds each child, not the parent;
* depth: capped (``max_depth``, Spark's limit is 30); splits on ``maxBins``
  quantised thresholds;
* bags are Poisson draws (a row's counts are independent of other rows'), not
  draws of exactly n rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.ml.classification import RandomForestClassifier, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrisk.functions import scalar as S
from carrisk.operators import bagging, clean, metrics, rank, sampling
from carrisk.operators.bagging import assembler, detached, sized
from carrisk.session import checkpoint

# Feature sets of the two models and the report labels of features.
FEATURES_A = ("fleet_size_log", "log_driver_total", "hm_flag", "is_interstate", "is_intra_hazmat",
              "is_intra_nonhaz", "log_total_crashes", "log_severity_weight")
FEATURES_B = FEATURES_A + ("drivers_per_unit", "state_risk_tier", "rate_unsafe", "rate_fatigued",
                           "rate_dr_fitness", "rate_subt_alc", "rate_vh_maint", "rate_hm")
FEATURE_LABELS = {
    "fleet_size_log": "Fleet Size (log)",
    "log_driver_total": "Driver Total (log)",
    "drivers_per_unit": "Drivers per Power Unit",
    "hm_flag": "Hazmat Flag",
    "is_interstate": "Interstate Op.",
    "is_intra_hazmat": "Intrastate Hazmat Op.",
    "is_intra_nonhaz": "Intrastate Non-Haz Op.",
    "state_risk_tier": "State Risk Tier",
    "rate_unsafe": "Unsafe Driving Rate",
    "rate_fatigued": "Fatigued Driving Rate",
    "rate_dr_fitness": "Driver Fitness Rate",
    "rate_subt_alc": "Substance/Alcohol Rate",
    "rate_vh_maint": "Vehicle Maintenance Rate",
    "rate_hm": "Hazmat Compliance Rate",
    "log_total_crashes": "Total Crashes (log)",
    "log_severity_weight": "Crash Severity Weight (log)",
}
RATE_SOURCES = {
    "rate_unsafe": "viol_unsafe",
    "rate_fatigued": "viol_fatigued",
    "rate_dr_fitness": "viol_dr_fitness",
    "rate_subt_alc": "viol_subt_alcohol",
    "rate_vh_maint": "viol_vh_maint",
    "rate_hm": "viol_hm",
}
TIER_LEVELS = ("LOW", "MED", "HIGH")
POSITIVE = "OOS"
NODE_SIZES = (20, 100, 300)
TREE_STEPS = (10, 25, 50, 100, 150, 200, 300, 400, 500)


# ---------------------------------------------------------------- features
def model_features(master: DataFrame) -> DataFrame:
    """M7: inspected carriers with the feature superset (before the complete-row filter)."""
    return clean.inspected_universe(master).withColumns({
        "fleet_size_log": S.log1p_floor("nbr_power_unit"),
        "log_driver_total": S.log1p_floor("driver_total"),
        "drivers_per_unit": S.guarded_ratio("driver_total", "nbr_power_unit"),
        "log_total_crashes": S.log1p_floor("total_crashes"),
        "log_severity_weight": S.log1p_floor("sum_severity_weight"),
        **{out: S.safe_div(src, "total_inspections") for out, src in RATE_SOURCES.items()},
    })


MODEL_REQUIRED = ("oos_flag", "fleet_size_log", "log_driver_total", "log_total_crashes", "log_severity_weight",
                  "drivers_per_unit", "hm_flag", "is_interstate", "is_intra_hazmat", "is_intra_nonhaz",
                  *RATE_SOURCES, "phy_state")


def complete_rows(features: DataFrame) -> DataFrame:
    """N9 for the model: known state and no NULL/NaN in any modelling column."""
    df = features.where(F.col("phy_state").isNotNull() & (F.col("phy_state") != ""))
    return clean.drop_na_rows(df.select("dot_number", *MODEL_REQUIRED), MODEL_REQUIRED)


def model_frame(master: DataFrame) -> DataFrame:
    """M7: the modelling frame (``drivers_per_unit`` uncapped; see ``Winsorizer``)."""
    return complete_rows(model_features(master))


@dataclass
class Winsorizer:
    """Cap a column at its q-quantile, fitted on the rows given to ``fit``."""
    column: str = "drivers_per_unit"
    q: float = 0.99
    cap: float | None = None

    def fit(self, df: DataFrame) -> "Winsorizer":
        row = rank.quantiles(df, {"cap": self.column}, [self.q]).first()
        self.cap = row["q"][0] if row else None
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.cap is None:
            return df
        return df.withColumn(self.column, F.least(F.col(self.column), F.lit(float(self.cap))))


@dataclass
class StateTierEncoder:
    """M5: train-only target encoding of the state into LOW / MED / HIGH.

    fit: per state (n >= ``min_n``) the OOS share; tertile cuts (type-7
    quantiles 0, 1/3, 2/3, 1) of those shares; ``[q0, q1]`` LOW, ``(q1, q2]``
    MED, ``(q2, q3]`` HIGH.  transform: lookup, unseen -> MED.  When cut
    points coincide every state falls back to MED (``degenerate``).
    The fitted table (a row per state) stays a frame and is joined; only its
    four cut points come to the driver.
    """
    state: str = "phy_state"
    label: str = "oos_flag"
    min_n: int = 30
    default: str = "MED"
    rates: DataFrame | None = None
    cuts: list[float] | None = None
    degenerate: bool = False

    def fit(self, train: DataFrame) -> "StateTierEncoder":
        rates = (train.groupBy(self.state).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col(self.label) == POSITIVE).cast("double")).alias("state_oos_rate"))
            .where(F.col("n") >= self.min_n))
        self.rates = checkpoint(rates)
        found = rank.quantiles(self.rates, {"rate": "state_oos_rate"}, [0.0, 1 / 3, 2 / 3, 1.0]).first()
        self.cuts = list(found["q"]) if found and found["n"] else None
        self.degenerate = self.cuts is None or len(set(self.cuts)) < 4
        return self

    def table(self) -> DataFrame:
        """The fitted (state, n, state_oos_rate, state_risk_tier) table; all MED where the cuts coincide."""
        assert self.rates is not None
        rate = F.col("state_oos_rate")
        tier = F.lit(self.default) if self.degenerate else (
            F.when((rate >= self.cuts[0]) & (rate <= self.cuts[1]), "LOW").when(rate <= self.cuts[2], "MED").otherwise("HIGH"))
        return self.rates.withColumn("state_risk_tier", tier)

    def transform(self, df: DataFrame, out: str = "state_risk_tier_label") -> DataFrame:
        tiers = self.table().select(F.col(self.state).alias("_state"), F.col("state_risk_tier").alias("_tier"))
        joined = df.join(tiers, F.col(self.state) == F.col("_state"), "left")
        return joined.withColumn(out, F.coalesce("_tier", F.lit(self.default))).drop("_state", "_tier")


# ---------------------------------------------------------------- prepared data
@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    weights: dict[str, float]
    tier: StateTierEncoder
    winsor: Winsorizer


def prepare(master: DataFrame, seed: int = 42, cap_fit_on: str = "train", train_frac: float = 0.7) -> Prepared:
    """Features -> stratified split -> cap and tier fitted on train -> weights.

    ``cap_fit_on="all"`` fits the p99 cap on every inspected carrier before
    the split, as the analysed pipeline does (test rows then move the cap).
    The split's rank step checkpoints, so every fit reads the same rows.
    """
    feats = model_features(master)
    mf = complete_rows(feats)
    split = sampling.strat_split(mf, "oos_flag", "dot_number", train_frac, seed)
    train = split.where(F.col("split") == "train")
    winsor = Winsorizer().fit(train if cap_fit_on == "train" else feats)
    split = winsor.transform(split)
    train = split.where(F.col("split") == "train")
    tier = StateTierEncoder().fit(train)
    split = tier.transform(split).withColumns({
        "state_risk_tier": S.level_index("state_risk_tier_label", TIER_LEVELS).cast("double"),
        "label": (F.col("oos_flag") == POSITIVE).cast("double"),
    })
    weights = sampling.class_weights(split.where(F.col("split") == "train"), "oos_flag")
    split = split.withColumn("weight", sampling.weight_column("oos_flag", weights))
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    return Prepared(train, test, weights, tier, winsor)


# ---------------------------------------------------------------- forests
MAX_DEPTH = 30  # the most Spark's trees can hold; node sizes stop them earlier


def mtry_grid(p: int) -> list[int]:
    vals = [math.floor(math.sqrt(p)), math.floor(math.sqrt(p)) + 2, max(2, math.floor(p / 3))]
    out = []
    for v in vals:
        if v not in out:
            out.append(v)
    return out


def forest(mtry: int, node_size: int, trees: int, seed: int = 42, max_depth: int = MAX_DEPTH,
           max_bins: int = 64) -> RandomForestClassifier:
    return bagging.Forest(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees,
        featureSubsetStrategy=str(mtry), minInstancesPerNode=node_size, maxDepth=max_depth,
        maxBins=max_bins, seed=seed, bootstrap=True, subsamplingRate=1.0, maxMemoryInMB=1024,
        cacheNodeIds=True)


def score(model: RandomForestClassificationModel, df: DataFrame, features, out: str = "prob") -> DataFrame:
    """Probability of the positive class."""
    scored = model.transform(assembler(features).transform(df))
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def fit_forest(train: DataFrame, features, mtry: int, node_size: int, trees: int, seed: int = 42,
               max_depth: int = MAX_DEPTH) -> RandomForestClassificationModel:
    """M8: probability forest with case weights."""
    return detached(forest(mtry, node_size, trees, seed, max_depth).fit(assembler(features).transform(train)))


def grid_cv(train: DataFrame, features, trees: int = 300, folds: int = 5, frac: float = 0.1,
            seed: int = 42, max_depth: int = MAX_DEPTH) -> DataFrame:
    """M9: grid {mtry} x {20, 100, 300} scored by 5-fold CV on a stratified 10% of train.

    The trees of all forests of the grid are grown side by side (``bagging.fold_scores``).
    Returns (mtry, min_node_size, mean_auc, sd_auc) with the sample standard deviation over folds.
    """
    tune = sampling.strat_fraction(train, "oos_flag", "dot_number", frac, f"{seed}|tune")
    tune = sampling.strat_folds(tune, "oos_flag", "dot_number", folds, f"{seed}|fold")
    grid = list(product(mtry_grid(len(features)), NODE_SIZES))
    scores = bagging.fold_scores(tune, features, grid, folds, trees, seed=seed, max_depth=max_depth)
    # every fold AUC from one pass over the stacked validation scores
    fold_auc = metrics.auc_frame(scores.withColumn("oos_flag", F.when(F.col("positive"), F.lit(POSITIVE)).otherwise(F.lit(""))),
                                 "oos_flag", "prob", POSITIVE, by=["mtry", "min_node_size", "fold"])
    results = [(r["mtry"], r["min_node_size"], r["fold"], r["auc"]) for r in fold_auc.collect()]
    rows = []
    for mtry, ns in grid:
        aucs = [a for (m, n, _k, a) in results if m == mtry and n == ns and a is not None]
        mean = sum(aucs) / len(aucs) if aucs else None
        sd = (math.sqrt(sum((a - mean) ** 2 for a in aucs) / (len(aucs) - 1)) if len(aucs) > 1 else None)
        rows.append((mtry, ns, mean, sd))
    return train.sparkSession.createDataFrame(rows, "mtry int, min_node_size int, mean_auc double, sd_auc double")


def best_params(cv: DataFrame) -> tuple[int, int, float]:
    """Argmax of mean AUC; ties -> smaller mtry, then larger node size."""
    rows = [r for r in cv.collect() if r["mean_auc"] is not None]
    best = max(rows, key=lambda r: (r["mean_auc"], -r["mtry"], r["min_node_size"]))
    return best["mtry"], best["min_node_size"], best["mean_auc"]


@dataclass
class Evaluation:
    name: str
    features: tuple
    cv: DataFrame
    mtry: int
    node_size: int
    auc_cv: float
    auc_train: float | None
    auc_test: float | None
    threshold: float | None
    confusion: dict
    model: bagging.BaggedForest
    test_scores: DataFrame
    roc: DataFrame
    oob_counters: DataFrame
    oob_brier: float | None
    oob_error: float | None


def evaluate_feature_set(prep: Prepared, name: str, features, trees_final: int = 500, trees_cv: int = 300,
                         seed: int = 42, max_depth: int = MAX_DEPTH, case_weights: str = "bootstrap") -> Evaluation:
    """Tune, fit, score and evaluate one feature set on the shared split."""
    cv = grid_cv(prep.train, features, trees_cv, seed=seed, max_depth=max_depth)
    mtry, ns, auc_cv = best_params(cv)
    model = bagging.fit(prep.train, features, mtry, ns, trees_final, case_weights=case_weights, seed=seed, max_depth=max_depth)
    counters = bagging.oob_counters(model, prep.train, TREE_STEPS)
    oob = bagging.oob_error(counters).first()
    # written once: AUC, ROC, confusion and the score reports all read it
    dealt = lambda rows: sized(rows.select("dot_number", "oos_flag", *features), 2000)  # noqa: E731 - so that scoring has tasks enough
    test_scores = checkpoint(model.score(dealt(prep.test)).select("dot_number", "oos_flag", "prob"))
    auc_train = metrics.auc(checkpoint(model.score(dealt(prep.train)).select("oos_flag", "prob")), "oos_flag", "prob", POSITIVE)
    auc_test = metrics.auc(test_scores, "oos_flag", "prob", POSITIVE)
    roc = checkpoint(metrics.roc_points(test_scores, "oos_flag", "prob", POSITIVE))
    yj = metrics.youden(roc).first()
    thr = yj["threshold"] if yj else None
    cm = metrics.confusion(test_scores, "oos_flag", "prob", thr).first().asDict() if thr is not None else {}
    return Evaluation(name, tuple(features), cv, mtry, ns, auc_cv, auc_train, auc_test, thr, cm, model,
                      test_scores, roc, counters, oob["brier"], oob["error"])


def comparison_long(evals: list[Evaluation]) -> DataFrame:
    """U3 input: (metric, model, value) rows; ``pivot_table`` turns it into the side-by-side table."""
    rows = []
    for e in evals:
        vals = {
            "Features": float(len(e.features)), "mtry": float(e.mtry), "min.node.size": float(e.node_size),
            "OOB Error": e.oob_brier, "OOB Misclassification": e.oob_error, "Train AUC": e.auc_train, "CV AUC": e.auc_cv, "Test AUC": e.auc_test,
            "Train-Test Gap": (e.auc_train - e.auc_test) if e.auc_train is not None and e.auc_test is not None
            else None,
            "Sensitivity": e.confusion.get("sensitivity"), "Specificity": e.confusion.get("specificity"),
            "Balanced Accuracy": e.confusion.get("balanced_accuracy"), "Kappa": e.confusion.get("kappa"),
            "Threshold": e.threshold,
        }
        rows += [(k, e.name, None if v is None else float(v)) for k, v in vals.items()]
    spark = evals[0].cv.sparkSession
    return spark.createDataFrame(rows, "metric string, model string, value double")


# ---------------------------------------------------------------- importance
def permute_columns(df: DataFrame, key: str, columns, seed: int = 42, n_rows: int | None = None, bucket_rows: int = 1000) -> DataFrame:
    """``df`` + ``perm_<c>`` for each column: its values moved to other rows, without a global sort.

    Rows fall into ``n / bucket_rows`` buckets by a hash of (key, seed), each
    gathered in a second hash order; a column takes the value that stands its
    own number of places further on, wrapping round.  Buckets and order are
    random in the label, which breaks the link between feature and label;
    buckets hold about ``bucket_rows`` rows, and one shuffle serves all columns.
    The number is 1 to size - 1: no value stays, but for a bucket of one row.
    """
    n = df.count() if n_rows is None else n_rows
    buckets = max(1, n // bucket_rows)
    hashed = lambda what: F.xxhash64(F.col(key).cast("string"), F.lit(f"{seed}|{what}"))
    row = F.struct(hashed("order").alias("_o"), *df.columns)
    gathered = df.groupBy(F.pmod(hashed("bucket"), F.lit(buckets)).alias("_b")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    rows, size = F.col("_rows"), F.size("_rows")

    def with_moved(x, i):
        moved = [F.element_at(rows, F.pmod(i + 1 + F.pmod(F.lit(37 * k + 10), F.greatest(size - 1, F.lit(1))), size) + 1)[c].alias(f"perm_{c}") for k, c in enumerate(columns)]
        return F.struct(*[x[c].alias(c) for c in df.columns], *moved)

    return gathered.select(F.inline(F.transform(rows, with_moved)))


def permutation_importance(forest: bagging.BaggedForest, train: DataFrame, bucket_rows: int = 1000) -> DataFrame:
    """Out-of-bag permutation importance with the trees' impurity importance as a second column; sorted, labelled."""
    impurity = dict(zip(forest.features, forest.featureImportances()))
    rows = [(r["feature"], FEATURE_LABELS.get(r["feature"], r["feature"]), r["importance"], impurity[r["feature"]])
            for r in bagging.oob_importance(forest, train, bucket_rows).collect()]
    out = train.sparkSession.createDataFrame(rows, "feature string, label string, importance double, impurity_importance double")
    return out.orderBy(F.desc_nulls_last("importance"))


def auc_importance(model: RandomForestClassificationModel, df: DataFrame, features, key: str = "dot_number",
                   seed: int = 42) -> DataFrame:
    """M15 on any scored rows: AUC drop on the rows of ``df`` when each feature is permuted, with Spark's
    impurity importance as a second column; sorted, labelled.

    All permuted columns come from one shuffle; the frame with them is
    written once, each copy of it (plain, and per feature) is scored from
    there, and all AUCs come from one pass over score counts by copy.
    """
    held = checkpoint(permute_columns(df.select(key, "oos_flag", *features), key, features, seed))
    copies = []
    for f in (None, *features):
        swapped = held.select("oos_flag", *[F.col(f"perm_{c}" if c == f else c).alias(c) for c in features])
        copies.append(score(model, swapped, features).select(F.lit(f or "__base__").alias("feature"), "oos_flag", "prob"))
    stacked = copies[0]
    for c in copies[1:]:
        stacked = stacked.unionByName(c)
    aucs = {r["feature"]: r["auc"] for r in metrics.auc_frame(stacked, "oos_flag", "prob", POSITIVE, by=["feature"]).collect()}
    base_auc = aucs.get("__base__")
    imp = model.featureImportances.toArray().tolist()
    rows = []
    for i, f in enumerate(features):
        a = aucs.get(f)
        drop = (base_auc - a) if base_auc is not None and a is not None else None
        rows.append((f, FEATURE_LABELS.get(f, f), drop, float(imp[i])))
    out = df.sparkSession.createDataFrame(
        rows, "feature string, label string, importance double, impurity_importance double")
    return out.orderBy(F.desc_nulls_last("importance"))
