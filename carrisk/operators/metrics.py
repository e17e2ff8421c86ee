"""Rank-based evaluation metrics (M11-M14) and the Kruskal-Wallis test (K8).

All are DataFrame aggregates over exact distributed ranks (``rank``): only
report-size results (a handful of scalars, or one row per distinct score)
come back.  No Python runs per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrisk.operators import rank
from carrisk.session import checkpoint


def auc_frame(df: DataFrame, label: str, score: str, positive: str = "OOS", by: Sequence[str] = ()) -> DataFrame:
    """M11 as a frame: Mann-Whitney AUC with mid-ranks per group; NULL when a class is empty.

    Columns: by..., n_pos, n_neg, auc.  Rows with a NULL score are dropped.
    """
    per_value = rank.value_mid_ranks(df, score, by, extra_aggs=[F.count_if(F.col(label) == F.lit(positive)).alias("pos")])
    agg = per_value.groupBy(*by).agg(
        F.sum("pos").cast("double").alias("n_pos"),
        (F.sum("cnt") - F.sum("pos")).cast("double").alias("n_neg"),
        F.sum(F.col("pos") * F.col("mid_rank")).alias("rank_sum"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 (F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg")))
    return agg.select(*by, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                      auc.alias("auc"))


def auc(df: DataFrame, label: str, score: str, positive: str = "OOS") -> float | None:
    """Scalar AUC."""
    row = auc_frame(df, label, score, positive).first()
    return None if row is None else row["auc"]


def roc_points(df: DataFrame, label: str, score: str, positive: str = "OOS") -> DataFrame:
    """One ROC point per distinct score t (predict positive when score >= t).

    Scores become counts per distinct score in a hash aggregate; running
    sums over these, in descending order, are the cumulative counts.
    Columns: threshold, tp, fp, tpr, fpr (NULL where a class is empty).
    """
    counts = (df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold"))
              .agg(F.count_if(F.col(label) == F.lit(positive)).alias("pos"), F.count(F.lit(1)).alias("cnt"))
              .withColumn("neg", F.col("cnt") - F.col("pos")).drop("cnt"))
    runs = rank.cumulate(counts, [F.col("threshold").desc()], [], {"pos": "_pos", "neg": "_neg"}, {"pos": "n_pos", "neg": "n_neg"})
    out = runs.select("threshold", (F.col("_pos") + F.col("pos")).alias("tp"), (F.col("_neg") + F.col("neg")).alias("fp"), "n_pos", "n_neg")
    return out.withColumns({
        "tpr": F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")),
        "fpr": F.when(F.col("n_neg") > 0, F.col("fp") / F.col("n_neg")),
    }).drop("n_pos", "n_neg")


def youden(roc: DataFrame) -> DataFrame:
    """The ROC point maximising J = tpr - fpr (= sens + spec - 1); ties -> lowest threshold."""
    j = F.col("tpr") - F.col("fpr")
    best = roc.agg(F.max_by(F.struct("threshold", "tpr", "fpr"),
                            F.struct(j, -F.col("threshold"))).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), F.col("b.tpr").alias("sensitivity"),
                       (1 - F.col("b.fpr")).alias("specificity"),
                       (F.col("b.tpr") - F.col("b.fpr")).alias("youden_j"))


def confusion(df: DataFrame, label: str, score: str, threshold: float, positive: str = "OOS") -> DataFrame:
    """Confusion counts at ``score >= threshold`` plus sensitivity, specificity,
    balanced accuracy and Cohen's kappa (one aggregate pass)."""
    y = F.col(label) == F.lit(positive)
    p = F.col(score) >= F.lit(float(threshold))
    c = df.where(F.col(score).isNotNull()).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    po = (F.col("tp") + F.col("tn")) / n
    pe = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn"))
          + (F.col("tn") + F.col("fn")) * (F.col("tn") + F.col("fp"))) / (n * n)
    sens = F.col("tp") / (F.col("tp") + F.col("fn"))
    spec = F.col("tn") / (F.col("tn") + F.col("fp"))
    return c.select("tp", "fp", "tn", "fn", sens.alias("sensitivity"), spec.alias("specificity"),
                    ((sens + spec) / 2).alias("balanced_accuracy"),
                    F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def _chi2_sf(x: float, df: int) -> float:
    """Upper-tail chi-square probability via the regularised incomplete gamma (series / continued fraction)."""
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    gln = math.lgamma(a)
    if z < a + 1:
        term = s = 1.0 / a
        ap = a
        for _ in range(10000):
            ap += 1
            term *= z / ap
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-z + a * math.log(z) - gln))
    b = z + 1 - a
    c = 1.0 / 1e-300
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return min(1.0, math.exp(-z + a * math.log(z) - gln) * h)


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """K8: tie-corrected Kruskal-Wallis H across ``group`` on ``value`` (NULLs dropped).

    Rows become counts per (value, group) at once; mid-ranks, rank sums per
    group and the tie term sum(t^3 - t) come from distinct values.  H and df are
    computed in the plan; the p-value (chi-square upper tail) is a scalar
    computed on the driver.  Descriptive only when the groups were formed
    from the same variables (as with clusters).
    """
    counts = (df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
              .groupBy(value, group).agg(F.count(F.lit(1)).alias("c")))
    counts = checkpoint(counts)
    per_value = rank.cumulate(counts.groupBy(value).agg(F.sum("c").alias("cnt")), [F.col(value).asc()], [], {"cnt": "_before"})
    pv = checkpoint(per_value.select(F.col(value).alias("_v"), "cnt", (F.col("_before") + (F.col("cnt") + 1) / F.lit(2.0)).alias("mid_rank")))
    per_group = (counts.join(pv, F.col(value) == F.col("_v")).groupBy(group)
                 .agg(F.sum("c").alias("n_j"), F.sum(F.col("c") * F.col("mid_rank")).alias("r_j")))
    sums = pv.agg(F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("t"), F.sum("cnt").alias("n")).first()
    n_total, ties = float(sums["n"] or 0), sums["t"] or 0.0
    stats = per_group.agg(F.sum(F.col("r_j") * F.col("r_j") / F.col("n_j")).alias("s"),
                          F.count(F.lit(1)).alias("k")).first()
    k = int(stats["k"] or 0)
    if n_total < 2 or k < 2:
        h = None
    else:
        h = 12.0 / (n_total * (n_total + 1)) * stats["s"] - 3 * (n_total + 1)
        denom = 1 - ties / (n_total ** 3 - n_total)
        h = h / denom if denom > 0 else None
    p = _chi2_sf(h, k - 1) if h is not None else None
    return df.sparkSession.createDataFrame(
        [(value, h, k - 1, p, int(n_total))], "variable string, H double, df int, p_value double, n long")
