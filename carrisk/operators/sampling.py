"""Exact, seeded, stratified sampling (M1-M4) and class weights (M6).

Rows are ordered inside each class by ``md5(key|seed)`` (ties by key); the
exact per-class row number comes from ``rank.row_number`` (no single-task
window), so ``floor(frac * n_class)`` rows are taken per class and the
result does not depend on partitioning.  DuckDB computes the same md5, so
every split here has an SQL oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrisk.operators import rank


def hash_order(key: str, seed: int | str = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def _class_rank(df: DataFrame, label: str, key: str, seed) -> DataFrame:
    """``df`` with ``_rn``, the place in the class's hash order, and ``_n``, the size of the class."""
    return rank.row_number(df, [hash_order(key, seed).asc(), F.col(key).asc()], [label], out="_rn", size="_n").df


def strat_split(df: DataFrame, label: str, key: str, frac: float = 0.7, seed: int | str = 42,
                out: str = "split") -> DataFrame:
    """M1: ``train`` for the first floor(frac * n) rows of each class in hash order, else ``test``."""
    first = F.col("_rn") <= F.floor(F.lit(float(frac)) * F.col("_n"))
    return (_class_rank(df, label, key, seed).withColumn(out, F.when(first, F.lit("train")).otherwise(F.lit("test")))
            .drop("_rn", "_n"))


def strat_fraction(df: DataFrame, label: str, key: str, frac: float = 0.1, seed: int | str = "42|tune") -> DataFrame:
    """M2: floor(frac * n) rows per class (the CV tuning subset)."""
    return _class_rank(df, label, key, seed).where(F.col("_rn") <= F.floor(F.lit(float(frac)) * F.col("_n"))).drop("_rn", "_n")


def strat_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int | str = "42|fold",
                out: str = "fold") -> DataFrame:
    """M4: stratified fold id in 0..k-1 (round-robin over the hash order within class)."""
    return _class_rank(df, label, key, seed).withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn", "_n")


def capped_sample(df: DataFrame, label: str, key: str, cap: int, seed: int | str = "42|cap") -> DataFrame:
    """M3: at most ``cap`` rows per class, the first in hash order."""
    return _class_rank(df, label, key, seed).where(F.col("_rn") <= F.lit(cap)).drop("_rn", "_n")


def class_weights(df: DataFrame, label: str, classes: Sequence[str] = ("Clean", "OOS")) -> dict[str, float]:
    """M6: balanced weights n / (2 n_c) from one grouped count (report-size result)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    k = len(classes)
    return {c: (n / (k * counts[c]) if counts.get(c) else 0.0) for c in classes}


def weight_column(label: str, weights: dict[str, float]) -> Column:
    pairs = []
    for c, w in weights.items():
        pairs += [F.lit(c), F.lit(float(w))]
    return F.element_at(F.create_map(*pairs), F.col(label))
